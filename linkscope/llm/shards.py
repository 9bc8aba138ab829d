"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a 64-bit key: the upper bits hash the text, the lower bits the
text and its id. So equal texts stand together, and a group of copies larger than a
shard can still be cut. Each round counts the exact bytes of the keys in every cell
of a fine grid over the intervals that still hold a splitter, over all partitions,
and narrows each interval to the cell in which its target falls, until the bytes
below every splitter are within tolerance. Only then the rows move, once.

A round's counts are at most (splitters x CELLS) rows, whatever the data's size. The one
exchange moves whole rows to runs, parts of a shard that one task sorts and numbers.
Runs are bounded in bytes and cut by the same key, inside a group of copies too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscope.llm.common import cut
from linkscope.llm.runs import ROW, run_edges, run_of

#: Cells of an interval in a round, by their bits; bits of the key that hash the id too.
CELL_BITS, ID_BITS = 11, 24
CELLS = 1 << CELL_BITS
#: A splitter may be off by this share of a shard.
TOLERANCE = 0.0005


def sort_key(text: Column, key: Column) -> Column:
    """Not negative. Rows equal in text and key are equal here as well."""
    upper = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 1 + ID_BITS), ID_BITS)
    return upper + F.shiftrightunsigned(F.xxhash64(key, text), 64 - ID_BITS)


def splitters(sized: DataFrame, targets: list[float], total: int, tolerance: float) -> list[int]:
    """For each target (bytes, ascending) a key such that the bytes of smaller keys
    come within tolerance of it, or as near as rows of equal key allow. sized has
    the columns at (key) and size."""
    found: dict[int, int] = {}
    open_: dict[int, tuple[int, int, int]] = dict.fromkeys(range(len(targets)), (0, 63, 0))  # first key, bits, bytes below
    while open_:
        grids = sorted(set(open_.values()))
        which = {g: i for i, g in enumerate(grids)}
        cell = F.lit(None).cast("long")
        grid = F.lit(None).cast("int")
        for g, i in which.items():
            lo, bits, _ = g
            inside = F.shiftright(F.col("at"), bits) == (lo >> bits) if bits < 63 else F.lit(True)
            step = max(0, bits - CELL_BITS)
            cell = F.when(inside, F.shiftright(F.col("at"), step).bitwiseAND(CELLS - 1 if bits > CELL_BITS else (1 << bits) - 1)).otherwise(cell)
            grid = F.when(inside, F.lit(i)).otherwise(grid)
        counted = sized.select(grid.alias("grid"), cell.alias("cell"), "size").filter("grid is not null").groupBy("grid", "cell").agg(F.sum("size").alias("bytes")).collect()
        by_grid: dict[int, dict[int, int]] = {}
        for r in counted:
            by_grid.setdefault(r["grid"], {})[r["cell"]] = r["bytes"]
        for j, g in list(open_.items()):
            lo, bits, below = g
            step = max(0, bits - CELL_BITS)
            cells = by_grid.get(which[g], {})
            del open_[j]
            at, bytes_ = lo, below
            for c in sorted(cells):
                at, after = lo + (c << step), bytes_ + cells[c]
                if after >= targets[j]:
                    break
                bytes_ = after
                at = lo + ((c + 1) << step)
            else:
                found[j] = at
                continue
            if targets[j] - bytes_ <= tolerance or step == 0:
                # the cell's start or its end, whichever is nearer
                found[j] = at if targets[j] - bytes_ <= after - targets[j] else at + (1 << step)
            elif after - targets[j] <= tolerance:
                found[j] = at + (1 << step)
            else:
                open_[j] = (at, step, bytes_)
    return [found[j] for j in range(len(targets))]


def text_bytes(text: Column) -> Column:
    """A row's size: the bytes of its text in UTF-8 (null: none) plus one."""
    return F.octet_length(F.coalesce(text, F.lit(""))) + F.lit(1).cast("long")


def histogram_shards(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """docs with the columns shard (int) and slot (long): shards of near-equal bytes, a row's
    bytes being those of text_bytes, and slots from 0 without gaps in each shard.

    A null text is empty; a null key is a key like others; rows equal in key and text
    are one point of the order and stay in one shard; with no rows, or fewer than
    shards, some shards stay empty. A row larger than a shard makes its shard larger.
    All columns of docs stay as they came; one already named as a new one is replaced.
    """
    kept = [c for c in docs.columns if c not in (shard, slot)]
    named = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)])
    key_, text_ = F.col(f"_{kept.index(key)}"), F.col(f"_{kept.index(text)}")
    at = sort_key(F.coalesce(text_, F.lit("")), key_)
    sized = cut(named.select(text_bytes(text_).alias("size"), at.alias("at")))
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = [total * i / n_shards for i in range(1, n_shards)]
    cuts = sorted(splitters(sized, targets, total, tolerance * total / n_shards)) if n else []
    zero = F.lit(0).cast("long")
    found = run_edges(sized.select(F.col("at").alias("hi"), zero.alias("lo"), (F.col("size") + ROW).alias("weight"))) if n else []
    edges = sorted({*((c, 0) for c in cuts if c < 1 << 63), *found})

    def run(at: Column) -> Column:
        return run_of(edges, at, zero)

    rows = {r["run"]: r["n"] for r in sized.groupBy(run(F.col("at")).alias("run")).agg(F.count("*").alias("n")).collect()}  # one row a run
    starts, held, last = [], 0, 0
    for i in range(len(edges) + 1):
        of = sum(c <= edges[i - 1][0] for c in cuts) if i else 0
        held = held if of == last else 0
        starts.append((i, of, held))
        held, last = held + rows.get(i, 0), of
    starts = docs.sparkSession.createDataFrame(starts, "_run int, _shard int, _start long")
    # the one exchange, of whole rows
    order = Window.partitionBy("_run").orderBy("_at", key_.asc_nulls_first(), F.xxhash64(text_))
    placed = named.withColumn("_at", at).withColumn("_run", run(F.col("_at"))).withColumn("_nth", F.row_number().over(order) - 1).join(F.broadcast(starts), "_run")
    return placed.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)], F.col("_shard").alias(shard), (F.col("_start") + F.col("_nth")).cast("long").alias(slot))
