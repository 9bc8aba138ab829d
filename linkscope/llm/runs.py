"""Cutting a table, in the order of a key, into runs of bounded weight.

The key is a pair (hi, lo) of longs, each not negative (hi may be -1); rows of one hi go
by lo. A histogram over the upper bits of hi is counted; cells that weigh more than a run
are counted again in finer cells, and if a single hi is too heavy, over lo. So a run is
never heavier than asked for, unless a single key is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a key, and bits by which a heavy cell is refined.
BITS, FINER = 63, 11
#: Bytes that a row counts besides its text.
ROW = 100
#: A run's weight: so much of the whole, within these bounds.
PARTS, LEAST, MOST = 128, 1 << 20, 1 << 27


def run_weight(total: int) -> int:
    return min(MOST, max(LEAST, total // PARTS))


def _heavy_cells(weighed: DataFrame, within: list[tuple[int, ...]], column: str, most: int, bits: int) -> list[tuple[tuple[int, ...], int]]:
    """(cell, weight) of cells of 2 ** bits values of column, refined while they are too
    heavy; a cell is (hi,) or (hi, lo), its first key. within: the hi to look into."""
    leaves: list[tuple[tuple[int, ...], int]] = []
    prefix, wide, open_ = [], BITS, None
    if within:
        weighed = weighed.join(F.broadcast(weighed.sparkSession.createDataFrame(within, "hi long")), "hi")  # a hi heavier than a run each
        prefix = ["hi"]
    while True:
        part = weighed if open_ is None else weighed.join(F.broadcast(open_), [F.shiftright(column, wide) == F.col("_cell"), *[F.col(p) == F.col(f"_{p}") for p in prefix]], "left_semi")
        cells = part.groupBy(*prefix, F.shiftright(column, bits).alias("cell")).agg(F.sum("weight").alias("weight")).collect()
        again = []
        for c in cells:
            at = (*[c[p] for p in prefix], c["cell"])
            if c["weight"] > most and bits > 0 and c["cell"] >= 0:
                again.append(at)
            else:
                leaves.append(((*at[:-1], at[-1] << bits if at[-1] >= 0 else -1), c["weight"]))
        if not again:
            return leaves
        names = [*[f"_{p}" for p in prefix], "_cell"]
        open_ = weighed.sparkSession.createDataFrame(again, ", ".join(f"{n} long" for n in names))  # cells heavier than a run
        wide, bits = bits, max(0, bits - FINER)


def run_edges(weighed: DataFrame, most: int | None = None) -> list[tuple[int, int]]:
    """Keys at which a new run starts, ascending, for weighed(hi, lo, weight). What comes
    to the driver is a few numbers for each run."""
    total = weighed.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    most = most or run_weight(total)
    bits = max(FINER, math.ceil(math.log2(4 * max(1, total // most))))
    leaves = _heavy_cells(weighed, [], "hi", most, BITS - bits)
    hot = [at for at, w in leaves if w > most]
    cells = [((*at, 0), w) for at, w in leaves if w <= most]
    if hot:
        cells += _heavy_cells(weighed, hot, "lo", most, BITS - FINER)
    edges, held = [], 0
    for at, w in sorted(cells):
        if held and held + w > most:
            edges.append(at)
            held = 0
        held += w
    return edges


def run_of(edges: list[tuple[int, int]], hi: Column, lo: Column) -> Column:
    """Number of edges that are at most (hi, lo): a coarse and a fine look-up."""
    if not edges:
        return F.lit(0)
    step = math.isqrt(len(edges)) + 1

    def longs(xs: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")

    def table(part: list[tuple[int, int]]) -> Column:
        return F.arrays_zip(longs([a for a, _ in part]).alias("hi"), longs([b for _, b in part]).alias("lo"))

    def upto(e: Column) -> Column:
        return (e.hi < hi) | ((e.hi == hi) & (e.lo <= lo))

    coarse = F.size(F.filter(table(edges[::step]), upto))
    fine = F.size(F.filter(F.slice(table(edges), (coarse - 1) * step + 1, step), upto))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)
