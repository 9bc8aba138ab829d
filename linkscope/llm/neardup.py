"""Near-duplicate documents by MinHash banding and odd sketches.

A document is the set of its word shingles, as 64-bit hashes. Documents of equal sets
make one class; all that follows is between classes. SAMPLES MinHash values give
BANDS keys of ROWS values, and an odd sketch: a bitmap in which each sample flips one
bit, so that the bits in which two sketches differ count the samples in which the
documents differ - precisely where similarities are high.

Candidates share a band key. In a bucket each class is first held against the
bucket's smallest id only, never all against all; a candidate goes on if sizes and
sketches allow the similarity, and is confirmed on the full sets. What that leaves
apart is made good: in buckets whose classes are still in several components, the
classes outside the bucket's largest component are held against all classes of other
components. That is done block by block of a bucket, on the full sets, and only links
come out, one for each class and component it reaches. So every pair that shares a
bucket is in one component already or has been compared.

A pair of similarity 0.8 shares no band with probability 5e-8 and is refused by its
sketches with probability 2e-8 (both computed exactly in the tests).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.llm.common import arrow_schema, cut, discard, text_batches

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch, as 64-bit words; sketches must allow this similarity.
SKETCH_WORDS = 8
SKETCH_FLOOR = 0.55
#: Shingles of a block of a bucket's classes, about.
BLOCK_SHINGLES = 500_000
#: Ids up to which a list of documents is broadcast; beyond, it is joined by shuffling.
FEW_IDS = 2_000_000

_SEEDS = np.random.default_rng(20140407).integers(1, 1 << 63, (2, SAMPLES), np.uint64)
_FLIP, _TIMES = _SEEDS[0], _SEEDS[1] * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of width words, A-Z lower-cased; with
    fewer words, of all words as one shingle; empty without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    w = min(width, len(ids))
    n = len(ids) - w + 1
    h = np.full(n, w, np.uint64)
    for j in range(w):
        h = _mixed(h * _ODD + ids[j : j + n])
    return np.unique(h)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES MinHash values of a set."""
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 1024):
        part = (shingles[None, lo : lo + 1024] ^ _FLIP[:, None]) * _TIMES[:, None]
        np.minimum(best, part.min(1), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = _mixed(key * _ODD + best[j::ROWS])
    return key


def odd_sketch(best: np.ndarray) -> np.ndarray:
    """Parities of the samples' bits, as SKETCH_WORDS 64-bit words."""
    bits = _mixed(best + np.arange(1, SAMPLES + 1, dtype=np.uint64) * _ODD) % np.uint64(64 * SKETCH_WORDS)
    return np.packbits(np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1).view(np.int64)


def most_differing_bits(floor: float = SKETCH_FLOOR) -> int:
    """Differing bits expected of sketches whose samples differ as at that similarity."""
    m = 64 * SKETCH_WORDS
    return math.floor(m / 2 * (1 - math.exp(-2 * (2 * SAMPLES * (1 - floor)) / m)))


SIGNATURE = [T.StructField(c, T.LongType()) for c in ("n_shingles", "k1", "k2")] + [T.StructField("bands", T.ArrayType(T.LongType(), False))] + [T.StructField(f"s{i}", T.LongType()) for i in range(SKETCH_WORDS)]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, tie, n_shingles, k1, k2, bands, s0..) from docs(doc_id, text); tie is the
    text's hash, k1 and k2 identify the set."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tie", T.LongType(), False), *SIGNATURE])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(SKETCH_WORDS, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n, k1, k2, bands, sketches = [], [], [], [], []
                for text in part.column(2):
                    s = shingle_set(text.as_py(), width)
                    n.append(len(s))
                    k1.append(s.sum().view(np.int64))
                    k2.append(_mixed(s).sum().view(np.int64))
                    best = min_hashes(s) if len(s) else None
                    bands.append(band_keys(best).view(np.int64) if len(s) else none[:0])
                    sketches.append(odd_sketch(best) if len(s) else none)
                ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
                flat = np.stack(sketches) if sketches else np.empty((0, SKETCH_WORDS), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands) if bands else none[:0])).cast(arrow.field("bands").type)]
                    + [pa.array(flat[:, i]) for i in range(SKETCH_WORDS)],
                    schema=arrow,
                )

    return text_batches(docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")).mapInArrow(run, schema)


def _texts_of(docs: DataFrame, known: DataFrame | None, needed: DataFrame) -> DataFrame:
    """(id, text) of the classes in needed(id). Their ids are those of documents, unless
    known(id, doc_id, tie) says which row stands for each."""
    few = needed.count() <= FEW_IDS
    if known is None:
        side = F.broadcast(needed) if few else needed.hint("merge")
        return docs.join(side, docs.doc_id == needed.id, "left_semi").select(F.col("doc_id").alias("id"), "text")
    rows = cut(known.join(needed.hint("merge"), "id", "left_semi").withColumnsRenamed({"doc_id": "d", "tie": "t"}))
    side = F.broadcast(rows) if few else rows.hint("merge")
    return docs.join(side, (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("t"))).select("id", "text").dropDuplicates(["id"])


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles) from docs(id, text)."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType(), False))])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                sets = [shingle_set(t.as_py(), width).view(np.int64) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets))).cast(arrow.field(1).type)], schema=arrow)

    return text_batches(docs).mapInArrow(run, schema)


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and odd sketches allow the similarity."""
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    differ = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    return (100 * small >= percent * large) & (differ <= most_differing_bits())


def confirmed(texts_of: Callable[[DataFrame], DataFrame], pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose full sets have the similarity. Only the documents in
    pairs are read again, and only their sets move."""
    needed = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = cut(full_sets(texts_of(needed), width))
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return cut(both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct())


def _block_links(percent: int):
    """Links between the classes of two blocks of a bucket: those to place (side 0)
    against all (side 1). A pair is compared in the first bucket that it shares."""
    most = most_differing_bits()

    def links(rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        x, y = rows.filter(pa.array(side == 0)), rows.filter(pa.array(side == 1))
        out: tuple[list, list] = ([], [])
        if x.num_rows and y.num_rows:
            lists = lambda t, c: t[c].combine_chunks()
            bucket = rows["bucket"][0].as_py()
            flat = lambda t, c: lists(t, c).flatten().to_numpy()
            bands_x, bands_y = flat(x, "bands").reshape(-1, BANDS), flat(y, "bands").reshape(-1, BANDS)
            sketch_x, sketch_y = (flat(t, "sketch").reshape(-1, SKETCH_WORDS) for t in (x, y))
            n_x, n_y = np.diff(lists(x, "shingles").offsets.to_numpy()), np.diff(lists(y, "shingles").offsets.to_numpy())
            ends_x, starts_y = np.cumsum([0, *n_x]), np.cumsum([0, *n_y[:-1]])
            every, code = np.unique(np.concatenate([flat(x, "shingles"), flat(y, "shingles")]), return_inverse=True)
            code_x, code_y = code[: ends_x[-1]], code[ends_x[-1] :]
            ids_x, ids_y = x["id"].to_numpy(), y["id"].to_numpy()
            own_x, own_y = x["component"].to_numpy(), y["component"].to_numpy()
            major = rows["major"][0].as_py()
            band = int(np.argmax(bands_x[0] == bucket))
            for i in range(len(ids_x)):
                may = (own_y != own_x[i]) & ((own_y == major) | (ids_y > ids_x[i]))
                may &= (100 * np.minimum(n_y, n_x[i]) >= percent * np.maximum(n_y, n_x[i])) & ((bands_y == bands_x[i]).argmax(1) == band)
                may &= np.bitwise_count((sketch_y ^ sketch_x[i]).view(np.uint64)).sum(1) <= most
                if not may.any():
                    continue
                mine = np.zeros(len(every), np.int32)
                mine[code_x[ends_x[i] : ends_x[i + 1]]] = 1
                common = np.add.reduceat(mine[code_y], starts_y)
                linked = np.flatnonzero(may & (100 * common >= percent * (n_x[i] + n_y - common)))
                for j in linked[np.unique(own_y[linked], return_index=True)[1]]:
                    out[0].append(min(ids_x[i], ids_y[j]))
                    out[1].append(max(ids_x[i], ids_y[j]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return links


def links_left(texts_of: Callable[[DataFrame], DataFrame], members: DataFrame, labels: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components in buckets that still hold several."""
    at = cut(members.join(labels.hint("merge"), "id", "left").select("bucket", "first", "id", F.coalesce("component", "id").alias("component")))
    sizes = at.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    split = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("parts"), F.sum("n").alias("n")).filter("parts > 1 and n > 2")
    apart = at.join(split.select("bucket", "major").hint("merge"), "bucket").filter("id <> first")  # the first has been held against all
    apart = cut(apart.join(classes.select("id", "n_shingles").hint("merge"), "id").select("bucket", "id", "component", "major", "n_shingles"))
    weigh = apart.groupBy("bucket").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    needed = cut(apart.select("id").distinct())
    sets = cut(full_sets(texts_of(needed), width))
    info = classes.select("id", "bands", F.array(*[f"s{i}" for i in range(SKETCH_WORDS)]).alias("sketch")).join(sets.hint("merge"), "id")
    # a class to place goes to its block's row of cells, and each class to its block's column
    placed = apart.join(weigh.hint("merge"), "bucket").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = F.transform(others, lambda o: F.struct(o.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))
    own = F.transform(others, lambda o: F.struct(F.col("block").alias("i"), o.alias("j"), F.lit(0).alias("side")))
    dealt = placed.select("bucket", "id", "component", "major", F.explode(F.when(F.col("component") != F.col("major"), F.concat(cells, own)).otherwise(cells)).alias("c")).select("bucket", "id", "component", "major", "c.*")
    rows = dealt.join(info.hint("merge"), "id").select("bucket", "i", "j", "side", "id", "component", "major", "bands", "sketch", "shingles")
    return cut(rows.groupBy("bucket", "i", "j").applyInArrow(_block_links(percent), "a long, b long").distinct())


def to_roots(up: DataFrame) -> DataFrame:
    """up(node, to), where following to leads to ever smaller nodes, with to at the end of
    each way: every round looks one step on from where the last one came, so that the
    steps double."""
    while True:
        on = up.filter("node <> to").select(F.col("node").alias("at"), F.col("to").alias("on"))
        after = cut(up.join(on.hint("merge"), up["to"] == on["at"], "left").select("node", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved")))
        discard(up)
        up = after.select("node", "to")
        if after.filter("moved").isEmpty():
            return up


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ends of edges(a, b): the smallest id reachable.

    Each round every node points to its smallest neighbour, if that is smaller; pointers
    are followed to their ends, by doubling steps, and the nodes move there, their edges
    with them. A round leaves at most half of the nodes, so rounds grow with the logarithm
    of the number of nodes, and steps within one with that of the longest way: a
    path of 1,000 nodes takes 10 steps in one round. A node's many edges or the many
    nodes of one root are rows of two numbers in sort-merge joins, which Spark splits
    where they are skewed."""
    edges = cut(edges)
    labels = cut(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("at", F.col("id")))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = to_roots(cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))))
        moved = cut(labels.join(up.hint("merge"), labels["at"] == up.node, "left").select("id", F.coalesce("to", "at").alias("at")))
        left = edges.join(up.hint("merge"), edges.a == up.node).select(F.col("to").alias("a"), "b")
        left = left.join(up.hint("merge"), left.b == up.node).select("a", F.col("to").alias("b"))
        left = cut(left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        discard(labels, edges, up)
        labels, edges = moved, left
    return labels.select("id", F.col("at").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for every row of docs.

    Documents are linked if 100 * common shingles >= percent * shingles of either; a
    component has all that links reach, component_id is its smallest doc_id, and
    documents of that id are kept. Texts without words (null, empty) are linked with
    nothing. Rows of one doc_id with different texts are documents of their own, linked
    only if their texts are. Rows without a doc_id are linked with nothing, have null
    component_id, and are kept. Keys are whole numbers, or are cast to them."""
    return _components_of_rows(docs, width, percent, key, text).select("doc_id", "n_shingles", "class_id", "component_id", "kept")


def _components_of_rows(docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """near_duplicates with tie, the text's hash, and component, a number for each component."""
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = cut(signatures(docs, width))
    sketch = [f"s{i}" for i in range(SKETCH_WORDS)]
    linked = rows.filter("doc_id is not null and n_shingles > 0")
    classes = cut(linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", *sketch)]))
    # a class is known by its smallest doc_id; where one doc_id stands for several texts, by a number below 0
    clash = cut(classes.groupBy("least").agg(F.count("*").alias("n")).filter("n > 1").select("least"))
    several = not clash.isEmpty()
    if several:
        other = F.lit(-1).cast("long") - F.shiftrightunsigned(F.xxhash64("k1", "k2"), 1)
        classes = cut(classes.join(clash.withColumn("clash", F.lit(True)).hint("merge"), "least", "left").withColumn("id", F.when(F.col("clash"), other).otherwise(F.col("least"))).drop("clash"))
    else:
        classes = classes.withColumn("id", F.col("least"))
    known = classes.select("id", "n_shingles", *sketch)
    in_buckets = classes.select("id", F.explode("bands").alias("bucket"))

    # a bucket's smallest id against each other one
    buckets = cut(in_buckets.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("bucket", "first"))
    members = cut(in_buckets.join(buckets.hint("merge"), "bucket").select("bucket", "first", "id"))
    pairs = members.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(known.alias("p").hint("merge"), F.col("b") == F.col("p.id")).join(known.alias("q").hint("merge"), F.col("a") == F.col("q.id"))
    pairs = cut(pairs.filter(_may_link("p", "q", percent)).select("a", "b"))
    # a class's text is that of one of its rows
    one = classes.select("id", "least", "k1", "k2")
    if several:
        one = cut(rows.join(one.hint("merge"), ["k1", "k2"]).filter("doc_id = least").groupBy("id").agg(F.min(F.struct("doc_id", "tie")).alias("x")).select("id", "x.*"))
    texts_of = partial(_texts_of, docs, one if several else None)
    edges = confirmed(texts_of, pairs, width, percent)
    labels = components(edges)

    # what the smallest ids left apart
    new = links_left(texts_of, members, labels, classes, width, percent)
    if not new.isEmpty():
        labels = components(edges.union(new))

    named = classes.select("k1", "k2", "least", F.col("id")).join(labels.hint("merge"), "id", "left").select("k1", "k2", "least", F.coalesce("component", "id").alias("component"))
    if several:
        whole = named.groupBy("component").agg(F.min("least").alias("component_id"))
        named = named.join(whole.hint("merge"), "component")
    else:
        named = named.withColumn("component_id", F.col("component"))
    out = rows.select("doc_id", "tie", "n_shingles", "k1", "k2").join(named.hint("merge"), ["k1", "k2"], "left")
    own = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    mine = lambda c: F.when(own, F.col(c)).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "tie", "n_shingles", mine("least").alias("class_id"), mine("component_id").alias("component_id"), F.when(own, F.col("component")).alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component of near_duplicates, with their columns as they
    came; the texts stay in their partitions unless very many rows go.

    The row that stays has the smallest doc_id, then the smallest hash of its text; of
    rows equal in both, one stays, by a hash of all its columns. Rows that are linked
    with nothing stay, so do those without a doc_id and those without words."""
    found = cut(_components_of_rows(docs, width, percent, key, text).filter("component is not null").select("doc_id", "tie", "component", "component_id"))
    # a row of the smallest doc_id stays, so only those of that id are compared within a component
    heads = found.filter("doc_id = component_id")
    first = heads.groupBy("component").agg(F.min("tie").alias("t"))
    other = heads.join(first.hint("merge"), "component").filter("tie <> t")
    gone = cut(found.filter("doc_id <> component_id").select("doc_id", "tie").union(other.select("doc_id", "tie")).distinct().select(F.col("doc_id").alias("_gone"), F.col("tie").alias("_tie")))
    side = F.broadcast(gone) if gone.count() <= FEW_IDS else gone.hint("merge")
    number, tie = F.col(f"`{key}`").cast("long"), F.xxhash64(F.col(f"`{text}`"))
    left = docs.join(side, (number == F.col("_gone")) & (tie == F.col("_tie")), "left_anti")
    again = cut(found.groupBy("doc_id", "tie").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_gone"), F.col("tie").alias("_tie")))
    n = again.count()
    if n:
        side = F.broadcast(again) if n <= FEW_IDS else again.hint("merge")
        same = (number == F.col("_gone")) & (tie == F.col("_tie"))
        every = [F.col(f"`{c}`") for c in docs.columns]
        repeated = left.join(side, same, "left_semi").groupBy(number.alias("_gone"), tie.alias("_tie")).agg(F.min_by(F.struct(*every), F.xxhash64(*every)).alias("_row"))
        left = left.join(side, same, "left_anti").union(repeated.select("_row.*"))
    return left
