"""Hard negatives of embeddings by exact integer inner products.

A tile of anchors meets a tile of candidates, both int64, and Strassen's recursion
multiplies them: seven products of half the size instead of eight, odd edges padded with
zeros, additions exact. From each tile an anchor keeps a heap of its best positives;
heaps merge by taking the best of both, inside a task and, as rows under a rank limit,
between tasks. The merged positives give each anchor its windows of scores, and a second
pass keeps a heap for each window.

A tile is a bounded number of rows, whatever the labels: positives are sought between
blocks of one label (a label with a third of all rows has many blocks), negatives between
anchor blocks and all blocks of candidates. Each pair of blocks is one group, so a task
holds two blocks and a bounded part of their product. Anchors x rows products are made,
as the query set is held against all rows; a heap of a few rows for each leaves a task.

Rows with a null id, label or vector, or with a null or non-finite component, take no
part; an empty vector has score 0 with all. Vectors of unequal length are compared over
the shorter one, as if padded with zeros. Rows equal in id, label and vector are one; rows
of one id that differ are rows of their own, and ties between them go by a hash. Other
columns are left out. Vectors whose scores
could reach 2 ** 55 are an error, as is a component beyond int64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscope.llm.common import cut

#: Rows of a block of anchors and of candidates.
ANCHORS, CANDIDATES = 1024, 2048
#: Anchors multiplied with a block at a time.
STRIP = 256
#: Strassen's recursion ends where a side is no longer than this.
LEAF = 16
#: Scores stay below this, so that their hundredths and sums stay in int64.
SAFE = 1 << 55


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 by Strassen's recursion."""
    (m, k), n = a.shape, b.shape[0]
    if min(m, k, n) <= LEAF:
        return np.einsum("ik,jk->ij", a, b)
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, n % 2), (0, k % 2)))
    i, h, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[0] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    # b holds columns as rows: its upper right quarter is the lower left one of the factor
    b11, b21, b12, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    m1 = product(a11 + a22, b11 + b22)
    m2 = product(a21 + a22, b11)
    m3 = product(a11, b12 - b22)
    m4 = product(a22, b21 - b11)
    m5 = product(a11 + a12, b22)
    m6 = product(a21 - a11, b11 + b12)
    m7 = product(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = m1 + m4 - m5 + m7
    out[:i, j:] = m3 + m5
    out[i:, :j] = m2 + m4
    out[i:, j:] = m1 - m2 + m3 + m6
    return out[:m, :n]


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of two tiles; an OverflowError where one could reach SAFE."""
    largest = max(1, *(int(np.abs(x).max(initial=0)) for x in (a, b)))
    if largest * largest * max(1, a.shape[1]) >= SAFE:
        raise OverflowError("inner products of these vectors are too large")
    return product(a, b)


def heaps(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places) of the k best allowed scores of each row; earlier ones win ties."""
    n = scores.shape[1]
    fine = allowed
    if n > k:
        # what reaches the kth best score; ties beyond k go after the sort
        least = np.partition(np.where(allowed, scores, np.iinfo(np.int64).min), n - k, axis=1)[:, n - k]
        fine = allowed & (scores >= least[:, None])
    row, at = np.nonzero(fine)
    order = np.lexsort((at, -scores[row, at], row))
    row, at = row[order], at[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], at[keep]


def vectors_as_integers(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v, row): components floor(scale * x) as long; row tells rows of one id apart."""
    v = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: F.floor(scale * x))
    sound = F.forall(F.col(f"`{vector}`").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), v.alias("v"))
    return rows.withColumn("row", F.xxhash64("id", "label", "v")).dropDuplicates(["id", "row"])


def _tile(batch: pa.Table) -> np.ndarray:
    """The vectors of a block as rows of one length."""
    lists = batch.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy()
    length = np.diff(ends)
    flat = lists.values.to_numpy()
    if len(length) and (length == length[0]).all():
        return flat[ends[0] : ends[-1]].reshape(len(length), length[0])
    out = np.zeros((len(length), int(length.max(initial=0))), np.int64)
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def _both(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _order(table: pa.Table) -> pa.Table:
    return table.sort_by([("id", "ascending"), ("row", "ascending")])


def _meet(anchors: DataFrame, rows: DataFrame, by: list[str], work, schema: str) -> DataFrame:
    """work(anchor block, candidate block) for each pair of blocks, which are cut by hash;
    by: columns that must agree, beyond which no block goes."""
    sizes = [d.groupBy(*by).agg(F.ceil(F.count("*") / size).alias(f"n_{c}")) for d, size, c in ((anchors, ANCHORS, "x"), (rows, CANDIDATES, "y"))]
    n = cut(sizes[0].join(sizes[1].hint("merge"), by) if by else sizes[0].crossJoin(F.broadcast(sizes[1])))  # one row each

    def spread(d: DataFrame, own: str, other: str) -> DataFrame:
        j = d.join(n.hint("merge"), by) if by else d.crossJoin(F.broadcast(n))  # one row
        j = j.withColumn(own, F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), f"n_{own}")))
        return j.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), f"n_{other}") - 1))).drop("n_x", "n_y")

    keys = [*by, "x", "y"]
    left, right = spread(anchors, "x", "y"), spread(rows, "y", "x")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def _positives(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(anchor, arow, positive, prow, score, place): each anchor's k best others of its label."""
    schema = "anchor long, arow long, positive long, prow long, score long"
    names = ["anchor", "arow", "positive", "prow", "score"]

    def work(p: pa.Table, q: pa.Table) -> pa.Table:
        p, q = _order(p), _order(q)
        a, b = _both(_tile(p), _tile(q))
        own, ids = [(t.column("id").to_numpy(), t.column("row").to_numpy()) for t in (p, q)]
        out = [np.zeros((5, 0), np.int64)]
        for at in range(0, len(a) if len(b) else 0, STRIP):
            some = slice(at, at + STRIP)
            s = inner_products(a[some], b)
            itself = (own[0][some, None] == ids[0]) & (own[1][some, None] == ids[1])
            r, j = heaps(s, ~itself, k)
            out.append(np.stack([own[0][at + r], own[1][at + r], ids[0][j], ids[1][j], s[r, j]]))
        return pa.table(list(np.concatenate(out, 1)), names=names)

    found = _meet(anchors, rows, ["label"], work, schema)
    order = Window.partitionBy("anchor", "arow").orderBy(F.desc("score"), "positive", "prow")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 3, window: tuple[int, int, int] = (50, 95, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for
    vectors(id, label, v, row) of vectors_as_integers. anchor: a condition on id that says
    which rows are anchors. window: a negative's score is at least the first and at most
    the second hundredths (the third) of the positive's."""
    low, high, whole = window
    rows = cut(vectors)
    anchors = cut(rows.filter(anchor))
    positives = cut(_positives(anchors, rows, n_positives))
    bounds = F.collect_list(F.struct("place", "positive", "prow", "score"))
    asked = positives.groupBy(F.col("anchor").alias("id"), F.col("arow").alias("row")).agg(F.sort_array(bounds).alias("p"))
    asked = anchors.join(asked.hint("merge"), ["id", "row"]).select("id", "row", "label", "v", "p.positive", "p.prow", "p.score")
    schema = "anchor long, arow long, positive long, prow long, score long, negative long, nrow long, found long"
    names = ["anchor", "arow", "positive", "prow", "score", "negative", "nrow", "found"]

    def work(p: pa.Table, q: pa.Table) -> pa.Table:
        p, q = _order(p), _order(q)
        a, b = _both(_tile(p), _tile(q))
        (own, arow, alabel), (ids, row, label) = [[t.column(c).to_numpy() for c in ("id", "row", "label")] for t in (p, q)]
        known = [p.column(c).to_pylist() for c in ("positive", "prow", "score")]
        out = [np.zeros((8, 0), np.int64)]
        for at in range(0, len(a) if len(b) else 0, STRIP):
            some = slice(at, at + STRIP)
            s = inner_products(a[some], b)
            other = alabel[some, None] != label
            for place in range(n_positives):
                has = np.flatnonzero([len(x) > place for x in known[2][some]])
                if not len(has):
                    break
                pos, prow, score = (np.array([c[at + i][place] for i in has], np.int64) for c in known)
                least, most = -(-low * score // whole), high * score // whole
                inside = other[has] & (s[has] >= least[:, None]) & (s[has] <= most[:, None])
                kept = np.flatnonzero(inside.any(1))
                r, j = heaps(s[has[kept]], inside[kept], n_negatives)
                r = kept[r]
                i = at + has[r]
                out.append(np.stack([own[i], arow[i], pos[r], prow[r], score[r], ids[j], row[j], s[has[r], j]]))
        return pa.table(list(np.concatenate(out, 1)), names=names)

    found = _meet(asked, rows, [], work, schema)
    order = Window.partitionBy("anchor", "arow", "positive", "prow").orderBy(F.desc("found"), "negative", "nrow")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    return best.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), F.col("score").alias("positive_score"), F.col("found").alias("negative_score"))
