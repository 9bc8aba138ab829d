"""Vector space and similarity. Term weights are a long table (doc_id, token, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscope.operators import pairs as P
from linkscope.operators.retrieval import few
from linkscope.operators.text import bag_rows
from linkscope.plans.iterate import cut

#: Words of a corpus up to which their document frequencies are sent to all tasks (some 100 MB).
FEW_WORDS = 1_000_000


def unit_rows(weights: DataFrame) -> DataFrame:
    """w divided by the document's length; a row of zeros stays."""
    n = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))  # a join would shuffle the rows twice
    return weights.withColumn("len", n).select("doc_id", "token", F.when(F.col("len") > 0, F.col("w") / F.col("len")).otherwise(0.0).alias("w"))


def bow_unit(counts: DataFrame, stop: list[str], top: int | None = None) -> DataFrame:
    """Stopword-free counts at unit length, over the top terms of each document if given."""
    c = counts.filter(~F.col("token").isin(list(stop))).select("doc_id", "token", F.col("tf").cast("double").alias("w"))
    if top:
        rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("w"), "token"))
        c = c.withColumn("r", rank).filter(F.col("r") <= top).drop("r")
    return unit_rows(c)


def tfidf(counts: DataFrame, n_docs: int) -> DataFrame:
    """w = count / length * ln(N / df); words on every document weigh 0."""
    df = cut(counts.groupBy("token").agg(F.count("*").alias("df")))
    length = F.sum("tf").over(Window.partitionBy("doc_id"))
    # up to so many words, they go to the documents; else the documents' words are shuffled to them
    return counts.join(few(df, FEW_WORDS), "token").withColumn("length", length).select("doc_id", "token", (F.col("tf") / F.col("length") * F.log(n_docs / F.col("df"))).alias("w"))


def bag_lengths(bags: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, len): the length of each document's weights (tfidf) in bags of text.word_bags.

    The commonest words, up to FEW_WORDS, go to the documents, whose squares are added up
    there; only rows of rarer words, which are few, are shuffled to their frequencies."""
    bands = df.groupBy(F.floor(F.log2("df")).alias("band")).agg(F.count("*").alias("n")).collect()  # 63 at most
    least, held = 64, 0
    for band, n in sorted(bands, reverse=True):
        if held + n > FEW_WORDS:
            break
        least, held = band, held + n
    common = F.floor(F.log2("df")) >= least
    square = F.pow(F.col("tf") / F.col("n") * F.log(n_docs / F.col("df")), F.lit(2.0))
    rows = bag_rows(bags).join(df.filter(common).hint("broadcast"), "token", "left")
    parts = rows.filter("df is not null").groupBy("doc_id").agg(F.sum(square).alias("sq"))
    if held < sum(n for _, n in bands):
        rare = rows.filter("df is null").drop("df").join(df.filter(~common).hint("merge"), "token")
        parts = parts.union(rare.groupBy("doc_id").agg(F.sum(square).alias("sq")))
    return parts.groupBy("doc_id").agg(F.sqrt(F.sum("sq")).alias("len"))


def cosine_pairs(unit: DataFrame, max_df: int | None = None) -> DataFrame:
    """(a, b, cos), a < b, for documents that share a term. Terms of weight 0 are left
    out; max_df, if given, leaves out frequent terms too (an approximation)."""
    p = unit.filter("w <> 0")
    if max_df:
        p = p.join(p.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") <= max_df).select("token").hint("merge"), "token", "left_semi")
    return P.all_pairs(P.packed(p))


def topk_neighbours(pairs: DataFrame, k: int, score: str = "cos") -> DataFrame:
    """(doc_id, other, score, rank): each document's k nearest, ties to the smaller id."""
    both = pairs.select(F.col("a").alias("doc_id"), F.col("b").alias("other"), score).union(pairs.select("b", "a", score))
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round(score, 9)), "other")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pair_set(neighbours: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a, b)."""
    return neighbours.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()


def decompose_pairs(unit: DataFrame, kinds: DataFrame) -> DataFrame:
    """(a, b, cos, p_name, p_habit, p_other, verdict): the cosine split exactly by the kind
    of the shared terms. NAME at half or more; else HABIT if it is at least OTHER; else STORY."""
    return P.all_pairs(P.packed(unit, kinds), len(P.KINDS)).withColumn("verdict", verdict())


def verdict() -> Column:
    total = F.col("p_name") + F.col("p_habit") + F.col("p_other")
    return F.when(total <= 0, "STORY").when(2 * F.col("p_name") >= total, "NAME").when(F.col("p_habit") >= F.col("p_other"), "HABIT").otherwise("STORY")


def dial_cosine(unit: DataFrame, kinds: DataFrame, settings: DataFrame) -> DataFrame:
    """(wn, wh, a, b, cos): the cosine with name and habit words weighed anew, from its
    parts and each document's own parts (squared weights by kind); settings(wn, wh)."""
    weigh = lambda *c: F.col("wn") ** 2 * F.col(c[0]) + F.col("wh") ** 2 * F.col(c[1]) + F.col(c[2])
    j = P.all_pairs(P.packed(unit, kinds), len(P.KINDS), own=True).crossJoin(F.broadcast(settings))  # a few settings
    norm = F.sqrt(weigh("a_name", "a_habit", "a_other") * weigh("b_name", "b_habit", "b_other"))
    return j.select("wn", "wh", "a", "b", F.coalesce(weigh("p_name", "p_habit", "p_other") / F.nullif(norm, F.lit(0.0)), F.lit(0.0)).alias("cos"))


def network_agreement(neighbours: DataFrame, links: DataFrame, by: list[str] = ()) -> DataFrame:
    """(n, agreement): mean number of a document's neighbours that are linked to it. links(a, b)."""
    e = links.select(F.col("a").alias("doc_id"), F.col("b").alias("other")).union(links.select("b", "a")).distinct().withColumn("hit", F.lit(1))
    per = neighbours.join(e.hint("merge"), ["doc_id", "other"], "left").groupBy(*by, "doc_id").agg(F.count("hit").alias("hits"))
    return per.groupBy(*by).agg(F.count("*").alias("n"), F.avg("hits").alias("agreement"))


def neighbour_rank_shift(now: DataFrame, base: DataFrame) -> DataFrame:
    """now with base_rank: the rank that each neighbour had before; null if none."""
    return now.join(base.select("doc_id", "other", F.col("rank").alias("base_rank")).hint("merge"), ["doc_id", "other"], "left")


def pair_summary(unit: DataFrame, kinds: DataFrame) -> DataFrame:
    """(verdict, n, share, median_cos, mean_name_share) of all pairs that share a term."""
    return P.summary(P.packed(unit, kinds))


def pair_top_terms(unit: DataFrame, pairs: DataFrame, k: int = 3) -> DataFrame:
    """(a, b, token, part, rank): the terms that carry each of pairs(a, b)."""
    x, y = unit.select(F.col("doc_id").alias("a"), "token", F.col("w").alias("wa")), unit.select(F.col("doc_id").alias("b"), "token", F.col("w").alias("wb"))
    p = pairs.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), ["b", "token"]).select("a", "b", "token", (F.col("wa") * F.col("wb")).alias("part")).filter("part > 0")
    w = Window.partitionBy("a", "b").orderBy(F.desc(F.round("part", 9)), "token")
    return p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_terms_of_pairs(unit: DataFrame, least: float, k: int = 3) -> DataFrame:
    """pair_top_terms of the pairs with a cosine of least or more; only the terms asked for leave a task."""
    terms = cut(P.numbered(unit))
    best = P.top_terms(P.packed(unit, terms=terms), least, k)
    return best.join(terms.hint("merge"), "code").select("a", "b", "token", "part", "rank")


def pairs_across(unit: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, cos) for documents that share a term and have different labels(doc_id, label),
    both known."""
    return P.all_pairs(P.packed(unit, label=labels), apart=True)


def far_twins(unit: DataFrame, links: DataFrame, lengths: DataFrame, floor: int, k: int) -> DataFrame:
    """(a, b, cos): the k closest pairs of documents of lengths(doc_id, length) of floor or more
    that neither a link nor two links in a row join: their distance is 3 or more, or
    there is no way."""
    e = links.select("a", "b").union(links.select("b", "a")).distinct()
    two = e.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")).hint("merge"), "b").select("a", F.col("c").alias("b"))
    near = e.union(two).filter("a < b").distinct()
    long = unit.join(lengths.filter(F.col("length") >= floor).select("doc_id").hint("merge"), "doc_id", "left_semi")
    return P.closest(P.packed(long, skip=near), k)


def centroid_outliers(unit: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, cos): likeness to the mean of all documents."""
    mean = unit.groupBy("token").agg((F.sum("w") / n_docs).alias("m"))
    length = mean.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("len"))
    d = unit.join(mean.hint("merge"), "token").groupBy("doc_id").agg(F.sum(F.col("w") * F.col("m")).alias("dot"))
    return d.crossJoin(F.broadcast(length)).select("doc_id", (F.col("dot") / F.nullif(F.col("len"), F.lit(0.0))).alias("cos"))


def distinctive_terms(counts: DataFrame, k: int = 8, least: int = 3) -> DataFrame:
    """(doc_id, token, ratio, rank): relative frequency against the whole corpus."""
    total = counts.groupBy("token").agg(F.sum("tf").alias("all"))
    size = counts.agg(F.sum("tf").alias("size"))
    length = counts.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    j = counts.filter(F.col("tf") >= least).join(total.hint("merge"), "token").join(length.hint("merge"), "doc_id").crossJoin(F.broadcast(size))
    r = j.select("doc_id", "token", (F.col("tf") / F.col("length") / (F.col("all") / F.col("size"))).alias("ratio"))
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("ratio", 9)), "token")
    return r.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def single_term_oracle(unit: DataFrame) -> DataFrame:
    """(doc_id, token, margin): the one term that puts a document ahead of all others by the
    widest margin; documents that no term puts ahead are absent."""
    w = Window.partitionBy("token").orderBy(F.desc("w"), "doc_id")
    two = unit.filter("w > 0").withColumn("r", F.row_number().over(w)).filter("r <= 2")
    best = two.groupBy("token").agg(F.min_by("doc_id", "r").alias("doc_id"), (F.max("w") - F.coalesce(F.max(F.when(F.col("r") == 2, F.col("w"))), F.lit(0.0))).alias("margin")).filter("margin > 1e-12")
    pick = Window.partitionBy("doc_id").orderBy(F.desc(F.round("margin", 9)), "token")
    return best.withColumn("r", F.row_number().over(pick)).filter("r = 1").select("doc_id", "token", "margin")


def vector_cosines(vectors: DataFrame, block: int = 512) -> DataFrame:
    """(a, b, cos) for all pairs of unit vectors(id, v): blocks of one side meet blocks of
    the other and are multiplied there."""
    import numpy as np
    import pandas as pd

    n = max(1, -(-vectors.count() // block))
    b = vectors.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(n)))
    left = b.select(F.explode(F.sequence(F.col("g"), F.lit(n - 1))).alias("y"), F.col("g").alias("x"), F.col("id").alias("i"), F.col("v").alias("vi"))
    right = b.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("g"))).alias("x"), F.col("g").alias("y"), F.col("id").alias("j"), F.col("v").alias("vj"))

    def multiply(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "cos": pd.Series(dtype="float64")})
        s = np.array(p["vi"].tolist(), np.float64) @ np.array(q["vj"].tolist(), np.float64).T
        i, j = np.meshgrid(p["i"].to_numpy(), q["j"].to_numpy(), indexing="ij")
        same = p["x"].iloc[0] == p["y"].iloc[0]
        keep = (i < j) if same else np.ones_like(i, bool)
        return pd.DataFrame({"a": np.minimum(i, j)[keep], "b": np.maximum(i, j)[keep], "cos": s[keep]})

    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(multiply, "a long, b long, cos double")


def vector_neighbours(vectors: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """(doc_id, other, cos, rank): each row's k nearest of unit vectors(id, v), ties of nine
    digits to the smaller id, as topk_neighbours of vector_cosines. A task multiplies the rows of a block
    with those of another and keeps k for each row, so pairs never leave it."""
    import numpy as np
    import pyarrow as pa

    n = max(1, -(-vectors.count() // block))
    b = vectors.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(n)))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    # both sides are the same table: Spark tells their columns apart only by other names
    left = b.select(F.col("g").alias("x"), every.alias("y"), F.col("id").alias("i"), F.col("v").alias("vi"))
    right = b.select(every.alias("x"), F.col("g").alias("y"), F.col("id").alias("j"), F.col("v").alias("vj"))
    schema = pa.schema([("doc_id", pa.int64()), ("other", pa.int64()), ("cos", pa.float64())])

    def matrix(t: pa.Table, ids: str, v: str) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(t[ids].to_numpy())
        flat = t[v].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return t[ids].to_numpy()[order], flat.reshape(t.num_rows, -1)[order]

    def nearest(p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows or not q.num_rows:
            return schema.empty_table()
        (i, vi), (j, vj) = matrix(p, "i", "vi"), matrix(q, "j", "vj")
        found = []
        for at in range(0, len(i), 256):
            s = vi[at : at + 256] @ vj.T
            s[i[at : at + 256, None] == j] = -np.inf
            # a few columns give a bound that most others miss
            few = s[:, : max(64, k)]
            least = np.partition(few, max(0, few.shape[1] - k), axis=1)[:, max(0, few.shape[1] - k), None]
            r, c = np.nonzero(s >= least - 2e-9)
            cos = s[r, c]
            keep = P.firsts(r, k, -np.rint(cos * 1e9), j[c])
            keep = keep[np.isfinite(cos[keep])]
            found.append((i[at + r[keep]], j[c[keep]], cos[keep]))
        return pa.table([np.concatenate(f) for f in zip(*found, strict=True)], schema=schema)

    best = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(nearest, "doc_id long, other long, cos double")
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("cos", 9)), "other")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
