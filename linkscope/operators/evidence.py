"""Why documents were found, and which way of finding is better. queries(qid, text),
engines(engine, qid, doc_id, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscope.functions.scalars import STOPWORDS
from linkscope.operators.retrieval import dense_search, expected_score, few, fit_abstention, loo_abstention, retrieval_summary
from linkscope.operators.text import tokens_of
from linkscope.plans.iterate import cut
from linkscope.plans.order import running


def matched_overlap(queries: DataFrame, matches: DataFrame, stop: list[str] = STOPWORDS) -> DataFrame:
    """(qid, words, found, share): a query's distinct content words, and those that stand in
    the passage that it was matched with. matches(qid, text), one row a query."""
    words = lambda d: d.select("qid", F.explode(F.array_distinct(tokens_of(F.col("text")))).alias("token"))
    q = words(queries).filter(~F.col("token").isin(list(stop)))
    on = words(matches).withColumn("hit", F.lit(1))
    g = q.join(on.hint("merge"), ["qid", "token"], "left").groupBy("qid").agg(F.count("*").alias("words"), F.count("hit").alias("found"))
    return g.withColumn("share", F.col("found") / F.col("words"))


def evidence_table(engines: DataFrame, parts: DataFrame, passages: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(engine, qid, top, pick, words, passage): each engine's k best documents in order, the
    first of them, the k words that add most to its score there (parts(engine, qid,
    doc_id, token, part); empty if the engine has none), and its best passage
    (passages(engine, qid, doc_id, passage); else null)."""
    w = Window.partitionBy("engine", "qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    ranked = engines.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    top = ranked.groupBy("engine", "qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x.doc_id).alias("top"))  # k rows
    top = cut(top.withColumn("pick", F.element_at("top", 1)))
    own = parts.join(few(top.select("engine", "qid", F.col("pick").alias("doc_id"))), ["engine", "qid", "doc_id"])
    best = own.withColumn("r", F.row_number().over(Window.partitionBy("engine", "qid").orderBy(F.desc(F.round("part", 9)), "token"))).filter(F.col("r") <= k)
    words = best.groupBy("engine", "qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "token"))), lambda x: x.token).alias("words"))
    out = top.join(words.hint("merge"), ["engine", "qid"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    if passages is None:
        return out.withColumn("passage", F.lit(None).cast("long"))
    return out.join(passages.select("engine", "qid", F.col("doc_id").alias("pick"), "passage").hint("merge"), ["engine", "qid", "pick"], "left").select("engine", "qid", "top", "pick", "words", "passage")


def dense_variants(sets: dict[str, tuple[DataFrame, DataFrame]], skip_self: bool = False) -> DataFrame:
    """(variant, qid, doc_id, score): for each named set of vectors (queries(qid, v),
    passages(passage, doc_id, v), unit rows), its best passage under its name, and the
    mean vector of a document's passages under name-mean. Passages of another length, or
    whole documents, are sets of their own."""
    out = []
    for name, (queries, passages) in sets.items():
        found = cut(dense_search(queries, passages, skip_self))
        out.append(found.select(F.lit(name).alias("variant"), "qid", "doc_id", "score"))
        out.append(found.select(F.lit(f"{name}-mean").alias("variant"), "qid", "doc_id", F.col("mean_score").alias("score")))
    return reduce(DataFrame.unionByName, out)


def engine_comparison(rows: DataFrame, ranks: DataFrame, weights: dict[str, float], engines: list[str]) -> DataFrame:
    """(engine, n, top1, top3, top10, median_rank, mrr, threshold, fitted, left_out): a row an
    engine: its summary over ranks(engine, qid, target, rank), the threshold at which
    abstaining scores best over rows(engine, qid, style, correct, value), that score, and
    the score when each row is decided by a threshold fitted on the others."""
    fit = fit_abstention(rows, weights, ["engine"]).select("engine", "threshold", F.col("score").alias("fitted"))
    left = []
    for e in engines:  # a few
        own = cut(rows.filter(F.col("engine") == e))
        judged = own.join(loo_abstention(own, weights).select("qid", "abstains").hint("merge"), "qid")
        left.append(expected_score(judged, weights).select(F.lit(e).alias("engine"), F.col("score").alias("left_out")))
    return retrieval_summary(ranks, ["engine"]).join(fit.hint("merge"), "engine").join(reduce(DataFrame.unionByName, left).hint("merge"), "engine")


def hard_negatives(neighbours: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(doc_id, other, place, kind): for every document of pool(doc_id) k others of the pool: its
    nearest ones first ("near", from neighbours(doc_id, other, rank)), then "random" ones.
    Those are the next ones in a ring of the pool, ordered by a hash, so that no other
    pair is made; a pool is a chosen list. A pool of less than k + 1 gives what it has."""
    inside = pool.select("doc_id").distinct()
    near = neighbours.join(inside.hint("merge"), "doc_id", "left_semi").join(inside.withColumnRenamed("doc_id", "other").hint("merge"), "other", "left_semi")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "other"))).filter(F.col("r") <= k)
    near = cut(near.select("doc_id", "other", "r", F.lit("near").alias("kind")))
    n = inside.count()
    ring = running(inside, [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], i=F.lit(1))
    ring = cut(ring.withColumn("i", F.col("i") - 1))
    ahead = ring.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(2 * k))).alias("step"), "i").filter(F.col("step") < n)
    ahead = ahead.select("doc_id", "step", ((F.col("i") + F.col("step")) % n).alias("i")).join(ring.select("i", F.col("doc_id").alias("other")).hint("merge"), "i")
    fill = ahead.join(near.select("doc_id", "other").hint("merge"), ["doc_id", "other"], "left_anti").select("doc_id", "other", (F.col("step") + k).alias("r"), F.lit("random").alias("kind"))
    every = near.unionByName(fill)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("r"))).filter(F.col("place") <= k).select("doc_id", "other", "place", "kind")
