"""Retrieval and its evaluation: scores(qid, doc_id, score), queries(qid, text, style, target)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscope.operators.text import bag_rows, tokens_of
from linkscope.plans.iterate import cut, small_batches
from linkscope.plans.order import average_ranks, running, running_best


#: Rows of a query table up to which it is sent to all tasks; a larger one is joined by a shuffle.
FEW_ROWS = 100_000


def few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """df with a hint: broadcast if it has at most so many rows, else merge."""
    return df.hint("broadcast" if df.limit(most + 1).count() <= most else "merge")


def query_weights(queries: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """(qid, token, w): tf over all tokens of the query, unknown ones too, times ln(N / df); unit length."""
    t = queries.select("qid", F.explode(tokens_of(F.col("text"))).alias("token"))
    c = t.groupBy("qid", "token").agg(F.count("*").alias("tf"))
    length = t.groupBy("qid").agg(F.count("*").alias("n"))
    w = c.join(df.hint("merge"), "token").join(length.hint("merge"), "qid").select("qid", "token", (F.col("tf") / F.col("n") * F.log(n_docs / F.col("df"))).alias("w"))
    norm = w.groupBy("qid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return w.join(norm.hint("merge"), "qid").select("qid", "token", (F.col("w") / F.nullif(F.col("len"), F.lit(0.0))).alias("w"))


def contributions(query_w: DataFrame, unit: DataFrame) -> DataFrame:
    """(qid, doc_id, token, part): what each word adds to a cosine."""
    q = query_w.select("qid", "token", F.col("w").alias("wq")).filter("wq <> 0")
    return unit.filter("w <> 0").join(few(q), "token").select("qid", "doc_id", "token", (F.col("wq") * F.col("w")).alias("part"))


def sparse_search(query_w: DataFrame, unit: DataFrame) -> DataFrame:
    """(qid, doc_id, score): cosine with every document that shares a word."""
    return contributions(query_w, unit).groupBy("qid", "doc_id").agg(F.sum("part").alias("score"))


def unknown_words(queries: DataFrame, df: DataFrame) -> DataFrame:
    """(qid, token): query words of no document."""
    t = queries.select("qid", F.explode(F.array_distinct(tokens_of(F.col("text")))).alias("token"))
    return t.join(df.hint("merge"), "token", "left_anti")


def binary_query_search(queries: DataFrame, unit: DataFrame) -> DataFrame:
    """(qid, doc_id, score): summed weights of the distinct query words over the root of their number."""
    t = queries.select("qid", F.explode(F.array_distinct(tokens_of(F.col("text")))).alias("token"))
    known = unit.select("token", "doc_id", "w").join(few(t), "token")
    n = known.select("qid", "token").distinct().groupBy("qid").agg(F.count("*").alias("n"))
    return known.groupBy("qid", "doc_id").agg(F.sum("w").alias("s")).join(few(n), "qid").select("qid", "doc_id", (F.col("s") / F.sqrt("n")).alias("score"))


def known_words(queries: DataFrame, df: DataFrame) -> DataFrame:
    """(token, df) of the queries' words: all that a search needs of the frequencies."""
    t = queries.select(F.explode(tokens_of(F.col("text"))).alias("token")).distinct()
    return df.join(few(t), "token", "left_semi")


def binary_weights(queries: DataFrame, df: DataFrame) -> DataFrame:
    """(qid, token, w): 1 over the root of their number for a query's distinct words in df."""
    t = queries.select("qid", F.explode(F.array_distinct(tokens_of(F.col("text")))).alias("token")).distinct()
    known = t.join(df.select("token").hint("merge"), "token")
    n = known.groupBy("qid").agg(F.count("*").alias("n"))
    return known.join(n.hint("merge"), "qid").select("qid", "token", (1 / F.sqrt("n")).alias("w"))


#: Queries times documents that a task scores at once.
SCORED = 1 << 20


def bag_search(query_w: DataFrame, bags: DataFrame, lengths: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """(qid, doc_id, score): as sparse_search over query_w(qid, token, w), in bags of
    text.word_bags with vectors.bag_lengths. Up to FEW_ROWS query words go to all tasks, where documents
    keep what they share with them; these rows meet their lengths and are scored in tasks, so
    that no score is shuffled. df(token, df) of the query words will do."""
    words = cut(query_w.filter("w is not null").join(df.hint("merge"), "token").select("qid", "token", "w", F.log(n_docs / F.col("df")).alias("idf")))
    if words.limit(FEW_ROWS + 1).count() > FEW_ROWS:
        own = bag_rows(bags).join(words.hint("merge"), "token").select("doc_id", "qid", (F.col("tf") / F.col("n") * F.col("idf") * F.col("w")).alias("part"))
        sums = own.groupBy("qid", "doc_id").agg(F.sum("part").alias("score")).join(lengths.hint("merge"), "doc_id")
        return sums.select("qid", "doc_id", F.when(F.col("len") > 0, F.col("score") / F.col("len")).otherwise(0.0).alias("score"))
    t = words.orderBy("token", "qid").toArrow()
    tokens, start, code = np.unique(np.array(t["token"].to_pylist(), dtype=object), return_index=True, return_inverse=True) if len(t) else (np.zeros(0, object), np.zeros(0, np.int64), None)
    qids, query = np.unique(t["qid"].to_numpy(), return_inverse=True)
    sent = bags.sparkSession.sparkContext.broadcast({
        "tokens": tokens.tolist(), "start": start, "held": np.diff(np.append(start, len(t))), "qids": qids, "query": query,
        "w": t["w"].to_numpy() * t["idf"].to_numpy(),
    })

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["token"]
            flat = lists.flatten()
            code = pc.fill_null(pc.index_in(flat, pa.array(sent.value["tokens"], flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            share = b["tf"].flatten().to_numpy() / b["n"].to_numpy()[row] if len(row) else np.zeros(0)
            some = code >= 0
            held = np.bincount(row[some], minlength=b.num_rows)
            full = held > 0
            ends = pa.array(np.concatenate([[0], np.cumsum(held[full])]), pa.int32())
            yield pa.RecordBatch.from_arrays([b["doc_id"].filter(pa.array(full)), pa.ListArray.from_arrays(ends, pa.array(code[some])), pa.ListArray.from_arrays(ends, pa.array(share[some]))], names=["doc_id", "code", "share"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        n = max(1, len(s["qids"]))
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, SCORED // n)):
                b = whole.slice(at, max(1, SCORED // n))
                lists, length = b["code"], b["len"].to_numpy()
                code = lists.flatten().to_numpy()
                row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                share = np.divide(b["share"].flatten().to_numpy(), length[row], out=np.zeros(len(row)), where=length[row] > 0)
                # each word of a document meets the queries that have it
                many = s["held"][code]
                meet = np.repeat(s["start"][code] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                cell = np.repeat(row, many) * n + s["query"][meet]
                total = np.bincount(cell, np.repeat(share, many) * s["w"][meet], b.num_rows * n)
                got = np.flatnonzero(np.bincount(cell, minlength=b.num_rows * n))
                yield pa.RecordBatch.from_arrays([pa.array(s["qids"][got % n]), b["doc_id"].take(pa.array(got // n)), pa.array(total[got])], names=["qid", "doc_id", "score"])

    doc, qid = bags.schema["doc_id"].dataType.simpleString(), query_w.schema["qid"].dataType.simpleString()
    hits = small_batches(bags).mapInArrow(keep, f"doc_id {doc}, code array<int>, share array<double>")
    return hits.join(lengths.hint("merge"), "doc_id").mapInArrow(score, f"qid {qid}, doc_id {doc}, score double")


def word_status(queries: DataFrame, df: DataFrame, banned: DataFrame) -> DataFrame:
    """(qid, pos, word, status): ok, unknown, banned, duplicate or invalid."""
    w = queries.select("qid", F.posexplode(F.split(F.lower(F.trim(F.coalesce("text", F.lit("")))), "\\s+")).alias("pos", "word"))
    first = F.min("pos").over(Window.partitionBy("qid", "word"))
    j = w.withColumn("first", first).join(df.select(F.col("token").alias("word"), F.lit(True).alias("known")).hint("merge"), "word", "left").join(banned.select("qid", F.col("token").alias("word"), F.lit(True).alias("ban")).hint("merge"), ["qid", "word"], "left")
    status = F.when(F.col("word") == "", "empty").when(~F.col("word").rlike("^[a-z]+$"), "invalid").when(F.col("ban"), "banned").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("known").isNull(), "unknown").otherwise("ok")
    return j.select("qid", "pos", "word", status.alias("status"))


def dense_search(queries: DataFrame, passages: DataFrame, skip_self: bool = False) -> DataFrame:
    """(qid, doc_id, score, passage, mean_score): best passage of each document and the
    cosine with its mean vector. queries(qid, v), passages(passage, doc_id, v), unit rows;
    skip_self: a passage isn't an answer to the query of its own number.

    Queries meet passages in blocks, of which each task multiplies one pair; a document's
    passages may lie in many blocks, whose bests and sums are merged."""
    import numpy as np
    import pandas as pd

    nq, np_ = max(1, -(-queries.count() // 256)), max(1, -(-passages.count() // 2048))
    q = queries.withColumn("x", F.pmod(F.xxhash64("qid"), F.lit(nq))).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(np_ - 1).cast("bigint"))).alias("y"), "x", "qid", F.col("v").alias("vq"))
    p = passages.withColumn("y", F.pmod(F.xxhash64("passage"), F.lit(np_))).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))).alias("x"), "y", "passage", "doc_id", "v")
    empty = {"qid": "int64", "doc_id": "int64", "score": "float64", "passage": "int64", "total": "float64"}

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({k: pd.Series(dtype=t) for k, t in empty.items()})
        b = b.sort_values(["doc_id", "passage"])
        v = np.array(b["v"].tolist(), np.float64)
        s = np.array(a["vq"].tolist(), np.float64) @ v.T
        docs, first = np.unique(b["doc_id"].to_numpy(), return_index=True)
        total = np.add.reduceat(s, first, 1)
        s = np.round(s, 9)
        if skip_self:
            s[a["qid"].to_numpy()[:, None] == b["passage"].to_numpy()] = -np.inf
        best = np.maximum.reduceat(s, first, 1)
        owner = np.repeat(np.arange(len(docs)), np.diff(np.append(first, len(b))))
        at = np.where(s == best[:, owner], np.arange(s.shape[1]), s.shape[1])
        at = np.minimum.reduceat(at, first, 1)
        qid = np.repeat(a["qid"].to_numpy(), len(docs))
        return pd.DataFrame({"qid": qid, "doc_id": np.tile(docs, len(a)), "score": best.ravel(), "passage": b["passage"].to_numpy()[at.ravel()], "total": total.ravel()})

    found = q.groupBy("x", "y").cogroup(p.groupBy("x", "y")).applyInPandas(search, "qid long, doc_id long, score double, passage long, total double")
    g = found.groupBy("qid", "doc_id").agg(F.max("score").alias("score"), F.min_by("passage", F.struct(-F.col("score"), "passage")).alias("passage"), F.sum("total").alias("total"))
    length = passages.select("doc_id", F.posexplode("v").alias("i", "x")).groupBy("doc_id", "i").agg(F.sum("x").alias("x")).groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    own = g.filter(F.col("score") > float("-inf")).join(length.hint("merge"), "doc_id")
    return own.select("qid", "doc_id", "score", "passage", F.coalesce(F.col("total") / F.nullif(F.col("len"), F.lit(0.0)), F.lit(0.0)).alias("mean_score"))


def rank_of_target(scores: DataFrame, targets: DataFrame, by: list[str] = ()) -> DataFrame:
    """(qid, target, rank): from 1, a tie counting against the target; null if it has no score."""
    t = few(targets.select("qid", "target"))
    # targets are as few as queries: they go to the scores, of which only counts are shuffled
    own = few(scores.select(*by, "qid", F.col("doc_id").alias("target"), F.round("score", 9).alias("own")).join(t, ["qid", "target"]))
    above = scores.select(*by, "qid", F.round("score", 9).alias("s")).join(own, [*by, "qid"]).filter(F.col("s") >= F.col("own"))
    ranks = above.groupBy(*by, "qid", "target").agg(F.count("*").alias("rank"))
    return t.join(ranks.hint("merge"), ["qid", "target"], "left").select(*by, "qid", "target", "rank")


def retrieval_summary(ranks: DataFrame, by: list[str]) -> DataFrame:
    """(n, top1, top3, top10, median_rank, mrr)."""
    top = lambda k: F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).cast("long").alias(f"top{k}")
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), top(1), top(3), top(10), F.median("rank").alias("median_rank"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def paired_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(worse, same, better) of b against a on the same queries; a missing rank is last."""
    last = F.lit(2**62)
    j = a.select("qid", F.coalesce("rank", last).alias("x")).join(b.select("qid", F.coalesce("rank", last).alias("y")).hint("merge"), "qid")
    n = lambda c: F.sum(c.cast("long"))
    return j.agg(n(F.col("y") > F.col("x")).alias("worse"), n(F.col("y") == F.col("x")).alias("same"), n(F.col("y") < F.col("x")).alias("better"))


def standout(scores: DataFrame, n_docs: int, by: list[str] = ()) -> DataFrame:
    """(qid, best, z, gap) against the mean and population deviation over all documents,
    those without a score counting 0; a deviation of 0 counts as 1."""
    g = scores.groupBy(*by, "qid").agg(F.max("score").alias("best"), (F.sum("score") / n_docs).alias("mean"), (F.sum(F.col("score") * F.col("score")) / n_docs).alias("sq"))
    # the second is the best again if two documents have it: maxima and counts are taken before the shuffle
    top = few(g.select(*by, "qid", F.col("best").alias("top")))
    held = scores.join(top, [*by, "qid"]).groupBy(*by, "qid").agg(F.sum((F.col("score") == F.col("top")).cast("long")).alias("held"), F.max(F.when(F.col("score") < F.col("top"), F.col("score"))).alias("next"))
    second = F.when(F.col("held") > 1, F.col("best")).otherwise(F.coalesce("next", F.lit(0.0)))
    g = g.join(held.hint("merge"), [*by, "qid"]).withColumn("second", second)
    var = F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0))
    sd = F.when(F.sqrt(var) > 1e-12, F.sqrt(var)).otherwise(1.0)
    return g.select(*by, "qid", "best", ((F.col("best") - F.col("mean")) / sd).alias("z"), ((F.col("best") - F.col("second")) / sd).alias("gap"))


def expected_score(rows: DataFrame, weights: dict[str, float], by: list[str] = ()) -> DataFrame:
    """(score): accuracies by style, weighed. rows(style, correct, abstains): an abstention is
    right where the style is absent, an answer where it is correct and not abstained."""
    ok = F.when(F.col("style") == "absent", F.col("abstains")).otherwise(F.col("correct") & ~F.col("abstains"))
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("style"))
    per = rows.groupBy(*by, "style").agg(F.avg(ok.cast("double")).alias("acc"))
    return per.groupBy(*by).agg(F.sum(F.col("acc") * F.coalesce(w, F.lit(0.0))).alias("score"))


def fit_abstention(rows: DataFrame, weights: dict[str, float], by: list[str] = ()) -> DataFrame:
    """(threshold, score): among midpoints of the values, the threshold below which to
    abstain that gives the best expected score, the smallest on ties. One pass over the
    sorted values: what is gained as the threshold rises are running sums by style."""
    by = list(by)
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("style"))
    n = F.count("*").over(Window.partitionBy(*by, "style"))
    r = rows.withColumn("unit", F.coalesce(w, F.lit(0.0)) / n)
    gain = F.when(F.col("style") == "absent", F.col("unit")).otherwise(-F.col("unit") * F.col("correct").cast("double"))
    base = F.when((F.col("style") != "absent") & F.col("correct"), F.col("unit")).otherwise(0.0)
    v = r.withColumn("gain", gain).withColumn("base", base).groupBy(*by, "value").agg(F.sum("gain").alias("gain"), F.sum("base").alias("base"))
    order = Window.partitionBy(*by).orderBy("value")
    v = v.withColumn("next", F.lead("value").over(order)).withColumn("up", F.sum("gain").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("base").over(Window.partitionBy(*by)))
    c = v.filter("next is not null").select(*by, ((F.col("value") + F.col("next")) / 2).alias("threshold"), F.round(F.col("all") + F.col("up"), 9).alias("score"))
    return c.groupBy(*by).agg(F.max_by("threshold", F.struct("score", -F.col("threshold"))).alias("threshold"), F.max("score").alias("score"))


def loo_abstention(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(qid, threshold, abstains): each row decided by the threshold fitted on all others;
    none where the others have fewer than two values.

    No row meets all others. For each style, scores of all thresholds are running sums with
    that style one row short; a row left out takes its own part from those below it or
    from those above, so the best is a maximum before its value or one after it. Where
    it alone has its value, the thresholds on either side of it become one."""
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("style"))
    rows = rows.filter("value is not null").select("qid", "style", "correct", "value", F.coalesce(w, F.lit(0.0)).alias("w"))
    right = (F.when(F.col("style") == "absent", 1).otherwise(-F.col("correct").cast("int"))).alias("right")
    sizes = rows.groupBy("style", "w").agg(F.count("*").alias("n"))
    # one row a style and value: how many of the style become right, or cease to be, as the threshold passes it
    steps = rows.select("style", "value", right).groupBy("style", "value").agg(F.sum("right").alias("up"))
    values = running(rows.groupBy("value").agg(F.count("*").alias("held")), [F.col("value")], k=F.lit(1))
    nexts = values.select((F.col("k") - 1).alias("k"), F.col("value").alias("next"))
    values = cut(values.join(nexts.hint("merge"), "k", "left"))
    start = rows.filter("style <> 'absent' and correct").groupBy("style").agg(F.count("*").alias("base"))
    sizes = cut(sizes.join(start.hint("merge"), "style", "left").fillna(0, ["base"]))
    parts = steps.join(sizes.hint("merge"), "style").groupBy("value").agg(F.sum(F.col("up") * F.col("w") / F.col("n")).alias("all"))
    everything = sizes.agg(F.sum(F.col("base") * F.col("w") / F.col("n")).alias("base_all"))
    own = F.when(F.col("n") > 1, F.col("w") / (F.col("n") - 1)).otherwise(0.0)
    styles = sizes.withColumn("own", own).select("style", "n", "w", "own", "base")
    grid = values.crossJoin(F.broadcast(styles)).join(parts.hint("merge"), "value").join(steps.hint("merge"), ["style", "value"], "left").fillna(0, ["up"])  # a row a style
    change = F.col("all") + F.col("up") * (F.col("own") - F.col("w") / F.col("n"))
    grid = running(grid.withColumn("change", change), [F.col("style"), F.col("k")], total=F.col("change"))
    ends = grid.filter("next is null").select("style", F.col("total").alias("end"))
    # totals run on through the styles: each starts from where the one before it ended
    begun = running(ends.withColumn("sum", F.lit(0.0)), [F.col("style")], at=F.lit(1)).select("style", "end", "at")
    before = begun.select(F.col("style"), F.col("at")).join(begun.select((F.col("at") + 1).alias("at"), F.col("end").alias("before")).hint("merge"), "at", "left").select("style", F.coalesce("before", F.lit(0.0)).alias("before"))
    grid = grid.join(F.broadcast(before), "style").crossJoin(F.broadcast(everything))
    score = F.round(F.col("base_all") + F.col("base") * (F.col("own") - F.col("w") / F.col("n")) + F.col("total") - F.col("before"), 9)
    at = grid.filter("next is not null").select("style", "k", ((F.col("value") + F.col("next")) / 2).alias("threshold"), score.alias("score"))
    best = F.struct("score", (-F.col("threshold")).alias("minus"))
    at = cut(running_best(running_best(at, ["style"], [F.col("k")], first=best), ["style"], [F.desc("k")], last=best))
    mine = rows.join(values.hint("merge"), "value").join(styles.select("style", "own").hint("merge"), "style")
    mine = mine.withColumn("alone", F.col("held") == 1)
    # up to below: thresholds before the row's value; from above on: those after it
    mine = mine.withColumn("below", F.col("k") - F.when(F.col("alone"), 2).otherwise(1)).withColumn("above", F.col("k") + F.when(F.col("alone"), 1).otherwise(0)).withColumn("mid", F.col("k") - 1)
    j = mine.join(at.select("style", F.col("k").alias("below"), "first").hint("merge"), ["style", "below"], "left")
    j = j.join(at.select("style", F.col("k").alias("above"), "last").hint("merge"), ["style", "above"], "left")
    j = j.join(at.select("style", F.col("k").alias("mid"), F.col("score").alias("mid_score")).hint("merge"), ["style", "mid"], "left")
    j = j.join(values.select((F.col("k") + 1).alias("k"), F.col("value").alias("previous")).hint("merge"), "k", "left")
    low = F.when((F.col("style") != "absent") & F.col("correct"), F.col("own")).otherwise(0.0)
    high = F.when(F.col("style") == "absent", F.col("own")).otherwise(0.0)

    def less(c: str, part: Column) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.round(F.col(f"{c}.score") - part, 9).alias("score"), F.col(f"{c}.minus").alias("minus")))

    between = F.col("alone") & F.col("previous").isNotNull() & F.col("next").isNotNull()
    joined = F.when(between, F.struct(F.round(F.col("mid_score") - low, 9).alias("score"), (-(F.col("previous") + F.col("next")) / 2).alias("minus")))
    pick = F.array_max(F.filter(F.array(less("first", low), less("last", high), joined), lambda x: x.isNotNull()))
    out = j.withColumn("pick", pick).filter("pick is not null").withColumn("threshold", -F.col("pick.minus"))
    return out.select("qid", "threshold", (F.col("value") < F.col("threshold")).alias("abstains"))


def confidence_report(rows: DataFrame, value: str = "value") -> DataFrame:
    """(auc, median_right, median_wrong): chance that a right answer's value is above a
    wrong one's, ties half."""
    r = average_ranks(rows.select("correct", F.col(value).alias("v")), "v", "rk")
    np_, nn = F.sum(F.col("correct").cast("long")), F.sum((~F.col("correct")).cast("long"))
    auc = (F.sum(F.when(F.col("correct"), F.col("rk")).otherwise(0.0)) - np_ * (np_ + 1) / 2) / F.nullif(np_ * nn, F.lit(0))
    return r.agg(auc.alias("auc"), F.median(F.when(F.col("correct"), F.col("v"))).alias("median_right"), F.median(F.when(~F.col("correct"), F.col("v"))).alias("median_wrong"))


def top_pick(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """(qid, doc_id, score): the best document, the smaller id on ties. Scores aren't sorted:
    maxima go back to them, and only rows that reach them are compared."""
    keys = [*by, "qid"]
    best = few(scores.groupBy(*keys).agg(F.max(F.round("score", 9)).alias("best")))
    reach = scores.join(best, keys).filter(F.round("score", 9) == F.col("best"))
    return reach.groupBy(*keys).agg(F.min("doc_id").alias("doc_id"), F.min_by("score", "doc_id").alias("score"))


def carrier_word(parts: DataFrame, picks: DataFrame) -> DataFrame:
    """(qid, doc_id, token, share): the word that carried each pick and its share of the score."""
    p = parts.join(picks.select("qid", "doc_id").hint("merge"), ["qid", "doc_id"])
    w = Window.partitionBy("qid", "doc_id")
    r = p.withColumn("share", F.col("part") / F.sum("part").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc(F.round("part", 9)), "token")))
    return r.filter("r = 1").select("qid", "doc_id", "token", "share")


def query_leak_check(queries: DataFrame, counts: DataFrame, targets: DataFrame, stop: list[str], rare: int = 30) -> DataFrame:
    """(qid, words, on_target, rare_on_target, level): how many query words stand on the
    target, and how many of those are rare; leaks from two rare ones, weak from one."""
    t = queries.select("qid", F.explode(F.array_distinct(tokens_of(F.col("text")))).alias("token")).filter(~F.col("token").isin(list(stop)))
    df = counts.groupBy("token").agg(F.count("*").alias("df"))
    on = counts.select(F.col("doc_id").alias("target"), "token").withColumn("hit", F.lit(1))
    j = t.join(targets.select("qid", "target").hint("merge"), "qid").join(df.hint("merge"), "token", "left").join(on.hint("merge"), ["target", "token"], "left")
    g = j.groupBy("qid", "target").agg(F.count("*").alias("words"), F.count("hit").alias("on_target"), F.sum((F.col("hit").isNotNull() & (F.col("df") <= rare)).cast("long")).alias("rare_on_target"))
    return g.withColumn("level", F.when(F.col("rare_on_target") >= 2, "leaks").when(F.col("rare_on_target") == 1, "weak").otherwise("none"))


def candidate_lineup(engines: DataFrame, targets: DataFrame, size: int = 6) -> DataFrame:
    """(qid, doc_id, place): the right answer, then each engine's ranking in turn, without
    repeats, size in all. engines(engine, qid, doc_id, score)."""
    w = Window.partitionBy("engine", "qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    r = engines.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size).select("qid", "doc_id", "rank", "engine")
    every = targets.select("qid", F.col("target").alias("doc_id"), F.lit(0).alias("rank"), F.lit("").alias("engine")).union(r)
    once = every.groupBy("qid", "doc_id").agg(F.min(F.struct("rank", "engine")).alias("o"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("o", "doc_id"))
    return once.withColumn("place", place).filter(F.col("place") <= size).select("qid", "doc_id", "place")


def early_commit(steps: DataFrame, least: int = 2, factor: float = 2.0) -> DataFrame:
    """(qid, option, step, forced): running sums by option; commits at the first step, from
    least on, at which the leader is positive and has factor times the runner-up, else at
    the last. steps(qid, option, step, score), a row for every option and step."""
    run = steps.withColumn("total", F.sum("score").over(Window.partitionBy("qid", "option").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("qid", "step").orderBy(F.desc(F.round("total", 9)), "option")
    two = run.withColumn("r", F.row_number().over(w)).filter("r <= 2").groupBy("qid", "step").agg(F.max_by("option", -F.col("r")).alias("option"), F.max("total").alias("lead"), F.min("total").alias("second"), F.count("*").alias("k"))
    last = F.max("step").over(Window.partitionBy("qid"))
    sure = (F.col("step") >= least) & (F.col("lead") > 0) & ((F.col("k") < 2) | (F.col("lead") >= factor * F.col("second")))
    c = two.withColumn("sure", sure).withColumn("last", last).filter(F.col("sure") | (F.col("step") == F.col("last")))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("step"))).filter("r = 1").select("qid", "option", "step", (~F.col("sure")).alias("forced"))


def review_misses(ranks: DataFrame, picks: DataFrame, reviews: DataFrame) -> DataFrame:
    """(qid, state): reviewed, unreviewed or stale: misses of a ranking against
    reviews(qid, pick), which count only with the same pick."""
    misses = ranks.filter("rank is null or rank > 1").join(picks.select("qid", F.col("doc_id").alias("now")).hint("merge"), "qid", "left")
    j = misses.select("qid", "now", F.lit(True).alias("miss")).join(reviews.hint("merge"), "qid", "full")
    return j.select("qid", F.when(F.col("miss").isNull() | (F.col("pick").isNotNull() & ~F.col("pick").eqNullSafe(F.col("now"))), "stale").when(F.col("pick").isNull(), "unreviewed").otherwise("reviewed").alias("state"))


def candidate_pools(lengths: DataFrame, floor: int, best: DataFrame, n: int) -> DataFrame:
    """(pool, doc_id): "full": documents above a length; "famous": the n of highest best(doc_id, score) among them."""
    full = lengths.filter(F.col("length") >= floor).select(F.lit("full").alias("pool"), "doc_id")
    famous = best.join(full.select("doc_id").hint("merge"), "doc_id", "left_semi").orderBy(F.desc("score"), "doc_id").limit(n).select(F.lit("famous").alias("pool"), "doc_id")
    return full.union(famous)
