"""Searches whose queries go to the documents."""

import random

from linkscope.operators import retrieval as R
from linkscope.operators import text as T
from linkscope.queries import evidence as E


def scores(spark):
    r = random.Random(2)
    rows = [(q, d, r.choice([0.25, 0.5, 0.75])) for q in range(6) for d in range(30) if r.random() < 0.7]
    return rows, spark.createDataFrame([*rows, (9, 1, 0.5)], "qid long, doc_id long, score double")


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge"), df._jdf.queryExecution().executedPlan().toString()


def test_scores_are_not_shuffled_for_ranks(spark):
    rows, s = scores(spark)
    t = spark.createDataFrame([(q, q + 3) for q in range(8)], "qid long, target long")
    own = {(q, d): x for q, d, x in rows}
    want = {q: sum(x >= own[q, q + 3] for p, _, x in rows if p == q) if (q, q + 3) in own else None for q in range(8)}
    got = R.rank_of_target(s, t)
    assert {x["qid"]: x["rank"] for x in got.collect()} == want
    assert joins(got)[0] <= 1 and "BroadcastHashJoin" in joins(got)[1]


def test_standout_takes_the_second_of_equal_bests(spark):
    rows, s = scores(spark)
    got = {x["qid"]: x for x in R.standout(s, 40).collect()}
    for q in range(6):
        x = sorted((v for p, _, v in rows if p == q), reverse=True)
        mean, sq = sum(x) / 40, sum(v * v for v in x) / 40
        assert abs(got[q]["gap"] - (x[0] - x[1]) / (sq - mean * mean) ** 0.5) < 1e-9
    assert abs(got[9]["gap"] - got[9]["best"] / (0.25 / 40 - (0.5 / 40) ** 2) ** 0.5) < 1e-9


def test_search_joins_no_weights_by_word(spark):
    unit = spark.createDataFrame([(d, f"w{d % 5}", 0.5) for d in range(40)], "doc_id long, token string, w double")
    q = spark.createDataFrame([(1, "w1", 1.0), (1, "w2", 0.5), (2, "w9", 1.0)], "qid long, token string, w double")
    got = R.sparse_search(q, unit)
    assert {(x["qid"], x["doc_id"]): x["score"] for x in got.collect()} == {(1, d): 0.5 if d % 5 == 1 else 0.25 for d in range(40) if d % 5 in (1, 2)}
    assert "SortMergeJoin" not in joins(got)[1]


def test_capped_sample_reads_on_where_one_document_has_the_first_rows(spark):
    rows = [(1, p) for p in range(5000)] + [(d, 0) for d in range(2, 30)]
    got = T.capped_sample(spark.createDataFrame(rows, "doc_id long, pos long"), 3, 3, 20)
    assert got.count() == 20 and got.filter("doc_id = 1").count() == 3
    many = T.capped_sample(spark.createDataFrame([(d, p) for d in range(500) for p in range(9)], "doc_id long, pos long"), 3, 3, 20)
    assert "Window" not in joins(many)[1] and many.count() == 20


def test_mentions_are_runs(spark, tmp_path):
    """A text isn't searched again for each item."""
    spark.createDataFrame([(1, "The Copper mine"), (2, "12 a"), (3, "silver"), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["copper", "a copper-mine", "copper_mine xcopper copperé", "(COPPER)\n", "so, Silver; silver.", "silvery 1silver", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = E.fn8(spark, str(tmp_path))
    assert {x["item_id"]: x["documents"] for x in got.collect()} == {1: 3, 3: 1}
    assert "RLIKE" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_weights_take_one_shuffle_by_document(spark):
    from linkscope.operators import vectors as V

    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 4), (3, "c", 5)], "doc_id long, token string, tf long")
    got = V.unit_rows(V.tfidf(counts, 3))
    plan = joins(got)[1].split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= 1 and "SortMergeJoin" not in plan
    w = {(x["doc_id"], x["token"]): x["w"] for x in got.collect()}
    assert w[2, "a"] == w[3, "c"] == 1.0 and abs(w[1, "a"] ** 2 + w[1, "b"] ** 2 - 1) < 1e-12 and w[1, "b"] > w[1, "a"] > 0
