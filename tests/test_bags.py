"""Searches in bags of words against searches in rows of words."""

import pytest

from linkscope.operators import retrieval as R
from linkscope.operators import text as T
from linkscope.operators import vectors as V
from linkscope.plans.iterate import cut
from linkscope.queries import sets

TEXTS = [(1, "The cat, the CAT and a dog"), (2, "a dog ate; a fish"), (3, None), (4, ""), (5, "Größe 7 Kelvin"), (1, "the end"), (6, "one one one"), (7, "the mouse of the house"), (8, "123")]


@pytest.fixture(scope="module")
def docs(spark):
    return cut(spark.createDataFrame(TEXTS, "doc_id long, text string"))


def test_bags_hold_the_words_of_rows(docs):
    bags = cut(T.word_bags(docs))
    want = {(r.doc_id, r.token): r.tf for r in T.term_counts(T.tokenize(docs)).collect()}
    assert {(r.doc_id, r.token): r.tf for r in T.bag_rows(bags).collect()} == want
    assert {r.token: r.df for r in T.bag_frequencies(bags).collect()} == {t: sum(k[1] == t for k in want) for _, t in want}
    assert {r.doc_id: r.n for r in bags.collect()} == {d: sum(n for (i, _), n in want.items() if i == d) for d, _ in want}


@pytest.mark.parametrize(("words", "rows"), [(10, 100), (0, 100), (2, 100), (10, 0)])
def test_scores_are_those_of_rows(spark, docs, monkeypatch, words, rows):
    """Words and query words that are sent to all tasks, and those that are joined."""
    q = spark.createDataFrame([(10, "the cat and the dog"), (20, "one fish nowhere"), (30, "nothing here"), (40, None)], "qid long, text string")
    n = docs.count()
    bags = cut(T.word_bags(docs))
    df = cut(T.bag_frequencies(bags))
    unit = cut(V.unit_rows(V.tfidf(T.term_counts(T.tokenize(docs)), n)))
    sparse = R.sparse_search(R.query_weights(q, df, n), unit)
    binary = R.binary_query_search(q, unit)
    monkeypatch.setattr(V, "FEW_WORDS", words)
    monkeypatch.setattr(R, "FEW_ROWS", rows)
    lengths, known = V.bag_lengths(bags, df, n), R.known_words(q, df)
    table = lambda s: sorted((r.qid, r.doc_id, round(r.score, 9)) for r in s.collect())
    assert table(R.bag_search(R.query_weights(q, known, n), bags, lengths, known, n)) == table(sparse)
    assert table(R.bag_search(R.binary_weights(q, known), bags, lengths, known, n)) == table(binary)


def test_no_score_is_shuffled_or_sorted(spark):
    scores = cut(spark.createDataFrame([(1, 5, 0.5), (1, 3, 0.5 + 1e-12), (1, 9, 0.1), (2, 4, 0.2)], "qid long, doc_id long, score double"))
    pick = R.top_pick(scores)
    assert {(r.qid, r.doc_id) for r in pick.collect()} == {(1, 3), (2, 4)}
    plan = pick._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortAggregate" not in plan


def test_short_items_have_targets(spark, tmp_path):
    """Items of any number of words: found in the first document that has their text."""
    texts = [(1, "xa rare word indeed"), (2, "none"), (3, "a rare word in the other"), (4, "rare"), (5, "a-b"), (6, None)]
    items = [(10, "a rare word in"), (20, "rare word"), (30, "a rare wor"), (40, "-"), (50, "not there at all"), (60, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r.qid, r.target) for r in sets.targets(spark, str(tmp_path)).collect()} == {(10, 1), (20, 1), (30, 1), (40, 5)}
