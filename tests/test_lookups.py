"""Distances of given pairs: nothing but these leaves a task."""

import random

import pytest
from pyspark.sql import functions as F
from test_searches import graph

from linkscope.operators import searches as X
from linkscope.operators import structure as S


@pytest.fixture(autouse=True)
def no_table_of_all_pairs(monkeypatch):
    monkeypatch.setattr(S, "bfs", None)
    monkeypatch.setattr(S, "distances", None)


@pytest.mark.parametrize("undirected", [False, True])
def test_distance_lookup(spark, monkeypatch, undirected):
    monkeypatch.setattr(X, "WORDS", 1)
    n, e, d, _ = graph(spark, undirected)
    r, nodes = random.Random(2), sorted(d)
    asked = [(a, b) for a in nodes for b in [a, *r.sample(nodes, 7)]] + [(1, 5000), (5000, 1)]
    asked += asked[:20]  # asked twice, told twice
    got = S.distance_lookup(spark.createDataFrame(asked, "a long, b long"), e).collect()
    assert sorted(map(str, got)) == sorted(f"Row(a={a}, b={b}, dist={d.get(a, {}).get(b)})" for a, b in asked)


def test_asymmetric_links(spark):
    _, e, d, edges = graph(spark, False)
    pairs = e.select(F.col("dst").alias("source"), F.col("src").alias("node"))
    got = S.asymmetric_links(e, S.distances_between(e, pairs), 4).collect()
    want = {(a, b, d[b].get(a)) for a, b in edges if d[b].get(a, 4) >= 4}
    assert set(map(tuple, got)) == want and len(got) == len(want) > 50
