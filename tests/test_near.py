"""Trips, eccentricities and betweenness without a table of all pairs and without all links at each step."""

import pytest
from pyspark.sql import functions as F
from test_balls import distances, made
from test_searches import graph

from linkscope.operators import balls as D
from linkscope.operators import centrality as C
from linkscope.operators import searches as X
from linkscope.operators import structure as S


@pytest.mark.parametrize("lo,hi", [(2, 3), (4, 4)])
def test_band_pool_of_near_trips(spark, monkeypatch, lo, hi):
    monkeypatch.setattr(S, "round_trips", None)
    n, e, d, _ = graph(spark, False)
    trips = [(a, b, k) for a, at in d.items() for b, k in at.items() if a != b and a in d[b]]
    some = {a for a, _, k in trips if lo <= k <= hi}
    got = S.distance_band_pool(S.near_trips(n, e, hi), lo, hi).collect()
    assert sorted(map(tuple, got)) == sorted(t for t in trips if lo <= t[2] <= hi or t[0] not in some) and some != {t[0] for t in trips}


def test_eccentricities_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(D, "bfs", None)
    n, e, edges = made(spark, 400, 60, 4)
    want = {v: max(at.values()) for v, at in distances(range(400), edges).items()}
    got = D.bounded_eccentricities(n, e, 8).collect()
    assert {x["node"]: x["eccentricity"] for x in got} == want and {(x["diameter"], x["radius"]) for x in got} == {(max(want.values()), min(want.values()))}
    alone = D.bounded_eccentricities(spark.range(7, 8).withColumnRenamed("id", "node"), e.limit(0)).collect()
    assert [tuple(x) for x in alone] == [(7, 0, 0, 0, True)]


def test_betweenness_follows_live_links(spark, monkeypatch):
    whole = X.sent

    def few(links, back=False):
        g = whole(links, back).value
        g.runs = None  # met, which takes all links, needs them
        return spark.sparkContext.broadcast(g)

    monkeypatch.setattr(X, "sent", few)
    n = spark.range(600).withColumnRenamed("id", "node")
    path = spark.range(599).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = dict(C.betweenness(n, path, directed=True, normalised=False).collect())
    assert got == pytest.approx({v: v * (599.0 - v) for v in range(600)})
