"""Distances by sketches and bounds, against searches from every node."""

import random

import pytest

from linkscope.operators import balls as D
from linkscope.operators import structure as S


def distances(nodes, edges):
    near = {v: set() for v in nodes}
    for a, b in edges:
        near[a].add(b)
    out = {}
    for s in nodes:
        at, ring, d = {s: 0}, {s}, 0
        while ring:
            d += 1
            ring = {w for v in ring for w in near[v]} - at.keys()
            at |= dict.fromkeys(ring, d)
        out[s] = at
    return out


def made(spark, n, m, seed):
    r = random.Random(seed)
    edges = {(i, r.randrange(i // 2, i)) for i in range(1, n)} | {(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b}
    edges |= {(b, a) for a, b in edges}
    return spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(sorted(edges), "src long, dst long"), edges


def test_ball_measures_are_near(spark):
    n, e, edges = made(spark, 120, 40, 3)
    d = distances(range(120), edges)
    got = {x["node"]: x for x in D.ball_measures(n, e).collect()}
    for v, at in d.items():
        far = [x for x in at.values() if x]
        assert got[v]["reached"] == pytest.approx(len(far), rel=0.06)
        assert got[v]["total_dist"] == pytest.approx(sum(far), rel=0.12) and got[v]["harmonic"] == pytest.approx(sum(1 / x for x in far), rel=0.1)
        assert got[v]["depth"] <= max(far)
    one = D.path_length_estimate(D.ball_measures(n, e)).first()
    pairs = [x for at in d.values() for x in at.values() if x]
    assert one["aspl"] == pytest.approx(sum(pairs) / len(pairs), rel=0.05)
    alone = D.ball_measures(spark.range(3).withColumnRenamed("id", "node"), e.limit(0)).collect()
    assert [round(x["reached"]) for x in alone] == [0, 0, 0]


def test_balls_of_few_links_take_no_rounds_of_joins(spark, monkeypatch):
    n, e, edges = made(spark, 400, 300, 4)
    e = e.filter("src % 3 > 0 or src < dst")
    d = distances(range(400), [(a, b) for a, b in edges if a % 3 > 0 or a < b])
    monkeypatch.setattr(D, "cut", None)
    got = {x["node"]: x for x in D.ball_measures(n.union(spark.range(900, 901)), e.union(spark.createDataFrame([(5, 901)], "src long, dst long"))).collect()}
    assert got.pop(900)[1:] == (0.0, 0.0, 0.0, 0)
    for v, at in d.items():
        far = [x for x in at.values() if x]
        assert got[v]["reached"] == pytest.approx(len(far), rel=0.06, abs=0.1) and got[v]["depth"] <= max(far, default=0)
        assert got[v]["total_dist"] == pytest.approx(sum(far), rel=0.12, abs=0.1) and got[v]["harmonic"] == pytest.approx(sum(1 / x for x in far), rel=0.1, abs=0.1)


@pytest.mark.parametrize("seed", [1, 2])
def test_bounded_eccentricities_are_exact(spark, seed):
    n, e, edges = made(spark, 60, (0, 20)[seed - 1], seed)
    d = distances(range(60), edges)
    got = D.bounded_eccentricities(n, e).collect()
    assert {x["node"]: x["eccentricity"] for x in got} == {v: max(at.values()) for v, at in d.items()}
    plain = S.eccentricities(S.bfs(e, n.selectExpr("node as source")))
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain.select(*got[0].asDict()).collect()))
