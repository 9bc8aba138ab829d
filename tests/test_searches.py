"""Searches in tasks against plain searches, without a table of rounds."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_balls import distances, made

from linkscope.operators import centrality as C
from linkscope.operators import searches as X
from linkscope.operators import structure as S


@pytest.fixture(autouse=True)
def in_tasks_only(monkeypatch):
    """Joins write their rounds, searches in tasks don't."""
    monkeypatch.setattr(S, "cut", None)
    monkeypatch.setattr(C, "cut", None)


def graph(spark, undirected):
    n, e, edges = made(spark, 300, 90, 5)
    if not undirected:
        r = random.Random(1)
        edges = {x for x in edges if r.random() < 0.7}
        e = spark.createDataFrame(sorted(edges), "src long, dst long")
    nodes = [*range(300), 1000, 1001]
    return n.union(spark.range(1000, 1002)), e, distances(nodes, edges), edges


@pytest.mark.parametrize("undirected", [False, True])
def test_searches_in_tasks(spark, undirected):
    n, e, d, _ = graph(spark, undirected)
    s = n.select(F.col("node").alias("source"))
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(S.bfs(e, s)) == sorted((a, b, k) for a, at in d.items() for b, k in at.items())
    assert rows(S.bfs(e, s, max_hops=2)) == sorted((a, b, k) for a, at in d.items() for b, k in at.items() if k <= 2)
    assert rows(S.distance_counts(e, s)) == sorted((a, k, c) for a, at in d.items() for k, c in Counter(at.values()).items())
    trips = [(a, b, k, d[b][a], k + d[b][a]) for a, at in d.items() for b, k in at.items() if a != b and a in d[b]]
    assert rows(S.round_trips(e, s)) == sorted(trips)
    near = {a for a, _, k, _, _ in trips if 2 <= k <= 3}
    assert rows(S.distance_band_pool(S.round_trips(e, s), 2, 3)) == sorted((a, b, k) for a, b, k, _, _ in trips if 2 <= k <= 3 or a not in near)


@pytest.mark.parametrize("directed", [False, True])
def test_betweenness_in_tasks(spark, directed):
    n, e, d, edges = graph(spark, not directed)
    into = {v: [a for a, b in edges if b == v] for v in d}
    total = dict.fromkeys(d, 0.0)
    for s, at in d.items():
        order, paths, share = sorted(at, key=at.get), {s: 1}, dict.fromkeys(at, 0.0)
        for v in order[1:]:
            paths[v] = sum(paths[u] for u in into[v] if at.get(u) == at[v] - 1)
        for v in reversed(order[1:]):
            for u in into[v]:
                if at.get(u) == at[v] - 1:
                    share[u] += paths[u] / paths[v] * (1 + share[v])
            total[v] += share[v]
    got = dict(C.betweenness(n, e, directed=directed, normalised=False).collect())
    assert got == pytest.approx({v: x * (1.0 if directed else 0.5) for v, x in total.items()}, rel=1e-9) and max(got.values()) > 100


def test_runs_of_links_end_between_nodes(monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    g = X.Links(r.integers(0, 50, 4000), np.append(r.integers(0, 50, 2000), np.full(2000, 7)))
    state = r.integers(0, 1 << 40, (50, 1 << 15)).astype(np.uint64)  # 64 links a run
    seen = {}
    for heads, came in g.met(np.bitwise_or, state):
        seen |= dict(zip(heads.tolist(), came, strict=True))
    for v in range(50):
        assert (seen[v] == np.bitwise_or.reduce(state[np.unique(g.at[g.to == v])])).all()
