"""Hand graphs with known answers, and invariants."""

import math

import numpy as np
import pytest

from linkscope.operators import centrality as C
from linkscope.operators import community as M
from linkscope.operators import lowlink as L
from linkscope.operators import nulls as N
from linkscope.operators import robustness as B
from linkscope.operators import structure as S
from linkscope.operators import tails as H


def graph(spark, edges, n):
    return spark.createDataFrame([(i,) for i in range(1, n + 1)], "node long"), spark.createDataFrame(edges, "src long, dst long")


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_path(spark):
    n, e = graph(spark, [(1, 2), (2, 3), (3, 4), (4, 5)], 5)
    d = S.bfs(S.symmetrise(e), n.selectExpr("node as source")).cache()
    ecc = S.eccentricities(d).collect()
    assert {r["node"] for r in ecc if r["central"]} == {3} and ecc[0]["diameter"] == 4
    b = as_dict(C.betweenness(n, e, normalised=False), "node", "betweenness")
    assert b == {1: 0, 2: 3, 3: 4, 4: 3, 5: 0}
    damage = L.removal_damage(n, e, n)
    assert {r["node"] for r in L.articulation_points(damage).collect()} == {2, 3, 4}
    assert as_dict(damage, "removed", "damage") == {1: 0, 2: 1, 3: 2, 4: 1, 5: 0}
    path = S.shortest_path(S.symmetrise(e), spark.createDataFrame([(1,)], "source long"), spark.createDataFrame([(1, 5)], "source long, target long")).first()
    assert path["path"] == [1, 2, 3, 4, 5]


def test_star(spark):
    n, e = graph(spark, [(1, 2), (1, 3), (1, 4), (1, 5)], 5)
    assert as_dict(C.betweenness(n, e, normalised=False), "node", "betweenness")[1] == 6
    d = S.bfs(S.symmetrise(e), n.selectExpr("node as source"))
    assert as_dict(C.closeness(n, d), "node", "closeness")[1] == 1
    assert set(as_dict(S.core_numbers(n, e), "node", "core").values()) == {1}
    assert S.degree_assortativity(e).first()["assortativity"] == pytest.approx(-1)
    v = as_dict(C.eigenvector(n, e), "node", "score")
    assert v[1] == pytest.approx(math.sqrt(0.5), abs=1e-6)


def test_two_triangles(spark):
    n, e = graph(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)], 6)
    assert sum(as_dict(S.triangles(n, e), "node", "triangles").values()) == 6
    und = S.undirected(e)
    labels = M.louvain(n, und, seeds=2)
    best = M.best_seed(labels, und)
    assert M.modularity(und, best).first()["q"] == pytest.approx(5 / 14)
    assert M.modularity(und, M.agglomerate(n, und)).first()["q"] == pytest.approx(5 / 14)
    assert M.nmi(best, best).first()["nmi"] == pytest.approx(1)
    one = n.selectExpr("node", "1 as community")
    assert M.modularity(und, one).first()["q"] == pytest.approx(0)
    attack = B.adaptive_attack(n, e, 2).collect()
    assert attack[0]["node"] == 3 and attack[0]["giant"] == 6


def test_strong_components_and_pagerank(spark):
    n, e = graph(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], 7)
    c = as_dict(S.strong_components(n, e), "node", "component")
    assert c[1] == c[2] == c[3] and len({c[i] for i in range(1, 8)}) == 5
    p = as_dict(C.pagerank(n, e), "node", "rank")
    assert sum(p.values()) == pytest.approx(1) and p[5] > p[6]
    s = S.graph_summary(n, e).first()
    assert (s["isolates"], s["sinks"]) == (2, 3)


def test_clique_and_pendant(spark):
    n, e = graph(spark, [(i, j) for i in range(1, 6) for j in range(i + 1, 6)] + [(5, 6)], 6)
    core = S.core_numbers(n, e)
    assert as_dict(core, "node", "core") == {1: 4, 2: 4, 3: 4, 4: 4, 5: 4, 6: 1}
    cliques = sorted(tuple(r["clique"]) for r in S.maximal_cliques(e, core).collect())
    assert cliques == [(1, 2, 3, 4, 5), (5, 6)]
    assert S.k_cliques(e, 4).first()["n"] == 5


@pytest.mark.parametrize("directed", [True, False])
def test_swaps_keep_degrees(spark, directed):
    r = np.random.default_rng(3)
    pairs = sorted({(int(a), int(b)) for a, b in r.integers(1, 30, (80, 2)) if a != b})
    n, e = graph(spark, pairs, 30)
    draws = N.swap_edges(e, 2, directed=directed, per_edge=3)
    base = e if directed else S.undirected(e).selectExpr("a as src", "b as dst")
    for k in (0, 1):
        got = draws.filter(f"replicate = {k}").select("src", "dst")
        rows = got.collect()
        assert len(rows) == len(set(rows)) == base.count() and all(x["src"] != x["dst"] for x in rows)
        want = S.degrees(n, base).select("node", "in_degree" if directed else "degree").collect()
        assert sorted(S.degrees(n, got).select("node", "in_degree" if directed else "degree").collect()) == sorted(want)


def test_tail_recovered(spark):
    r = np.random.default_rng(1)
    k, n = np.unique(np.concatenate([H.draw_tail(r, 1500, 3, 2.5), r.integers(1, 3, 500)]), return_counts=True)
    hist = spark.createDataFrame([("x", int(a), int(b)) for a, b in zip(k, n, strict=True)], "kind string, k long, n long")
    f = H.fit_tails(hist, "kind").first()
    assert f["alpha"] == pytest.approx(2.5, abs=0.2) and f["k_min"] <= 6


def test_empty_graph(spark):
    n, e = graph(spark, [], 2)
    assert S.connected_components(n, e).count() == 2
    assert as_dict(S.degrees(n, e), "node", "degree") == {1: 0, 2: 0}
    assert S.graph_summary(n, e).first()["n_edges"] == 0


def test_removal_curve_is_monotone(spark):
    n, e = graph(spark, [(i, i + 1) for i in range(1, 10)], 10)
    order = spark.createDataFrame([(5, 1), (3, 2), (8, 3)], "node long, step int")
    c = [r["giant"] for r in B.removal_curve(n, e, order).orderBy("step").collect()]
    assert c == [5, 5, 2]


def chain(spark, n, falling=False):
    e = spark.range(1, n).selectExpr("id as src", "id + 1 as dst")
    return spark.range(1, n + 1).selectExpr("id as node"), e.selectExpr("dst as src", "src as dst") if falling else e


def test_components_of_a_long_path(spark):
    n, e = chain(spark, 600)
    assert S.connected_components(n, e).filter("component = 1").count() == 600


def test_strong_components_lose_no_node(spark):
    """A chain of falling ids: every node is trimmed, one after the other."""
    n, e = chain(spark, 12, falling=True)
    loop = e.union(spark.createDataFrame([(1, 3)], "src long, dst long"))
    got = {r["node"]: r["component"] for r in S.strong_components(n, loop).collect()}
    assert got == {i: 3 if i <= 3 else i for i in range(1, 13)}


def test_swaps_that_nothing_allows(spark):
    from linkscope.operators import nulls
    from linkscope.plans.iterate import NotFinished

    star = spark.range(1, 6).selectExpr("cast(0 as bigint) as src", "id as dst")
    with pytest.raises(NotFinished):
        nulls.swap_edges(star, 1, per_edge=1)


def test_swap_improve_ends_at_a_triangle(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4), (4, 5), (5, 6), (4, 6)], "a long, b long")
    start = spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "host long, node long")
    got = sorted(r["node"] for r in M.swap_improve(e, start).collect())
    assert got == [1, 2, 3]


def test_blanks(spark):
    """One sentence a word, the word in it exactly once and gone, decoys not in it."""
    from linkscope.operators import relations as L

    lines = spark.createDataFrame([(1, 0, "The stone wall and the stone path met"), (1, 1, "A Stone lay there"), (2, 0, "Water and river and cloud"), (2, 1, "mountains rise")], "doc_id long, pos int, sentence string")
    targets = spark.createDataFrame([("stone", 8), ("river", 9), ("cloud", 10), ("water", 11), ("mountain", 12), ("forest", 13)], "token string, uses long")
    got = {r["token"]: r for r in L.concordance_blanks(targets, lines).collect()}
    assert "mountain" not in got and "forest" not in got
    assert got["stone"]["blanked"] == "A ____ lay there" and len(got["stone"]["options"]) == 3 and "stone" not in got["stone"]["options"]
    for word in ("river", "cloud", "water"):
        assert set(got[word]["options"]) == {"stone", "mountain", "forest"} or word not in got
