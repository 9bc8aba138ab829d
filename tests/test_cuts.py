"""What falls apart when nodes go, against plain searches."""

import random
from collections import Counter

import pytest

from linkscope.operators import lowlink as L
from linkscope.operators import robustness as B
from linkscope.plans import iterate


def tables(spark, nodes, edges):
    return spark.createDataFrame([(i,) for i in nodes], "node long"), spark.createDataFrame(list(edges), "src long, dst long")


def parts(nodes, edges):
    """Components as sets."""
    near = {v: set() for v in nodes}
    for a, b in edges:
        if a in near and b in near and a != b:
            near[a].add(b)
            near[b].add(a)
    left, out = set(nodes), []
    while left:
        todo, seen = [min(left)], {min(left)}
        while todo:
            for w in near[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        out.append(seen)
        left -= seen
    return out


def damage_plain(nodes, edges):
    giant = max(parts(nodes, edges), key=lambda c: (len(c), -min(c)))
    out = {}
    for v in giant:
        rest = parts(giant - {v}, edges)
        out[v] = (len(giant) - 1 - max(map(len, rest), default=0), max(1, len(rest)))
    return out


def graphs():
    r = random.Random(4)
    yield range(1, 31), [(r.randrange(1, 31), r.randrange(1, 31)) for _ in range(32)]
    yield range(60), [(i, r.randrange(i)) for i in range(1, 60)] + [(r.randrange(60), r.randrange(60)) for _ in range(6)]
    yield range(40), [(i, (i + 1) % 40) for i in range(40)] + [(3, 20)]
    yield range(50), [(0, i) for i in range(1, 40)] + [(1, 2), (3, 4), (4, 5), (45, 46)]
    yield range(3), []
    yield range(24), [(a + 6 * k, b + 6 * k) for k in range(4) for a in range(6) for b in range(a)] + [(0, 6), (7, 12), (13, 18)]


@pytest.mark.parametrize("which", range(6))
def test_removal_damage_equals_searches(spark, which):
    nodes, edges = list(graphs())[which]
    n, e = tables(spark, nodes, edges)
    got = {x["removed"]: (x["damage"], x["parts"]) for x in L.removal_damage(n, e, n).collect()}
    assert got == damage_plain(set(nodes), edges)


def test_blocks_of_a_bow_tie(spark):
    """Two triangles that share a node, and a bridge."""
    n, e = tables(spark, range(1, 7), [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (3, 5), (5, 6)])
    got = {x["node"]: x["block"] for x in L.blocks(n, e).collect()}
    assert got[1] is None and got[2] == got[3] and got[4] == got[5] and len({got[2], got[4], got[6]}) == 3


def test_long_path_takes_tens_of_tables(spark, monkeypatch):
    written = []
    real = iterate.cut
    for module in (L, L.connected_components.__globals__, L.running.__globals__):
        target = module if isinstance(module, dict) else vars(module)
        monkeypatch.setitem(target, "cut", lambda df: written.append(1) or real(df))
    n, e = spark.range(1000).withColumnRenamed("id", "node"), spark.range(999).selectExpr("id as src", "id + 1 as dst")
    got = {x["removed"]: (x["damage"], x["parts"]) for x in L.removal_damage(n, e, n).collect()}
    assert got == {i: (min(i, 999 - i), 1 + (0 < i < 999)) for i in range(1000)} and len(written) <= 70


def curve_plain(nodes, edges, order):
    return {t: max((len(c) for c in parts({v for v in nodes if order.get(v, 1 << 60) > t}, edges)), default=0) for t in set(order.values())}


@pytest.mark.parametrize("small", [False, True])
def test_removal_curves_equal_searches(spark, small, monkeypatch):
    """The same whether a sweep is one group or is split at many steps."""
    if small:
        monkeypatch.setattr(B, "GROUP", 5)
        monkeypatch.setattr(B, "FAN", 3)
    r = random.Random(6)
    nodes = list(range(40))
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(70)] + [(0, i) for i in range(1, 25)]
    rows, want = [], Counter()
    for k in range(3):
        order = r.sample(nodes, (40, 12, 25)[k])
        step = {v: 1 + i // (1, 1, 4)[k] for i, v in enumerate(order)}
        rows += [(k, v, s) for v, s in step.items()]
        want.update((k, t, g) for t, g in curve_plain(nodes, edges, step).items())
    n, e = tables(spark, nodes, edges)
    got = B.removal_curve(n, e, spark.createDataFrame(rows, "replicate long, node long, step int"), ["replicate"])
    assert Counter(map(tuple, got.select("replicate", "step", "giant").collect())) == want
    alone = B.removal_curve(n, e, spark.createDataFrame([x[1:] for x in rows if x[0] == 0], "node long, step int"))
    assert {(0, *x) for x in map(tuple, alone.select("step", "giant").collect())} == {x for x in want if x[0] == 0}
    assert B.removal_curve(n, e.limit(0), spark.createDataFrame([(0, 1), (39, 2)], "node long, step int")).collect()[0]["giant"] == 1


def test_maximal_cliques_equal_a_plain_search(spark):
    """A dense graph with a hub that all others link to."""
    from itertools import combinations

    from linkscope.operators import structure as S

    r = random.Random(9)
    edges = {(0, i) for i in range(1, 16)} | {p for p in combinations(range(1, 16), 2) if r.random() < 0.45} | {(20, 21), (21, 22)}
    near = {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in {x for p in edges for x in p}}

    def grow(clique, may, not_):
        if not may and not not_:
            yield tuple(sorted(clique))
        for v in sorted(may):
            yield from grow([*clique, v], may & near[v], not_ & near[v])
            may, not_ = may - {v}, not_ | {v}

    n, e = tables(spark, sorted(near), sorted(edges))
    got = sorted(tuple(x["clique"]) for x in S.maximal_cliques(e, S.core_numbers(n, e)).collect())
    assert got == sorted(grow([], set(near), set()))
