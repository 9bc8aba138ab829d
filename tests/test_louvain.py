"""Louvain's node tables aren't sent through the driver."""

import re

from linkscope.operators import community as M


def test_only_tables_of_a_row_a_seed_are_broadcast(spark, monkeypatch):
    links = [(10 * g + i, 10 * g + j, 1.0) for g in range(3) for i in range(5) for j in range(i)] + [(0, 10, 1.0), (10, 20, 1.0)]
    e = spark.createDataFrame(links, "a long, b long, weight double")
    nodes = e.select("a").union(e.select("b")).distinct().withColumnRenamed("a", "node")
    plans, cut = [], M.cut
    monkeypatch.setattr(M, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    runs = M.louvain(nodes, e, seeds=2, max_levels=2, max_moves=3)
    plans.append(M.flip_counts(runs, M.best_seed(runs, e))._jdf.queryExecution().executedPlan().toString())
    plans.append(M.partition_stability(runs)._jdf.queryExecution().executedPlan().toString())
    joins = {re.sub(r"#\d+L?", "", j) for p in plans for j in re.findall(r"BroadcastHashJoin (\[.*?\], \[.*?\]),", p)}
    assert joins <= {"[seed], [seed]", "[seed_a], [seed_a]", "[seed_b], [seed_b]", "[seed_a, seed_b], [seed_a, seed_b]"}, joins
    assert runs.count() == 30


def test_labels_that_hold_for_all_replicates(spark):
    e = spark.createDataFrame([(r, a, b) for r, step in ((0, 1), (1, 2), (2, 3)) for a in range(8) for b in [(a + step) % 8]], "replicate long, a long, b long")
    lab = spark.range(8).selectExpr("id as node", "nullif(id % 3, 2) as community")
    each = lab.crossJoin(e.select("replicate").distinct())
    got, want = ({x["replicate"]: round(x["q"], 12) for x in M.modularity(e, labels, ["replicate"]).collect()} for labels in (lab, each))
    assert got == want and len(got) == 3
