"""Queries on the order-succession graph: structure, centrality, robustness, nulls, arrival."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkscope.operators import balls as D
from linkscope.operators import lowlink as L
from linkscope.operators import structure as S
from linkscope.plans.iterate import cut
from linkscope.queries.registry import CC, DIST, UDIST, W, query
from linkscope.sources.fixtures import customers, handovers, successions


def f1(spark, sf):
    return customers(spark, sf), successions(spark, sf)


def r(c, n=6):
    return F.round(c, n).alias(c) if isinstance(c, str) else F.round(c, n)


def all_dist(spark, sf):
    n, e = f1(spark, sf)
    return S.bfs(e, n.select(F.col("node").alias("source")))


def all_counts(spark, sf):
    n, e = f1(spark, sf)
    return S.distance_counts(e, n.select(F.col("node").alias("source")))


def all_ucounts(spark, sf):
    n, e = f1(spark, sf)
    return S.distance_counts(S.symmetrise(e), n.select(F.col("node").alias("source")))


def giant_counts(spark, sf):
    """Distances inside the largest component, which no link leaves."""
    n, e = f1(spark, sf)
    big = cut(S.giant(S.connected_components(n, e)))
    return S.distance_counts(S.induced_subgraph(S.symmetrise(e), big), big.select(F.col("node").alias("source")))


@query("gr1_degrees", f"{W} SELECT node, in_degree, out_degree, degree FROM deg")
def gr1(spark, sf):
    return S.degrees(*f1(spark, sf))


HAND = "WITH h AS (SELECT CAST(user_id AS BIGINT) AS src, lead(CAST(user_id AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst FROM events), hw AS (SELECT src, dst, count(*) AS weight FROM h WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst), hn AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS node FROM events)"


@query("gr2_strengths", f"{HAND} SELECT n.node, CAST(coalesce(sum(w.weight), 0) AS BIGINT) AS strength FROM hn n LEFT JOIN (SELECT src AS node, weight FROM hw UNION ALL SELECT dst, weight FROM hw) w USING (node) GROUP BY n.node")
def gr2(spark, sf):
    from linkscope.sources.fixtures import read

    return S.strengths(read(spark, sf, "events").select(F.col("user_id").cast("long").alias("node")).distinct(), handovers(spark, sf))


@query("src4_weighted_undirected", f"{HAND} SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM hw GROUP BY 1, 2")
def src4(spark, sf):
    return S.weighted_undirected(handovers(spark, sf))


@query("gr3_symmetrise", f"{W} SELECT src, dst FROM sym")
def gr3(spark, sf):
    return S.symmetrise(successions(spark, sf))


@query("gr4_adjacency", f"{W} SELECT n.node, coalesce((SELECT string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) FROM edges WHERE src = n.node), '') AS successors, coalesce((SELECT string_agg(CAST(src AS VARCHAR), ' ' ORDER BY src) FROM edges WHERE dst = n.node), '') AS predecessors FROM nodes n")
def gr4(spark, sf):
    a = S.adjacency(*f1(spark, sf))
    return a.select("node", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("successors", "predecessors")])


@query("gr5_graph_summary", f"{W} SELECT count(*) AS n_nodes, CAST(sum(out_degree) AS BIGINT) AS n_edges, CAST(sum(CAST(degree = 0 AS INT)) AS BIGINT) AS isolates, CAST(sum(CAST(out_degree = 0 AS INT)) AS BIGINT) AS sinks, CAST(sum(CAST(in_degree = 0 AS INT)) AS BIGINT) AS sources, round(avg(degree), 6) AS mean_degree, CAST(max(degree) AS BIGINT) AS max_degree, CAST(median(degree) AS DOUBLE) AS median_degree, round(sum(out_degree) / (count(*) * (count(*) - 1.0)), 9) AS density FROM deg")
def gr5(spark, sf):
    g = S.graph_summary(*f1(spark, sf))
    return g.withColumn("mean_degree", r("mean_degree")).withColumn("density", r("density", 9))


@query("gr6_top_degree_share", f"{W} SELECT node, in_degree, round(in_degree / t.total, 6) AS link_share, round(in_degree / (t.n - 1.0), 6) AS hub_share, round(sum(in_degree) OVER () / t.total, 6) AS top_share FROM (SELECT * FROM deg ORDER BY in_degree DESC, node LIMIT 10), (SELECT CAST(sum(in_degree) AS DOUBLE) AS total, count(*) AS n FROM deg) t")
def gr6(spark, sf):
    return S.top_degree_share(S.degrees(*f1(spark, sf))).select("node", "in_degree", r("link_share"), r("hub_share"), r("top_share"))


@query("gr7_degree_distribution", f"{W} SELECT degree AS k, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM nodes), 6) AS p FROM deg WHERE degree > 0 GROUP BY degree")
def gr7(spark, sf):
    return S.degree_distribution(S.degrees(*f1(spark, sf))).select("k", "n", r("p"))


@query("gr8_ccdf", f"{W} SELECT DISTINCT a.degree AS k, round((SELECT count(*) FROM deg b WHERE b.degree >= a.degree) / (SELECT CAST(count(*) AS DOUBLE) FROM deg WHERE degree > 0), 6) AS p FROM deg a WHERE a.degree > 0")
def gr8(spark, sf):
    return S.ccdf(S.degrees(*f1(spark, sf)), "degree").select("k", r("p"))


@query("gr9_ccdf_band", f"{W}, runs AS (SELECT c_nationkey AS run, degree AS v FROM deg JOIN customer ON c_custkey = node WHERE degree > 0), p AS (SELECT z.run, k, (SELECT count(*) FROM runs b WHERE b.run = z.run AND b.v >= k) / CAST(z.n AS DOUBLE) AS p FROM (SELECT run, count(*) AS n FROM runs GROUP BY run) z, range(1, 11) t(k)) SELECT CAST(k AS INT) AS k, round(quantile_cont(p, 0.05), 6) AS p05, round(quantile_cont(p, 0.5), 6) AS p50, round(quantile_cont(p, 0.95), 6) AS p95 FROM p GROUP BY k")
def gr9(spark, sf):
    from linkscope.sources.fixtures import read

    d = S.degrees(*f1(spark, sf)).join(read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("node"), F.col("c_nationkey").alias("run")), "node")
    return S.ccdf_band(d, "degree", "run", 10).select("k", r("p05"), r("p50"), r("p95"))


@query("gr10_loglog_slope", f"{W} SELECT round(regr_slope(log10(out_degree), log10(in_degree)), 6) AS slope, round(regr_intercept(log10(out_degree), log10(in_degree)), 6) AS intercept FROM deg WHERE in_degree > 0 AND out_degree > 0")
def gr10(spark, sf):
    return S.loglog_slope(S.degrees(*f1(spark, sf)), "in_degree", "out_degree").select(r("slope"), r("intercept"))


@query("gr11_correlations", f"{W}, k AS (SELECT in_degree AS x, out_degree AS y, rank() OVER (ORDER BY in_degree) + (count(*) OVER (PARTITION BY in_degree) - 1) / 2.0 AS rx, rank() OVER (ORDER BY out_degree) + (count(*) OVER (PARTITION BY out_degree) - 1) / 2.0 AS ry FROM deg) SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k")
def gr11(spark, sf):
    return S.correlations(S.degrees(*f1(spark, sf)), "in_degree", "out_degree").select("n", r("pearson"), r("spearman"))


@query("gr12_reciprocity", f"{W} SELECT count(*) AS n_edges, count(b.src) AS reciprocated, round(count(b.src) / CAST(count(*) AS DOUBLE), 6) AS reciprocity FROM edges a LEFT JOIN edges b ON b.src = a.dst AND b.dst = a.src")
def gr12(spark, sf):
    return S.reciprocity(successions(spark, sf)).select("n_edges", "reciprocated", r("reciprocity"))


@query("gr13_connected_components", f"{W}, {CC} SELECT node, component FROM cc")
def gr13(spark, sf):
    return S.connected_components(*f1(spark, sf))


@query("gr14_islands", f"{W}, {CC} SELECT (SELECT count(*) FROM sizes WHERE size > 1) - 1 AS n_islands, (SELECT count(*) FROM sizes WHERE size = 1) AS n_isolates")
def gr14(spark, sf):
    return S.islands(S.connected_components(*f1(spark, sf)))


@query("gr15_strong_components", f"{W}, {DIST}, scc AS (SELECT a.source AS node, max(a.node) AS component FROM dist a JOIN dist b ON b.source = a.node AND b.node = a.source GROUP BY a.source) SELECT node, component FROM scc")
def gr15(spark, sf):
    return S.strong_components(*f1(spark, sf))


@query("gr16_induced_subgraph", f"{W}, {CC} SELECT src, dst FROM edges WHERE src IN (SELECT node FROM big) AND dst IN (SELECT node FROM big)")
def gr16(spark, sf):
    n, e = f1(spark, sf)
    return S.induced_subgraph(e, S.giant(S.connected_components(n, e)))


@query("gr17_bfs", f"{W}, {DIST} SELECT source, node, dist FROM dist")
def gr17(spark, sf):
    return all_dist(spark, sf)


@query("gr18_shortest_path", f"""{W}, {DIST}, t AS (SELECT min(node) AS source FROM nodes WHERE node IN (SELECT src FROM edges)), pred AS (SELECT y.node, min(x.node) AS p FROM dist x JOIN edges e ON e.src = x.node JOIN dist y ON y.node = e.dst AND y.source = x.source JOIN t ON t.source = x.source WHERE y.dist = x.dist + 1 GROUP BY y.node), path AS (WITH RECURSIVE w(target, node, path) AS (SELECT node, node, CAST(node AS VARCHAR) FROM nodes UNION ALL SELECT w.target, p.p, p.p || ' ' || w.path FROM w JOIN pred p ON p.node = w.node JOIN t ON true WHERE w.node <> t.source) SELECT target, path FROM w JOIN t ON w.node = t.source) SELECT t.source, n.node AS target, path.path FROM nodes n CROSS JOIN t LEFT JOIN path ON path.target = n.node""")
def gr18(spark, sf):
    n, e = f1(spark, sf)
    s = e.agg(F.min("src").alias("source"))
    t = n.select(F.col("node").alias("target")).crossJoin(F.broadcast(s)).select("source", "target")
    return S.shortest_path(e, s, t).select("source", "target", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"))


@query("gr19_round_trips", f"{W}, {DIST} SELECT a.source, a.node, a.dist AS out_dist, b.dist AS back_dist, a.dist + b.dist AS total FROM dist a JOIN dist b ON b.source = a.node AND b.node = a.source WHERE a.source <> a.node")
def gr19(spark, sf):
    n, e = f1(spark, sf)
    return S.round_trips(e, n.select(F.col("node").alias("source")))


@query("gr20_distance_band_pool", f"{W}, {DIST}, t AS (SELECT a.source, a.node, a.dist AS out_dist FROM dist a JOIN dist b ON b.source = a.node AND b.node = a.source WHERE a.source <> a.node), u AS (SELECT *, max(CAST(out_dist BETWEEN 2 AND 4 AS INT)) OVER (PARTITION BY source) AS has_any FROM t) SELECT source, node, out_dist FROM u WHERE out_dist BETWEEN 2 AND 4 OR has_any = 0")
def gr20(spark, sf):
    n, e = f1(spark, sf)
    return S.distance_band_pool(S.near_trips(n, e, 4), 2, 4)


@query("gr21_distance_histogram", f"{W}, {UDIST} SELECT dist, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(sum(dist * count(*)) OVER () / sum(count(*)) OVER (), 6) AS mean FROM udist WHERE dist > 0 GROUP BY dist")
def gr21(spark, sf):
    return S.distance_histogram(all_ucounts(spark, sf)).select("dist", "n", r("share"), r("mean"))


@query("gr22_eccentricity", f"{W}, {CC}, {UDIST}, e AS (SELECT source AS node, max(dist) AS eccentricity FROM udist WHERE source IN (SELECT node FROM big) GROUP BY source) SELECT node, eccentricity, max(eccentricity) OVER () AS diameter, min(eccentricity) OVER () AS radius, eccentricity = min(eccentricity) OVER () AS central FROM e")
def gr22(spark, sf):
    return S.eccentricities(giant_counts(spark, sf))


@query("gr22_eccentricity_by_bounds", f"{W}, {CC}, {UDIST}, e AS (SELECT source AS node, max(dist) AS eccentricity FROM udist WHERE source IN (SELECT node FROM big) GROUP BY source) SELECT node, eccentricity, max(eccentricity) OVER () AS diameter, min(eccentricity) OVER () AS radius, eccentricity = min(eccentricity) OVER () AS central FROM e")
def gr22b(spark, sf):
    n, e = f1(spark, sf)
    big = cut(S.giant(S.connected_components(n, e)))
    return D.bounded_eccentricities(big, S.induced_subgraph(S.symmetrise(e), big))


@query("gr23_path_length_estimate")
def gr23e(spark, sf):
    """All nodes; sketches of 4,096 registers."""
    n, e = f1(spark, sf)
    return D.path_length_estimate(D.ball_measures(n, S.symmetrise(e)))


@query("gr24_reachability_estimate")
def gr24e(spark, sf):
    """Along the arrows."""
    return D.ball_measures(*f1(spark, sf)).select("node", r("reached"), r("total_dist"), "depth")


@query("ce1_closeness_estimate")
def ce1e(spark, sf):
    n, e = f1(spark, sf)
    return D.closeness_estimate(D.ball_measures(n, S.symmetrise(e)), n.count()).select("node", r("closeness"))


@query("gr23_aspl", f"{W}, {CC}, {UDIST} SELECT round(avg(dist), 6) AS aspl, max(dist) AS diameter FROM udist WHERE source IN (SELECT node FROM big) AND dist > 0")
def gr23(spark, sf):
    return S.average_path_length(giant_counts(spark, sf)).select(r("aspl"), "diameter")


@query("gr24_reachability", f"{W}, {DIST} SELECT count(*) AS pairs, round(count(*) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1.0)), 6) AS share, round(avg(dist), 6) AS mean_dist FROM dist WHERE dist > 0")
def gr24(spark, sf):
    return S.reachability(all_counts(spark, sf), customers(spark, sf).count()).select("pairs", r("share"), r("mean_dist"))


@query("gr25_asymmetric_links", f"{W}, {DIST} SELECT e.src, e.dst, d.dist AS back FROM edges e LEFT JOIN dist d ON d.source = e.dst AND d.node = e.src WHERE d.dist IS NULL OR d.dist >= 5")
def gr25(spark, sf):
    e = cut(successions(spark, sf))
    return S.asymmetric_links(e, S.distances_between(e, e.select(F.col("dst").alias("source"), F.col("src").alias("node"))))


TRI = "tri AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM und x JOIN und y ON y.a = x.b JOIN und z ON z.a = x.a AND z.b = y.b), nt AS (SELECT n.node, count(t.v) AS triangles FROM nodes n LEFT JOIN (SELECT p AS v FROM tri UNION ALL SELECT q FROM tri UNION ALL SELECT r FROM tri) t ON t.v = n.node GROUP BY n.node)"


@query("gr26_triangles", f"{W}, {TRI} SELECT node, triangles FROM nt")
def gr26(spark, sf):
    return S.triangles(*f1(spark, sf))


@query("gr27_clustering", f"{W}, {TRI} SELECT round(avg(CASE WHEN degree > 1 THEN triangles / (degree * (degree - 1) / 2.0) ELSE 0 END), 6) AS average_clustering, round(sum(triangles) / sum(degree * (degree - 1) / 2.0), 6) AS transitivity, CAST(sum(triangles) / 3 AS BIGINT) AS triangles FROM nt JOIN deg USING (node)")
def gr27(spark, sf):
    return S.clustering(*f1(spark, sf)).select(r("average_clustering"), r("transitivity"), "triangles")


@query("gr28_core_numbers")
def gr28(spark, sf):
    return S.core_numbers(*f1(spark, sf))


@query("gr29_assortativity", f"{W} SELECT round(corr(a.degree, b.degree), 6) AS assortativity FROM sym s JOIN deg a ON a.node = s.src JOIN deg b ON b.node = s.dst")
def gr29(spark, sf):
    return S.degree_assortativity(successions(spark, sf)).select(r("assortativity"))


@query("gr29_directed_assortativity", f"{W}, x AS (SELECT a.in_degree AS si, a.out_degree AS so, b.in_degree AS ti, b.out_degree AS tt FROM edges e JOIN deg a ON a.node = e.src JOIN deg b ON b.node = e.dst) SELECT 'in_in' AS variant, round(corr(si, ti), 6) AS assortativity FROM x UNION ALL SELECT 'in_out', round(corr(si, tt), 6) FROM x UNION ALL SELECT 'out_in', round(corr(so, ti), 6) FROM x UNION ALL SELECT 'out_out', round(corr(so, tt), 6) FROM x")
def gr29d(spark, sf):
    return S.directed_assortativity(*f1(spark, sf)).select("variant", r("assortativity"))


@query("gr30_neighbour_degree", f"{W}, m AS (SELECT s.src, avg(d.degree) AS mean, count(*) AS k FROM sym s JOIN deg d ON d.node = s.dst GROUP BY s.src) SELECT k, round(avg(mean), 6) AS knn, count(*) AS n FROM m GROUP BY k")
def gr30(spark, sf):
    return S.neighbour_degree(successions(spark, sf)).select("k", r("knn"), "n")


#: Cliques of up to six nodes that no further node extends.
CLIQUES = ", ".join([f"{W}, k2 AS (SELECT a AS v1, b AS v2 FROM und)", *(f"k{i} AS (SELECT k.*, u1.b AS v{i} FROM k{i - 1} k " + " ".join(f"JOIN und u{j} ON u{j}.a = k.v{j}" + ("" if j == 1 else f" AND u{j}.b = u1.b") for j in range(1, i)) + ")" for i in range(3, 7))])


def _maximal(i: int) -> str:
    return f"SELECT CAST({i} AS INT) AS size, count(*) AS n FROM k{i} k WHERE NOT EXISTS (SELECT 1 FROM sym s1 " + " ".join(f"JOIN sym s{j} ON s{j}.src = k.v{j} AND s{j}.dst = s1.dst" for j in range(2, i + 1)) + " WHERE s1.src = k.v1) HAVING count(*) > 0"


@query("gr31_clique_sizes", f"{CLIQUES} " + " UNION ALL ".join(map(_maximal, range(2, 7))))
def gr31(spark, sf):
    n, e = f1(spark, sf)
    return S.maximal_cliques(e, S.core_numbers(n, e)).groupBy("size").agg(F.count("*").alias("n"))


@query("gr32_k_cliques", f"{W}, {TRI} SELECT 3 AS k, count(*) AS n FROM tri")
def gr32(spark, sf):
    return S.k_cliques(successions(spark, sf), 3)


@query("gr33_neighbour_overlap", f"{W} SELECT u.a, u.b, (SELECT count(*) FROM sym x JOIN sym y ON y.dst = x.dst WHERE x.src = u.a AND y.src = u.b) AS shared FROM und u")
def gr33(spark, sf):
    return S.neighbour_overlap(successions(spark, sf))


CUTS = f"""{W}, {CC}, lab AS (WITH RECURSIVE w(removed, node, m) USING KEY (removed, node) AS (SELECT r.node, v.node, v.node FROM big r JOIN big v ON v.node <> r.node UNION SELECT w.removed, s.dst, min(w.m) FROM w JOIN sym s ON s.src = w.node AND s.dst <> w.removed JOIN recurring.w o ON o.removed = w.removed AND o.node = s.dst WHERE w.m < o.m GROUP BY w.removed, s.dst) SELECT * FROM w),
part AS (SELECT removed, m, count(*) AS size FROM lab GROUP BY removed, m),
damage AS (SELECT removed, (SELECT count(*) FROM big) - 1 - max(size) AS damage, count(*) AS parts FROM part GROUP BY removed)"""


@query("gr34_removal_damage", f"{CUTS} SELECT removed, CAST(damage AS BIGINT) AS damage, parts FROM damage")
def gr34(spark, sf):
    n, e = f1(spark, sf)
    return L.removal_damage(n, e, n)


@query("gr35_articulation_points", f"{CUTS} SELECT removed AS node FROM damage WHERE parts > 1")
def gr35(spark, sf):
    n, e = f1(spark, sf)
    return L.articulation_points(L.removal_damage(n, e, n))


@query("gr36_distance_lookup", f"{W}, {UDIST}, p AS (SELECT node AS a, node + 1 AS b FROM nodes WHERE node + 1 IN (SELECT node FROM nodes)) SELECT p.a, p.b, d.dist FROM p LEFT JOIN udist d ON d.source = p.a AND d.node = p.b")
def gr36(spark, sf):
    n, e = f1(spark, sf)
    p = n.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")).join(n.select(F.col("node").alias("b")), "b", "left_semi")
    return S.distance_lookup(p, S.symmetrise(e))


# Centrality

from linkscope.operators import arrival as A  # noqa: E402
from linkscope.operators import centrality as C  # noqa: E402
from linkscope.sources.fixtures import read  # noqa: E402

CLO = "SELECT n.node, round(coalesce(count(d.node) / CAST(sum(d.dist) AS DOUBLE) * count(d.node) / ((SELECT count(*) FROM nodes) - 1.0), 0), 6) AS closeness FROM nodes n LEFT JOIN (SELECT * FROM udist WHERE dist > 0) d ON d.source = n.node GROUP BY n.node"


@query("ce1_closeness", f"{W}, {UDIST} {CLO}")
def ce1(spark, sf):
    return C.closeness(customers(spark, sf), all_ucounts(spark, sf)).select("node", r("closeness"))


@query("ce2_harmonic", f"{W}, {UDIST} SELECT n.node, round(coalesce(sum(1.0 / d.dist), 0) / ((SELECT count(*) FROM nodes) - 1.0), 6) AS harmonic FROM nodes n LEFT JOIN (SELECT * FROM udist WHERE dist > 0) d ON d.source = n.node GROUP BY n.node")
def ce2(spark, sf):
    return C.harmonic(customers(spark, sf), all_ucounts(spark, sf)).select("node", r("harmonic"))


@query("ce2_harmonic_directed", f"{W}, {DIST} SELECT n.node, round(coalesce(sum(1.0 / d.dist), 0), 6) AS harmonic FROM nodes n LEFT JOIN (SELECT * FROM dist WHERE dist > 0) d ON d.source = n.node GROUP BY n.node")
def ce2d(spark, sf):
    return C.harmonic(customers(spark, sf), all_counts(spark, sf), normalised=False).select("node", r("harmonic"))


@query("ce3_betweenness")
def ce3(spark, sf):
    return C.betweenness(*f1(spark, sf)).select("node", r("betweenness"))


@query("ce4_eigenvector")
def ce4(spark, sf):
    """After 100 steps; whether that is settled depends on how alike the largest hubs are."""
    return C.eigenvector(*f1(spark, sf), steps=100).select("node", r("score"))


def pagerank_sql(alpha: float, rounds: int, then: str) -> str:
    """A fixed number of rounds, enough for six digits."""
    return f"""{W}, links AS (SELECT e.src, e.dst, o.out_degree AS k FROM edges e JOIN deg o ON o.node = e.src), size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes),
flow AS (SELECT src, dst, CAST(1.0 / k AS DOUBLE) AS w FROM links UNION ALL SELECT d.node, x.node, 1.0 / n FROM deg d, nodes x, size WHERE d.out_degree = 0 UNION ALL SELECT node, node, 0.0 FROM nodes),
pr AS (WITH RECURSIVE p(i, node, r) AS (SELECT 0, node, CAST(1.0 / n AS DOUBLE) FROM nodes, size UNION ALL SELECT p.i + 1, f.dst, (1 - {alpha}) / max(n) + {alpha} * sum(p.r * f.w) FROM p JOIN flow f ON f.src = p.node, size WHERE p.i < {rounds} GROUP BY p.i, f.dst) SELECT node, CAST(r AS DOUBLE) AS pagerank FROM p WHERE i = {rounds})
{then}"""


@query("ce5_pagerank", pagerank_sql(0.85, 130, "SELECT node, round(pagerank, 6) AS rank FROM pr"))
def ce5(spark, sf):
    return C.pagerank(*f1(spark, sf)).select("node", r("rank"))


@query("ce5_pagerank_half", pagerank_sql(0.5, 40, "SELECT node, round(pagerank, 6) AS rank FROM pr"))
def ce5h(spark, sf):
    return C.pagerank(*f1(spark, sf), alpha=0.5).select("node", r("rank"))


@query("ce5_pagerank_top", pagerank_sql(0.85, 130, "SELECT pr.node, round(pagerank, 6) AS rank, in_degree, out_degree FROM pr JOIN deg USING (node) ORDER BY round(pagerank, 9) DESC, pr.node LIMIT 20"))
def ce5t(spark, sf):
    n, e = f1(spark, sf)
    top = C.top_k(C.pagerank(n, e).withColumn("rank", F.round("rank", 9)), "rank", 20)
    return top.join(S.degrees(n, e), "node").select("node", r("rank"), "in_degree", "out_degree")


def in_out(spark, sf):
    d = S.degrees(*f1(spark, sf))
    return C.rank_table(C.stack({"in": d.select("node", "in_degree"), "out": d.select("node", "out_degree"), "all": d.select("node", "degree")}))


RANKS = "st AS (SELECT 'in' AS measure, node, in_degree AS score FROM deg UNION ALL SELECT 'out', node, out_degree FROM deg UNION ALL SELECT 'all', node, degree FROM deg), rk AS (SELECT measure, node, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY measure ORDER BY score DESC, node) AS INT) AS rank FROM st)"


@query("ce6_top_k", f"{W}, {RANKS} SELECT measure, node, score FROM rk WHERE rank <= 10")
def ce6(spark, sf):
    return C.top_k(in_out(spark, sf).drop("rank"), "score", 10, ["measure"])


@query("ce7_rank_table", f"{W}, {RANKS} SELECT measure, node, score, rank FROM rk")
def ce7(spark, sf):
    return in_out(spark, sf)


@query("ce8_top_set_sizes", f"{W}, {RANKS} SELECT node, string_agg(measure, ',' ORDER BY measure) AS measures, count(*) AS n FROM rk WHERE rank <= 25 GROUP BY node")
def ce8(spark, sf):
    return C.top_set_sizes(in_out(spark, sf), 25)


@query("ce9_rank_shift", f"{W}, {RANKS} SELECT a.node, a.rank AS rank_a, b.rank AS rank_b, a.rank - b.rank AS shift FROM rk a JOIN rk b USING (node) WHERE a.measure = 'in' AND b.measure = 'out'")
def ce9(spark, sf):
    t = in_out(spark, sf)
    return C.rank_shift(t.filter("measure = 'in'"), t.filter("measure = 'out'"))


@query("ce10_score_sources", pagerank_sql(0.85, 130, "SELECT l.dst AS node, l.src AS source, round(pagerank / k, 6) AS share FROM links l JOIN pr ON pr.node = l.src"))
def ce10(spark, sf):
    n, e = f1(spark, sf)
    return C.score_sources(e, C.pagerank(n, e)).select("node", "source", r("share"))


@query("ce11_powerlaw_residuals", f"{W}, p AS (SELECT node, log10(in_degree) AS x, log10(out_degree) AS y FROM deg WHERE in_degree > 0 AND out_degree > 0), f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p) SELECT node, round(y - i - s * x, 6) AS residual FROM p, f")
def ce11(spark, sf):
    return C.powerlaw_residuals(S.degrees(*f1(spark, sf)), "in_degree", "out_degree").select("node", r("residual"))


@query("ce12_friendship_paradox", f"{W}, k AS (SELECT * FROM deg WHERE degree > 0), e AS (SELECT s.src, a.degree AS ks, b.degree AS kd FROM sym s JOIN k a ON a.node = s.src JOIN k b ON b.node = s.dst), own AS (SELECT src, ks, avg(kd) AS m, max(kd) AS top FROM e GROUP BY src, ks) SELECT (SELECT count(*) FROM k) AS n, (SELECT round(avg(degree), 6) FROM k) AS mean_degree, round(sum(kd / CAST(ks AS DOUBLE)) / (SELECT count(*) FROM k), 6) AS mean_friend_degree, round(avg(kd), 6) AS mean_end_degree, round(sum(CASE WHEN kd >= ks THEN 1.0 / ks ELSE 0 END) / (SELECT count(*) FROM k), 6) AS p_friend_at_least, (SELECT round(avg(CAST(ks < m AS INT)), 6) FROM own) AS share_below, (SELECT count(*) FROM own WHERE top <= ks) AS unbeaten FROM e")
def ce12(spark, sf):
    p = C.friendship_paradox(*f1(spark, sf))
    return p.select("n", *[r(c) for c in ("mean_degree", "mean_friend_degree", "mean_end_degree", "p_friend_at_least", "share_below")], "unbeaten")


@query("ce13_directed_paradox", f"{W}, e AS (SELECT s.src, s.dst, a.in_degree AS ks, b.in_degree AS kd FROM edges s JOIN deg a ON a.node = s.src JOIN deg b ON b.node = s.dst), o AS (SELECT src, avg(CAST(kd >= ks AS INT)) AS lev, max(CAST(kd >= ks AS INT)) AS up FROM e GROUP BY src), i AS (SELECT dst, max(CAST(ks >= kd AS INT)) AS beaten FROM e GROUP BY dst) SELECT (SELECT round(avg(CAST(kd > ks AS INT)), 6) FROM e) AS share_up, (SELECT round(avg(lev), 6) FROM o) AS p_linked_at_least, (SELECT count(*) FROM o WHERE up = 0) AS only_down, (SELECT count(*) FROM i WHERE beaten = 0) AS above_all_linkers")
def ce13(spark, sf):
    return C.directed_paradox(*f1(spark, sf)).select(r("share_up"), r("p_linked_at_least"), "only_down", "above_all_linkers")


@query("ce14_agreement", pagerank_sql(0.85, 130, "SELECT count(*) AS n, true AS agrees FROM pr"))
def ce14(spark, sf):
    n, e = f1(spark, sf)
    return C.agreement(C.pagerank(n, e, every=5), C.pagerank(n, e, every=7), F.col("rank"), 1e-8).select("n", "agrees")


# Arrival order: a customer arrives with their first order

ARR = "ar AS (SELECT node, (SELECT min(year(o_orderdate)) FROM orders WHERE o_custkey = node) AS year FROM nodes), rk AS (SELECT *, row_number() OVER (ORDER BY year NULLS LAST, node) AS rank FROM ar)"


def arrivals(spark, sf):
    y = read(spark, sf, "orders").groupBy(F.col("o_custkey").cast("long").alias("node")).agg(F.min(F.year("o_orderdate")).alias("year"))
    return A.arrival_ranks(customers(spark, sf).join(y, "node", "left"))


@query("tm1_arrival_replay", f"{W}, {ARR}, e AS (SELECT e.src, e.dst, greatest(a.rank, b.rank) AS step FROM edges e JOIN rk a ON a.node = e.src JOIN rk b ON b.node = e.dst), c AS (SELECT node, step, count(*) AS n FROM (SELECT src AS node, step FROM e UNION ALL SELECT dst, step FROM e) GROUP BY node, step) SELECT node, step, CAST(sum(n) OVER (PARTITION BY node ORDER BY step) AS BIGINT) AS degree FROM c")
def tm1(spark, sf):
    return A.arrival_replay(arrivals(spark, sf), successions(spark, sf))


@query("tm2_first_mover", f"{W}, {ARR}, k AS (SELECT rk.*, in_degree FROM rk JOIN deg USING (node) WHERE year IS NOT NULL), q AS (SELECT rank() OVER (ORDER BY year) + (count(*) OVER (PARTITION BY year) - 1) / 2.0 AS a, rank() OVER (ORDER BY in_degree) + (count(*) OVER (PARTITION BY in_degree) - 1) / 2.0 AS b FROM k) SELECT count(*) AS n, round(corr(a, b), 6) AS spearman, round((SELECT 100 * avg(rank) FROM (SELECT rank FROM k ORDER BY in_degree DESC, node LIMIT 10)) / count(*), 6) AS top_percentile FROM q")
def tm2(spark, sf):
    d = S.degrees(*f1(spark, sf)).select("node", "in_degree")
    return A.first_mover(arrivals(spark, sf).join(d, "node"), "in_degree").select("n", r("spearman"), r("top_percentile"))


@query("tm3_decade_profile", f"{W}, {ARR}, k AS (SELECT rk.*, in_degree FROM rk JOIN deg USING (node) WHERE year IS NOT NULL) SELECT CAST(floor(year / 10) * 10 AS INT) AS decade, count(*) AS n, round(avg(in_degree), 6) AS mean, CAST(median(in_degree) AS DOUBLE) AS median, max(in_degree) AS top, first(node ORDER BY in_degree DESC, node) AS holder FROM k GROUP BY 1")
def tm3(spark, sf):
    d = S.degrees(*f1(spark, sf)).select("node", "in_degree")
    return A.decade_profile(arrivals(spark, sf).join(d, "node"), "in_degree").withColumn("mean", r("mean"))
