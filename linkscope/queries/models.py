"""Queries on communities, robustness, nulls and tails."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkscope.operators import community as M
from linkscope.operators import nulls as N
from linkscope.operators import robustness as B
from linkscope.operators import structure as S
from linkscope.operators import tails as H
from linkscope.operators import text as T
from linkscope.plans.iterate import cut
from linkscope.plans.order import running
from linkscope.queries.graph import customers, f1, r
from linkscope.queries.registry import W, query
from linkscope.queries.words import sh
from linkscope.sources.fixtures import read

SEG = "lab AS (SELECT CAST(c_custkey AS BIGINT) AS node, c_mktsegment AS class, CAST(c_nationkey AS BIGINT) AS community FROM customer)"


def pairs(spark, sf):
    return S.undirected(f1(spark, sf)[1])


def nations(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("node"), F.col("c_nationkey").cast("long").alias("community"))


def segments(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("node"), F.col("c_mktsegment").alias("class"))


def copies(spark, sf):
    """The copy graph of the documents, weighed by shared shingles."""
    return cut(T.copy_pairs(sh(spark, sf)).filter("shared >= 5").withColumnRenamed("shared", "weight"))


def ends(e):
    return e.select(F.col("a").alias("node")).union(e.select("b")).distinct()


@query("cm1_modularity", f"{W}, {SEG}, x AS (SELECT s.src, s.dst, p.community AS ca, q.community AS cb FROM sym s JOIN lab p ON p.node = s.src JOIN lab q ON q.node = s.dst), per AS (SELECT ca, count(*) AS d, count(*) FILTER (ca = cb) AS i FROM x GROUP BY ca), t AS (SELECT CAST(sum(d) AS DOUBLE) AS m2 FROM per) SELECT round(sum(i / m2 - (d / m2) * (d / m2)), 6) AS q FROM per, t")
def cm1(spark, sf):
    return M.modularity(pairs(spark, sf), nations(spark, sf)).select(r("q"))


@query("cm2_louvain")
def cm2(spark, sf):
    e = copies(spark, sf)
    return M.best_seed(cut(M.louvain(ends(e), e, seeds=2)), e)


@query("cm3_agglomerate")
def cm3(spark, sf):
    e = copies(spark, sf)
    return M.agglomerate(ends(e), e)


@query("cm5_nmi", f"WITH {SEG}, c AS (SELECT community AS x, class AS y, count(*) AS n FROM lab GROUP BY 1, 2), w AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, CAST(sum(n) OVER () AS DOUBLE) AS t FROM c), hx AS (SELECT -sum(z / t * ln(z / t)) AS h FROM (SELECT DISTINCT community, count(*) OVER (PARTITION BY community) AS z, CAST(count(*) OVER () AS DOUBLE) AS t FROM lab)), hy AS (SELECT -sum(z / t * ln(z / t)) AS h FROM (SELECT DISTINCT class, count(*) OVER (PARTITION BY class) AS z, CAST(count(*) OVER () AS DOUBLE) AS t FROM lab)) SELECT round(2 * sum(n / t * ln(n * t / (nx * ny))) / ((SELECT h FROM hx) + (SELECT h FROM hy)), 6) AS nmi FROM w")
def cm5(spark, sf):
    return M.nmi(nations(spark, sf), segments(spark, sf).withColumnRenamed("class", "community")).select(r("nmi"))


@query("cm6_partition_stability")
def cm6(spark, sf):
    e = copies(spark, sf)
    return M.partition_stability(cut(M.louvain(ends(e), e, seeds=2)))


@query("cm7_majority_map", f"WITH {SEG}, c AS (SELECT class AS community, community AS reference, count(*) AS n FROM lab GROUP BY 1, 2) SELECT community, reference FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, reference) AS i FROM c) WHERE i = 1")
def cm7(spark, sf):
    return M.majority_map(segments(spark, sf).withColumnRenamed("class", "community"), nations(spark, sf))


@query("cm9_community_profile", f"{W}, {SEG}, x AS (SELECT s.src, p.community AS ca, q.community AS cb FROM sym s JOIN lab p ON p.node = s.src JOIN lab q ON q.node = s.dst), m AS (SELECT CAST(count(*) AS DOUBLE) AS m2 FROM sym) SELECT l.community, count(*) AS size, first(l.node ORDER BY degree DESC, l.node) AS head, CAST((SELECT count(*) FROM x WHERE ca = l.community AND cb = l.community) / 2.0 AS DOUBLE) AS links_inside, CAST(sum(degree) AS DOUBLE) AS degree_sum, round((SELECT count(*) FROM x WHERE ca = l.community AND cb = l.community) / max(m2) - (sum(degree) / max(m2)) * (sum(degree) / max(m2)), 6) AS q_share FROM lab l JOIN deg USING (node), m GROUP BY l.community")
def cm9(spark, sf):
    return M.community_profile(pairs(spark, sf), nations(spark, sf)).withColumn("q_share", r("q_share"))


@query("cm11_seeded_propagation")
def cm11(spark, sf):
    n = nations(spark, sf)
    seeds = n.groupBy("community").agg(F.min("node").alias("node")).select("node", "community")
    return M.seeded_propagation(customers(spark, sf), pairs(spark, sf), seeds)


@query("cm12_nearest_seed")
def cm12(spark, sf):
    n = nations(spark, sf)
    return M.nearest_seed(pairs(spark, sf), n, n.groupBy("community").agg(F.min("node").alias("node")).select("node"))


@query("cm13_random_assignment")
def cm13(spark, sf):
    runs = M.random_assignment(customers(spark, sf), 7, 20)
    e = pairs(spark, sf).crossJoin(F.broadcast(runs.select("replicate").distinct()))
    return M.modularity(e, runs, ["replicate"]).agg(r(F.avg("q")).alias("q"))


@query("cm14_set_scores", f"{W}, {SEG}, i AS (SELECT p.community AS host, count(*) AS links FROM und u JOIN lab p ON p.node = u.a JOIN lab q ON q.node = u.b AND q.community = p.community GROUP BY 1), d AS (SELECT community AS host, sum(degree) AS dd FROM lab JOIN deg USING (node) GROUP BY 1), m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM und) SELECT host, CAST(coalesce(links, 0) AS DOUBLE) AS links, CAST(dd AS DOUBLE) AS degree_sum, round(dd * dd / (4 * m), 6) AS expected, round(coalesce(links, 0) - dd * dd / (4 * m), 6) AS surplus, round((coalesce(links, 0) - dd * dd / (4 * m)) / m, 6) AS q_share FROM d LEFT JOIN i USING (host), m")
def cm14(spark, sf):
    s = M.set_scores(pairs(spark, sf), nations(spark, sf).withColumnRenamed("community", "host"), ["host"])
    return s.select("host", "links", "degree_sum", *[r(c) for c in ("expected", "surplus", "q_share")])


@query("cm15_expansion_candidates", f"{W}, m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM und) SELECT s.src AS host, s.dst AS node, CAST(1 AS DOUBLE) AS links, round(1 - q.degree * (2 * p.degree + q.degree) / (4 * m), 6) AS gain FROM sym s JOIN deg p ON p.node = s.src JOIN deg q ON q.node = s.dst, m")
def cm15(spark, sf):
    n = customers(spark, sf)
    return M.expansion_candidates(pairs(spark, sf), n.select(F.col("node").alias("host"), "node"), ["host"]).withColumn("gain", r("gain"))


@query("cm16_greedy_expand")
def cm16(spark, sf):
    return M.greedy_expand(cut(pairs(spark, sf)), customers(spark, sf).select(F.col("node").alias("host")), 3)


@query("cm18_random_sets")
def cm18(spark, sf):
    e = cut(pairs(spark, sf))
    s = M.random_sets(e, customers(spark, sf).select(F.col("node").alias("host")), 3, 5)
    return M.set_scores(e, s, ["host", "replicate"]).groupBy("host").agg(r(F.avg("surplus")).alias("surplus"))


@query("cm19_chance_levels", f"{W}, {SEG} SELECT round(2.0 * (SELECT count(*) FROM und) / (n * (n - 1)), 9) AS density, round(s2 / (CAST(n AS DOUBLE) * n), 6) AS same_chance, (SELECT round(avg(CAST(p.community = q.community AS INT)), 6) FROM und u JOIN lab p ON p.node = u.a JOIN lab q ON q.node = u.b) AS same_share FROM (SELECT sum(k) AS n, sum(k * k) AS s2 FROM (SELECT count(*) AS k FROM lab GROUP BY community))")
def cm19(spark, sf):
    return M.chance_levels(pairs(spark, sf), nations(spark, sf)).select(r("density", 9), r("same_chance"), r("same_share"))


def by_degree(spark, sf, steps=None):
    """Nodes in the order of their degrees, the smaller id first on ties."""
    order = running(S.degrees(*f1(spark, sf)).select("node", "degree"), [F.desc("degree"), F.col("node")], step=F.lit(1)).select("node", F.col("step").cast("int").alias("step"))
    return order.filter(F.col("step") <= steps) if steps else order


#: The largest component after each removal by degree, by labels that shrink from node to node.
SWEEP = f"""{W}, ord AS (SELECT node, CAST(row_number() OVER (ORDER BY degree DESC, node) AS INT) AS step FROM deg),
so AS (SELECT s.src, s.dst, q.step FROM sym s JOIN ord q ON q.node = s.dst),
lab AS (WITH RECURSIVE w(step, node, m) USING KEY (step, node) AS (SELECT t.step, v.node, v.node FROM ord t JOIN ord v ON v.step > t.step UNION SELECT w.step, s.dst, min(w.m) FROM w JOIN so s ON s.src = w.node AND s.step > w.step JOIN recurring.w o ON o.step = w.step AND o.node = s.dst WHERE w.m < o.m GROUP BY w.step, s.dst) SELECT * FROM w),
curve AS (SELECT t.step, coalesce(max(k), 0) AS giant FROM ord t LEFT JOIN (SELECT step, m, count(*) AS k FROM lab GROUP BY step, m) c ON c.step = t.step GROUP BY t.step)"""


@query("rb1_removal_curve", f"{SWEEP} SELECT step, giant FROM curve")
def rb1(spark, sf):
    return B.removal_curve(*f1(spark, sf), by_degree(spark, sf))


@query("rb2_adaptive_attack")
def rb2(spark, sf):
    return B.adaptive_attack(*f1(spark, sf), steps=5)


@query("rb3_random_attack")
def rb3(spark, sf):
    n, e = f1(spark, sf)
    return B.mean_curve(B.removal_curve(n, e, B.random_orders(n, 20), ["replicate"]))


@query("rb4_halving_point", f"{SWEEP} SELECT min(step) FILTER (2 * giant <= (SELECT count(*) FROM nodes)) AS to_half, round(sum(giant) / CAST((SELECT count(*) FROM nodes) AS DOUBLE) / count(*), 6) AS robustness FROM curve")
def rb4(spark, sf):
    n, e = f1(spark, sf)
    return B.halving_point(B.removal_curve(n, e, by_degree(spark, sf)), n.count()).select("to_half", r("robustness"))


@query("rb5_evaluate_removal_set")
def rb5(spark, sf):
    n, e = f1(spark, sf)
    return B.evaluate_removal_set(n, e, by_degree(spark, sf, 20).select("node"))


@query("rb6_severed_nodes")
def rb6(spark, sf):
    n, e = f1(spark, sf)
    top = S.degrees(n, e).orderBy(F.desc("degree"), "node").first()
    return B.severed_nodes(n, e, top["node"])


@query("nu1_swap_edges_directed")
def nu1(spark, sf):
    return N.swap_edges(f1(spark, sf)[1], 10)


@query("nu2_swap_edges_undirected")
def nu2(spark, sf):
    return N.swap_edges(f1(spark, sf)[1], 10, directed=False)


@query("nu3_gnm")
def nu3(spark, sf):
    n, e = f1(spark, sf)
    return N.gnm(n, e.count(), 3)


@query("nu5_null_summary")
def nu5(spark, sf):
    n, e = f1(spark, sf)
    nulls = {"gnm": cut(N.gnm(n, e.count(), 200)), "swap": N.swap_edges(e, 200)}
    real, samples = N.run_ensemble(n, e, N.undirected_battery, nulls)
    return N.survival_verdict(N.null_summary(real, samples))


@query("nu9_directed_battery")
def nu9(spark, sf):
    return N.directed_battery(*f1(spark, sf), [])


@query("nu10_mixing_counts", f"{W}, {SEG} SELECT p.class || '>' || q.class AS pair, count(*) AS n, count(b.src) AS mutual FROM edges e JOIN lab p ON p.node = e.src JOIN lab q ON q.node = e.dst LEFT JOIN edges b ON b.src = e.dst AND b.dst = e.src GROUP BY 1")
def nu10(spark, sf):
    return N.mixing_counts(f1(spark, sf)[1], segments(spark, sf))


@query("nu11_mixing_report", f"{W}, {SEG} SELECT class, count(*) AS nodes, CAST(sum(out_degree) AS BIGINT) AS out_links, CAST(sum(in_degree) AS BIGINT) AS in_links, first(node ORDER BY in_degree DESC, node) AS top FROM deg JOIN lab USING (node) GROUP BY class")
def nu11(spark, sf):
    return N.mixing_report(*f1(spark, sf), segments(spark, sf))


PERM = "base AS (SELECT doc_id, quality, toxic FROM labels), a AS (SELECT doc_id, k AS replicate, row_number() OVER (PARTITION BY k ORDER BY md5(CAST(doc_id AS VARCHAR) || ':' || CAST(k AS VARCHAR) || ':1')) AS i FROM base, range(20) t(k)), b AS (SELECT k AS replicate, quality, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS i FROM base, range(20) t(k)), pm AS (SELECT a.replicate, b.quality, avg(base.toxic) AS v FROM a JOIN b USING (replicate, i) JOIN base ON base.doc_id = a.doc_id GROUP BY 1, 2), re AS (SELECT quality, avg(toxic) AS real FROM base GROUP BY quality)"


@query("nu12_label_permutation_test", f"WITH {PERM} SELECT quality, round(max(real), 6) AS real, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round((count(*) FILTER (v <= real) + 1) / (count(*) + 1.0), 6) AS p FROM pm JOIN re USING (quality) GROUP BY quality")
def nu12(spark, sf):
    t = N.label_permutation_test(read(spark, sf, "labels"), "quality", "toxic", 20)
    return t.select("quality", *[r(c) for c in ("real", "mean", "sd", "p")])


@query("nu13_random_neighbours")
def nu13(spark, sf):
    return N.random_neighbours(read(spark, sf, "documents"), 5)


def degree_hist(spark, sf):
    d = S.degrees(*f1(spark, sf))
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("v")) for c in ("in_degree", "out_degree", "degree")]))
    return cut(H.histogram(d.select(kinds.alias("x")).select("x.*"), "v", ["kind"]))


@query("ht1_histogram", f"{W} SELECT 'degree' AS kind, CAST(degree AS BIGINT) AS k, count(*) AS n FROM deg WHERE degree > 0 GROUP BY 2 UNION ALL SELECT 'in_degree', in_degree, count(*) FROM deg WHERE in_degree > 0 GROUP BY 2 UNION ALL SELECT 'out_degree', out_degree, count(*) FROM deg WHERE out_degree > 0 GROUP BY 2")
def ht1(spark, sf):
    return degree_hist(spark, sf)


@query("ht3_fit_tails")
def ht3(spark, sf):
    return H.fit_tails(degree_hist(spark, sf), "kind")


@query("ht2_candidate_fits")
def ht2(spark, sf):
    """The gap of every tail that could be fitted."""
    return H.fit_candidates(degree_hist(spark, sf), "kind").select("kind", "k_min", r("alpha"), r("ks"), "tail")


@query("ht8_fits_by_two_keys")
def ht8(spark, sf):
    """Degrees by market segment and kind."""
    d = S.degrees(*f1(spark, sf)).join(segments(spark, sf).hint("merge"), "node")
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("v")) for c in ("in_degree", "out_degree", "degree")]))
    h = cut(H.histogram(d.select("class", kinds.alias("x")).select("class", "x.*"), "v", ["class", "kind"]))
    return H.fit_tails(h, ["class", "kind"]).select("class", "kind", "k_min", r("alpha"), r("error"), r("ks"), "tail")


@query("ht4_bootstrap_pvalue")
def ht4(spark, sf):
    h = degree_hist(spark, sf)
    return H.bootstrap_pvalue(h, "kind", cut(H.fit_tails(h, "kind")))


@query("ht7_compare_tails")
def ht7(spark, sf):
    h = degree_hist(spark, sf)
    return H.compare_tails(h, "kind", cut(H.fit_tails(h, "kind")))


@query("cm8_flip_counts")
def cm8(spark, sf):
    e = copies(spark, sf)
    runs = cut(M.louvain(ends(e), e, seeds=2))
    return M.flip_counts(runs, M.best_seed(runs, e))


@query("cm10_null_modularity")
def cm10(spark, sf):
    """Modularity of the nations on degree-preserving and random graphs."""
    n, e = f1(spark, sf)
    out = None
    for name, draws in {"gnm": N.gnm(n, e.count(), 200), "swap": N.swap_edges(e, 200)}.items():
        und = S.undirected(cut(draws), ["replicate"])
        q = M.modularity(und, nations(spark, sf), ["replicate"]).agg(F.lit(name).alias("null"), r(F.avg("q")).alias("mean"), r(F.stddev_pop("q")).alias("sd"))
        out = q if out is None else out.unionByName(q)
    return out


@query("nu6_node_z_scores")
def nu6(spark, sf):
    """In-degree against random graphs of the same size."""
    n, e = f1(spark, sf)
    real = S.degrees(n, e).select("node", F.col("in_degree").alias("score"))
    return N.z_scores(real, N.gnm_in_degrees(n, e.count(), 200))


@query("nu14_distance_null")
def nu14(spark, sf):
    """Distances from the 20 nodes of highest degree, against swapped graphs."""
    n, e = f1(spark, sf)
    top = cut(by_degree(spark, sf, 20).select(F.col("node").alias("source")))
    real = S.distance_histogram(S.bfs(e, top))
    draws = N.swap_edges(e, 20)
    sources = top.crossJoin(F.broadcast(draws.select("replicate").distinct()))
    return N.distance_null(real, S.distance_histogram(S.bfs(draws, sources, ["replicate"]), ["replicate"]))
