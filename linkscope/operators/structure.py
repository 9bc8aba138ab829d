"""Graph structure. nodes has the column node, edges src and dst (a set: no
self-loops, no repeats); undirected measures take the symmetric edges. Columns named
in by are carried through, so one job serves many graphs."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscope.operators.searches import both_ways, counts, distances, in_tasks, lookups
from linkscope.plans.iterate import cut, discard, iterate
from linkscope.plans.order import average_ranks


def cols(by: list[str], *more: str) -> list[str]:
    return [*by, *more]


def symmetrise(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """Both directions of every edge, once."""
    return edges.select(*by, "src", "dst").union(edges.select(*by, F.col("dst"), F.col("src"))).distinct()


def undirected(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row (a, b), a < b, per linked pair."""
    return edges.filter("src <> dst").select(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def weighted_undirected(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """Weights of both directions added, self-loops dropped."""
    return edges.filter("src <> dst").groupBy(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def degrees(nodes: DataFrame, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """(node, in_degree, out_degree, degree) with zeros; degree counts linked nodes."""
    ends = edges.select(*by, F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).alias("d")).union(edges.select(*by, "dst", F.lit(1), F.lit(0), F.lit(0)))
    ends = ends.union(symmetrise(edges, by).select(*by, "src", F.lit(0), F.lit(0), F.lit(1)))
    per = ends.groupBy(*by, "node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("d").alias("degree"))
    return nodes.join(per, cols(by, "node"), "left").fillna(0, ["in_degree", "out_degree", "degree"])


def strengths(nodes: DataFrame, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """(node, strength): weight of all links of a node."""
    both = edges.select(*by, F.col("src").alias("node"), "weight").union(edges.select(*by, "dst", "weight"))
    return nodes.join(both.groupBy(*by, "node").agg(F.sum("weight").alias("strength")), cols(by, "node"), "left").fillna(0, ["strength"])


def adjacency(nodes: DataFrame, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """(node, successors, predecessors): sorted arrays, empty for none."""
    out = edges.groupBy(*by, F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("successors"))
    into = edges.groupBy(*by, F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("predecessors"))
    empty = F.array().cast("array<bigint>")
    j = nodes.join(out, cols(by, "node"), "left").join(into, cols(by, "node"), "left")
    return j.select(*by, "node", F.coalesce("successors", empty).alias("successors"), F.coalesce("predecessors", empty).alias("predecessors"))


def graph_summary(nodes: DataFrame, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row: counts, density, isolates, sinks, sources and degree statistics."""
    d = degrees(nodes, edges, by)
    g = d.groupBy(*by).agg(
        F.count("*").alias("n_nodes"),
        F.sum("out_degree").alias("n_edges"),
        F.sum((F.col("degree") == 0).cast("long")).alias("isolates"),
        F.sum((F.col("out_degree") == 0).cast("long")).alias("sinks"),
        F.sum((F.col("in_degree") == 0).cast("long")).alias("sources"),
        F.avg("degree").alias("mean_degree"),
        F.max("degree").alias("max_degree"),
        F.median("degree").alias("median_degree"),
    )
    return g.withColumn("density", F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)))


def top_degree_share(deg: DataFrame, k: int = 10, measure: str = "in_degree") -> DataFrame:
    """The k nodes of highest degree with their share of all links and of possible ones."""
    total = deg.agg(F.sum(measure).alias("total"), F.count("*").alias("n"))
    top = deg.orderBy(F.desc(measure), "node").limit(k)
    return top.crossJoin(F.broadcast(total)).select("node", measure, (F.col(measure) / F.col("total")).alias("link_share"), (F.col(measure) / (F.col("n") - 1)).alias("hub_share"), (F.sum(measure).over(Window.partitionBy()) / F.col("total")).alias("top_share"))


def degree_distribution(deg: DataFrame, measure: str = "degree", by: list[str] = ()) -> DataFrame:
    """(k, n, p): nodes of each degree above 0; p is the share of all nodes."""
    return deg.groupBy(*by, F.col(measure).alias("k")).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by))).filter("k > 0")


def ccdf(values: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(k, p): share of values that are at least k, at every value above 0."""
    c = values.filter(F.col(value) > 0).groupBy(*by, F.col(value).alias("k")).agg(F.count("*").alias("n"))
    up = Window.partitionBy(*by).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return c.select(*by, "k", (F.sum("n").over(up) / F.sum("n").over(Window.partitionBy(*by))).alias("p"))


def ccdf_band(values: DataFrame, value: str, run: str, k_max: int) -> DataFrame:
    """(k, p05, p50, p95): percentiles over runs of the CCDF at k = 1 .. k_max."""
    sizes = values.filter(F.col(value) > 0).groupBy(run).agg(F.count("*").alias("n"))
    grid = values.filter(F.col(value) > 0).select(run, F.explode(F.sequence(F.lit(1), F.least(F.col(value), F.lit(k_max)).cast("int"))).alias("k")).groupBy(run, "k").agg(F.count("*").alias("c"))
    every = sizes.select(run, "n", F.explode(F.sequence(F.lit(1), F.lit(k_max))).alias("k"))
    p = every.join(grid.hint("merge"), [run, "k"], "left").select("k", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("p"))
    return p.groupBy("k").agg(*[F.percentile("p", x).alias(f"p{int(100 * x):02d}") for x in (0.05, 0.5, 0.95)])


def loglog_slope(points: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """(slope, intercept) of log10 y on log10 x by least squares, over positive points."""
    p = points.filter((F.col(x) > 0) & (F.col(y) > 0)).select(*by, F.log10(x).alias("lx"), F.log10(y).alias("ly"))
    return p.groupBy(*by).agg(F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"))


def average_rank(value: str, by: list[str] = ()) -> Column:
    """Rank from 1, ties sharing their mean rank."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def correlations(rows: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """(n, pearson, spearman, t): t is Spearman's statistic, referred to Student's t
    with n - 2 degrees of freedom."""
    if by:
        ranked = rows.select(*by, x, y, average_rank(x, by).alias("rx"), average_rank(y, by).alias("ry"))
    else:
        ranked = average_ranks(average_ranks(rows.select(x, y), x, "rx"), y, "ry")
    c = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("rx", "ry").alias("spearman"))
    return c.withColumn("t", F.col("spearman") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("spearman") * F.col("spearman"), F.lit(0.0))))


def reciprocity(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """(n_edges, reciprocated, reciprocity)."""
    back = edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    j = edges.join(back, cols(by, "src", "dst"), "left")
    return j.groupBy(*by).agg(F.count("*").alias("n_edges"), F.count("back").alias("reciprocated"), (F.count("back") / F.count("*")).alias("reciprocity"))


def to_roots(up: DataFrame, by: list[str]) -> DataFrame:
    """up(at, to), where following to leads to ever smaller nodes, with to at the end of
    each way; each round looks on from where the last one came, so the steps double."""
    while True:
        on = up.filter("at <> to").select(*by, F.col("at").alias("to"), F.col("to").alias("on"))
        after = cut(up.join(on.hint("merge"), cols(by, "to"), "left").select(*by, "at", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved")))
        discard(up)
        up = after.select(*by, "at", "to")
        if after.filter("moved").isEmpty():
            return up


def connected_components(nodes: DataFrame, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """(node, component): the smallest node that links reach, direction aside.

    Each round every node points to its smallest neighbour, if that is smaller; pointers
    are followed to their ends and the links move there. A round leaves at most half of
    the nodes with links, and following takes the logarithm of the longest way, so a long
    path needs one round of a few steps. Joins are sort-merge, which Spark splits at hubs."""
    by = list(by)
    left = cut(undirected(edges, by).select(*by, F.col("a").alias("src"), F.col("b").alias("dst")))
    labels = cut(nodes.select(*by, "node", F.col("node").alias("component")))
    while not left.isEmpty():
        both = left.union(left.select(*by, "dst", "src"))
        up = to_roots(cut(both.groupBy(*by, F.col("src").alias("at")).agg(F.min("dst").alias("to")).withColumn("to", F.least("at", "to"))), by)
        named = cut(labels.join(up.withColumnRenamed("at", "component").hint("merge"), cols(by, "component"), "left").select(*by, "node", F.coalesce("to", "component").alias("component")))
        moved = left.join(up.withColumnRenamed("at", "src").hint("merge"), cols(by, "src")).select(*by, F.col("to").alias("src"), "dst")
        moved = moved.join(up.withColumnRenamed("at", "dst").hint("merge"), cols(by, "dst")).select(*by, "src", F.col("to").alias("dst"))
        after = cut(moved.filter("src <> dst").select(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
        discard(labels, left, up)
        labels, left = named, after
    return labels


def component_sizes(labels: DataFrame, by: list[str] = ()) -> DataFrame:
    """(component, size, giant): giant is the largest, the smaller id on ties."""
    s = labels.groupBy(*by, "component").agg(F.count("*").alias("size"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("size"), "component")) == 1
    return s.withColumn("giant", first)


def giant(labels: DataFrame, by: list[str] = ()) -> DataFrame:
    """nodes(node) of the giant component."""
    return labels.join(component_sizes(labels, by).filter("giant").select(*by, "component"), cols(by, "component"), "left_semi").select(*by, "node")


def islands(labels: DataFrame, by: list[str] = ()) -> DataFrame:
    """(n_islands, n_isolates): components besides the giant with more than one node, and nodes alone."""
    s = component_sizes(labels, by)
    return s.groupBy(*by).agg(F.sum((~F.col("giant") & (F.col("size") > 1)).cast("long")).alias("n_islands"), F.sum((F.col("size") == 1).cast("long")).alias("n_isolates"))


def induced_subgraph(edges: DataFrame, kept: DataFrame, by: list[str] = ()) -> DataFrame:
    """Edges with both ends in kept(node)."""
    a, b = kept.withColumnRenamed("node", "src"), kept.withColumnRenamed("node", "dst")
    return edges.join(a, cols(by, "src"), "left_semi").join(b, cols(by, "dst"), "left_semi")


def bfs(edges: DataFrame, sources: DataFrame, by: list[str] = (), max_hops: int | None = None) -> DataFrame:
    """(source, node, dist) for what links reach from sources(source), the source itself at
    0; at most max_hops away where that is given. Tasks search a graph of few links from
    many sources, see searches; else all sources take a step in one join."""
    by = list(by)
    if not by and (few_links := in_tasks(edges, sources)):
        return distances(few_links, sources, max_hops)
    frontier = cut(sources.select(*by, "source", F.col("source").alias("node")))
    found = [frontier.withColumn("dist", F.lit(0))]
    links = edges.select(*by, F.col("src").alias("node"), "dst")
    visited = frontier
    for d in count(1):
        if max_hops is not None and d > max_hops:
            break
        step = frontier.join(links, cols(by, "node")).select(*by, "source", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(visited, cols(by, "source", "node"), "left_anti"))
        if frontier.isEmpty():
            break
        found.append(frontier.withColumn("dist", F.lit(d)))
        visited = visited.unionByName(frontier)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def distance_counts(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, dist, n): how many nodes bfs finds so far from each source."""
    if few_links := in_tasks(edges, sources):
        return counts(few_links, sources)
    return bfs(edges, sources).groupBy("source", "dist").agg(F.count("*").alias("n"))


def pairs_of(dist: DataFrame) -> Column:
    """How many pairs a row of distances stands for: n if there is such a column, else 1."""
    return F.col("n") if "n" in dist.columns else F.lit(1)


def shortest_path(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, path): one shortest route for each pair of sources(source) and
    targets(source, target), each node reached from its smallest predecessor; null if
    there is none."""
    d = cut(bfs(edges, sources))
    links = edges.select(F.col("src").alias("p"), F.col("dst").alias("node"))
    pred = d.select("source", F.col("node").alias("p"), F.col("dist").alias("pd")).join(links, "p").join(d, ["source", "node"]).filter("dist = pd + 1").groupBy("source", "node").agg(F.min("p").alias("p"))
    pred = cut(pred)
    walk = targets.join(d.withColumnRenamed("node", "target"), ["source", "target"], "left").select("source", "target", "dist", F.when(F.col("dist").isNotNull(), F.array("target")).alias("path"))
    longest = walk.agg(F.max("dist")).first()[0] or 0
    for _ in range(longest):
        head = walk.withColumn("node", F.element_at("path", 1)).join(pred, ["source", "node"], "left")
        walk = cut(head.select("source", "target", "dist", F.when(F.col("p").isNotNull() & (F.col("node") != F.col("source")), F.concat(F.array("p"), "path")).otherwise(F.col("path")).alias("path")))
    return walk.select("source", "target", "path")


def round_trips(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, out_dist, back_dist, total) for nodes reached both ways."""
    total = F.col("out_dist") + F.col("back_dist")
    if few_links := in_tasks(edges, sources):
        return both_ways(few_links, sources).withColumn("total", total)
    out = bfs(edges, sources).withColumnRenamed("dist", "out_dist")
    back = bfs(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), sources).withColumnRenamed("dist", "back_dist")
    return out.join(back, ["source", "node"]).filter("node <> source").withColumn("total", total)


def distance_band_pool(trips: DataFrame, lo: int, hi: int) -> DataFrame:
    """(source, node): nodes at lo to hi hops; for a source with none, all its trips."""
    inside = F.col("out_dist").between(lo, hi)
    # a flag a source, not all trips, is shuffled
    none = trips.groupBy("source").agg(F.max(inside.cast("int")).alias("some")).filter("some = 0").select("source")
    return trips.filter(inside).unionByName(trips.join(none, "source", "left_semi")).select("source", "node", "out_dist")


def near_trips(nodes: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """(source, node, out_dist): round_trips whose way out takes max_hops or less. Nodes that reach each other are
    a strong component, and no shortest way between them leaves it. So a source without a trip of lo hops,
    lo up to max_hops, has no longer one either, and distance_band_pool of these is that of all trips."""
    scc = cut(strong_components(nodes, edges))
    inside = edges.join(scc.select(F.col("node").alias("src"), F.col("component").alias("c")).hint("merge"), "src").join(scc.select(F.col("node").alias("dst"), F.col("component").alias("d")).hint("merge"), "dst").filter("c = d")
    inside = cut(inside.select("src", "dst"))
    near = bfs(inside, inside.select(F.col("src").alias("source")).distinct(), max_hops=max_hops)
    return cut(near.filter("node <> source").select("source", "node", F.col("dist").alias("out_dist")))


def distance_histogram(dist: DataFrame, by: list[str] = ()) -> DataFrame:
    """(dist, n, share, mean) over pairs of different nodes."""
    h = dist.filter("dist > 0").groupBy(*by, "dist").agg(F.sum(pairs_of(dist)).alias("n"))
    w = Window.partitionBy(*by)
    return h.select(*by, "dist", "n", (F.col("n") / F.sum("n").over(w)).alias("share"), (F.sum(F.col("dist") * F.col("n")).over(w) / F.sum("n").over(w)).alias("mean"))


def eccentricities(dist: DataFrame, by: list[str] = ()) -> DataFrame:
    """(node, eccentricity, diameter, radius, central)."""
    e = dist.groupBy(*by, F.col("source").alias("node")).agg(F.max("dist").alias("eccentricity"))
    w = Window.partitionBy(*by)
    return e.select(*by, "node", "eccentricity", F.max("eccentricity").over(w).alias("diameter"), F.min("eccentricity").over(w).alias("radius"), (F.col("eccentricity") == F.min("eccentricity").over(w)).alias("central"))


def average_path_length(dist: DataFrame, by: list[str] = ()) -> DataFrame:
    """(aspl, diameter) over reached pairs."""
    n = pairs_of(dist)
    return dist.filter("dist > 0").groupBy(*by).agg((F.sum(n * F.col("dist")) / F.sum(n)).alias("aspl"), F.max("dist").alias("diameter"))


def reachability(dist: DataFrame, n_nodes: int) -> DataFrame:
    """(pairs, share, mean_dist) over ordered pairs of different nodes; share of n (n - 1)."""
    n = F.coalesce(F.sum(pairs_of(dist)), F.lit(0)).cast("long")
    return dist.filter("dist > 0").agg(n.alias("pairs"), (n / F.lit(max(1, n_nodes * (n_nodes - 1)))).alias("share"), (F.sum(pairs_of(dist) * F.col("dist")) / F.sum(pairs_of(dist))).alias("mean_dist"))


def asymmetric_links(edges: DataFrame, dist: DataFrame, hops: int = 5) -> DataFrame:
    """(src, dst, back): links whose way back takes hops or more, or doesn't exist (null)."""
    way = dist.select(F.col("source").alias("dst"), F.col("node").alias("src"), F.col("dist").alias("back"))
    return edges.join(way.hint("merge"), ["src", "dst"], "left").filter(F.col("back").isNull() | (F.col("back") >= hops)).select("src", "dst", "back")


def triangles(nodes: DataFrame, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """(node, triangles). Each edge points to its end of higher degree (then higher id),
    so a hub starts few wedges."""
    by = list(by)
    sym = symmetrise(edges, by)
    deg = sym.groupBy(*by, F.col("src").alias("node")).agg(F.count("*").alias("k"))
    e = sym.join(deg.select(*by, F.col("node").alias("src"), F.col("k").alias("ks")), cols(by, "src")).join(deg.select(*by, F.col("node").alias("dst"), F.col("k").alias("kd")), cols(by, "dst"))
    up = e.filter("ks < kd or (ks = kd and src < dst)").select(*by, "src", "dst", "kd")
    a, b = up.select(*by, "src", F.col("dst").alias("x"), F.col("kd").alias("kx")), up.select(*by, "src", F.col("dst").alias("y"), F.col("kd").alias("ky"))
    wedges = a.join(b, cols(by, "src")).filter("kx < ky or (kx = ky and x < y)").select(*by, "src", "x", "y")
    t = wedges.join(up.select(*by, F.col("src").alias("x"), F.col("dst").alias("y")), cols(by, "x", "y"))
    each = t.select(*by, F.explode(F.array("src", "x", "y")).alias("node")).groupBy(*by, "node").agg(F.count("*").alias("triangles"))
    return nodes.join(each, cols(by, "node"), "left").fillna(0, ["triangles"])


def clustering(nodes: DataFrame, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """(average_clustering, transitivity, triangles); degree below 2 counts as 0."""
    by = list(by)
    t = triangles(nodes, edges, by).join(degrees(nodes, edges, by).select(*by, "node", "degree"), cols(by, "node"))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return t.groupBy(*by).agg(F.avg(F.when(F.col("degree") > 1, F.col("triangles") / pairs).otherwise(0.0)).alias("average_clustering"), F.coalesce(F.sum("triangles") / F.nullif(F.sum(pairs), F.lit(0.0)), F.lit(0.0)).alias("transitivity"), (F.sum("triangles") / 3).cast("long").alias("triangles"))


def core_numbers(nodes: DataFrame, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """(node, core): each node's estimate, from its degree down, becomes the largest h
    such that h neighbours have an estimate of h or more, until nothing changes."""
    by = list(by)
    sym = cut(symmetrise(edges, by))
    start = nodes.join(sym.groupBy(*by, F.col("src").alias("node")).agg(F.count("*").alias("core")), cols(by, "node"), "left").fillna(0, ["core"]).select(*by, "node", "core")

    def step(state: DataFrame, _: int) -> DataFrame:
        around = sym.join(state.select(*by, F.col("node").alias("dst"), "core"), cols(by, "dst")).select(*by, F.col("src").alias("node"), F.col("core").alias("c"))
        w = Window.partitionBy(*by, "node").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
        h = around.withColumn("r", F.count("*").over(w)).groupBy(*by, "node").agg(F.max(F.least("c", "r")).alias("h"))
        return state.join(h, cols(by, "node"), "left").select(*by, "node", F.least("core", F.coalesce("h", F.lit(0))).alias("core"))

    def done(before: DataFrame, after: DataFrame) -> bool:
        return before.agg(F.sum("core")).first()[0] == after.agg(F.sum("core")).first()[0]

    return iterate(start, step, done)


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): sets of nodes that reach each other, named by their largest
    node. Nodes without a way in or out are components of their own and leave first,
    again and again; the rest take the largest node that reaches them as colour, and what
    reaches its colour's root inside the colour is a component; it leaves, and the rest
    goes on until nothing is left."""
    left, links = cut(nodes.select("node").distinct()), cut(edges.filter("src <> dst").select("src", "dst"))
    done: list[DataFrame] = []
    while not left.isEmpty():
        inner = cut(left.join(links.select(F.col("src").alias("node")).distinct().hint("merge"), "node", "left_semi").join(links.select(F.col("dst").alias("node")).distinct().hint("merge"), "node", "left_semi"))
        alone = cut(left.join(inner.hint("merge"), "node", "left_anti"))
        if not alone.isEmpty():
            done.append(alone.select("node", F.col("node").alias("component")))
            left, links = inner, cut(induced_subgraph(links, inner))
            continue
        colour = cut(left.withColumn("colour", F.col("node")))
        while True:
            came = links.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("c"))
            after = cut(colour.join(came, "node", "left").select("node", F.greatest("colour", F.coalesce("c", "colour")).alias("colour"), (F.coalesce("c", "colour") > F.col("colour")).alias("moved")))
            discard(colour)
            colour = after.select("node", "colour")
            if after.filter("moved").isEmpty():
                break
        inside = links.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").filter("cs = cd").select("src", "dst")
        roots = colour.filter("node = colour").select(F.col("node").alias("source"))
        back = bfs(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots)
        done.append(cut(back.select("node", F.col("source").alias("component"))))
        left = cut(left.join(done[-1], "node", "left_anti"))
        links = cut(induced_subgraph(links, left))
    out = nodes.sparkSession.createDataFrame([], "node long, component long")
    for d in done:
        out = out.unionByName(d)
    return out


def degree_assortativity(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """(assortativity): Pearson correlation of the degrees at both ends, undirected."""
    sym = symmetrise(edges, by)
    k = sym.groupBy(*by, F.col("src").alias("node")).agg(F.count("*").alias("k"))
    e = sym.join(k.select(*by, F.col("node").alias("src"), F.col("k").alias("ks")), cols(by, "src")).join(k.select(*by, F.col("node").alias("dst"), F.col("k").alias("kd")), cols(by, "dst"))
    return e.groupBy(*by).agg(F.corr("ks", "kd").alias("assortativity"))


def directed_assortativity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(variant, assortativity) for in and out degrees at source and target."""
    d = degrees(nodes, edges)
    e = edges.join(d.select(F.col("node").alias("src"), F.col("in_degree").alias("si"), F.col("out_degree").alias("so")), "src").join(d.select(F.col("node").alias("dst"), F.col("in_degree").alias("ti"), F.col("out_degree").alias("to")), "dst")
    names = {"in_in": ("si", "ti"), "in_out": ("si", "to"), "out_in": ("so", "ti"), "out_out": ("so", "to")}
    one = e.agg(*[F.corr(a, b).alias(k) for k, (a, b) in names.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.col(k).alias("assortativity")) for k in names])).alias("x")).select("x.*")


def neighbour_degree(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """(k, knn, n): mean degree of the neighbours of nodes of degree k."""
    sym = symmetrise(edges, by)
    k = sym.groupBy(*by, F.col("src").alias("node")).agg(F.count("*").alias("k"))
    e = sym.join(k.select(*by, F.col("node").alias("dst"), F.col("k").alias("kd")), cols(by, "dst"))
    own = e.groupBy(*by, F.col("src").alias("node")).agg(F.avg("kd").alias("mean"), F.count("*").alias("k"))
    return own.groupBy(*by, "k").agg(F.avg("mean").alias("knn"), F.count("*").alias("n"))


def maximal_cliques(edges: DataFrame, core: DataFrame) -> DataFrame:
    """(clique, size): every maximal clique of two or more nodes once, as a sorted array.

    Nodes are ordered by core number, then id. A node's task holds its later neighbours, of
    which there are at most the core number, and the links among them, and reports the
    cliques that nothing among these extends; a hub's earlier neighbours are in no task.
    What a node before all of a clique extends goes afterwards: of its member with the
    fewest links, the earlier neighbours are joined to all other members."""
    import pandas as pd

    sym = cut(symmetrise(edges))
    order = core.select("node", F.struct("core", "node").alias("o"))
    e = cut(sym.join(order.select(F.col("node").alias("src"), F.col("o").alias("a")).hint("merge"), "src").join(order.select(F.col("node").alias("dst"), F.col("o").alias("b")).hint("merge"), "dst").filter("a < b").select("src", "dst"))
    x, y = (e.select(F.col("src").alias("start"), F.col("dst").alias(c)) for c in "xy")
    among = x.join(y.hint("merge"), "start").filter("x < y").join(sym.select(F.col("src").alias("x"), F.col("dst").alias("y")).hint("merge"), ["x", "y"], "left_semi")
    rows = x.withColumn("y", F.lit(None).cast("long")).unionByName(among.select("start", "x", "y"))

    def cliques(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf["start"].iloc[0])
        link: dict[int, set[int]] = {int(v): set() for v in pdf.loc[pdf["y"].isna(), "x"]}
        for v, w in pdf.loc[pdf["y"].notna(), ["x", "y"]].itertuples(index=False):
            link[int(v)].add(int(w))
            link[int(w)].add(int(v))
        out, todo = [], [([start], set(link), set())]
        while todo:
            clique, may, not_ = todo.pop()
            if not may:
                if not not_:
                    out.append(sorted(clique))
                continue
            pivot = max(may | not_, key=lambda v: len(link[v] & may))
            for v in sorted(may - link[pivot]):
                todo.append(([*clique, v], may & link[v], not_ & link[v]))
                may = may - {v}
                not_ = not_ | {v}
        return pd.DataFrame({"start": start, "clique": pd.Series(out, dtype=object)})

    found = cut(rows.groupBy("start").applyInPandas(cliques, "start long, clique array<bigint>"))
    degree = sym.groupBy(F.col("src").alias("m")).agg(F.count("*").alias("k"))
    least = found.select("start", "clique", F.explode("clique").alias("m")).join(degree.hint("merge"), "m").groupBy("start", "clique").agg(F.min_by("m", F.struct("k", "m")).alias("m"))
    before = least.join(sym.select(F.col("src").alias("m"), F.col("dst").alias("u")).hint("merge"), "m")
    before = before.join(order.select(F.col("node").alias("u"), F.col("o").alias("ou")).hint("merge"), "u").join(order.select(F.col("node").alias("start"), F.col("o").alias("os")).hint("merge"), "start").filter("ou < os")
    pairs = before.select("clique", "u", F.explode("clique").alias("m")).join(sym.select(F.col("src").alias("u"), F.col("dst").alias("m")).hint("merge"), ["u", "m"], "left_semi")
    extended = pairs.groupBy("clique", "u").agg(F.count("*").alias("n")).filter(F.col("n") == F.size("clique")).select("clique").distinct()
    return found.select("clique", F.size("clique").alias("size")).join(extended.hint("merge"), "clique", "left_anti")


def k_cliques(edges: DataFrame, k: int) -> DataFrame:
    """(k, n): distinct cliques of k nodes, by joins along ascending nodes."""
    und = undirected(edges)
    paths = und.select(F.col("a").alias("v1"), F.col("b").alias("v2"))
    for i in range(3, k + 1):
        paths = paths.join(und.select(F.col("a").alias(f"v{i - 1}"), F.col("b").alias(f"v{i}")), f"v{i - 1}")
        for j in range(1, i - 1):
            paths = paths.join(und.select(F.col("a").alias(f"v{j}"), F.col("b").alias(f"v{i}")), [f"v{j}", f"v{i}"], "left_semi")
    return paths.agg(F.lit(k).alias("k"), F.count("*").alias("n"))


def neighbour_overlap(edges: DataFrame) -> DataFrame:
    """(a, b, shared) for linked pairs: neighbours that both have."""
    sym = symmetrise(edges)
    und = undirected(edges)
    x, y = sym.select(F.col("src").alias("a"), F.col("dst").alias("n")), sym.select(F.col("src").alias("b"), F.col("dst").alias("n"))
    shared = und.join(x, "a").join(y, ["b", "n"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return und.join(shared, ["a", "b"], "left").fillna(0, ["shared"])


def distances_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, node, dist) of those of pairs(source, node) that have a way."""
    pairs = pairs.select("source", "node").distinct()
    if few_links := in_tasks(edges, pairs.select("source").distinct()):
        return lookups(few_links, cut(pairs))
    return bfs(edges, pairs.select("source").distinct()).join(pairs, ["source", "node"], "left_semi")


def distance_lookup(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, dist) for pairs(a, b): hops between them, null where there is no way."""
    d = distances_between(edges, pairs.select(F.col("a").alias("source"), F.col("b").alias("node")))
    return pairs.join(d.select(F.col("source").alias("a"), F.col("node").alias("b"), "dist").hint("merge"), ["a", "b"], "left")
