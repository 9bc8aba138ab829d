"""Centrality and comparison of rankings. Undirected measures take symmetric edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscope.operators.searches import dependencies, in_tasks
from linkscope.operators.structure import cols, degrees, pairs_of, symmetrise
from linkscope.plans.iterate import NotFinished, cut, iterate


def closeness(nodes: DataFrame, dist: DataFrame, by: list[str] = ()) -> DataFrame:
    """(node, closeness): reached nodes over their summed distance, scaled by the share
    of nodes reached; 0 for a node that reaches none. dist(source, node, dist) or
    (source, dist, n)."""
    n = nodes.groupBy(*by).agg(F.count("*").alias("n"))
    d = dist.filter("dist > 0").groupBy(*by, F.col("source").alias("node")).agg(F.sum(pairs_of(dist)).alias("r"), F.sum(pairs_of(dist) * F.col("dist")).alias("s"))
    j = nodes.join(d, cols(by, "node"), "left")
    j = j.join(F.broadcast(n), list(by)) if by else j.crossJoin(F.broadcast(n))
    return j.select(*by, "node", F.coalesce(F.col("r") / F.col("s") * F.col("r") / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0)).alias("closeness"))


def harmonic(nodes: DataFrame, dist: DataFrame, normalised: bool = True, by: list[str] = ()) -> DataFrame:
    """(node, harmonic): sum of 1 / distance, divided by n - 1 if normalised."""
    n = nodes.groupBy(*by).agg(F.count("*").alias("n"))
    d = dist.filter("dist > 0").groupBy(*by, F.col("source").alias("node")).agg(F.sum(pairs_of(dist) / F.col("dist")).alias("h"))
    j = nodes.join(d, cols(by, "node"), "left")
    j = j.join(F.broadcast(n), list(by)) if by else j.crossJoin(F.broadcast(n))
    h = F.coalesce("h", F.lit(0.0))
    return j.select(*by, "node", (h / F.nullif(F.col("n") - 1, F.lit(0)) if normalised else h).alias("harmonic"))


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, directed: bool = False, normalised: bool = True) -> DataFrame:
    """(node, betweenness) by Brandes' recursion for all sources at once.

    Tasks take the sources of a graph of few links, see searches. Else the state is keyed by (source, node); levels go forward adding path counts, then
    backward adding dependencies. sources(source): all nodes by default; for a sample of k
    the result is scaled by n / k. Undirected pairs count once."""
    n = nodes.count()
    links = edges if directed else symmetrise(edges)
    start = (sources or nodes.select(F.col("node").alias("source"))).distinct()
    k = start.count()
    scale = (n / k if k else 1.0) * (1.0 if directed else 0.5)
    if normalised:
        scale /= max(1.0, (n - 1) * (n - 2) / (1.0 if directed else 2.0))
    if few_links := in_tasks(links, start):
        each = dependencies(few_links, start).groupBy("node").agg(F.sum("b").alias("b"))
        return nodes.join(each.hint("merge"), "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))
    links = cut(links.select(F.col("src").alias("node"), F.col("dst").alias("to")))
    level = cut(start.select("source", F.col("source").alias("node"), F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("source", "node")
    while True:
        step = level.join(links, "node").groupBy("source", F.col("to").alias("node")).agg(F.sum("paths").alias("paths"))
        level = cut(step.join(seen, ["source", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.union(level.select("source", "node"))
    below = levels[-1].withColumn("share", F.lit(0.0))
    total = [below.select("source", "node", "share")]
    for upper in reversed(levels[:-1]):
        came = upper.select("source", F.col("node"), F.col("paths").alias("own")).join(links, "node").join(below.select("source", F.col("node").alias("to"), "paths", "share"), ["source", "to"])
        got = came.groupBy("source", "node").agg(F.sum(F.col("own") / F.col("paths") * (1 + F.col("share"))).alias("share"))
        below = cut(upper.join(got, ["source", "node"], "left").fillna(0.0, ["share"]))
        total.append(below.select("source", "node", "share"))
    shares = total[0]
    for t in total[1:]:
        shares = shares.union(t)
    each = shares.filter("source <> node").groupBy("node").agg(F.sum("share").alias("b"))
    return nodes.join(each, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def eigenvector(nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-10, max_rounds: int = 500, every: int = 4, steps: int | None = None) -> DataFrame:
    """(node, score): leading eigenvector of the undirected graph, of length 1, by
    power iteration on the matrix plus the identity; not settled within max_rounds (of
    every steps each) is an error. Where steps are given, so many are taken (rounded up
    to whole rounds), settled or not: with two hubs alike the rest can take thousands."""
    # the identity is a link of each node to itself, so that a step reads its state once
    sym = cut(symmetrise(edges).union(nodes.select("node", "node")))
    n = nodes.count()
    taken = [0]

    def step(state: DataFrame, _: int) -> DataFrame:
        for _ in range(every):  # rounds that run as one job
            state = sym.join(state.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("score").alias("score"))
        length = state.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("length"))
        return state.crossJoin(F.broadcast(length)).select("node", (F.col("score") / F.col("length")).alias("score"))

    def done(a: DataFrame, b: DataFrame) -> bool:
        if steps is not None:
            taken[0] += every
            return taken[0] >= steps
        moved = a.join(b.withColumnRenamed("score", "after"), "node").agg(F.sum(F.abs(F.col("score") - F.col("after")))).first()[0]
        return (moved or 0) < n * tolerance

    return iterate(nodes.select("node", F.lit(n**-0.5).alias("score")), step, done, max_rounds)


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-10, max_rounds: int = 1000, every: int = 3) -> DataFrame:
    """(node, rank), summing to 1. What nodes without links hold is spread over all.
    The tolerance (L1) is looked at after every few rounds, which run as one job; ranks
    that still move after max_rounds are an error."""
    n = nodes.count()
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
    nodes = cut(nodes.select("node").join(out, "node", "left"))
    links = cut(edges.select("src", "dst"))
    state = cut(nodes.select("node", "out", F.lit(1.0 / max(1, n)).alias("rank")))
    for i in range(1, max_rounds + 1):
        came = links.join(state.filter("out is not null").select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("part")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("in"))
        lost = state.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        after = state.join(came, "node", "left").crossJoin(F.broadcast(lost)).select("node", "out", F.col("rank").alias("old"), (F.lit((1 - alpha) / max(1, n)) + alpha * (F.coalesce("in", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if i % every == 0 or i == max_rounds:
            after = cut(after)
            if (after.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < tolerance:
                state = after
                break
        state = after.select("node", "out", "rank")
    else:
        raise NotFinished(f"ranks still move after {max_rounds} rounds")
    total = state.agg(F.sum("rank").alias("total"))
    return state.crossJoin(F.broadcast(total)).select("node", (F.col("rank") / F.col("total")).alias("rank"))


def top_k(scores: DataFrame, score: str, k: int, by: list[str] = (), key: str = "node") -> DataFrame:
    """The k best of score, ties to the smaller key."""
    if not by:
        return scores.orderBy(F.desc(score), key).limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return scores.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def rank_table(stacked: DataFrame) -> DataFrame:
    """(measure, node, score, rank) from (measure, node, score): ranks from 1, ties to the smaller node."""
    return stacked.withColumn("rank", F.row_number().over(Window.partitionBy("measure").orderBy(F.desc("score"), "node")))


def stack(measures: dict[str, DataFrame]) -> DataFrame:
    """(measure, node, score) from one (node, score column) table per measure."""
    out = None
    for name, df in measures.items():
        score = next(c for c in df.columns if c != "node")
        one = df.select(F.lit(name).alias("measure"), "node", F.col(score).cast("double").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def top_set_sizes(ranked: DataFrame, k: int) -> DataFrame:
    """(node, measures, n): nodes in some top k, with the measures that have them there."""
    return ranked.filter(F.col("rank") <= k).groupBy("node").agg(F.array_join(F.sort_array(F.collect_set("measure")), ",").alias("measures"), F.count("*").alias("n"))


def rank_shift(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node, rank_a, rank_b, shift): shift > 0 is a rise from a to b."""
    return a.select("node", F.col("rank").alias("rank_a")).join(b.select("node", F.col("rank").alias("rank_b")), "node").withColumn("shift", F.col("rank_a") - F.col("rank_b"))


def score_sources(edges: DataFrame, rank: DataFrame) -> DataFrame:
    """(node, source, share): what each predecessor sends a node per round."""
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    return edges.join(out, "src").join(rank.select(F.col("node").alias("src"), "rank"), "src").select(F.col("dst").alias("node"), F.col("src").alias("source"), (F.col("rank") / F.col("out")).alias("share"))


def powerlaw_residuals(points: DataFrame, x: str, y: str, key: str = "node") -> DataFrame:
    """(key, residual): log10 y above the straight line through all log-log points."""
    p = points.filter((F.col(x) > 0) & (F.col(y) > 0)).select(key, F.log10(x).alias("lx"), F.log10(y).alias("ly"))
    fit = p.agg(F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"))
    return p.crossJoin(F.broadcast(fit)).select(key, (F.col("ly") - F.col("intercept") - F.col("slope") * F.col("lx")).alias("residual"))


def friendship_paradox(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: mean degree of a linked node, of a random friend of a random node
    (P(friend = v) = sum over its neighbours u of 1 / (n k_u)) and of a random edge end,
    the chance that a friend has at least one's degree, the share of nodes below their
    neighbours' mean, and the nodes that no neighbour beats."""
    sym = symmetrise(edges)
    k = cut(sym.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k")))
    e = sym.join(k.select(F.col("node").alias("src"), F.col("k").alias("ks")), "src").join(k.select(F.col("node").alias("dst"), F.col("k").alias("kd")), "dst")
    n = k.agg(F.count("*").alias("n"), F.avg("k").alias("mean_degree"))
    ends = e.agg(F.sum(F.col("kd") / F.col("ks")).alias("friend"), F.avg("kd").alias("mean_end_degree"), F.sum(F.when(F.col("kd") >= F.col("ks"), 1 / F.col("ks")).otherwise(0.0)).alias("at_least"))
    own = e.groupBy("src", "ks").agg(F.avg("kd").alias("m"), F.max("kd").alias("top"))
    each = own.agg(F.avg((F.col("ks") < F.col("m")).cast("double")).alias("share_below"), F.sum((F.col("top") <= F.col("ks")).cast("long")).alias("unbeaten"))
    one = n.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(each))
    return one.select("n", "mean_degree", (F.col("friend") / F.col("n")).alias("mean_friend_degree"), "mean_end_degree", (F.col("at_least") / F.col("n")).alias("p_friend_at_least"), "share_below", "unbeaten")


def directed_paradox(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row over nodes with links out: share of links that lead up in in-degree,
    chance that a random link of a random node leads at least level, nodes that link
    only downward, and nodes more linked than all that link to them."""
    d = degrees(nodes, edges).select("node", "in_degree")
    e = edges.join(d.select(F.col("node").alias("src"), F.col("in_degree").alias("ks")), "src").join(d.select(F.col("node").alias("dst"), F.col("in_degree").alias("kd")), "dst")
    out = e.groupBy("src").agg(F.avg((F.col("kd") >= F.col("ks")).cast("double")).alias("level"), F.max((F.col("kd") >= F.col("ks")).cast("int")).alias("some_up"))
    into = e.groupBy("dst").agg(F.max((F.col("ks") >= F.col("kd")).cast("int")).alias("beaten"))
    a = e.agg(F.avg((F.col("kd") > F.col("ks")).cast("double")).alias("share_up"))
    b = out.agg(F.avg("level").alias("p_linked_at_least"), F.sum((F.col("some_up") == 0).cast("long")).alias("only_down"))
    c = into.agg(F.sum((F.col("beaten") == 0).cast("long")).alias("above_all_linkers"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))


def agreement(a: DataFrame, b: DataFrame, score: Column, tolerance: float) -> DataFrame:
    """(n, max_difference, agrees) of two results with the columns node and score."""
    j = a.select("node", score.alias("x")).join(b.select("node", score.alias("y")), "node", "full")
    return j.agg(F.count("*").alias("n"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_difference"), (F.coalesce(F.max(F.abs(F.col("x") - F.col("y"))), F.lit(0.0)) <= tolerance).alias("agrees"))
