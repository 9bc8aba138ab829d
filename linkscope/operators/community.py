"""Communities and set scores. edges(a, b[, weight]) are undirected, once per pair;
labels(node, community), where a null community is a node of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscope.functions.scalars import seeded
from linkscope.operators.structure import bfs, cols
from linkscope.plans.iterate import cut, discard, iterate


def weighted(edges: DataFrame) -> DataFrame:
    return edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))


def both_ways(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    e = weighted(edges)
    return e.select(*by, "a", "b", "weight").union(e.select(*by, "b", "a", "weight"))


def named(labels: DataFrame) -> DataFrame:
    """labels with a community for every node: unlabelled ones get their own."""
    return labels.withColumn("community", F.coalesce(F.concat(F.lit("c"), F.col("community").cast("string")), F.concat(F.lit("n"), F.col("node").cast("string"))))


def modularity(edges: DataFrame, labels: DataFrame, by: list[str] = ()) -> DataFrame:
    """(q): sum over communities of links inside / m - (degree sum / 2m) ** 2. labels
    without columns of by hold for every graph."""
    by = list(by)
    e = weighted(edges)
    lab = named(labels)
    own = [c for c in by if c in labels.columns]
    x = both_ways(e, by).join(lab.select(*own, F.col("node").alias("a"), F.col("community").alias("ca")).hint("merge"), cols(own, "a")).join(lab.select(*own, F.col("node").alias("b"), F.col("community").alias("cb")).hint("merge"), cols(own, "b"))
    per = x.groupBy(*by, F.col("ca").alias("c")).agg(F.sum("weight").alias("d"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside2"))
    total = per.groupBy(*by).agg(F.sum("d").alias("m2"))
    j = per.join(total, by) if by else per.crossJoin(F.broadcast(total))
    return j.groupBy(*by).agg(F.sum(F.col("inside2") / F.col("m2") - (F.col("d") / F.col("m2")) ** 2).alias("q"))


def louvain(nodes: DataFrame, edges: DataFrame, seeds: int = 1, max_levels: int = 6, max_moves: int = 12) -> DataFrame:
    """(seed, node, community) by local moves and aggregation, all seeds at once.

    Moves of a round are decided together; a hash of node, seed and round lets half of
    the nodes move, so that neighbours seldom swap. A level ends when no node gains, and
    its best state by modularity is kept; then communities become nodes."""
    spark = nodes.sparkSession
    by = ["seed"]
    runs = F.broadcast(spark.range(seeds).select(F.col("id").cast("int").alias("seed")))
    e = cut(weighted(edges).crossJoin(runs).select("seed", "a", "b", "weight"))
    at = cut(nodes.crossJoin(runs).select("seed", "node", F.col("node").alias("community")))
    for level in range(max_levels):
        links = cut(both_ways(e.filter("a <> b"), by))
        loops = e.filter("a = b").select("seed", F.col("a").alias("node"), (2 * F.col("weight")).alias("d"))
        deg = cut(links.select("seed", F.col("a").alias("node"), F.col("weight").alias("d")).unionByName(loops).groupBy("seed", "node").agg(F.sum("d").alias("d")))
        total = cut(deg.groupBy("seed").agg(F.sum("d").alias("m2")))
        state = cut(deg.select("seed", "node", F.col("node").alias("c")))
        best, best_q = state, quality_of(e, state)
        for i in range(max_moves):
            sums = state.join(deg.hint("merge"), ["seed", "node"]).groupBy("seed", "c").agg(F.sum("d").alias("dc"))
            own = state.join(deg.hint("merge"), ["seed", "node"]).join(F.broadcast(total), "seed")
            near = links.join(state.select("seed", F.col("node").alias("b"), F.col("c").alias("to")).hint("merge"), ["seed", "b"]).groupBy("seed", F.col("a").alias("node"), "to").agg(F.sum("weight").alias("w"))
            stay = own.select("seed", "node", F.col("c").alias("to"), F.lit(0.0).alias("w"))
            options = near.unionByName(stay).groupBy("seed", "node", "to").agg(F.sum("w").alias("w")).join(own.hint("merge"), ["seed", "node"]).join(sums.withColumnRenamed("c", "to").hint("merge"), ["seed", "to"])
            others = F.col("dc") - F.when(F.col("to") == F.col("c"), F.col("d")).otherwise(0.0)
            gain = F.round(F.col("w") - others * F.col("d") / F.col("m2"), 9)
            o = options.withColumn("gain", gain)
            here = F.max(F.when(F.col("to") == F.col("c"), F.col("gain"))).alias("here")
            pick = o.groupBy("seed", "node").agg(F.max_by("to", F.struct("gain", -F.col("to"))).alias("to"), F.max("gain").alias("gain"), here, F.first("c").alias("c"))
            coin = F.xxhash64("node", "seed", F.lit(1000 * level + i)) % 2 == 0
            moved = cut(pick.select("seed", "node", F.when((F.col("gain") > F.col("here") + 1e-9) & coin, F.col("to")).otherwise(F.col("c")).alias("c"), (F.col("gain") > F.col("here") + 1e-9).alias("wants")))
            state = moved.select("seed", "node", "c")
            q = quality_of(e, state)
            better = {s for s in q if q[s] > best_q.get(s, -1) + 1e-12}
            if better:
                pickers = F.col("seed").isin(list(better))
                best = cut(state.filter(pickers).unionByName(best.filter(~pickers)))
                best_q |= {s: q[s] for s in better}
            if moved.filter("wants").isEmpty() or (i > 4 and not better):
                break
        merged = best.filter("node <> c").limit(1).count()
        at = cut(at.join(best.select("seed", F.col("node").alias("community"), "c").hint("merge"), ["seed", "community"], "left").select("seed", "node", F.coalesce("c", "community").alias("community")))
        if not merged:
            break
        x = e.join(best.select("seed", F.col("node").alias("a"), F.col("c").alias("ca")).hint("merge"), ["seed", "a"]).join(best.select("seed", F.col("node").alias("b"), F.col("c").alias("cb")).hint("merge"), ["seed", "b"])
        e = cut(x.groupBy("seed", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight")))
    return at


def quality_of(e: DataFrame, state: DataFrame) -> dict[int, float]:
    """Modularity by seed of a state; links inside aggregated nodes are loops."""
    x = e.join(state.select("seed", F.col("node").alias("a"), F.col("c").alias("ca")).hint("merge"), ["seed", "a"]).join(state.select("seed", F.col("node").alias("b"), F.col("c").alias("cb")).hint("merge"), ["seed", "b"])
    ends = x.select("seed", "weight", F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("o")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("o")))).alias("x"))
    per = ends.groupBy("seed", "x.c").agg(F.sum("weight").alias("d"), F.sum(F.when(F.col("x.c") == F.col("x.o"), F.col("weight")).otherwise(0.0)).alias("i"))
    total = per.groupBy("seed").agg(F.sum("d").alias("m2"))
    rows = per.join(F.broadcast(total), "seed").groupBy("seed").agg(F.sum(F.col("i") / F.col("m2") - (F.col("d") / F.col("m2")) ** 2).alias("q")).collect()  # one row a seed
    return {r["seed"]: r["q"] for r in rows}


def best_seed(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """labels(node, community) of the seed of highest modularity, the smaller seed on ties."""
    seeds = runs.select("seed").distinct()
    q = modularity(weighted(edges).crossJoin(F.broadcast(seeds)), runs, ["seed"])
    pick = q.orderBy(F.desc(F.round("q", 9)), "seed").limit(1).select("seed")
    return runs.join(F.broadcast(pick), "seed").select("node", "community")


def agglomerate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """labels(node, community) by greedy merging: each round every community proposes the
    partner of its best positive gain in modularity, and mutual proposals merge, until
    no merge gains."""
    e0 = cut(weighted(edges))

    def step(state: DataFrame, _: int) -> DataFrame:
        x = both_ways(e0).join(state.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(state.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
        d = x.groupBy("ca").agg(F.sum("weight").alias("d"))
        m2 = d.agg(F.sum("d").alias("m2"))
        pairs = x.filter("ca <> cb").groupBy("ca", "cb").agg(F.sum("weight").alias("w")).join(d, "ca").join(d.select(F.col("ca").alias("cb"), F.col("d").alias("db")), "cb").crossJoin(F.broadcast(m2))
        gain = F.round(F.col("w") / F.col("m2") - F.col("d") * F.col("db") / (F.col("m2") * F.col("m2")), 12)
        best = pairs.withColumn("gain", gain).filter("gain > 0").groupBy("ca").agg(F.max_by("cb", F.struct("gain", -(F.col("ca") + F.col("cb")), -F.col("cb"))).alias("cb"))
        mutual = best.join(best.select(F.col("ca").alias("cb"), F.col("cb").alias("back")), "cb").filter("ca = back and cb < ca").select(F.col("ca").alias("community"), F.col("cb").alias("to"))
        return state.join(mutual, "community", "left").select("node", F.coalesce("to", "community").alias("community"))

    def done(a: DataFrame, b: DataFrame) -> bool:
        return a.select("community").distinct().count() == b.select("community").distinct().count()

    return iterate(nodes.select("node", F.col("node").alias("community")), step, done)


def nmi(a: DataFrame, b: DataFrame, by: list[str] = ()) -> DataFrame:
    """(nmi): mutual information over the mean of both entropies; 1 when both are trivial."""
    by = list(by)
    j = named(a).select(*by, "node", F.col("community").alias("x")).join(named(b).select(*by, "node", F.col("community").alias("y")).hint("merge"), cols(by, "node"))
    c = j.groupBy(*by, "x", "y").agg(F.count("*").alias("n"))
    c = cut(c)
    w = lambda *k: Window.partitionBy(*by, *k)
    c = c.withColumn("nx", F.sum("n").over(w("x"))).withColumn("ny", F.sum("n").over(w("y")))
    total = F.broadcast(c.groupBy(*by).agg(F.sum("n").alias("t")))  # a row a pair of partitions
    c = c.join(total, by) if by else c.crossJoin(total)
    i = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny"))))
    hx, hy = -F.sum(F.col("n") / F.col("t") * F.log(F.col("nx") / F.col("t"))), -F.sum(F.col("n") / F.col("t") * F.log(F.col("ny") / F.col("t")))
    g = c.groupBy(*by).agg(i.alias("i"), hx.alias("hx"), hy.alias("hy"))
    return g.select(*by, F.when(F.col("hx") + F.col("hy") < 1e-12, 1.0).otherwise(2 * F.col("i") / (F.col("hx") + F.col("hy"))).alias("nmi"))


def partition_stability(runs: DataFrame) -> DataFrame:
    """(seed_a, seed_b, nmi) for all pairs of seeds."""
    pairs = runs.select(F.col("seed").alias("seed_a")).distinct().join(runs.select(F.col("seed").alias("seed_b")).distinct(), F.col("seed_a") < F.col("seed_b"))
    a = F.broadcast(pairs).join(runs.withColumnRenamed("seed", "seed_a"), "seed_a")
    b = F.broadcast(pairs).join(runs.withColumnRenamed("seed", "seed_b"), "seed_b")
    return nmi(a, b, ["seed_a", "seed_b"])


def majority_map(labels: DataFrame, reference: DataFrame, by: list[str] = ()) -> DataFrame:
    """(community, reference): the reference community that each overlaps most, the smaller on ties."""
    c = labels.join(reference.select("node", F.col("community").alias("reference")).hint("merge"), "node").groupBy(*by, "community", "reference").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by, "community").orderBy(F.desc("n"), "reference")
    return c.withColumn("r", F.row_number().over(w)).filter("r = 1").select(*by, "community", "reference")


def flip_counts(runs: DataFrame, reference: DataFrame) -> DataFrame:
    """(node, flips): runs(seed, node, community) that put a node elsewhere than reference, after majority mapping."""
    m = majority_map(runs, reference, ["seed"])
    j = runs.join(m.hint("merge"), ["seed", "community"]).join(reference.select("node", F.col("community").alias("own")).hint("merge"), "node")
    return j.groupBy("node").agg(F.sum((F.col("reference") != F.col("own")).cast("long")).alias("flips"))


def community_profile(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, size, head, links_inside, degree_sum, q_share): head has the highest degree."""
    x = both_ways(edges).join(labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    deg = labels.join(x.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("d")), "node", "left").fillna(0.0, ["d"])
    per = deg.groupBy("community").agg(F.count("*").alias("size"), F.max_by("node", F.struct("d", -F.col("node"))).alias("head"), F.sum("d").alias("degree_sum"))
    inside = x.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg((F.sum("weight") / 2).alias("links_inside"))
    m2 = deg.agg(F.sum("d").alias("m2"))
    j = per.join(inside, "community", "left").fillna(0.0, ["links_inside"]).crossJoin(F.broadcast(m2))
    return j.select("community", "size", "head", "links_inside", "degree_sum", (2 * F.col("links_inside") / F.col("m2") - (F.col("degree_sum") / F.col("m2")) ** 2).alias("q_share"))


def seeded_propagation(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """labels(node, community) spread from seeds(node, community). First in rings, however
    many there are: unlabelled nodes take the heaviest label among labelled neighbours at
    once, the lower on ties. Then all but seeds settle on their neighbours' heaviest
    label, staying on ties, half of them (by a hash) in each round, until none would move;
    if that isn't reached in max_rounds, it is an error."""
    links = cut(both_ways(edges))
    fixed = seeds.select("node", F.lit(True).alias("fixed"))
    state = nodes.join(seeds, "node", "left").join(fixed, "node", "left").select("node", "community", F.coalesce("fixed", F.lit(False)).alias("fixed"), F.lit(True).alias("moves"))

    def votes(s: DataFrame) -> DataFrame:
        v = links.join(s.filter("community is not null").select(F.col("node").alias("b"), F.col("community").alias("c")), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("weight").alias("w"))
        return v.join(s.select("node", F.col("community").alias("own")), "node").groupBy("node").agg(F.max_by("c", F.struct("w", (F.col("c") == F.col("own")).cast("int"), -F.col("c"))).alias("c"))

    def ring(s: DataFrame, _: int) -> DataFrame:
        return s.join(votes(s), "node", "left").select("node", F.coalesce("community", "c").alias("community"), "fixed", (F.col("community").isNull() & F.col("c").isNotNull()).alias("moves"))

    def settle(s: DataFrame, i: int) -> DataFrame:
        turn = F.xxhash64("node", F.lit(i)) % 2 == 0
        moves = ~F.col("fixed") & F.coalesce(F.col("c") != F.col("community"), F.lit(False))
        return s.join(votes(s), "node", "left").select("node", F.when(moves & turn, F.col("c")).otherwise(F.col("community")).alias("community"), "fixed", moves.alias("moves"))

    def still(_: DataFrame, after: DataFrame) -> bool:
        return after.filter("moves").isEmpty()

    state = iterate(state, ring, still)
    return iterate(state, settle, still, max_rounds).select("node", "community")


def nearest_seed(edges: DataFrame, labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, seed): the nearest seed of a node's own label along links of that label, the smaller on ties."""
    e = both_ways(edges).select(F.col("a").alias("src"), F.col("b").alias("dst")).join(labels.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(labels.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst").filter("cs = cd").select("src", "dst")
    d = bfs(e, seeds.select(F.col("node").alias("source")))
    return d.groupBy("node").agg(F.min_by("source", F.struct("dist", "source")).alias("seed"))


def random_assignment(nodes: DataFrame, k: int, replicates: int) -> DataFrame:
    """(replicate, node, community): every node at random in one of k."""
    runs = F.broadcast(nodes.sparkSession.range(replicates).select(F.col("id").alias("replicate")))
    return nodes.crossJoin(runs).select("replicate", "node", F.pmod(F.xxhash64("node", "replicate"), F.lit(k)).alias("community"))


def set_scores(edges: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """(links, degree_sum, expected, surplus, q_share) of each set members(by, node): links
    inside, and those above what its degrees let expect, degree_sum ** 2 / 4m."""
    e = weighted(edges)
    deg = both_ways(e).groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("d"))
    m = e.agg(F.sum("weight").alias("m"))
    inside = e.join(members.select(*by, F.col("node").alias("a")), "a").join(members.select(*by, F.col("node").alias("b")), [*by, "b"]).groupBy(*by).agg(F.sum("weight").alias("links"))
    per = members.join(deg, "node", "left").groupBy(*by).agg(F.sum(F.coalesce("d", F.lit(0.0))).alias("degree_sum"))
    j = per.join(inside, by, "left").fillna(0.0, ["links"]).crossJoin(F.broadcast(m))
    expected = F.col("degree_sum") ** 2 / (4 * F.col("m"))
    return j.select(*by, "links", "degree_sum", expected.alias("expected"), (F.col("links") - expected).alias("surplus"), ((F.col("links") - expected) / F.col("m")).alias("q_share"))


def expansion_candidates(edges: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, links, gain): neighbours of each set, their links into it and what each
    would add to its surplus: links - d (2 D + d) / 4m."""
    e = weighted(edges)
    both = both_ways(e)
    deg = both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("d"))
    m = e.agg(F.sum("weight").alias("m"))
    size = members.join(deg, "node", "left").groupBy(*by).agg(F.sum(F.coalesce("d", F.lit(0.0))).alias("dd"))
    front = both.join(members.select(*by, F.col("node").alias("a")), "a").groupBy(*by, F.col("b").alias("node")).agg(F.sum("weight").alias("links"))
    front = front.join(members.select(*by, "node"), [*by, "node"], "left_anti")
    j = front.join(deg, "node").join(size, by).crossJoin(F.broadcast(m))
    return j.select(*by, "node", "links", (F.col("links") - F.col("d") * (2 * F.col("dd") + F.col("d")) / (4 * F.col("m"))).alias("gain"))


def greedy_expand(edges: DataFrame, hosts: DataFrame, k: int) -> DataFrame:
    """(host, node): each host's set after k times adding the best candidate, the smaller on ties; all hosts at once."""
    members = cut(hosts.select("host", F.col("host").alias("node")))
    for _ in range(k):
        w = Window.partitionBy("host").orderBy(F.desc(F.round("gain", 9)), "node")
        add = expansion_candidates(edges, members, ["host"]).withColumn("r", F.row_number().over(w)).filter("r = 1").select("host", "node")
        members = cut(members.unionByName(add))
    return members


def swap_improve(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(host, node): sets members(host, node), each bettered by its best swap of one member (not
    the host) for one neighbour, round by round while some swap raises the surplus (see
    set_scores) by more than 1e-9, ties to the smaller member, then neighbour. Surpluses
    only grow, so it ends."""
    members = cut(members.select("host", "node"))
    both = cut(both_ways(edges))
    deg = cut(both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("d")))
    m = edges.count() if "weight" not in edges.columns else edges.agg(F.sum("weight")).first()[0]
    while True:
        out = members.filter("node <> host").join(deg, "node").select("host", F.col("node").alias("out"), F.col("d").alias("d_out"))
        inside = members.join(both.select(F.col("a").alias("node"), F.col("b").alias("to"), "weight"), "node").join(members.select("host", F.col("node").alias("to")), ["host", "to"]).groupBy("host", F.col("node").alias("out")).agg(F.sum("weight").alias("l_out"))
        total = members.join(deg, "node", "left").groupBy("host").agg(F.sum(F.coalesce("d", F.lit(0.0))).alias("dd"))
        into = members.join(both.select(F.col("a").alias("node"), F.col("b").alias("new"), "weight"), "node").groupBy("host", "new").agg(F.sum("weight").alias("l_new"))
        into = into.join(members.withColumnRenamed("node", "new"), ["host", "new"], "left_anti").join(deg.select(F.col("node").alias("new"), F.col("d").alias("d_new")), "new")
        # a host's members with its candidates: sets are small
        pairs = out.join(inside, ["host", "out"], "left").fillna(0.0, ["l_out"]).join(total, "host").join(into, "host")
        pairs = pairs.join(both.select(F.col("a").alias("out"), F.col("b").alias("new"), F.col("weight").alias("w")), ["out", "new"], "left").fillna(0.0, ["w"])
        after = F.col("dd") - F.col("d_out") + F.col("d_new")
        gain = F.col("l_new") - F.col("w") - F.col("l_out") - (after * after - F.col("dd") * F.col("dd")) / (4 * m)
        best = pairs.withColumn("gain", F.round(gain, 9)).filter("gain > 1e-9").groupBy("host").agg(F.min(F.struct(-F.col("gain"), "out", "new")).alias("x"))
        swaps = cut(best.select("host", "x.out", "x.new"))
        if swaps.isEmpty():
            return members
        kept = members.join(swaps.select("host", F.col("out").alias("node")), ["host", "node"], "left_anti")
        after = cut(kept.unionByName(swaps.select("host", F.col("new").alias("node"))))
        discard(members)
        members = after


def attribute_partition(edges: DataFrame, nodes: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """(q, nmi): modularity of the partition by a column of nodes(node, column), and its
    likeness to reference(node, community)."""
    own = nodes.select("node", F.col(column).alias("community"))
    return modularity(edges, own).select("q").crossJoin(F.broadcast(nmi(own, reference)))  # one row each


def random_sets(edges: DataFrame, hosts: DataFrame, k: int, replicates: int, seed: int = 1) -> DataFrame:
    """(host, replicate, node): each host with k random neighbours, all of them if there are fewer."""
    runs = F.broadcast(hosts.sparkSession.range(replicates).select(F.col("id").alias("replicate")))
    near = both_ways(edges).select(F.col("a").alias("host"), F.col("b").alias("node")).join(hosts.select("host"), "host").crossJoin(runs)
    w = Window.partitionBy("host", "replicate").orderBy(seeded(seed, "host", "node", "replicate"))
    some = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("host", "replicate", "node")
    return some.unionByName(hosts.select("host").crossJoin(runs).select("host", "replicate", F.col("host").alias("node")))


def chance_levels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(density, same_chance, same_share): link density, chance and share of links within a community."""
    n = labels.groupBy("community").agg(F.count("*").alias("s")).agg(F.sum("s").alias("n"), (F.sum(F.col("s") * F.col("s")) / (F.sum("s") * F.sum("s"))).alias("same_chance"))
    x = weighted(edges).join(labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    e = x.agg(F.count("*").alias("m"), F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("same_share"))
    return n.crossJoin(F.broadcast(e)).select((2 * F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("density"), "same_chance", "same_share")
