"""Node-removal sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.functions.scalars import seeded
from linkscope.operators.retrieval import few
from linkscope.operators.structure import component_sizes, connected_components, giant, induced_subgraph, symmetrise
from linkscope.plans.iterate import cut
from linkscope.plans.order import numbered_in_few


#: Links that one task adds up; a sweep with more is split at FAN steps.
GROUP, FAN = 1 << 18, 16


def removal_curve(nodes: DataFrame, edges: DataFrame, order: DataFrame, by: list[str] = ()) -> DataFrame:
    """(step, giant): size of the largest component after the first step removals of
    order(by, node, step), whole steps from 1.

    Read backwards, removals are links that come: a link is there until the first of its
    ends goes (its key), and components only merge. A sweep of at most GROUP links is added
    up in one task, largest keys first, with a growing forest. A longer one is split: at
    FAN steps its components are found by Spark, all of them in one job, and each interval
    between two such steps is a sweep of its own, whose nodes are the components at its
    end and whose links are those that come inside it. So the work depends on the links,
    not on links times steps. An interval of one step needs no sweep."""
    by = list(by)
    last = order.groupBy(*by).agg(F.max("step").alias("last"))
    n, removed = nodes.count(), order.select(*by, "node").distinct().groupBy(*by).agg(F.count("*").alias("removed"))
    # where every node goes in the end, nothing is left after the last step
    last = cut(last.join(removed.hint("merge"), by).withColumn("all", F.col("removed") >= n) if by else last.crossJoin(F.broadcast(removed)).withColumn("all", F.col("removed") >= n))  # one row each
    gone = order.groupBy(*by, "node").agg(F.min("step").alias("at"))
    und = symmetrise(edges).filter("src < dst")
    if by:
        und = und.crossJoin(F.broadcast(last.select(*by)))  # a row a sweep
    for end in ("src", "dst"):
        und = und.join(gone.select(*by, F.col("node").alias(end), F.col("at").alias(f"at_{end}")).hint("merge"), [*by, end], "left")
    key = F.least(F.coalesce("at_src", F.lit(NEVER)), F.coalesce("at_dst", F.lit(NEVER)))
    # sweeps(lo, hi): steps lo <= t < hi; floor: the largest component at hi; weights of nodes that stand for more than one
    links = cut(und.select(*by, F.lit(0).cast("long").alias("lo"), "src", "dst", key.cast("long").alias("key")))
    sweeps = cut(last.select(*by, F.lit(0).cast("long").alias("lo"), (F.col("last") + 1).cast("long").alias("hi"), F.lit(1).cast("long").alias("floor")))
    weights = links.select(*by, "lo", F.col("src").alias("node"), F.lit(1).cast("long").alias("weight")).limit(0)
    known: list[DataFrame] = []
    while True:
        keys = [*by, "lo"]
        size = links.groupBy(*keys).agg(F.count("*").alias("links"))
        sweeps = cut(sweeps.join(size.hint("merge"), keys, "left").fillna(0, ["links"]))
        large, one = F.col("links") > GROUP, F.col("hi") - F.col("lo") == 1
        known += [_swept(links, weights, sweeps.filter(~large), by), _one_step(links, weights, sweeps.filter(large & one), by)]
        long = sweeps.filter(large & ~one)
        if long.isEmpty():
            break
        sweeps, links, weights = _split(links, weights, long.drop("links"), by)
    out = known[0]
    for k in known[1:]:
        out = out.unionByName(k)
    got = order.select(*by, "step").distinct().join(out.hint("merge"), [*by, "step"])
    ends = last.select(*by, F.col("last").alias("step"), "all")
    got = got.join(ends.hint("merge"), [*by, "step"], "left")
    return got.select(*by, "step", F.when(F.col("all"), 0).otherwise(F.col("giant")).cast("long").alias("giant"))


#: The key of a link whose ends stay.
NEVER = 1 << 60


def _swept(links: DataFrame, weights: DataFrame, sweeps: DataFrame, by: list[str]) -> DataFrame:
    """(step, giant) of each sweep, links added in a task."""
    import numpy as np
    import pandas as pd

    keys = [*by, "lo"]
    few_ = few(sweeps.select(*keys))
    rows = links.join(few_, keys, "left_semi").select(*keys, "src", "dst", "key", F.lit(None).cast("long").alias("floor"))
    heavy = weights.join(few_, keys, "left_semi").select(*keys, F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"), F.col("weight").alias("key"), F.lit(None).cast("long").alias("floor"))
    rows = rows.unionByName(heavy).unionByName(sweeps.select(*keys, F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), F.col("hi").alias("key"), "floor"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in links.select(*by).schema), "step long", "giant long"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["floor"].notna()].iloc[0]
        lo, hi, best = int(own["lo"]), int(own["key"]), int(own["floor"])
        got = pdf[pdf["dst"].notna()].sort_values("key", ascending=False)
        mass = pdf[pdf["dst"].isna() & pdf["src"].notna()]
        at, ends = np.unique(np.concatenate([got["src"], got["dst"]]).astype("int64"), return_inverse=True)
        size = np.ones(len(at), np.int64)
        if len(mass):
            place = np.searchsorted(at, mass["src"].astype("int64"))
            fine = place < len(at)
            fine[fine] = at[place[fine]] == mass["src"].to_numpy()[fine].astype("int64")
            size[place[fine]] = mass["key"].to_numpy()[fine]
        up, size = list(range(len(at))), size.tolist()
        giant = np.zeros(hi - lo, np.int64)

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b, key in zip(ends[: len(got)].tolist(), ends[len(got) :].tolist(), got["key"].astype("int64").tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                if size[a] < size[b]:
                    a, b = b, a
                up[b] = a
                size[a] += size[b]
                if size[a] > best:
                    best = size[a]
                    if key > lo:  # there at all steps before the key
                        giant[min(key, hi) - lo - 1] = best
        giant = np.maximum(np.maximum.accumulate(giant[::-1])[::-1], int(own["floor"]))
        return pd.DataFrame({**{c: [own[c]] * (hi - lo) for c in by}, "step": np.arange(lo, hi), "giant": giant})

    return rows.groupBy(*keys).applyInPandas(add, schema)


def _weighed(labels: DataFrame, weights: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """(component, weight) by group; a node without a weight counts 1."""
    mass = labels.join(weights.hint("merge"), [*keys, "node"], "left").fillna(1, ["weight"])
    return mass.groupBy(*group, "component").agg(F.sum("weight").alias("weight"))


def _one_step(links: DataFrame, weights: DataFrame, sweeps: DataFrame, by: list[str]) -> DataFrame:
    """(step, giant) of sweeps of one step, all of whose links are there."""
    keys = [*by, "lo"]
    there = links.join(few(sweeps.select(*keys)), keys, "left_semi").filter("key > lo")
    ends = there.select(*keys, F.col("src").alias("node")).union(there.select(*keys, "dst")).distinct()
    largest = _weighed(connected_components(ends, there, keys), weights, keys, keys).groupBy(*keys).agg(F.max("weight").alias("largest"))
    return sweeps.join(largest.hint("merge"), keys, "left").select(*by, F.col("lo").alias("step"), F.greatest("floor", F.coalesce("largest", F.lit(1))).alias("giant"))


def _split(links: DataFrame, weights: DataFrame, sweeps: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sweeps, links and weights of FAN intervals for each long sweep. Intervals are few, and one
    may have all links: they go to the links, which would meet in one task otherwise."""
    keys = [*by, "lo"]
    wide = F.greatest(F.lit(1), F.expr(f"(hi - lo + {FAN} - 1) div {FAN}"))
    starts = F.sequence(F.col("lo"), F.col("hi") - 1, wide)
    each = cut(sweeps.select(*keys, "floor", "hi", F.posexplode(starts).alias("i", "from")).withColumn("to", F.least("hi", F.col("from") + wide)).drop("i"))
    inner = each.filter("to < hi").select(*keys, F.col("to").alias("upto"))
    # components at each step between intervals; by sweep and step
    there = links.join(few(inner), keys).filter("key > upto").select(*keys, "upto", "src", "dst")
    group = [*keys, "upto"]
    ends = there.select(*group, F.col("src").alias("node")).union(there.select(*group, "dst")).distinct()
    labels = cut(connected_components(cut(ends), there, group))
    sizes = cut(_weighed(labels, weights, group, keys))
    largest = sizes.groupBy(*group).agg(F.max("weight").alias("largest"))
    to = [*keys, "to"]
    next_sweeps = each.join(largest.withColumnRenamed("upto", "to").hint("merge"), to, "left")
    next_sweeps = cut(next_sweeps.select(*by, F.col("from").alias("lo"), F.col("to").alias("hi"), F.greatest("floor", F.coalesce("largest", F.lit(1))).alias("floor")))
    # a link belongs to the interval in which it comes, between the components at its end
    come = links.join(few(each.select(*keys, "from", "to", "hi")), keys).filter("key > from and (key <= to or to = hi)")
    name = labels.withColumnRenamed("upto", "to")
    for end in ("src", "dst"):
        come = come.join(name.select(*to, F.col("node").alias(end), F.col("component").alias(f"c_{end}")).hint("merge"), [*to, end], "left")
        come = come.withColumn(end, F.coalesce(f"c_{end}", end)).drop(f"c_{end}")
    next_links = cut(come.filter("src <> dst").select(*by, F.col("from").alias("lo"), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "key").groupBy(*by, "lo", "src", "dst").agg(F.max("key").alias("key")))
    begun = few(each.select(*keys, "from", "to"))
    grown = sizes.withColumnRenamed("upto", "to").join(begun, to).select(*by, F.col("from").alias("lo"), F.col("component").alias("node"), "weight")
    # nodes that nothing has joined yet keep the weight that they had
    held = weights.join(begun, keys).join(name.select(*to, "node").hint("merge"), [*to, "node"], "left_anti").select(*by, F.col("from").alias("lo"), "node", "weight")
    used = next_links.select(*by, "lo", F.col("src").alias("node")).union(next_links.select(*by, "lo", "dst")).distinct()
    return next_sweeps, next_links, cut(grown.unionByName(held).join(used.hint("merge"), [*by, "lo", "node"], "left_semi"))


def adaptive_attack(nodes: DataFrame, edges: DataFrame, steps: int, measure=None) -> DataFrame:
    """(step, node, giant): each step removes the best node of the current giant component, the
    smaller on ties, and gives the giant's size before it goes. measure: (nodes, edges) ->
    (node, score), degree by default. A shorter sweep is a prefix of a longer one."""
    spark = nodes.sparkSession
    links = cut(symmetrise(edges))
    left, rows = cut(nodes.select("node")), []
    for i in range(1, steps + 1):
        big = cut(giant(connected_components(left, links)))
        inside = induced_subgraph(links, big)
        score = measure(big, inside) if measure else big.join(inside.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("score")), "node", "left").fillna(0, ["score"])
        best = score.orderBy(F.desc(F.round("score", 9)), "node").limit(1).collect()
        if not best:
            break
        node = best[0]["node"]
        rows.append((i, node, big.count()))
        left, links = cut(left.filter(F.col("node") != node)), cut(links.filter((F.col("src") != node) & (F.col("dst") != node)))
    return spark.createDataFrame(rows, "step int, node long, giant long")


def random_orders(nodes: DataFrame, replicates: int, steps: int | None = None, seed: int = 1) -> DataFrame:
    """(replicate, node, step): seeded removal orders of all nodes, or of the first steps."""
    runs = F.broadcast(nodes.sparkSession.range(replicates).select(F.col("id").alias("replicate")))
    every = nodes.select("node").crossJoin(runs).withColumn("_hash", seeded(seed, "node", "replicate"))
    out = numbered_in_few(every, "replicate", [F.col("_hash"), F.col("node")], "step").select("replicate", "node", F.col("step").cast("int").alias("step"))
    return out.filter(F.col("step") <= steps) if steps else out


def mean_curve(curves: DataFrame) -> DataFrame:
    """(step, giant): mean over replicates."""
    return curves.groupBy("step").agg(F.avg("giant").alias("giant"))


def halving_point(curve: DataFrame, n: int) -> DataFrame:
    """(to_half, robustness): first step with half of n or less, null if none; mean share over the sweep."""
    return curve.agg(F.min(F.when(2 * F.col("giant") <= n, F.col("step"))).alias("to_half"), (F.sum("giant") / n / F.count("*")).alias("robustness"))


def evaluate_removal_set(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """(removed, giant): size of the giant component without removed(node)."""
    left = nodes.join(removed, "node", "left_anti")
    s = component_sizes(connected_components(left, induced_subgraph(symmetrise(edges), left)))
    return s.agg(F.lit(removed.count()).cast("long").alias("removed"), F.coalesce(F.max("size"), F.lit(0)).alias("giant"))


def severed_nodes(nodes: DataFrame, edges: DataFrame, node: int) -> DataFrame:
    """(node): what leaves the giant component with one removal, the node itself aside."""
    before = giant(connected_components(nodes, edges))
    left = nodes.filter(F.col("node") != node)
    after = giant(connected_components(left, induced_subgraph(edges, left)))
    return before.filter(F.col("node") != node).join(after, "node", "left_anti")
