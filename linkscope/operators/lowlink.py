"""Cut points and what they cut off, by low-links on a spanning forest.

No search goes through the graph. A spanning forest comes out of hooking components; an
Euler tour of it is a linked list of arcs, ranked by pointer doubling; ranks give each
node its number in preorder and its subtree's size. The lowest and highest numbers that
links out of a subtree reach are range minima and maxima over those numbers, put together
from blocks of powers of two. Two tree edges lie in one block (a maximal part without a
cut point) if a link spans them, so blocks are connected components of tree edges. All
joins are on single nodes, arcs or blocks; the steps grow with the logarithm of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.operators.structure import component_sizes, connected_components, to_roots, undirected
from linkscope.plans.iterate import cut, discard
from linkscope.plans.order import running

#: A root comes before all arcs of its component.
FIRST = 1 << 62


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: links of a spanning forest. Each round every node hooks on to its
    smallest neighbour, if that is smaller, by the smallest link between them; the trees
    shrink to their roots and the links move there."""
    left = cut(undirected(edges).select(F.col("a").alias("src"), F.col("b").alias("dst"), "a", "b"))
    tree = left.select("a", "b").limit(0)
    while not left.isEmpty():
        both = left.union(left.select("dst", "src", "a", "b"))
        hooks = cut(both.groupBy(F.col("src").alias("at")).agg(F.min(F.struct("dst", "a", "b")).alias("h")).select("at", F.least("at", "h.dst").alias("to"), "h.a", "h.b"))
        tree = tree.unionByName(hooks.filter("to < at").select("a", "b"))
        up = to_roots(cut(hooks.select("at", "to")), [])
        moved = left.join(up.withColumnRenamed("at", "src").hint("merge"), "src").select(F.col("to").alias("src"), "dst", "a", "b")
        moved = moved.join(up.withColumnRenamed("at", "dst").hint("merge"), "dst").select("src", F.col("to").alias("dst"), "a", "b").filter("src <> dst")
        after = cut(moved.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min(F.struct("a", "b")).alias("h")).select("src", "dst", "h.a", "h.b"))
        discard(left, up)
        left = after
    return cut(tree)


def euler_tour(labels: DataFrame, tree: DataFrame) -> DataFrame:
    """(tail, head, left, back): every tree link as two arcs, with the number of arcs from
    this one to the end of its tour, and the same for its way back. labels(node,
    component): a tour starts and ends at the node that names the component.

    After the arc u -> v comes the one from v to the neighbour that follows u in v's order."""
    arcs = tree.select(F.col("a").alias("tail"), F.col("b").alias("head")).union(tree.select("b", "a"))
    arcs = cut(running(arcs, [F.col("tail"), F.col("head")], at=F.lit(1)))
    ends = arcs.groupBy(F.col("tail").alias("head")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    turned = arcs.select(F.col("head").alias("tail"), F.col("tail").alias("head"), F.col("at").alias("turn"))
    start = labels.filter("node = component").select(F.col("node").alias("head"), F.lit(True).alias("root"))
    j = arcs.join(turned.hint("merge"), ["tail", "head"]).join(ends.hint("merge"), "head").join(start.hint("merge"), "head", "left")
    on = F.when(F.col("turn") < F.col("last"), F.col("turn") + 1).otherwise(F.when(F.col("root").isNull(), F.col("first")))
    ways = cut(j.select("tail", "head", "at", "turn", on.alias("on")))
    state = cut(ways.select("at", "on", F.lit(1).cast("long").alias("left")))
    while not state.filter("on is not null").isEmpty():
        then = state.select(F.col("at").alias("on"), F.col("on").alias("then"), F.col("left").alias("more"))
        after = cut(state.join(then.hint("merge"), "on", "left").select("at", F.col("then").alias("on"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
        discard(state)
        state = after
    left = state.select("at", "left")
    back = left.select(F.col("at").alias("turn"), F.col("left").alias("back"))
    return ways.join(left.hint("merge"), "at").join(back.hint("merge"), "turn").select("tail", "head", "left", "back")


def preorder(labels: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, component, parent, pre, size): numbers from 1 such that a subtree of size nodes
    has those from pre on; a root has no parent."""
    down = euler_tour(labels, tree).filter(F.col("left") > F.col("back"))
    below = down.select(F.col("head").alias("node"), F.col("tail").alias("parent"), "left", F.expr("(left - back + 1) div 2").alias("size"))
    sizes = component_sizes(labels).select("component", F.col("size").alias("whole"))
    rows = labels.join(below.hint("merge"), "node", "left").join(sizes.hint("merge"), "component")
    rows = rows.select("node", "component", "parent", F.coalesce("left", F.lit(FIRST)).alias("left"), F.coalesce("size", "whole").cast("long").alias("size"))
    return cut(running(rows, [F.col("component"), F.col("left").desc()], pre=F.lit(1)).drop("left"))


def range_bounds(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges(key, lo, hi) with the least low and greatest high of values(at, low, high)
    over lo <= at <= hi. Every value stands in one block of each power of two, every range is
    made up of two blocks of a power at most."""
    levels = F.sequence(F.lit(0), F.lit(values.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0].bit_length()))
    blocks = values.select("low", "high", "at", F.explode(levels).alias("level")).groupBy("level", F.expr("shiftright(at, level)").alias("block")).agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def parts(i):
        a, b = F.ceil(F.col("lo") / F.pow(F.lit(2.0), i)).cast("long"), F.floor((F.col("hi") + 1) / F.pow(F.lit(2.0), i)).cast("long")
        pair = F.array(F.struct(i.alias("level"), a.alias("block"), ((a < b) & (a % 2 == 1)).alias("used")), F.struct(i.alias("level"), (b - 1).alias("block"), ((a < b) & (b % 2 == 1)).alias("used")))
        return F.filter(pair, lambda x: x["used"])

    asked = ranges.select("key", F.explode(F.flatten(F.transform(levels, parts))).alias("x")).select("key", "x.level", "x.block")
    return asked.join(blocks.hint("merge"), ["level", "block"]).groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, parent, pre, size, block): the tree link from parent to node lies in
    the block; a root has none. A block is named by the smallest node below one of its links."""
    links = cut(undirected(edges))
    labels = cut(connected_components(nodes, edges))
    tree = spanning_forest(edges)
    at = preorder(labels, tree)
    place = at.select("node", "pre", "size")
    rest = links.join(tree.hint("merge"), ["a", "b"], "left_anti")
    x, y = (place.select(F.col("node").alias(c), F.col("pre").alias(f"pre_{c}"), F.col("size").alias(f"size_{c}")) for c in "ab")
    rest = cut(rest.join(x.hint("merge"), "a").join(y.hint("merge"), "b"))
    reached = rest.select(F.col("pre_a").alias("at"), F.col("pre_b").alias("to")).union(rest.select("pre_b", "pre_a"))
    values = place.select(F.col("pre").alias("at"), F.col("pre").alias("to")).union(reached).groupBy("at").agg(F.min("to").alias("low"), F.max("to").alias("high"))
    low = range_bounds(cut(values), place.select(F.col("node").alias("key"), F.col("pre").alias("lo"), (F.col("pre") + F.col("size") - 1).alias("hi")))
    # links between tree edges, each named by its lower node: spanned by a link across, or by one that leaves the parent's subtree
    apart = (F.col("pre_a") + F.col("size_a") <= F.col("pre_b")) | (F.col("pre_b") + F.col("size_b") <= F.col("pre_a"))
    across = rest.filter(apart).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    above = at.filter("parent is not null").select("node", "parent").join(low.withColumnRenamed("key", "node").hint("merge"), "node")
    above = above.join(at.filter("parent is not null").select(F.col("node").alias("parent"), "pre", "size").hint("merge"), "parent")
    out = above.filter("low < pre or high >= pre + size").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    block = connected_components(at.filter("parent is not null").select("node"), across.unionByName(out))
    return cut(at.join(block.select("node", F.col("component").alias("block")).hint("merge"), "node", "left"))


def removal_damage(nodes: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(removed, damage, parts): for each candidate(node) of the giant component, how many
    further nodes leave it when the node goes, and into how many parts it falls; 1 for a
    node alone. Below a node, the subtrees of one block stay together, and those of the
    node's own block stay with the rest."""
    at = blocks(nodes, edges)
    giant = component_sizes(at.select("node", "component")).filter("giant").select("component", F.col("size").alias("n"))
    at = cut(at.join(F.broadcast(giant), "component"))  # one row
    below = at.filter("parent is not null").groupBy(F.col("parent").alias("node"), "block").agg(F.sum("size").alias("size"))
    own = at.select("node", "parent", F.col("block").alias("own"), "n")
    cut_off = below.join(own.select("node", "own").hint("merge"), "node").filter("own is null or block <> own")
    fall = cut_off.groupBy("node").agg(F.max("size").alias("largest"), F.sum("size").alias("off"), F.count("*").alias("k"))
    j = candidates.select("node").distinct().join(own.hint("merge"), "node").join(fall.hint("merge"), "node", "left").fillna(0, ["largest", "off", "k"])
    rest = F.when(F.col("parent").isNull(), 0).otherwise(F.col("n") - 1 - F.col("off"))
    damage = F.col("n") - 1 - F.greatest("largest", rest)
    parts = F.greatest(F.lit(1), F.col("k") + F.col("parent").isNotNull().cast("int"))
    return j.select(F.col("node").alias("removed"), damage.cast("long").alias("damage"), parts.cast("long").alias("parts"))


def articulation_points(damage: DataFrame) -> DataFrame:
    """(node): those whose removal leaves more than one part."""
    return damage.filter("parts > 1").select(F.col("removed").alias("node"))
