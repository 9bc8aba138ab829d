"""Arrival order: growth replayed from a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscope.plans.order import average_ranks, running


def arrival_ranks(nodes: DataFrame, when: str = "year", name: str = "node") -> DataFrame:
    """nodes with rank: by when (nulls last), then name. No task holds all nodes, nor all of one time."""
    return running(nodes, [F.col(when).asc_nulls_last(), F.col(name)], rank=F.lit(1))


def arrival_replay(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, step, degree): each node's degree after every step at which it changes; an
    edge exists from its later end's arrival on."""
    r = ranked.select("node", "rank")
    e = edges.join(r.select(F.col("node").alias("src"), F.col("rank").alias("rs")), "src").join(r.select(F.col("node").alias("dst"), F.col("rank").alias("rd")), "dst").withColumn("step", F.greatest("rs", "rd"))
    ends = e.select(F.col("src").alias("node"), "step").union(e.select("dst", "step"))
    c = ends.groupBy("node", "step").agg(F.count("*").alias("n"))
    return c.select("node", "step", F.sum("n").over(Window.partitionBy("node").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)).alias("degree"))


def first_mover(ranked: DataFrame, value: str, when: str = "year", top: int = 10) -> DataFrame:
    """(n, spearman, top_percentile): arrival against value among nodes with a time, and
    the mean arrival percentile of the top nodes by value."""
    known = ranked.filter(F.col(when).isNotNull())
    both = average_ranks(average_ranks(known.select(when, value), when, "_a"), value, "_b")
    c = both.select(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.count("*").alias("n"), F.corr("a", "b").alias("spearman"))
    best = known.orderBy(F.desc(value), "node").limit(top).agg(F.avg("rank").alias("mean"))
    return c.crossJoin(F.broadcast(best)).select("n", "spearman", (100 * F.col("mean") / F.col("n")).alias("top_percentile"))


def decade_profile(nodes: DataFrame, value: str, when: str = "year") -> DataFrame:
    """(decade, n, mean, median, top, holder) of value."""
    d = nodes.filter(F.col(when).isNotNull()).withColumn("decade", (F.floor(F.col(when) / 10) * 10).cast("int"))
    return d.groupBy("decade").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(value).alias("top"), F.max_by("node", F.struct(value, -F.col("node"))).alias("holder"))
