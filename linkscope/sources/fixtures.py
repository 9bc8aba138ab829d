"""Graphs and corpora that queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes(node): every customer, isolates too."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("node"))


def successions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(src, dst): the customer of an urgent order to that of the next order."""
    o = read(spark, sf_dir, "orders")
    a = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("long").alias("src"), (F.col("o_orderkey") + 1).alias("k"))
    b = o.select(F.col("o_custkey").cast("long").alias("dst"), F.col("o_orderkey").alias("k"))
    return a.join(b, "k").filter("src <> dst").select("src", "dst").distinct()


def handovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(src, dst, weight): users of consecutive events, within event types."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("src"), "event_type", "ts", "event_id")
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = e.withColumn("dst", F.lead("src").over(w)).filter("dst is not null and src <> dst")
    return e.groupBy("src", "dst").agg(F.count("*").alias("weight"))
