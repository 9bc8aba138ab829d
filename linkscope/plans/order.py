"""Row numbers, running sums and ranks over a whole table.

Rows are sorted by range and added up within their ranges; only the ranges' totals, as
many as there are shuffle partitions, meet in one task. A window without partitions
would hold all rows there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscope.plans.iterate import cut

#: monotonically_increasing_id holds the partition above this many bits.
ROW_BITS = 33


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df with a column for each of sums: its sum up to and with this row, by order, in
    which no two rows should be equal. Nulls count as 0. A column already so named is
    replaced."""
    df = df.drop(*sums)
    columns = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(*columns, *[F.coalesce(c, F.lit(0)).alias(f"_own_{name}") for name, c in sums.items()])
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", ROW_BITS))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = rows.groupBy("_range").agg(*[F.sum(f"_own_{name}").alias(name) for name in sums])
    before = totals.select("_range", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums])
    within = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(F.broadcast(before), "_range").select(*columns, *[(F.sum(f"_own_{name}").over(within) + F.col(f"_before_{name}")).alias(name) for name in sums])


def running_best(df: DataFrame, by: list[str], order: list[Column], **best: Column) -> DataFrame:
    """df with a column for each of best: its greatest value up to and with this row among the
    rows of the same by, in order. A group may lie in many ranges; what is added up
    between ranges is a row for each range and group in it."""
    df = df.drop(*best)
    columns = [F.col(f"`{c}`") for c in df.columns]
    keys = [F.col(f"`{c}`") for c in by]
    rows = df.select(*columns, *[c.alias(f"_own_{name}") for name, c in best.items()])
    rows = cut(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", ROW_BITS))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range and group
    totals = rows.groupBy("_range", *by).agg(*[F.max(f"_own_{name}").alias(name) for name in best])
    before = totals.select("_range", *by, *[F.max(name).over(earlier).alias(f"_before_{name}") for name in best])
    within = Window.partitionBy("_range", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(before.hint("merge"), ["_range", *by])
    return joined.select(*columns, *[F.greatest(F.max(f"_own_{name}").over(within), F.coalesce(F.col(f"_before_{name}"), F.max(f"_own_{name}").over(within))).alias(name) for name in best])


def numbered_in_few(df: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """df with name: each row's number from 1 among those of its value of by, of which there
    are few (replicates); a value's rows may lie in many ranges."""
    at = cut(running(df, [F.col(f"`{by}`"), *order], _at_all=F.lit(1)))
    first = at.groupBy(by).agg(F.min("_at_all").alias("_first"))
    return at.join(F.broadcast(first), by).withColumn(name, F.col("_at_all") - F.col("_first") + 1).drop("_at_all", "_first")  # a row a replicate


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with name: the rank of value from 1, ties sharing their mean rank, nulls first.
    Ranks come from the distinct values, so a tie of many rows is one of them."""
    n = df.groupBy(F.col(f"`{value}`").alias("_value")).agg(F.count("*").alias("_n"))
    upto = running(n, [F.col("_value").asc_nulls_first()], _upto=F.col("_n"))
    ranks = upto.select("_value", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.drop(name).join(ranks.hint("merge"), F.col(f"`{value}`").eqNullSafe(F.col("_value"))).drop("_value")
