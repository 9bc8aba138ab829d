"""Running sums and ranks against plain loops."""

import random

from pyspark.sql import functions as F

from linkscope.plans.order import average_ranks, running


def table(spark, n, seed):
    r = random.Random(seed)
    return [(i, r.choice([None, 5, 5, 5, r.randrange(1000)]), r.choice([None, r.randrange(9)])) for i in range(n)]


def test_running_sums(spark):
    data = table(spark, 700, 3)
    df = spark.createDataFrame(data, "id long, v long, x long").repartition(9)
    got = running(df, [F.col("v").asc_nulls_last(), F.col("id").desc()], row=F.lit(1), upto=F.col("x")).collect()
    at, total, want = 0, 0, {}
    for i, v, x in sorted(data, key=lambda r: (r[1] is None, r[1] or 0, -r[0])):
        at, total = at + 1, total + (x or 0)
        want[i] = (v, x, at, total)
    assert {r.id: (r.v, r.x, r.row, r.upto) for r in got} == want
    assert len(got) == 700


def test_running_replaces_a_column_and_takes_no_rows(spark):
    df = spark.createDataFrame([], "id long, row long, `a.b` string")
    got = running(df, [F.col("id")], row=F.lit(1))
    assert sorted(got.columns) == ["a.b", "id", "row"] and got.count() == 0


def test_average_ranks(spark):
    data = table(spark, 500, 4)
    got = average_ranks(spark.createDataFrame(data, "id long, v long, x long"), "v", "rank").collect()
    places: dict = {}
    for place, v in enumerate(sorted((v for _, v, _ in data), key=lambda v: (v is not None, v or 0)), 1):
        places.setdefault(v, []).append(place)
    assert {r.id: r.rank for r in got} == {i: sum(places[v]) / len(places[v]) for i, v, _ in data}


def test_no_window_over_all_rows(spark):
    df = spark.range(1000).withColumn("one", F.lit(1))
    plan = running(df, [F.col("one"), F.col("id")], row=F.lit(1))._jdf.queryExecution().optimizedPlan().toString()
    # the one window without partitions is over the ranges' totals
    assert sum("Window" in x and "[_range" in x and "windowspecdefinition(_range" in x and "_at" not in x for x in plan.splitlines()) == 1
