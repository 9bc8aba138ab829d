"""Longest shared runs, against plain Python and on a text that repeats one line."""

import random

import numpy as np
from pyspark.sql import functions as F

from linkscope.operators import text as T


def plain(a, b):
    return max((k for i in range(len(a)) for j in range(len(b)) for k in [next((n for n in range(min(len(a) - i, len(b) - j)) if a[i + n] != b[j + n]), min(len(a) - i, len(b) - j))]), default=0)


def test_longest_run_of_two_lists():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.randrange(3) - 1 for _ in range(r.randrange(0, 30))] for _ in range(2))
        assert T._longest_run(np.array(a, np.int64), np.array(b, np.int64)) == plain(a, b), (a, b)


def test_repeated_lines_make_no_table_of_matches(spark):
    line = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, "x " + f"{line} " * 300 + "y"), (2, "z " + f"{line} " * 300), (3, "a b c")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    got = T.longest_shared_run(docs, pairs)
    assert [tuple(x) for x in got.collect()] == [(1, 2, 2700)]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()  # 810,000 matches lay in one before
    assert T.longest_shared_run(docs, pairs.select(F.col("a"), F.lit(3).cast("long").alias("b"))).count() == 0


def test_sweeps_go_to_their_links(spark):
    """One sweep may have all links: they aren't gathered by it."""
    from linkscope.operators import robustness as B

    links = spark.range(100).selectExpr("0L AS lo", "id AS src", "id + 1000 AS dst", "id + 1 AS key")
    sweeps = spark.createDataFrame([(0, 101, 1)], "lo long, hi long, floor long")
    swept = B._swept(links, links.selectExpr("lo", "src AS node", "1L AS weight").limit(0), sweeps, [])
    assert "SortMergeJoin" not in swept._jdf.queryExecution().executedPlan().toString()
    assert {r.giant for r in swept.filter("step < 100").collect()} == {2}
