"""Nearest vectors by blocks, against all pairs."""

import random

from linkscope.operators import vectors as V


def test_nearest_vectors_by_blocks(spark):
    r = random.Random(8)
    data = [(i * 37 % 401, [float(r.randrange(-2, 3)) / 4 for _ in range(4)]) for i in range(120)]
    data += [(1000 + i, data[0][1]) for i in range(30)]  # copies: ties
    v = spark.createDataFrame(data, "id long, v array<float>")
    want = {tuple(x) for x in V.topk_neighbours(V.vector_cosines(v, 64), 5).select("doc_id", "other", "rank").collect()}
    got = V.vector_neighbours(v, 5, 50)
    assert {tuple(x) for x in got.select("doc_id", "other", "rank").collect()} == want
    inner = V.vector_neighbours(v, 5, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in inner  # k rows a row and block leave a task
