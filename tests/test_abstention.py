"""Thresholds fitted without one row, against fitting them one by one."""

import random

import pytest

from linkscope.operators import retrieval as R

MIX = {"plain": 0.5, "hard": 0.3, "absent": 0.2}


def fitted(rows):
    """(score, threshold) by trying all midpoints."""
    values = sorted({v for _, _, _, v in rows})
    best = None
    for a, b in zip(values, values[1:], strict=False):
        t = (a + b) / 2
        score = 0
        for style in {s for _, s, _, _ in rows}:
            own = [(c, v) for _, s, c, v in rows if s == style]
            right = sum(v < t if style == "absent" else c and v >= t for c, v in own)
            score += MIX.get(style, 0) * right / len(own)
        if best is None or (round(score, 9), -t) > (best[0], -best[1]):
            best = (round(score, 9), t)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_leaving_one_out(spark, seed):
    r = random.Random(seed)
    styles = ["plain", "plain", "hard", "absent", "other"]
    rows = [(i, s := r.choice(styles), s != "absent" and r.random() < 0.6, float(r.randrange(3 + 9 * seed)) / 2) for i in range((2, 12, 30, 60)[seed])]
    if seed == 3:
        rows += [(100, "single", True, 3.25)]
    got = {x["qid"]: (x["threshold"], x["abstains"]) for x in R.loo_abstention(spark.createDataFrame(rows, "qid long, style string, correct boolean, value double"), MIX).collect()}
    want = {}
    for x in rows:
        if best := fitted([y for y in rows if y is not x]):
            want[x[0]] = (best[1], x[3] < best[1])
    assert got == want
