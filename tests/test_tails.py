"""Tail fits against dense grids."""

import numpy as np
import pytest

from linkscope.operators import tails as H


def dense_gap(k, n, k_min, alpha):
    grid = np.arange(k_min, k.max() + 1)
    model = np.cumsum(grid**-alpha) / H.hurwitz(alpha, k_min)
    have = np.zeros(len(grid))
    have[k - k_min] = n
    return np.abs(np.cumsum(have) / n.sum() - model).max()


def sample(seed, n=400, alpha=2.4):
    return np.unique(H.draw_tail(np.random.default_rng(seed), n, 2, alpha), return_counts=True)


@pytest.mark.parametrize("seed", range(5))
def test_gap_at_distinct_values_is_that_of_the_grid(seed):
    k, n = sample(seed)
    keep = k < 5000
    k, n = k[keep], n[keep]
    for i in range(0, len(k) - 1, 3):
        for alpha in (1.5, 2.4, 3.3):
            assert H.ks_of(k[i:], n[i:], int(k[i]), alpha) == pytest.approx(dense_gap(k[i:], n[i:], int(k[i]), alpha), abs=1e-9)


def test_draws_follow_the_law():
    x = H.draw_tail(np.random.default_rng(1), 200_000, 3, 2.5)
    for v in (3, 4, 10, 50):
        assert (x >= v).mean() == pytest.approx(H.hurwitz(2.5, v) / H.hurwitz(2.5, 3), abs=0.006)
    assert x.min() == 3
    k, n = np.unique(x, return_counts=True)
    assert H.alpha_of(k, n, 3) == pytest.approx(2.5, abs=0.02)


def test_fits_by_several_keys(spark, monkeypatch):
    """The same as group by group, however candidates are dealt; a huge value costs nothing."""
    monkeypatch.setattr(H, "CANDIDATES", 3)
    rows, want = [], {}
    for a in ("x", "y"):
        for b in (1, 2):
            k, n = sample(10 * b + (a == "x"), 150)
            if b == 2:
                k, n = np.append(k, 10**9), np.append(n, 1)
            rows += [(a, b, int(v), int(c)) for v, c in zip(k, n, strict=True)]
            want[a, b] = H.fit_histogram(k, n)
    hist = spark.createDataFrame([*rows, ("z", 1, 5, 3)], "a string, b int, k long, n long")
    got = {(r["a"], r["b"]): (r["k_min"], r["alpha"], r["ks"], r["tail"]) for r in H.fit_tails(hist, ["a", "b"]).collect()}
    assert got.keys() == want.keys()
    for key, f in want.items():
        assert got[key] == pytest.approx(f)
    p = {(r["a"], r["b"]): r["p"] for r in H.bootstrap_pvalue(hist, ["a", "b"], H.fit_tails(hist, ["a", "b"]), 20).collect()}
    assert p.keys() == want.keys() and all(0 < v <= 1 for v in p.values()) and p["x", 1] > 0.1
