"""Heavy tails: discrete power laws fitted on histograms (k, n) of a sample, whose size
is the number of distinct values, not of observations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Models are normalised up to here.
K_TOP = 200_000


def hurwitz(s: float, q):
    """Sum of (q + i) ** -s over i >= 0, by Euler and Maclaurin; q is a number or an array."""
    n = 20
    head = sum((q + i) ** -s for i in range(n))
    a = q + n
    tail = a ** (1 - s) / (s - 1) + 0.5 * a**-s
    term = s * a ** (-s - 1)
    tail = tail + term / 12.0 - s * (s + 1) * (s + 2) * a ** (-s - 3) / 720 + s * (s + 1) * (s + 2) * (s + 3) * (s + 4) * a ** (-s - 5) / 30240
    return head + tail


def smallest(f, lo: float, hi: float, rounds: int = 6, points: int = 41) -> float:
    """Where f is smallest, by nested grids."""
    for _ in range(rounds):
        x = np.linspace(lo, hi, points)
        i = int(np.argmin([f(v) for v in x]))
        lo, hi = x[max(0, i - 1)], x[min(points - 1, i + 1)]
    return (lo + hi) / 2


def alpha_of(k: np.ndarray, n: np.ndarray, k_min: int) -> float:
    """Likeliest exponent in 1.01 .. 8 of the tail from k_min."""
    total, logs = n.sum(), float((n * np.log(k)).sum())
    return smallest(lambda a: a * logs + total * math.log(hurwitz(a, k_min)), 1.01, 8.0)


def ks_of(k: np.ndarray, n: np.ndarray, k_min: int, alpha: float) -> float:
    """Largest gap between both distribution functions over the integers from k_min to the
    largest value, of ascending values k. The sample's stays the same between two values
    while the law's rises, so the gap is largest at a value or just before the next one."""
    k = k.astype(np.float64)
    have = np.cumsum(n) / n.sum()
    law = 1 - hurwitz(alpha, k + 1) / hurwitz(alpha, float(k_min))
    before = 1 - hurwitz(alpha, k) / hurwitz(alpha, float(k_min))
    return float(max(np.abs(have - law).max(), np.abs(np.concatenate([[0.0], have[:-1]]) - before)[k > k_min].max(initial=0.0)))


def fit_candidate(k: np.ndarray, n: np.ndarray, i: int, min_tail: int) -> tuple[int, float, float, int] | None:
    """(k_min, alpha, ks, tail) for the tail from the value at i on; none if it is too short."""
    tail = int(n[i:].sum())
    if tail < min_tail or len(k) - i < 2:
        return None
    alpha = alpha_of(k[i:], n[i:], int(k[i]))
    return int(k[i]), alpha, ks_of(k[i:], n[i:], int(k[i]), alpha), tail


def fit_histogram(k: np.ndarray, n: np.ndarray, min_tail: int = 15) -> tuple[int, float, float, int] | None:
    """(k_min, alpha, ks, tail) of the smallest gap, the first on ties."""
    order = np.argsort(k)
    k, n = k[order], n[order]
    fits = [f for i in range(len(k)) if (f := fit_candidate(k, n, i, min_tail))]
    return min(fits, key=lambda f: (round(f[2], 12), f[0]), default=None)


def histogram(values: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(k, n) of positive values."""
    return values.filter(F.col(value) > 0).groupBy(*by, F.col(value).cast("long").alias("k")).agg(F.count("*").alias("n"))


#: Candidates for the start of a tail that a task tries at a time.
CANDIDATES = 16


def _keys(group: str | list[str]) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def _fields(hist: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {t}" for k, t in hist.dtypes if k in keys)


def fit_candidates(hist: DataFrame, group: str | list[str], min_tail: int = 15) -> DataFrame:
    """(group, k_min, alpha, ks, tail): the fit of every tail that is long enough. A row of
    the distinct values of a group goes to a task for each CANDIDATES starts of a tail."""
    keys = _keys(group)
    packed = hist.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("h"))
    each = packed.select(*keys, F.col("h.k").alias("k"), F.col("h.n").alias("n"), F.explode(F.sequence(F.lit(0), F.size("h") - 1, F.lit(CANDIDATES))).alias("at")).repartition(*keys, "at")

    def fit(frames):
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                k, n = np.array(row["k"], np.int64), np.array(row["n"], np.int64)
                fits = [fit_candidate(k, n, i, min_tail) for i in range(row["at"], min(len(k), row["at"] + CANDIDATES))]
                out += [(*(row[c] for c in keys), *f) for f in fits if f]
            yield pd.DataFrame(out, columns=[*keys, "k_min", "alpha", "ks", "tail"])

    return each.mapInPandas(fit, f"{_fields(hist, keys)}, k_min long, alpha double, ks double, tail long")


def fit_tails(hist: DataFrame, group: str | list[str], min_tail: int = 15) -> DataFrame:
    """(group, k_min, alpha, error, ks, tail) for each group's histogram: the tail of the
    smallest gap, the earliest on ties. group: one column or several."""
    best = fit_candidates(hist, group, min_tail).groupBy(*_keys(group)).agg(F.min_by(F.struct("k_min", "alpha", "ks", "tail"), F.struct(F.round("ks", 12), "k_min")).alias("f"))
    return best.select(*_keys(group), "f.k_min", "f.alpha", ((F.col("f.alpha") - 1) / F.sqrt("f.tail")).alias("error"), "f.ks", "f.tail")


def draw_tail(r: np.random.Generator, n: int, k_min: int, alpha: float) -> np.ndarray:
    """n draws of the discrete power law: the largest value that the law reaches or exceeds
    with at least the drawn probability, by doubling and halving. Values stop at 2 ** 52."""
    whole, p = hurwitz(alpha, float(k_min)), 1 - r.random(n)
    low, high = np.full(n, float(k_min)), np.full(n, 2.0 * k_min)
    while (up := (hurwitz(alpha, high) / whole >= p) & (high < 2**52)).any():
        low[up], high[up] = high[up], 2 * high[up]
    while (open_ := high - low > 1).any():
        mid = np.floor((low[open_] + high[open_]) / 2)
        over = hurwitz(alpha, mid) / whole >= p[open_]
        low[open_], high[open_] = np.where(over, mid, low[open_]), np.where(over, high[open_], mid)
    return low.astype(np.int64)


def bootstrap_pvalue(hist: DataFrame, group: str | list[str], fits: DataFrame, n_boot: int = 500, seed: int = 1) -> DataFrame:
    """(group, p): share of samples drawn from the fit (tail from the law, body from the
    data) whose own refit is as far off, with one added on both sides. A row of
    (group, replicate) is a task's unit."""
    spark, keys = hist.sparkSession, _keys(group)
    packed = hist.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("h")).join(fits.hint("merge"), keys).select(*keys, F.col("h.k").alias("k"), F.col("h.n").alias("n"), "k_min", "alpha", "ks", "tail")
    runs = packed.crossJoin(F.broadcast(spark.range(n_boot).select(F.col("id").alias("replicate")))).repartition(max(1, min(n_boot, 64)), *keys, "replicate")

    def boot(frames):
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                k, n = np.array(row["k"], np.int64), np.array(row["n"], np.int64)
                r = np.random.default_rng([seed, int(row["replicate"])])
                total, body = int(n.sum()), k < row["k_min"]
                tail = r.binomial(total, row["tail"] / total)
                below = r.multinomial(total - tail, n[body] / n[body].sum()) if body.any() else n[:0]
                drawn, times = np.unique(draw_tail(r, tail, int(row["k_min"]), row["alpha"]), return_counts=True)
                some = below > 0
                got = fit_histogram(np.concatenate([k[body][some], drawn]), np.concatenate([below[some], times]))
                out.append((*(row[c] for c in keys), bool(got and got[2] >= row["ks"])))
            yield pd.DataFrame(out, columns=[*keys, "worse"])

    drawn = runs.mapInPandas(boot, f"{_fields(hist, keys)}, worse boolean")
    return drawn.groupBy(*keys).agg(((F.sum(F.col("worse").cast("long")) + 1) / (F.count("*") + 1)).alias("p"))


def log_mass(family: str, grid: np.ndarray, p: tuple[float, ...]) -> np.ndarray:
    """Log probabilities of a family over the integers of grid, normalised there."""
    if family == "lognormal":
        x = -np.log(grid) - (np.log(grid) - p[0]) ** 2 / (2 * p[1] ** 2)
    elif family == "exponential":
        x = -p[0] * grid
    elif family == "truncated":
        x = -p[0] * np.log(grid) - p[1] * grid
    else:
        x = -p[0] * np.log(grid)
    x = x - x.max()
    return x - math.log(np.exp(x).sum())


def fit_family(family: str, k: np.ndarray, n: np.ndarray, k_min: int) -> tuple[float, ...]:
    """Likeliest parameters by nested grids, coordinate by coordinate twice."""
    grid = np.arange(k_min, min(K_TOP, max(2000, 20 * int(k.max()))))
    at = k - k_min

    def cost(*p):
        return -float((n * log_mass(family, grid, p)[at]).sum())

    if family == "exponential":
        return (smallest(lambda a: cost(a), 1e-4, 3.0, 5, 25),)
    bounds = ((-3.0, math.log(k.max()) + 1), (0.05, 5.0)) if family == "lognormal" else ((0.0, 6.0), (0.0, 1.0))
    p = [sum(b) / 2 for b in bounds]
    for _ in range(4):
        p[0] = smallest(lambda a: cost(a, p[1]), *bounds[0], 4, 17)
        p[1] = smallest(lambda b: cost(p[0], b), *bounds[1], 4, 17)
    return tuple(p)


def compare_tails(hist: DataFrame, group: str, fits: DataFrame) -> DataFrame:
    """(group, family, r, r_norm, p): log-likelihood ratio of the power law over each
    alternative on the same tail, divided by its deviation (one degree taken off), with a
    two-sided p; for the nested cut-off, chi-square with one degree of freedom. One task
    for each (group, family)."""
    families = hist.sparkSession.createDataFrame([("lognormal",), ("exponential",), ("truncated",)], "family string")
    rows = hist.join(fits.select(group, "k_min", "alpha"), group).filter("k >= k_min").crossJoin(F.broadcast(families))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        k, n, k_min, alpha, family = pdf["k"].to_numpy(), pdf["n"].to_numpy(), int(pdf["k_min"].iloc[0]), float(pdf["alpha"].iloc[0]), pdf["family"].iloc[0]
        grid = np.arange(k_min, min(K_TOP, max(2000, 20 * int(k.max()))))
        law = -alpha * np.log(k) - math.log(hurwitz(alpha, k_min))
        d = law - log_mass(family, grid, fit_family(family, k, n, k_min))[k - k_min]
        total, r = n.sum(), float((n * d).sum())
        sd = math.sqrt(max(0.0, float((n * (d - r / total) ** 2).sum()) / max(1, total - 1)))
        norm = r / (sd * math.sqrt(total)) if sd > 0 else 0.0
        p = math.erfc(math.sqrt(max(0.0, -2 * r) / 2)) if family == "truncated" else math.erfc(abs(norm) / math.sqrt(2))
        return pd.DataFrame([(pdf[group].iloc[0], family, r, norm, p)], columns=[group, "family", "r", "r_norm", "p"])

    return rows.groupBy(group, "family").applyInPandas(one, f"{group} {dict(hist.dtypes)[group]}, family string, r double, r_norm double, p double")
