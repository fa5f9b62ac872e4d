"""Closed-form statistics as Column expressions, and exact tests as Arrow functions over distinct counts."""

from __future__ import annotations

from collections import Counter
from math import exp, factorial, inf, lgamma, log, nan, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def wilson(k: Column, n: Column, alpha: float = 0.05, contain: bool = False) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k of n, within [0, 1]; NULL for n = 0, or (0, 1) with contain, which also makes the
    interval hold the rate in spite of rounding."""
    z = F.lit(normal_quantile(1 - alpha / 2))
    size = F.nullif(n.cast("double"), F.lit(0.0))
    p = k.cast("double") / size
    denominator = 1 + z * z / size
    centre = (p + z * z / (2 * size)) / denominator
    half = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size)) / denominator
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    if contain:
        return F.coalesce(F.least(low, p), F.lit(0.0)), F.coalesce(F.greatest(high, p), F.lit(1.0))
    return F.when(size.isNotNull(), low), F.when(size.isNotNull(), high)


def excludes(low: Column, high: Column, value: float) -> Column:
    """Whether an interval strictly excludes value; false where a bound is NULL, NaN or infinite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(finite(low) & finite(high) & ((low > value) | (high < value)), F.lit(False))


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", keys: tuple[str, ...] = (), alpha: float = 0.05, strict: bool = False) -> DataFrame:
    """tests with q_value and rejected: the step-up correction, over the family that keys divide. A family is one task,
    as every q-value needs all larger p-values.

    A p-value that is NULL, NaN or outside [0, 1] is no test: it is no member of the family, its q_value is NULL and it is
    not rejected; with strict it raises.
    """
    value = F.col(p).cast("double")
    valid = F.coalesce(~F.isnan(value) & value.between(0.0, 1.0), F.lit(False))
    if strict:
        tests = tests.withColumn(p, F.when(valid, F.col(p)).otherwise(F.raise_error(F.lit(f"{p} must lie within [0, 1]"))))
    family = Window.partitionBy(*keys, valid)
    ordered = family.orderBy(value)
    rank = F.row_number().over(ordered)
    d = tests.withColumn("__q", value * F.count(F.lit(1)).over(family) / rank).withColumn("__rank", rank)
    tail = family.orderBy("__rank").rowsBetween(0, Window.unboundedFollowing)
    q = F.when(valid, F.least(F.lit(1.0), F.min("__q").over(tail)))
    return d.withColumn("q_value", q).withColumn("rejected", F.coalesce(F.col("q_value") <= alpha, F.lit(False))).drop("__q", "__rank")


RATIO = T.StructType([T.StructField("point", T.DoubleType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("method", T.StringType())])


def rate_ratio(k1: int, n1: int, k0: int, n0: int, *, alpha: float = 0.05, method: str = "auto", n_boot: int = 10_000, seed: int = 0) -> tuple[float, float, float, str]:
    """The ratio of two rates with an interval and the method's name. `delta`: normal on the log scale, with half a case added to each cell
    where one is zero; `bootstrap`: percentiles of binomial draws; `auto`: bootstrap, but delta where a group has no case, as
    every draw of an empty cell is empty. An empty group, or two rates of zero, have no ratio: NaN with (0, inf)."""
    if min(k1, n1, k0, n0) < 0 or k1 > n1 or k0 > n0:
        raise ValueError("need 0 <= k <= n in both groups")
    if method not in ("auto", "delta", "bootstrap"):
        raise ValueError(f"unknown method {method}")
    if not n1 or not n0:
        return nan, 0.0, inf, "undefined_empty_group"
    if not k1 and not k0:
        return nan, 0.0, inf, "undefined_both_zero"
    empty = not k1 or not k0
    point = (k1 / n1) / (k0 / n0) if k0 else nan
    if method == "bootstrap" or (method == "auto" and not empty):
        rng = np.random.default_rng(seed)
        drawn1, drawn0 = rng.binomial(n1, k1 / n1, n_boot) / n1, rng.binomial(n0, k0 / n0, n_boot) / n0
        ratios = drawn1[drawn0 > 0] / drawn0[drawn0 > 0]
        low, high = np.quantile(ratios, [alpha / 2, 1 - alpha / 2]) if len(ratios) else (nan, nan)
        return point, float(low), float(high), "bootstrap"
    add = 0.5 if empty else 0.0
    cells = (k1 + add, n1 + 2 * add, k0 + add, n0 + 2 * add)
    spread = 1 / cells[0] - 1 / cells[1] + 1 / cells[2] - 1 / cells[3]
    if spread <= 0:
        return point, 0.0, inf, "delta_log_degenerate"
    centre, reach = log(cells[0] / cells[1] / (cells[2] / cells[3])), normal_quantile(1 - alpha / 2) * sqrt(spread)
    return point, exp(centre - reach), exp(centre + reach), "delta_log_haldane" if empty else "delta_log"


def with_rate_ratio(df: DataFrame, k1: str, n1: str, k0: str, n0: str, seed: Column, out: str = "ratio", *, alpha: float = 0.05, method: str = "auto", n_boot: int = 10_000) -> DataFrame:
    """df with out, a struct (point, lo, hi, method): each row's rate ratio, drawn with a seed of its own."""

    @F.pandas_udf(RATIO)
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rate_ratio(*map(int, x[:4]), alpha=alpha, method=method, n_boot=n_boot, seed=int(x[4])) for x in zip(a, b, c, d, s, strict=True)], columns=RATIO.names)

    return df.withColumn(out, test(k1, n1, k0, n0, seed))


def kendall_tau(a: list[float], b: list[float]) -> tuple[float, float]:
    """Tau-b of two rankings of a few things, and its two-sided p-value: exact without ties (by counting permutations of so many
    inversions), else by the normal approximation; NaN where one ranking is constant."""
    n = len(a)
    signs = [(x > y) - (x < y) for i, x in enumerate(a) for y in a[:i]], [(x > y) - (x < y) for i, x in enumerate(b) for y in b[:i]]
    score, free = sum(x * y for x, y in zip(*signs, strict=True)), [sum(map(abs, s)) for s in signs]
    if not free[0] or not free[1]:
        return nan, nan
    tau, pairs = score / sqrt(free[0] * free[1]), n * (n - 1) // 2
    if free == [pairs, pairs]:
        ways = [1]
        for m in range(2, n + 1):  # inversions of m things: those of m - 1, and up to m - 1 more
            ways = [sum(ways[max(0, j - m + 1) : j + 1]) for j in range(len(ways) + m - 1)]
        inversions = (pairs - score) // 2
        tail = min(inversions, pairs - inversions)
        return tau, min(1.0, 2 * sum(ways[: tail + 1]) / factorial(n))
    ties = [[c for c in Counter(x).values() if c > 1] for x in (a, b)]
    part = lambda f: [sum(f(t) for t in ts) for ts in ties]
    v = n * (n - 1) * (2 * n + 5) - sum(part(lambda t: t * (t - 1) * (2 * t + 5)))
    x, y = part(lambda t: t * (t - 1))
    u, w = part(lambda t: t * (t - 1) * (t - 2))
    variance = v / 18 + x * y / (2 * n * (n - 1)) + (u * w / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0)
    return tau, min(1.0, 2 * (1 - NormalDist().cdf(abs(score) / sqrt(variance))))


def fisher_greater(k1: int, n1: int, k0: int, n0: int) -> float:
    """One-sided exact test: odds of k1 successes or more in the first group, given all margins; 1 for an empty group."""
    if n1 <= 0 or n0 <= 0:
        return 1.0
    k = k1 + k0
    low, high = max(0, k - n0), min(n1, k)
    if k1 <= low:
        return 1.0
    choose = lambda n, r: lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1)
    odds = lambda x: exp(choose(n1, x) + choose(n0, k - x) - choose(n1 + n0, k))
    # The side of k1 that lies away from the mode is summed, until terms no longer count.
    upward = k1 > (k + 1) * (n1 + 1) / (n1 + n0 + 2)
    x = k1 if upward else k1 - 1
    term = tail = odds(x)
    while term > 1e-17 * tail and low < x + (not upward) and x < high + (not upward):
        if upward:
            term *= (n1 - x) * (k - x) / ((x + 1) * (n0 - k + x + 1))
        else:
            term *= x * (n0 - k + x) / ((n1 - x + 1) * (k - x + 1))
        x += 1 if upward else -1
        tail += term
    return min(1.0, tail if upward else 1.0 - tail)


def with_fisher(df: DataFrame, k1: str, n1: str, k0: str, n0: str, out: str = "p_value") -> DataFrame:
    """df with the p-value of each row's counts, NULL where one of them is; each distinct combination is computed once."""

    @F.pandas_udf(T.DoubleType())
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher_greater(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d, strict=True)])

    keys = [k1, n1, k0, n0]
    known = df.select(*[F.col(c).alias(f"__{c}") for c in keys]).distinct().na.drop().withColumn(out, test(*[f"__{c}" for c in keys]))
    same = [F.col(c) == F.col(f"__{c}") for c in keys]
    return df.join(known, same, "left").drop(*[f"__{c}" for c in keys])
