"""Distribution functions that Spark lacks, as vectorised functions over columns."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def chi2_tail(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom > x), by the recurrence from one or two degrees."""
    if x != x or k < 1:
        return float("nan")
    x = max(x, 0.0)
    if k % 2:
        out, term, at = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 1
    else:
        out, term, at = math.exp(-x / 2), (x / 2) * math.exp(-x / 2), 2
    while at < k:
        out += term
        at += 2
        term *= x / at
    return min(max(out, 0.0), 1.0)


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def student_cdf(x: float, nu: float) -> float:
    tail = 0.5 * _beta_share(nu / 2, 0.5, nu / (nu + x * x))
    return 1 - tail if x >= 0 else tail


def student_quantile(p: float, nu: float) -> float:
    """The quantile of Student's t, by halving; normal for infinite degrees."""
    if math.isinf(nu):
        return normal_quantile(p)
    lo, hi = -1.0, 1.0
    while student_cdf(lo, nu) > p:
        lo *= 2
    while student_cdf(hi, nu) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if student_cdf(mid, nu) < p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, nu: pd.Series) -> pd.Series:
    """The chance of a larger |t|, over aggregated rows; null stays null."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else 2 * (1 - student_cdf(abs(float(a)), float(b))) for a, b in zip(t, nu, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, k: pd.Series) -> pd.Series:
    """The tail of a chi-square variable; null stays null."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else chi2_tail(float(a), int(b)) for a, b in zip(x, k, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    nd = NormalDist()
    return p.map(lambda v: nd.inv_cdf(v) if v is not None and 0 < v < 1 else np.nan)


def erfc_column(x: Column) -> Column:
    """The complementary error function of x >= 0, to some 1e-7 of its value, as a column expression: a Chebyshev fit."""
    # Coefficients of the published rational fit.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = 1 / (1 + 0.5 * x)
    inner = F.lit(c[-1])
    for a in reversed(c[:-1]):
        inner = F.lit(a) + t * inner
    return t * F.exp(-x * x + inner)


def chi2_column(x: Column, k: Column, most: int = 130) -> Column:
    """The tail of a chi-square variable as a column: exp and erfc, and the recurrence over degrees as a fold; null stays
    null, more than `most` degrees are cut into as many steps as they need."""
    x = F.greatest(x, F.lit(0.0))
    odd = k % 2 == 1
    first = F.when(odd, erfc_column(F.sqrt(x / 2))).otherwise(F.exp(-x / 2))
    term = F.when(odd, F.sqrt(2 * x / F.lit(math.pi)) * F.exp(-x / 2)).otherwise(x / 2 * F.exp(-x / 2))
    at = F.when(odd, 1.0).otherwise(2.0)
    start = F.struct(first.cast("double").alias("sum"), term.cast("double").alias("term"), at.alias("at"))
    steps = F.sequence(F.lit(1), F.greatest(F.floor((k - F.when(odd, 1).otherwise(2)) / 2), F.lit(0)).cast("int") + 1)
    walk = lambda a, i: F.when(a["at"] + 1 < k, F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * x / (a["at"] + 2)).alias("term"), (a["at"] + 2).alias("at"))).otherwise(a)
    out = F.aggregate(steps, start, walk, lambda a: a["sum"])
    return F.when(x.isNotNull() & (k >= 1), F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)))


def chi2_even(x: Column) -> Column:
    """The tail with two degrees, which needs no Python."""
    return F.exp(-x / 2)
