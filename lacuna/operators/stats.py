"""Coverage statistics: likelihood ratios, dispersion tests, proper scores, joint tails."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_column


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x > 0, x * F.log(F.greatest(y, F.lit(1e-12)))).otherwise(0.0)


def kupiec_lr(misses: Column, n: Column, claimed: Column) -> Column:
    """Unconditional coverage: twice the log likelihood of the observed miss rate over the claimed one; null without rows.
    claimed is the miss probability."""
    p = misses / n
    own = _xlogy(n - misses, 1 - p) + _xlogy(misses, p)
    base = (n - misses) * F.log(1 - claimed) + misses * F.log(claimed)
    return F.when(n > 0, F.greatest(2 * (own - base), F.lit(0.0)))


def transitions(rows: DataFrame, by: Sequence[str], order: Sequence[str], miss: str) -> DataFrame:
    """n00, n01, n10 and n11 of consecutive misses in each group."""
    line = rows.withColumn("_p", F.lag(miss).over(Window.partitionBy(*by).orderBy(*order))).where("_p IS NOT NULL")
    return line.groupBy(*by).agg(*[F.count_if((F.col("_p") == a) & (F.col(miss) == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])


def pooled_transitions(rows: DataFrame, by: Sequence[str], date: str, order: str, miss: str) -> DataFrame:
    """transitions of each of by over all its rows in one line, by date and then order: inside dates by a window, and from
    the last row of a date to the first of the next by one over dates, so no task needs the whole line."""
    day = Window.partitionBy(*by, date)
    here = rows.withColumns({"_p": F.lag(miss).over(day.orderBy(order)), "_at": F.row_number().over(day.orderBy(order))})
    last = rows.groupBy(*by, date).agg(F.max_by(miss, order).alias("_l"))
    last = last.withColumn("_l", F.lag("_l").over(Window.partitionBy(*by).orderBy(date)))
    both = here.join(last, [*by, date]).withColumn("_p", F.when(F.col("_at") == 1, F.col("_l")).otherwise(F.col("_p"))).where("_p IS NOT NULL")
    return both.groupBy(*by).agg(*[F.count_if((F.col("_p") == a) & (F.col(miss) == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])


def independence_lr(t: DataFrame) -> Column:
    """Whether misses follow misses: the transition likelihood ratio; null if no row left one of the two states."""
    n00, n01, n10, n11 = (t[f"n{a}{b}"] for a in (0, 1) for b in (0, 1))
    p01, p11, p = n01 / (n00 + n01), n11 / (n10 + n11), (n01 + n11) / (n00 + n01 + n10 + n11)
    own = _xlogy(n00, 1 - p01) + _xlogy(n01, p01) + _xlogy(n10, 1 - p11) + _xlogy(n11, p11)
    base = _xlogy(n00 + n10, 1 - p) + _xlogy(n01 + n11, p)
    return F.when((n00 + n01 > 0) & (n10 + n11 > 0), F.greatest(2 * (own - base), F.lit(0.0)))


def conditional(uc: DataFrame, t: DataFrame, by: Sequence[str], claimed: str = "tau") -> DataFrame:
    """Coverage and independence together. uc has n rows and x misses of each of by; t has transitions of its groups.

    lr_ind sums the groups' ratios, k is how many have one; p_ind is on k degrees, p_cc of both on 1 + k."""
    ind = t.withColumn("_lr", independence_lr(t)).groupBy(*by).agg(F.sum("_lr").alias("lr_ind"), F.count("_lr").cast("int").alias("k"))
    both = uc.withColumn("lr_uc", kupiec_lr(F.col("x"), F.col("n"), 1 - F.col(claimed))).join(ind, list(by), "left")
    both = both.withColumn("lr_cc", F.col("lr_uc") + F.coalesce("lr_ind", F.lit(0.0)))
    k = F.coalesce("k", F.lit(0))
    return both.withColumns({"p_uc": chi2_column(F.col("lr_uc"), F.lit(1)), "p_ind": F.when(k > 0, chi2_column(F.col("lr_ind"), k)), "p_cc": chi2_column(F.col("lr_cc"), k + 1)})


def binomial_tails(counts: DataFrame, by: str, p: Column, thresholds: Sequence[int] = (3, 5, 7)) -> DataFrame:
    """Misses a date (n_w, k_w) against independent ones: ratios of mean and variance, observed and binomial shares of
    dates with at least so many, and the chi-square of the cells 0, 1, 2 and more, those expected at least once."""
    n = F.col("n_w")

    def pmf(k: int) -> Column:  # the chance of k, from that of none by the ratio of neighbours
        out = F.pow(1 - F.col("_p"), n)
        for i in range(1, k + 1):
            out = out * F.greatest(n - i + 1, F.lit(0)) / i * F.col("_p") / (1 - F.col("_p"))
        return out

    tail = lambda k: 1 - sum((pmf(i) for i in range(k)), F.lit(0.0))
    rows = counts.withColumn("_p", p)
    sums = [F.count("*").alias("dates"), (F.avg("k_w") / F.avg(n * F.col("_p"))).alias("mean_ratio"), (F.var_samp("k_w") / F.avg(n * F.col("_p") * (1 - F.col("_p")))).alias("var_ratio")]
    for t in thresholds:
        sums += [F.avg((F.col("k_w") >= t).cast("double")).alias(f"tail{t}"), F.avg(tail(t)).alias(f"binom{t}")]
    cells = [(F.col("k_w") == 0, pmf(0)), (F.col("k_w") == 1, pmf(1)), (F.col("k_w") == 2, pmf(2)), (F.col("k_w") >= 3, tail(3))]
    for i, (seen, want) in enumerate(cells):
        sums += [F.count_if(seen).cast("double").alias(f"_o{i}"), F.sum(want).alias(f"_e{i}")]
    g = rows.groupBy(by).agg(*sums)
    chi = sum((F.when(F.col(f"_e{i}") >= 1, F.pow(F.col(f"_o{i}") - F.col(f"_e{i}"), F.lit(2.0)) / F.col(f"_e{i}")).otherwise(0.0) for i in range(4)), F.lit(0.0))
    return g.withColumn("chi2", chi).drop(*[f"_{c}{i}" for c in "oe" for i in range(4)])


def crps(points: Sequence[tuple[float, Column]], truth: Column) -> Column:
    """Twice the trapezoid of pinball losses over quantiles (level, value)."""
    loss = [F.when(truth >= q, (truth - q) * a).otherwise((q - truth) * (1 - a)) for a, q in points]
    out = F.lit(0.0)
    for (a, _), (b, _), x, y in zip(points[:-1], points[1:], loss[:-1], loss[1:], strict=True):
        out = out + (x + y) / 2 * (b - a)
    return out * 2


def breach_counts(rows: DataFrame, date: str, miss: str, by: str) -> DataFrame:
    """For each date and level: rows n_w and misses k_w."""
    return rows.groupBy(by, date).agg(F.count("*").alias("n_w"), F.sum(miss).alias("k_w"))


def breach_shares(counts: DataFrame, by: str) -> DataFrame:
    """The share of dates at each number of misses, 0 to the most rows of a date, zeros filled; and of at least so many."""
    total = counts.groupBy(by).agg(F.count("*").alias("dates"), F.max("n_w").alias("top"))
    spine = total.select(by, "dates", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("k"))
    seen = counts.groupBy(by, F.col("k_w").alias("k")).agg(F.count("*").alias("c"))
    both = spine.join(seen, [by, "k"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    tail = Window.partitionBy(by).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return both.select(by, "k", (F.col("c") / F.col("dates")).alias("share"), (F.sum("c").over(tail) / F.col("dates")).alias("at_least"))
