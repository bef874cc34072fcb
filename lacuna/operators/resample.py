"""Bootstraps by blocks of dates, moving blocks and permutations: draws are hashes, the same on any executor."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import sized


def _uniform(*of: Column) -> Column:
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 30)) + F.lit(0.5)) / F.lit(float(1 << 30))


def block_bootstrap(rows: DataFrame, block: str, by: Sequence[str], value: str, draws: int = 200, seed: int = 11, weight: str | None = None, kind: str = "poisson") -> DataFrame:
    """The (weighted) mean of value by groups and its 95% interval under resampling of whole blocks (dates).

    kind: multinomial draws as many blocks as a group has, with replacement; poisson gives each block a Poisson number
    of copies, in one pass. Sums by block come first, so the replicates multiply blocks and not rows.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by, block).agg(F.sum(F.col(value) * w).alias("_s"), F.sum(w).alias("_n"))
    reps = F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    if kind == "multinomial":
        line = Window.partitionBy(*by)
        numbered = sums.withColumns({"_i": F.row_number().over(line.orderBy(block)) - 1, "_m": F.count("*").over(line)})
        drawn = numbered.withColumn("_rep", reps).withColumn("_i", F.floor(_uniform("_rep", "_i", F.lit(seed)) * F.col("_m")).cast("int")).select(*by, "_rep", "_i")
        each = drawn.join(sized(numbered.select(*by, "_i", "_s", "_n")), [*by, "_i"]).groupBy(*by, "_rep").agg((F.sum("_s") / F.sum("_n")).alias("_m"))
    elif kind == "poisson":
        steps, p, term = [], 0.0, float(np.exp(-1))  # copies by the inverse of the Poisson(1) distribution
        for k in range(9):
            p += term
            steps.append((k, p))
            term /= k + 1
        copies = F.lit(9)
        for k, p in reversed(steps):
            copies = F.when(F.col("_u") <= p, k).otherwise(copies)
        many = sums.withColumn("_rep", reps).withColumn("_u", _uniform(F.col(block), F.col("_rep"), F.lit(seed))).withColumn("_c", copies)
        each = many.groupBy(*by, "_rep").agg((F.sum(F.col("_s") * F.col("_c")) / F.sum(F.col("_n") * F.col("_c"))).alias("_m"))
    else:
        raise ValueError(f"no kind of draws {kind!r}")
    spread = each.groupBy(*by).agg(F.percentile("_m", F.lit(0.025)).alias("lo"), F.percentile("_m", F.lit(0.975)).alias("hi"))
    whole = sums.groupBy(*by).agg((F.sum("_s") / F.sum("_n")).alias("mean"))
    return whole.join(spread, list(by))


def moving_blocks(line: DataFrame, by: Sequence[str], order: str, value: str, length: int, draws: int = 200, seed: int = 13) -> DataFrame:
    """The mean of a series and its 95% interval under runs of `length` neighbours, drawn with replacement from all starts
    and cut to the series' length, and its lag-1 correlation."""
    w = Window.partitionBy(*by).orderBy(order)
    own = line.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*by)), "_l": F.lag(value).over(w)})
    groups = own.select(*by, "_n").distinct()
    starts = groups.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / length) - 1)))
    room = F.greatest(F.col("_n") - length, F.lit(0)) + 1
    starts = starts.withColumn("_at", F.floor(_uniform(*[F.col(c) for c in by], F.col("_rep"), F.col("_b"), F.lit(seed)) * room))
    places = starts.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).where(F.col("_b") * length + F.col("_k") < F.col("_n"))
    places = places.select(*by, "_rep", (F.col("_at") + F.col("_k")).cast("int").alias("_i"))
    each = places.join(sized(own.select(*by, "_i", value)), [*by, "_i"]).groupBy(*by, "_rep").agg(F.avg(value).alias("_m"))
    spread = each.groupBy(*by).agg(F.percentile("_m", F.lit(0.025)).alias("lo"), F.percentile("_m", F.lit(0.975)).alias("hi"))
    whole = own.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.corr(value, "_l").alias("lag1"))
    return whole.join(spread, list(by))


def permuted_lag(line: DataFrame, by: Sequence[str], order: str, value: str, draws: int = 200, seed: int = 17, least: int = 100) -> DataFrame:
    """Whether neighbours in a series go together: its lag-1 correlation, and the two-sided share of shuffled series that
    have as much. Series under `least` values are left out."""
    own = line.where(F.col(value).isNotNull())
    own = own.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where(F.col("_n") >= least)
    told = own.withColumn("_l", F.lag(value).over(Window.partitionBy(*by).orderBy(order))).groupBy(*by).agg(F.count("*").alias("n"), F.corr(value, "_l").alias("lag1"))
    many = own.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_u", F.xxhash64(order, "_rep", F.lit(seed)))
    shuffled = many.withColumn("_l", F.lag(value).over(Window.partitionBy(*by, "_rep").orderBy("_u"))).groupBy(*by, "_rep").agg(F.corr(value, "_l").alias("_c"))
    both = shuffled.join(told, list(by)).groupBy(*by, "n", "lag1")
    out = both.agg(F.avg((F.col("_c") <= F.col("lag1")).cast("double")).alias("_a"), F.avg((F.col("_c") >= F.col("lag1")).cast("double")).alias("_b"))
    return out.select(*by, "n", "lag1", F.least(2 * F.least("_a", "_b"), F.lit(1.0)).alias("p"))
