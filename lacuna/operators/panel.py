"""The gap panel and what is computed along it: returns, regimes, causal scales, scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import prefix_quantiles


def gap_pairs(bars: DataFrame, mode: str = "weekend", min_gap: int = 3, vol_lookback: int = 20) -> DataFrame:
    """Each bar with the one before it, where the market was closed between: weekend (min_gap days or more) or overnight
    (one). fri_vol_20d is the spread of the last log returns up to the left edge; pairs before half a window have none
    and are left out."""
    if mode not in ("weekend", "overnight"):
        raise ValueError(f"mode is weekend or overnight, not {mode!r}")
    order = Window.partitionBy("symbol").orderBy("ts")
    near = order.rowsBetween(1 - vol_lookback, 0)
    moved = bars.withColumn("_r", F.log(F.col("close") / F.lag("close").over(order)))
    vol = F.when(F.count("_r").over(near) >= vol_lookback // 2, F.stddev_samp("_r").over(near))
    left = moved.withColumn("_vol", vol)
    pairs = left.select("symbol", F.lag("ts").over(order).alias("fri_ts"), F.col("ts").alias("mon_ts"), F.lag("close").over(order).alias("fri_close"), F.col("open").alias("mon_open"), F.lag("_vol").over(order).alias("fri_vol_20d"))
    gap = F.datediff("mon_ts", "fri_ts")
    pairs = pairs.where("fri_vol_20d IS NOT NULL")
    return pairs.withColumn("gap_days", gap).where(F.col("gap_days") == 1 if mode == "overnight" else F.col("gap_days") >= min_gap)


def with_factor(pairs: DataFrame, factor: DataFrame) -> DataFrame:
    """factor_ret over the gap and the volatility index at its left edge; rows without either are dropped."""
    at = lambda new, *cols: factor.select(F.col("ts").alias(new), *cols)
    both = pairs.join(at("fri_ts", F.col("level").alias("_l0"), F.col("vol").alias("vix")), "fri_ts", "left").join(at("mon_ts", F.col("level").alias("_l1")), "mon_ts", "left")
    out = both.withColumn("factor_ret", F.try_divide(F.col("_l1"), F.col("_l0")) - 1).withColumn("point", F.col("fri_close") * (1 + F.col("factor_ret")))
    return out.drop("_l0", "_l1").dropna(subset=["factor_ret", "vix", "fri_close", "mon_open"])


def with_regime(panel: DataFrame, window: int = 52, least: int = 20, quantile: float = 0.75, long_gap: int = 4, night: str | None = None) -> DataFrame:
    """normal, long_weekend or high_vol, known before the gap: the index stands above its own quantile over the last
    dates. night, a flag of overnight gaps, makes it normal, high_vol or the flag's name, which goes first. Dates are few
    next to rows; the flag is made for them and joined back."""
    dates = panel.select("fri_ts", "vix").distinct()
    near = Window.partitionBy(F.lit(0)).orderBy("fri_ts").rowsBetween(1 - window, 0)
    flag = dates.select("fri_ts", ((F.count("vix").over(near) >= least) & (F.col("vix") > F.percentile("vix", F.lit(quantile)).over(near))).alias("high"))
    high = F.when(F.col("high"), "high_vol")
    if night is None:
        regime = high.when(F.col("gap_days") >= long_gap, "long_weekend").otherwise("normal")
    else:
        regime = F.when(F.col(night), night).otherwise(high.otherwise("normal"))
    return panel.join(flag, "fri_ts").withColumn("regime_pub", regime).drop("high")


def with_residual(panel: DataFrame) -> DataFrame:
    return panel.withColumn("rel_resid", (F.col("mon_open") - F.col("point")) / F.col("fri_close"))


def ewma_scale(panel: DataFrame, half_life: float = 8.0, least: int = 8, keep: Column | None = None, name: str = "sigma") -> DataFrame:
    """The weighted root mean square of a symbol's strictly earlier residuals; null before `least` of them.

    Ages count kept rows. Weights cancel but for a factor that all share, so running sums do. They run in stretches of 64
    half-lives, the one before added at its weight; what is older weighs less than 2^-64 and is left out, so series may
    have any length.
    """
    r2 = F.col("rel_resid") * F.col("rel_resid")
    kept = r2 if keep is None else F.when(keep, r2)
    line = Window.partitionBy("symbol").orderBy("fri_ts")
    stretch = int(64 * half_life)
    counted = panel.withColumn("_r2", kept).withColumn("_n", F.count("_r2").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    counted = counted.withColumn("_s", F.floor(F.col("_n") / stretch))
    grow = F.pow(F.lit(2.0), (F.col("_n") - F.col("_s") * stretch) / F.lit(half_life))
    here = Window.partitionBy("symbol", "_s").orderBy("fri_ts").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("symbol").orderBy("_s").rangeBetween(-1, -1)
    both = lambda v: F.coalesce(F.sum(v).over(here), F.lit(0.0)) + F.coalesce(F.sum(v).over(last), F.lit(0.0)) * F.lit(2.0**-64)
    ratio = both(F.col("_r2") * grow) / both(F.when(F.col("_r2").isNotNull(), grow))
    enough = F.count("_r2").over(line.rowsBetween(Window.unboundedPreceding, -1)) >= least
    return counted.withColumn(name, F.when(enough, F.sqrt(ratio))).drop("_r2", "_n", "_s")


def window_scale(panel: DataFrame, window: int = 26, least: int = 8, name: str = "sigma_k") -> DataFrame:
    """The standard deviation of a symbol's last residuals, strictly earlier."""
    past = Window.partitionBy("symbol").orderBy("fri_ts").rowsBetween(-window, -1)
    return panel.withColumn(name, F.when(F.count("rel_resid").over(past) >= least, F.stddev_samp("rel_resid").over(past)))


def with_scores(panel: DataFrame) -> DataFrame:
    """score_raw (unscaled), score (by sigma) and downside (signed, point above open); null where sigma isn't positive."""
    sigma = F.when(F.col("sigma") > 0, F.col("sigma"))
    miss = F.abs(F.col("mon_open") - F.col("point")) / F.col("fri_close")
    return panel.withColumns({"score_raw": miss, "score": miss / sigma, "downside": (F.col("point") - F.col("mon_open")) / (F.col("fri_close") * sigma)})


def residual_quantiles(panel: DataFrame, taus: list[float], window: int = 104, least: int = 26, by: str | None = None) -> DataFrame:
    """Bounds from a symbol's own log residuals two and more gaps back: one row a gap and tau. by, a level such as the
    volatility index, divides residuals before the quantiles and multiplies them after."""
    past = Window.partitionBy("symbol").orderBy("fri_ts").rowsBetween(-window - 1, -2)
    unit = F.lit(1.0) if by is None else F.col(by)
    r = panel.withColumn("_r", F.try_divide(F.log(F.col("mon_open") / F.col("point")), unit))
    levels = [p for tau in taus for p in ((1 - tau) / 2, (1 + tau) / 2)]
    seen = r.withColumns({"_q": F.percentile("_r", F.array(*[F.lit(p) for p in levels])).over(past), "_c": F.count("_r").over(past)}).where(F.col("_c") >= least)
    edge = lambda i: F.col("point") * F.exp(F.col("_q")[i] * unit)
    rows = F.explode(F.array(*[F.struct(F.lit(int(round(t * 10_000))).alias("tau_bps"), edge(2 * i).alias("lower"), edge(2 * i + 1).alias("upper")) for i, t in enumerate(taus)]))
    return seen.select("symbol", "fri_ts", "mon_open", rows.alias("_b")).select("symbol", "fri_ts", "_b.tau_bps", "_b.lower", "_b.upper", "mon_open")


def with_path_score(panel: DataFrame) -> DataFrame:
    """score_path: the farthest a gap's path (path_lo, path_hi) or its end went from the point, by sigma and the close;
    null without a path or a positive sigma."""
    far = F.greatest(F.col("point") - F.col("path_lo"), F.col("path_hi") - F.col("point"), F.abs(F.col("mon_open") - F.col("point")), F.lit(0.0))
    whole = (F.col("sigma") > 0) & F.col("path_lo").isNotNull() & F.col("path_hi").isNotNull()
    return panel.withColumn("score_path", F.when(whole, far / (F.col("fri_close") * F.col("sigma"))))


def har_features(panel: DataFrame) -> DataFrame:
    """Absolute residual of the last gap and its means over 5 and 22, full windows only."""
    order = Window.partitionBy("symbol").orderBy("fri_ts")
    a = F.abs("rel_resid")
    mean = lambda n: F.when(F.count(a).over(order.rowsBetween(-n, -1)) == n, F.avg(a).over(order.rowsBetween(-n, -1)))
    return panel.withColumns({"rv_d": F.lag(a).over(order), "rv_w": mean(5), "rv_m": mean(22)})


def expanding_quantile(panel: DataFrame, tau: float, least: int = 100) -> DataFrame:
    """The tau quantile of all symbols' absolute residuals in strictly earlier gaps, a row a gap date: fri_ts, n and q."""
    a = panel.select("fri_ts", F.abs("rel_resid").alias("a"), F.lit("all").alias("cell")).where("a IS NOT NULL")
    at = lambda up: lambda n: (F.ceil if up else F.floor)((n - 1) * F.lit(tau)) + 1
    found = prefix_quantiles(a, "cell", "fri_ts", "a", a.select(F.col("fri_ts").alias("as_of")), [at(False), at(True)], least)
    pair = found.groupBy("as_of", "n").agg(F.max(F.when(F.col("ask") == 0, F.col("q"))).alias("lo"), F.max(F.when(F.col("ask") == 1, F.col("q"))).alias("hi"))
    part = (F.col("n") - 1) * F.lit(tau) - F.floor((F.col("n") - 1) * F.lit(tau))
    return pair.select(F.col("as_of").alias("fri_ts"), "n", (F.col("lo") + (F.col("hi") - F.col("lo")) * part).alias("q"))


def leave_one_out(panel: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The mean of the others of a group, and their median; null for a row alone.

    The median of the others is among the group's three middle values, which one aggregate each picks; groups aren't
    gathered.
    """
    group = Window.partitionBy(*by)
    n, s = F.count(value).over(group), F.sum(value).over(group)
    rank = F.row_number().over(group.orderBy(value, "symbol"))
    out = panel.where(F.col(value).isNotNull()).withColumns({"_n": n, "_s": s, "_rank": rank})
    low = F.floor(F.col("_n") / 2)  # of the n - 1 others the middle is at low, and at low + 1 if they are even in number
    out = out.withColumns({f"_v{i}": F.max(F.when(F.col("_rank") == low + i, F.col(value))).over(group) for i in range(3)})
    m = F.col("_n") - 1
    first = F.when(low >= F.col("_rank"), F.col("_v1")).otherwise(F.col("_v0"))
    second = F.when(low + 1 >= F.col("_rank"), F.col("_v2")).otherwise(F.col("_v1"))
    median = F.when(m > 0, F.when(m % 2 == 1, first).otherwise((first + second) / 2))
    return out.withColumns({"loo_mean": F.when(m > 0, (F.col("_s") - F.col(value)) / m), "loo_median": median}).drop("_n", "_s", "_rank", "_v0", "_v1", "_v2")


def ridge_forward(dates: DataFrame, features: list[str], target: str, split: str, ridge: float) -> DataFrame:
    """A ridge regression of target on features, standardised before the split: a row a feature with its coefficient, and
    the shares of variance explained before the split and after it, both against the mean before it.

    One row a date goes in; Spark makes the sums, and only the normal equations' small matrix comes to the driver.
    """
    some = dates.dropna(subset=[*features, target]).withColumn("_train", F.col("fri_ts") < split)
    told = some.where("_train").agg(*[F.avg(c).alias(f"m_{c}") for c in [*features, target]], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    z = {c: (F.col(c) - F.lit(told[f"m_{c}"])) / F.lit(told[f"s_{c}"] or 1.0) for c in features}
    scaled = some.select("_train", F.col(target).alias("_y"), *[v.alias(c) for c, v in z.items()])
    names = [*features, "_one"]
    scaled = scaled.withColumn("_one", F.lit(1.0))
    sums = scaled.where("_train").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)], *[F.sum(F.col(a) * F.col("_y")).alias(f"y_{i}") for i, a in enumerate(names)]).first()
    k = len(names)
    gram = np.array([[sums[f"{i}_{j}"] for j in range(k)] for i in range(k)]) + np.diag([ridge] * len(features) + [0.0])
    beta = np.linalg.solve(gram, np.array([sums[f"y_{i}"] for i in range(k)]))
    fit = sum((F.col(c) * F.lit(float(b)) for c, b in zip(names, beta, strict=True)), F.lit(0.0))
    off = lambda train, v: F.sum(F.when(F.col("_train") == train, F.pow(F.col("_y") - v, F.lit(2.0))))
    mean = F.lit(told[f"m_{target}"])
    share = scaled.agg((1 - off(True, fit) / off(True, mean)).alias("r2_train"), (1 - off(False, fit) / off(False, mean)).alias("r2_late"))
    rows = dates.sparkSession.createDataFrame([(c, float(b)) for c, b in zip([*features, "intercept"], beta, strict=True)], "feature string, coefficient double")
    return rows.crossJoin(F.broadcast(share))


def weekend_panel(bars: DataFrame, factor: DataFrame, mode: str = "weekend") -> DataFrame:
    """Everything up to scores, in one plan."""
    return with_scores(ewma_scale(with_residual(with_regime(with_factor(gap_pairs(bars, mode), factor)))))
