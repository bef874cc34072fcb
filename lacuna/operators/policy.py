"""Lending decisions on bands: grids, thresholds, ladders, costs, variants, reserves, origination and positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import percentiles, sized

# Threshold multipliers by regime, and the cost of a decision (first) when another was right (second).
MULTIPLIERS = {"normal": 1.00, "long_weekend": 0.95, "high_vol": 0.85}
COSTS = {
    ("Safe", "Safe"): 0.00, ("Caution", "Safe"): 0.10, ("Liquidate", "Safe"): 1.00,
    ("Safe", "Caution"): 0.15, ("Caution", "Caution"): 0.00, ("Liquidate", "Caution"): 0.35,
    ("Safe", "Liquidate"): 4.00, ("Caution", "Liquidate"): 2.50, ("Liquidate", "Liquidate"): 0.00,
}
MAX_LTV, LIQUIDATION, FLAT_BPS = 0.75, 0.85, 300.0
ACTIONS = {"in_band": "monitor", "approaching_upper": "prewarm", "approaching_lower": "prewarm", "exit_above": "bid", "exit_below": "bid"}


def ltv_grid(spark: SparkSession, low: float, high: float, step: float) -> DataFrame:
    """Loan-to-value targets, both ends in, rounded to six places."""
    n = int(round((high - low) / step))
    return spark.range(n + 1).select(F.round(F.lit(low) + F.col("id") * F.lit(step), 6).alias("ltv"))


def weighted_grid(grid: DataFrame, scheme: str, custom: DataFrame | None = None) -> DataFrame:
    """The grid with row_weight, which sums to one: uniform_ltv, borrower_heavy and threshold_heavy (bell curves about the
    two limits), debt_weighted, or custom, a table (ltv, weight) that has all of the grid."""
    bell = lambda at, width: F.exp(-0.5 * F.pow((F.col("ltv") - at) / width, F.lit(2.0)))
    raws = {"uniform_ltv": F.lit(1.0), "borrower_heavy": bell(MAX_LTV, 0.03), "threshold_heavy": bell(LIQUIDATION, 0.02), "debt_weighted": F.col("ltv")}
    if scheme == "custom":
        if custom is None:
            raise ValueError("custom weights need a table")
        own = custom.groupBy(F.round("ltv", 6).alias("ltv")).agg(F.max("weight").alias("_w"))
        rows = grid.join(own, "ltv", "left").withColumn("_w", F.when(F.col("_w") >= 0, F.col("_w")).otherwise(F.raise_error(F.lit("a weight is missing or negative"))))
    elif scheme in raws:
        rows = grid.withColumn("_w", raws[scheme])
    else:
        raise ValueError(f"no weight scheme {scheme!r}")
    return rows.withColumn("row_weight", F.try_divide(F.col("_w"), F.sum("_w").over(Window.partitionBy(F.lit(0))))).drop("_w")


def threshold(regime: Column, base: float = LIQUIDATION, multipliers: Mapping[str, float] = MULTIPLIERS) -> Column:
    """The liquidation threshold of a regime; an unknown one counts as high_vol."""
    out = None
    for k, m in multipliers.items():
        out = F.when(regime == k, F.lit(base * m)) if out is None else out.when(regime == k, F.lit(base * m))
    return out.otherwise(F.lit(base * multipliers["high_vol"]))


def decide(debt: Column, price: Column, limit: Column, most: float = MAX_LTV, clipped: Column | None = None) -> Column:
    """Liquidate from the threshold on, Caution from the most one may borrow on, else Safe; no positive price, Liquidate.
    A clipped claim is never Safe."""
    ltv = F.try_divide(debt, price)
    safe = F.lit("Safe") if clipped is None else F.when(clipped, "Caution").otherwise("Safe")
    return F.when(~(price > 0), "Liquidate").when(ltv >= limit, "Liquidate").when(ltv >= most, "Caution").otherwise(safe)


def cost(predicted: Column, right: Column) -> Column:
    out = F.lit(0.0)
    for (p, r), c in COSTS.items():
        out = F.when((predicted == p) & (right == r), F.lit(c)).otherwise(out)
    return out


def flagged(rows: DataFrame) -> DataFrame:
    """Rows with predicted and right, their cost and the flags of what went wrong."""
    p, r = F.col("predicted"), F.col("right")
    flags = {
        "fp_liq": (p == "Liquidate") & (r != "Liquidate"), "miss_liq": (p != "Liquidate") & (r == "Liquidate"),
        "false_caution": (p == "Caution") & (r == "Safe"), "missed_caution": (p == "Safe") & (r != "Safe"),
    }
    return rows.withColumns({"cost": cost(p, r), **{k: v.cast("int") for k, v in flags.items()}})


def decisions(bands: DataFrame, grid: DataFrame) -> DataFrame:
    """A loan a band and target, opened at the close: what the lower edge says, what the open proved, cost and flags."""
    debt = F.col("ltv") * F.col("fri_close")
    limit = threshold(F.col("regime_pub"))
    rows = bands.crossJoin(sized(grid)).withColumns({"predicted": decide(debt, F.col("lower"), limit), "right": decide(debt, F.col("mon_open"), limit)})
    return flagged(rows)


def variants(bands: DataFrame, grid: DataFrame, truth: str = "economic_flat85") -> DataFrame:
    """The decisions of two policies over the same loans: flat, a fixed distance under the close and one threshold; and
    band, the lower edge and thresholds by regime. truth: economic_flat85 judges both by the flat threshold,
    policy_consistent each by its own."""
    if truth not in ("economic_flat85", "policy_consistent"):
        raise ValueError(f"no truth mode {truth!r}")
    debt, flat = F.col("ltv") * F.col("fri_close"), F.lit(LIQUIDATION)
    by_regime = threshold(F.col("regime_pub"))
    low = F.col("fri_close") * F.lit(1 - FLAT_BPS / 10_000)
    rows = bands.crossJoin(sized(grid))
    made = []
    for name, price, limit, width in (("flat", low, flat, F.lit(FLAT_BPS)), ("band", F.col("lower"), by_regime, (F.col("upper") - F.col("lower")) / 2 / F.col("fri_close") * 10_000)):
        judged = flat if truth == "economic_flat85" else limit
        made.append(F.struct(F.lit(name).alias("variant"), decide(debt, price, limit).alias("predicted"), decide(debt, F.col("mon_open"), judged).alias("right"), width.alias("half_width_bps")))
    keep = [c for c in rows.columns if c not in ("predicted", "right", "half_width_bps", "variant")]
    return flagged(rows.withColumn("_v", F.explode(F.array(*made))).select(*keep, "_v.*"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null where the weights don't sum to something positive."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(value * weight) / total)


def variant_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weighted rates of decisions by any columns; a null is a group of its own."""
    w = F.col("row_weight") if "row_weight" in rows.columns else F.lit(1.0)
    is_ = lambda c, v: (F.col(c) == v).cast("double")
    rates = {
        "mean_half_width_bps": F.col("half_width_bps"), "liquidation_rate": is_("predicted", "Liquidate"), "caution_rate": is_("predicted", "Caution"),
        "safe_rate": is_("predicted", "Safe"), "realized_liquidation_rate": is_("right", "Liquidate"), "fp_liq_rate": F.col("fp_liq"), "miss_liq_rate": F.col("miss_liq"),
        "false_caution_rate": F.col("false_caution"), "missed_caution_rate": F.col("missed_caution"), "expected_loss": F.col("cost"),
    }
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("weight_sum"), *[weighted_mean(v, w).alias(k) for k, v in rates.items()])


def paired(rows: DataFrame, base: str, other: str, values: Sequence[str]) -> DataFrame:
    """Each loan once a coverage, with the values of both variants (value, base_value): the same loan under two policies."""
    key = ["symbol", "fri_ts", "ltv", "tau_bps"]
    one = rows.where(F.col("variant") == base).select(*key, *[F.col(v).alias(f"base_{v}") for v in values])
    return rows.where(F.col("variant") == other).join(one, key)


def reserve_state(lower: Column, truth: Column, reference: Column, most: float = MAX_LTV, liquidation: float = LIQUIDATION) -> Column:
    """Whether the band warned of a breach of the reserve price, and whether it came."""
    breach = reference * F.lit(most / liquidation)
    warned, came = lower < breach, truth < breach
    return F.when(warned & came, "matched").when(warned, "preemptive").when(came, "missed").otherwise("silent_safe")


def path_exhaustion(path: DataFrame, by: Sequence[str], ts: str, value: str, order: str, most: float = MAX_LTV, liquidation: float = LIQUIDATION) -> DataFrame:
    """Whether a path used up a reserve: each group's first value is its reference; a loan at the most one may borrow
    breaches at reference most / liquidation. Lowest value, its distance, how many breaches and when the first."""
    first = path.groupBy(*by).agg(F.min(F.struct(ts, order, value))[value].alias("reference"))
    both = path.join(sized(first), list(by)).withColumn("breach", F.col("reference") * F.lit(most / liquidation))
    hit = F.col(value) <= F.col("breach")
    g = both.groupBy(*by, "reference", "breach").agg(F.min(value).alias("path_min"), F.count_if(hit).alias("breaches"), F.min(F.when(hit, F.col(ts))).alias("first_breach"))
    return g.withColumns({"drawdown_bps": (F.col("path_min") - F.col("reference")) / F.col("reference") * 10_000, "breached": F.col("breaches") > 0})


def reserve_borrowers(rows: DataFrame, lower: str, max_ltv: float = 75.0, liquidation: float = 85.0) -> DataFrame:
    """Two loans a row, half a point under the most one may borrow and a twentieth under the threshold, opened at the
    close: what the lower edge says of each. No positive edge, n/a."""
    out = {}
    for name, target in (("near_origination", max_ltv - 0.5), ("near_liquidation", liquidation - 0.05)):
        ltv = F.lit(target / 100) * F.col("fri_close") / F.col(lower)
        state = F.when(ltv * 100 >= liquidation, "Liquidate").when(ltv * 100 >= max_ltv, "Caution").otherwise("Safe")
        out[name] = F.when(F.col(lower) > 0, state).otherwise("n/a")
    return rows.withColumns(out)


def haircuts(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """rows with haircut_bps, the frozen downside quantile (bps, at least 0) of their symbol and tau."""
    own = tables.select("symbol", "tau_bps", F.greatest(F.col("q"), F.lit(0.0)).alias("haircut_bps"))
    return rows.join(sized(own), ["symbol", "tau_bps"], "left")


def origination(rows: DataFrame, policies: Mapping[str, Column], timings: Mapping[str, Column], notional: float = 1_000_000.0, most: float = MAX_LTV, liquidation: float = LIQUIDATION) -> DataFrame:
    """Debt that each policy permits against a notional of collateral at each timing's reference price, and what the open
    proved: unsafe if it is over the threshold's worth, by shortfall. A policy is a lower price, from the column
    `reference` and others; one that freezes lends nothing."""
    at = F.explode(F.array(*[F.struct(F.lit(t).alias("timing"), r.alias("reference")) for t, r in timings.items()]))
    timed = rows.withColumn("_t", at).select(*rows.columns, "_t.*")
    lower = F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), F.greatest(v, F.lit(0.0)).alias("floor")) for k, v in policies.items()]))
    each = timed.withColumn("_p", lower).select(*timed.columns, "_p.*")
    units = F.lit(notional) / F.col("fri_close")
    each = each.withColumns({"permitted": F.col("floor") * units * most, "ceiling": F.col("mon_open") * units * liquidation})
    return each.withColumns({
        "unsafe": F.col("permitted") > F.col("ceiling"), "shortfall": F.greatest(F.col("permitted") - F.col("ceiling"), F.lit(0.0)),
        "breached": F.col("mon_open") < F.col("floor"), "buffer_bps": F.when(F.col("reference") > 0, (F.col("reference") - F.col("floor")) / F.col("reference") * 10_000),
    })


def origination_summary(rows: DataFrame, by: Sequence[str], yearly: float = 0.05, days: float = 2.0) -> DataFrame:
    """What policies lend, lose and earn, by any columns."""
    g = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct("fri_ts").alias("n_weekends"), F.avg("permitted").alias("mean_capacity"),
        F.count_if("unsafe").alias("unsafe_n"), F.avg(F.col("unsafe").cast("double")).alias("unsafe_rate"), F.avg("shortfall").alias("mean_shortfall"), F.max("shortfall").alias("max_shortfall"),
        F.avg(F.col("breached").cast("double")).alias("breach_rate"), F.avg("buffer_bps").alias("mean_buffer_bps"),
    )
    g = g.join(percentiles(rows, by, F.col("permitted"), {"median_capacity": 0.5}), list(by))
    return g.withColumns({"year_income": F.col("mean_capacity") * yearly, "weekend_income": F.col("mean_capacity") * yearly * days / 365})


def matched_safety(summary: DataFrame, fixed: str, band: str, by: Sequence[str]) -> DataFrame:
    """For each group, the fixed policy that lends most among those no less safe than the band policy: policy names
    begin with `fixed` or are `band`."""
    ours = summary.where(F.col("policy") == band).select(*by, F.col("unsafe_rate").alias("_rate"), F.col("mean_capacity").alias("band_capacity"))
    fits = summary.where(F.col("policy").startswith(fixed)).join(ours, list(by)).where(F.col("unsafe_rate") <= F.col("_rate"))
    best = fits.groupBy(*by, "band_capacity").agg(F.max(F.struct("mean_capacity", "policy")).alias("b"))
    return best.select(*by, F.col("b.policy").alias("policy"), F.col("b.mean_capacity").alias("capacity"), "band_capacity")


def portfolio(bands: DataFrame, targets: Sequence[float] = (0.50, 0.65, 0.75, 0.82, 0.88)) -> DataFrame:
    """Made-up loans over each band, decided three ways under thresholds by regime: flat, by the band (a claim of 0.995 or
    more is never Safe) and at the open that came."""
    debt = F.col("ltv") * F.col("fri_close")
    limit = threshold(F.col("regime_pub"))
    rows = bands.withColumn("ltv", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    flat = decide(debt, F.col("fri_close") * F.lit(1 - FLAT_BPS / 10_000), limit)
    return rows.withColumns({"flat": flat, "band": decide(debt, F.col("lower"), limit, clipped=F.col("tau") >= 0.995), "came": decide(debt, F.col("mon_open"), limit)})


def band_state(price: Column, lower: Column, upper: Column, near_bps: float = 100.0, unit: Column | None = None) -> Column:
    """Where a liquidation price stands to the band: beyond it, close to an edge (the upper is asked first), or in it.
    Distances are shares of unit, or of the edge."""
    to_low, to_high = (price - lower) / (lower if unit is None else unit) * 10_000, (upper - price) / (upper if unit is None else unit) * 10_000
    if unit is None:
        return F.when(price < lower, "exit_below").when(price > upper, "exit_above").when(to_low <= near_bps, "approaching_lower").when(to_high <= near_bps, "approaching_upper").otherwise("in_band")
    return F.when(price > upper, "exit_above").when(price < lower, "exit_below").when(to_high < near_bps, "approaching_upper").when(to_low < near_bps, "approaching_lower").otherwise("in_band")


def evaluated(positions: DataFrame, bands: DataFrame, near_bps: float = 100.0) -> DataFrame:
    """Positions (symbol, fri_ts, collateral, debt, limit and more) on the bands they stand under: the price at which each
    can be liquidated, its class, the distance to the point and beyond the edge in bps of the point, and the action."""
    both = positions.join(bands.select("symbol", "fri_ts", "tau_bps", "point", "lower", "upper"), ["symbol", "fri_ts"])
    price = F.when((F.col("collateral") > 0) & (F.col("limit") > 0), F.col("debt") / (F.col("limit") * F.col("collateral")))
    both = both.withColumn("price", price).withColumn("state", F.when(F.col("price").isNotNull(), band_state(F.col("price"), F.col("lower"), F.col("upper"), near_bps, F.col("point"))))
    beyond = F.greatest(F.col("price") - F.col("upper"), F.col("lower") - F.col("price"), F.lit(0.0))
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    bps = lambda v: v / F.col("point") * 10_000
    return both.withColumns({"distance_bps": bps(F.col("price") - F.col("point")), "exit_bps": F.when(F.col("price").isNotNull(), bps(beyond)), "action": action[F.col("state")]})
