"""Queries of lending policies on bands, each with the same rows in SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate as C
from ..operators import policy as L
from ..operators import resample as R
from ..sources import market as M
from ..sources import tapes as T
from .panel_queries import SERVED, SPLIT, TAUS, bands, panel

GRID = "(SELECT round(0.7::DOUBLE + i * 0.01::DOUBLE, 6) AS ltv FROM range(0, 21) t(i))"


def grid(s):  # noqa: ANN001, ANN201
    return L.ltv_grid(s, 0.70, 0.90, 0.01)


def rounded(df, places: int = 6):  # noqa: ANN001, ANN201
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def q_weights(s, d):  # noqa: ANN001, ANN201
    out = None
    for scheme in ("uniform_ltv", "borrower_heavy", "threshold_heavy", "debt_weighted"):
        own = L.weighted_grid(grid(s), scheme).select(F.lit(scheme).alias("scheme"), "ltv", F.round("row_weight", 9).alias("row_weight"))
        out = own if out is None else out.unionByName(own)
    return out


def q_policy(s, d):  # noqa: ANN001, ANN201
    rows = L.decisions(bands(s, d), L.ltv_grid(s, 0.05, 0.9, 0.05))
    return rows.groupBy("tau_bps", "ltv", "regime_pub").agg(F.count("*").alias("n"), F.sum("miss_liq").alias("missed"), F.sum("fp_liq").alias("false_alarms"), F.sum("false_caution").alias("false_cautions"), F.sum("missed_caution").alias("missed_cautions"), F.round(F.avg("cost"), 8).alias("mean_cost"))


def q_confusion(s, d):  # noqa: ANN001, ANN201
    rows = L.decisions(bands(s, d), L.ltv_grid(s, 0.1, 0.9, 0.1))
    g = rows.groupBy("tau_bps", "ltv", "predicted", "right").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(L.Window.partitionBy("tau_bps", "ltv", "right")), 6))


def compared(s, d, truth: str, scheme: str = "borrower_heavy"):  # noqa: ANN001, ANN201
    return L.variants(bands(s, d), L.weighted_grid(grid(s), scheme), truth)


def q_variants(s, d):  # noqa: ANN001, ANN201
    out = None
    for truth in ("economic_flat85", "policy_consistent"):
        own = L.variant_summary(compared(s, d, truth), ["variant", "tau_bps", "regime_pub"]).withColumn("truth", F.lit(truth))
        out = own if out is None else out.unionByName(own)
    return rounded(out, 5)


def q_paired(s, d):  # noqa: ANN001, ANN201
    values = ["half_width_bps", "fp_liq", "miss_liq", "cost"]
    rows = L.paired(compared(s, d, "economic_flat85"), "flat", "band", values)
    w = F.col("row_weight")
    return rounded(rows.groupBy("tau_bps", "regime_pub").agg(F.count("*").alias("n"), *[(L.weighted_mean(F.col(v), w) - L.weighted_mean(F.col(f"base_{v}"), w)).alias(f"delta_{v}") for v in values]), 5)


def q_delta_bootstrap(s, d):  # noqa: ANN001, ANN201
    rows = L.paired(compared(s, d, "economic_flat85"), "flat", "band", ["cost"]).withColumn("delta", F.col("cost") - F.col("base_cost"))
    return rounded(R.block_bootstrap(rows, "fri_ts", ["tau_bps"], "delta", 200, 5, weight="row_weight", kind="multinomial"), 6)


def q_reserve_borrowers(s, d):  # noqa: ANN001, ANN201
    return L.reserve_borrowers(bands(s, d), "lower").groupBy("tau_bps", "near_origination", "near_liquidation").agg(F.count("*").alias("n"))


def q_exhaustion(s, d):  # noqa: ANN001, ANN201
    rows = L.path_exhaustion(M.tape(s, d).where("value > 0"), ["symbol"], "ts", "value", "event_id")
    return rounded(rows.withColumn("first_breach", F.col("first_breach").cast("timestamp_ntz")), 6)


def downside_bps(s, d):  # noqa: ANN001, ANN201
    return panel(s, d).withColumn("down_bps", (F.col("fri_close") - F.col("mon_open")) / F.col("fri_close") * 10_000)


def haircut_table(s, d):  # noqa: ANN001, ANN201
    return C.quantile_table(downside_bps(s, d).where(F.col("fri_ts") < SPLIT), C.tau_table(s), ["symbol"], "down_bps")


def q_haircuts(s, d):  # noqa: ANN001, ANN201
    return haircut_table(s, d).select("symbol", "tau_bps", "n", F.round(F.greatest("q", F.lit(0.0)), 4).alias("haircut_bps"))


def originated(s, d):  # noqa: ANN001, ANN201
    rows = L.haircuts(bands(s, d).drop("q", "c"), haircut_table(s, d))
    ref = F.col("reference")
    policies = {"freeze": F.lit(0.0), "fixed_frozen": ref * (1 - F.col("haircut_bps") / 10_000), "band": ref - F.col("half")}
    policies |= {f"fixed_{b}": ref * F.lit(1 - b / 10_000) for b in (300, 1000, 3000, 9990)}
    return L.origination(rows, policies, {"friday": F.col("fri_close"), "preopen": F.col("point")})


def q_origination(s, d):  # noqa: ANN001, ANN201
    return rounded(L.origination_summary(originated(s, d), ["policy", "timing", "tau_bps"]), 3)


def q_matched(s, d):  # noqa: ANN001, ANN201
    by = ["timing", "tau_bps"]
    return rounded(L.matched_safety(L.origination_summary(originated(s, d), ["policy", *by]), "fixed_", "band", by), 3)


def q_capacity(s, d):  # noqa: ANN001, ANN201
    """Bootstrap of the difference in weekly mean capacity, band less a fixed haircut: a mean of weeks' means."""
    rows = originated(s, d).where("timing = 'friday' AND policy IN ('band', 'fixed_1000')")
    week = rows.groupBy("tau_bps", "fri_ts").agg((F.avg(F.when(F.col("policy") == "band", F.col("permitted"))) - F.avg(F.when(F.col("policy") != "band", F.col("permitted")))).alias("delta"))
    return rounded(R.block_bootstrap(week, "fri_ts", ["tau_bps"], "delta", 200, 9, kind="multinomial"), 2)


def q_portfolio(s, d):  # noqa: ANN001, ANN201
    return L.portfolio(bands(s, d)).groupBy("tau_bps", "ltv", "flat", "band", "came").agg(F.count("*").alias("n"))


def positions(s, d):  # noqa: ANN001, ANN201
    """A loan for each out-of-sample gap: a hundred units against a debt that grows with the gap's length."""
    rows = panel(s, d).where(F.col("fri_ts") >= SPLIT)
    return rows.select(F.concat_ws("-", "symbol", F.col("fri_ts").cast("string")).alias("position_id"), "symbol", "fri_ts", F.lit(100.0).alias("collateral"), (F.col("fri_close") * 85 * (F.lit(0.8) + F.col("gap_days") * F.lit(0.04))).alias("debt"), F.lit(0.85).alias("limit"))


def q_positions(s, d):  # noqa: ANN001, ANN201
    return rounded(L.evaluated(positions(s, d), bands(s, d)).select("position_id", "tau_bps", "price", "state", "distance_bps", "exit_bps", "action"), 4)


def q_position_tape(s, d):  # noqa: ANN001, ANN201
    """Evaluations go to the tape, a line of JSON each, before any action is counted; actions are read back from it."""
    events = L.evaluated(positions(s, d), bands(s, d)).select("position_id", "tau_bps", "state", "action")
    path = T.appended_lines(events, None)
    return s.read.schema(events.schema).json(path).groupBy("tau_bps", "state", "action").agg(F.count("*").alias("n"))


_LIM = "0.85::DOUBLE * CASE regime_pub WHEN 'normal' THEN 1.0::DOUBLE WHEN 'long_weekend' THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END"


def _dec(price: str, lim: str) -> str:
    return f"CASE WHEN NOT ({price} > 0) THEN 'Liquidate' WHEN ltv * fri_close / ({price}) >= {lim} THEN 'Liquidate' WHEN ltv * fri_close / ({price}) >= 0.75 THEN 'Caution' ELSE 'Safe' END"


COST = """CASE predicted || '/' || "right" WHEN 'Caution/Safe' THEN 0.10 WHEN 'Liquidate/Safe' THEN 1.00 WHEN 'Safe/Caution' THEN 0.15 WHEN 'Liquidate/Caution' THEN 0.35
  WHEN 'Safe/Liquidate' THEN 4.00 WHEN 'Caution/Liquidate' THEN 2.50 ELSE 0.00 END::DOUBLE"""
FLAGS = """CASE WHEN predicted = 'Liquidate' AND "right" <> 'Liquidate' THEN 1 ELSE 0 END AS fp_liq, CASE WHEN predicted <> 'Liquidate' AND "right" = 'Liquidate' THEN 1 ELSE 0 END AS miss_liq,
  CASE WHEN predicted = 'Caution' AND "right" = 'Safe' THEN 1 ELSE 0 END AS false_caution, CASE WHEN predicted = 'Safe' AND "right" <> 'Safe' THEN 1 ELSE 0 END AS missed_caution"""


def _decisions(low: float, step: float, n: int) -> str:
    return f"""g AS (SELECT round({low}::DOUBLE + i * {step}::DOUBLE, 6) AS ltv FROM range(0, {n}) t(i)),
z AS (SELECT *, {_dec('lower', _LIM)} AS predicted, {_dec('mon_open', _LIM)} AS "right" FROM bands, g), y AS (SELECT *, {COST} AS cost, {FLAGS} FROM z)"""


_FLAT = "fri_close * (1 - 300.0::DOUBLE / 10000)"
_W = f"gw AS (SELECT ltv, exp(-0.5 * pow((ltv - 0.75) / 0.03, 2)) / sum(exp(-0.5 * pow((ltv - 0.75) / 0.03, 2))) OVER () AS w FROM {GRID})"
_VARIANTS = f"""{_W}, v AS (SELECT *, (upper - lower) / 2 / fri_close * 10000 AS hw FROM bands, gw),
vv AS (SELECT 'flat' AS variant, 'economic_flat85' AS truth, *, {_dec(_FLAT, '0.85::DOUBLE')} AS predicted, {_dec('mon_open', '0.85::DOUBLE')} AS "right", 300.0::DOUBLE AS half_width_bps FROM v
UNION ALL SELECT 'flat', 'policy_consistent', *, {_dec(_FLAT, '0.85::DOUBLE')}, {_dec('mon_open', '0.85::DOUBLE')}, 300.0::DOUBLE FROM v
UNION ALL SELECT 'band', 'economic_flat85', *, {_dec('lower', _LIM)}, {_dec('mon_open', '0.85::DOUBLE')}, hw FROM v
UNION ALL SELECT 'band', 'policy_consistent', *, {_dec('lower', _LIM)}, {_dec('mon_open', _LIM)}, hw FROM v),
x AS (SELECT *, {COST} AS cost, {FLAGS} FROM vv)"""
_WM = lambda e, a: f"round(sum(({e}) * w) / sum(w), 5) AS {a}"
_HAIR = f"""hx AS (SELECT symbol, (fri_close - mon_open) / fri_close * 10000 AS s, row_number() OVER (PARTITION BY symbol ORDER BY (fri_close - mon_open) / fri_close * 10000) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM panel WHERE fri_ts < DATE '{SPLIT}'),
hc AS (SELECT symbol, tau_bps, n, greatest(s, 0) AS haircut_bps FROM hx, taus WHERE k = least(greatest(ceil(tau * (n + 1)), 1), n))"""
_ORIG = f"""{_HAIR}, o1 AS (SELECT b.*, (upper - lower) / 2 AS half, haircut_bps, timing, CASE timing WHEN 'friday' THEN fri_close ELSE point END AS reference FROM bands b LEFT JOIN hc USING (symbol, tau_bps), (VALUES ('friday'), ('preopen')) t(timing)),
o2 AS (SELECT 'freeze' AS policy, 0.0::DOUBLE AS low, * FROM o1 UNION ALL SELECT 'fixed_frozen', reference * (1 - haircut_bps / 10000), * FROM o1 UNION ALL SELECT 'band', reference - half, * FROM o1
UNION ALL SELECT 'fixed_' || b, reference * (1 - b / 10000.0::DOUBLE), o1.* FROM o1, (VALUES (300), (1000), (3000), (9990)) u(b)),
o3 AS (SELECT *, greatest(low, 0.0) AS fl, greatest(low, 0.0) * (1000000.0 / fri_close) * 0.75::DOUBLE AS permitted, mon_open * (1000000.0 / fri_close) * 0.85::DOUBLE AS ceiling FROM o2),
o4 AS (SELECT policy, timing, tau_bps, count(*) AS n, count(DISTINCT fri_ts) AS n_weekends, avg(permitted) AS mean_capacity, median(permitted) AS median_capacity, count(*) FILTER (permitted > ceiling) AS unsafe_n, avg(CASE WHEN permitted > ceiling THEN 1.0::DOUBLE ELSE 0 END) AS unsafe_rate,
  avg(greatest(permitted - ceiling, 0)) AS mean_shortfall, max(greatest(permitted - ceiling, 0)) AS max_shortfall, avg(CASE WHEN mon_open < fl THEN 1.0::DOUBLE ELSE 0 END) AS breach_rate, avg(CASE WHEN reference > 0 THEN (reference - fl) / reference * 10000 END) AS mean_buffer_bps FROM o3 GROUP BY 1, 2, 3)"""
_POS = f"""ps AS (SELECT symbol || '-' || fri_ts::VARCHAR AS position_id, symbol, fri_ts, (fri_close * 85 * (0.8::DOUBLE + gap_days * 0.04::DOUBLE)) / (0.85::DOUBLE * 100.0) AS price FROM panel WHERE fri_ts >= DATE '{SPLIT}'),
pe AS (SELECT position_id, tau_bps, price, point, lower, upper, CASE WHEN price > upper THEN 'exit_above' WHEN price < lower THEN 'exit_below' WHEN (upper - price) / point * 10000 < 100 THEN 'approaching_upper' WHEN (price - lower) / point * 10000 < 100 THEN 'approaching_lower' ELSE 'in_band' END AS state
  FROM ps JOIN bands USING (symbol, fri_ts)),
pa AS (SELECT *, CASE WHEN state LIKE 'exit%' THEN 'bid' WHEN state = 'in_band' THEN 'monitor' ELSE 'prewarm' END AS action FROM pe)"""

QUERIES = {
    "m2_weight_schemes": (q_weights, f"WITH g AS {GRID}, r AS (SELECT 'uniform_ltv' AS scheme, ltv, 1.0::DOUBLE AS r FROM g UNION ALL SELECT 'borrower_heavy', ltv, exp(-0.5 * pow((ltv - 0.75) / 0.03, 2)) FROM g UNION ALL SELECT 'threshold_heavy', ltv, exp(-0.5 * pow((ltv - 0.85) / 0.02, 2)) FROM g UNION ALL SELECT 'debt_weighted', ltv, ltv FROM g) SELECT scheme, ltv, round(r / sum(r) OVER (PARTITION BY scheme), 9) AS row_weight FROM r"),
    "m4_policy": (q_policy, f"WITH {SERVED}, {_decisions(0.05, 0.05, 18)} SELECT tau_bps, ltv, regime_pub, count(*) AS n, sum(miss_liq)::BIGINT AS missed, sum(fp_liq)::BIGINT AS false_alarms, sum(false_caution)::BIGINT AS false_cautions, sum(missed_caution)::BIGINT AS missed_cautions, round(avg(cost), 8) AS mean_cost FROM y GROUP BY 1, 2, 3"),
    "d10_confusion": (q_confusion, f"WITH {SERVED}, {_decisions(0.1, 0.1, 9)}, c AS (SELECT tau_bps, ltv, predicted, \"right\", count(*) AS n FROM y GROUP BY 1, 2, 3, 4) SELECT *, round(n / sum(n) OVER (PARTITION BY tau_bps, ltv, \"right\"), 6) AS share FROM c"),
    "m7_variants": (q_variants, f"WITH {SERVED}, {_VARIANTS} SELECT variant, tau_bps, regime_pub, truth, count(*) AS n, round(sum(w), 5) AS weight_sum, {_WM('half_width_bps', 'mean_half_width_bps')}, " + ", ".join(_WM(f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0 END", a) for c, v, a in (("predicted", "Liquidate", "liquidation_rate"), ("predicted", "Caution", "caution_rate"), ("predicted", "Safe", "safe_rate"), ('"right"', "Liquidate", "realized_liquidation_rate"))) + f", {_WM('fp_liq', 'fp_liq_rate')}, {_WM('miss_liq', 'miss_liq_rate')}, {_WM('false_caution', 'false_caution_rate')}, {_WM('missed_caution', 'missed_caution_rate')}, {_WM('cost', 'expected_loss')} FROM x GROUP BY 1, 2, 3, 4"),
    "c14_paired_variants": (q_paired, f"WITH {SERVED}, {_VARIANTS}, e AS (SELECT * FROM x WHERE truth = 'economic_flat85'), p AS (SELECT a.*, b.half_width_bps AS bh, b.fp_liq AS bf, b.miss_liq AS bm, b.cost AS bc FROM e a JOIN e b ON a.symbol = b.symbol AND a.fri_ts = b.fri_ts AND a.ltv = b.ltv AND a.tau_bps = b.tau_bps AND a.variant = 'band' AND b.variant = 'flat') SELECT tau_bps, regime_pub, count(*) AS n, round(sum(half_width_bps * w) / sum(w) - sum(bh * w) / sum(w), 5) AS delta_half_width_bps, round(sum(fp_liq * w) / sum(w) - sum(bf * w) / sum(w), 5) AS delta_fp_liq, round(sum(miss_liq * w) / sum(w) - sum(bm * w) / sum(w), 5) AS delta_miss_liq, round(sum(cost * w) / sum(w) - sum(bc * w) / sum(w), 5) AS delta_cost FROM p GROUP BY 1, 2"),
    "l2_delta_bootstrap": (q_delta_bootstrap, None),
    "m11_reserve_borrowers": (q_reserve_borrowers, f"""WITH {SERVED}, l AS (SELECT tau_bps, lower, (75 - 0.5) / 100::DOUBLE * fri_close / lower * 100 AS a, (85 - 0.05::DOUBLE) / 100 * fri_close / lower * 100 AS b FROM bands) SELECT tau_bps, CASE WHEN lower > 0 THEN CASE WHEN a >= 85 THEN 'Liquidate' WHEN a >= 75 THEN 'Caution' ELSE 'Safe' END ELSE 'n/a' END AS near_origination, CASE WHEN lower > 0 THEN CASE WHEN b >= 85 THEN 'Liquidate' WHEN b >= 75 THEN 'Caution' ELSE 'Safe' END ELSE 'n/a' END AS near_liquidation, count(*) AS n FROM l GROUP BY 1, 2, 3"""),
    "m10_path_exhaustion": (q_exhaustion, "WITH t AS (SELECT event_type AS symbol, ts, event_id, value FROM events WHERE value > 0), f AS (SELECT symbol, min_by(value, (ts, event_id)) AS reference FROM t GROUP BY 1), b AS (SELECT t.*, reference, reference * (0.75::DOUBLE / 0.85::DOUBLE) AS breach FROM t JOIN f USING (symbol)) SELECT symbol, round(reference, 6) AS reference, round(breach, 6) AS breach, round(min(value), 6) AS path_min, count(*) FILTER (value <= breach) AS breaches, min(ts) FILTER (value <= breach) AS first_breach, round((min(value) - reference) / reference * 10000, 6) AS drawdown_bps, count(*) FILTER (value <= breach) > 0 AS breached FROM b GROUP BY symbol, b.reference, b.breach"),
    "i23_haircuts": (q_haircuts, f"WITH {SERVED}, {_HAIR} SELECT symbol, tau_bps, n, round(haircut_bps, 4) AS haircut_bps FROM hc"),
    "m12_origination": (q_origination, f"WITH {SERVED}, {_ORIG} SELECT policy, timing, tau_bps, n, n_weekends, round(mean_capacity, 3) AS mean_capacity, round(median_capacity, 3) AS median_capacity, unsafe_n, round(unsafe_rate, 3) AS unsafe_rate, round(mean_shortfall, 3) AS mean_shortfall, round(max_shortfall, 3) AS max_shortfall, round(breach_rate, 3) AS breach_rate, round(mean_buffer_bps, 3) AS mean_buffer_bps, round(mean_capacity * 0.05, 3) AS year_income, round(mean_capacity * 0.05 * 2 / 365, 3) AS weekend_income FROM o4"),
    "m13_matched_safety": (q_matched, f"WITH {SERVED}, {_ORIG}, u AS (SELECT timing, tau_bps, unsafe_rate AS ur, mean_capacity AS bc FROM o4 WHERE policy = 'band') SELECT timing, tau_bps, max_by(policy, (mean_capacity, policy)) AS policy, round(max(mean_capacity), 3) AS capacity, round(any_value(bc), 3) AS band_capacity FROM o4 JOIN u USING (timing, tau_bps) WHERE policy LIKE 'fixed@_%' ESCAPE '@' AND unsafe_rate <= ur GROUP BY 1, 2"),
    "l4_capacity_bootstrap": (q_capacity, None),
    "m14_portfolio": (q_portfolio, f"WITH {SERVED}, l AS (SELECT * FROM bands, (VALUES (0.50::DOUBLE), (0.65::DOUBLE), (0.75::DOUBLE), (0.82::DOUBLE), (0.88::DOUBLE)) t(ltv)) SELECT tau_bps, ltv, {_dec(_FLAT, _LIM)} AS flat, {_dec('lower', _LIM)} AS band, {_dec('mon_open', _LIM)} AS came, count(*) AS n FROM l GROUP BY ALL"),
    "m15_positions": (q_positions, f"WITH {SERVED}, {_POS} SELECT position_id, tau_bps, round(price, 4) AS price, state, round((price - point) / point * 10000, 4) AS distance_bps, round(greatest(price - upper, lower - price, 0) / point * 10000, 4) AS exit_bps, action FROM pa"),
    "m16_position_tape": (q_position_tape, f"WITH {SERVED}, {_POS} SELECT tau_bps, state, action, count(*) AS n FROM pa GROUP BY 1, 2, 3"),
}
