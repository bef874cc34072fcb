"""Queries of coverage statistics, each with the same rows in SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.special import chi2_column
from ..operators import calibrate as C
from ..operators import resample as R
from ..operators import stats as S
from .panel_queries import _IND, SERVED, _x, bands, erfc_sql


def misses(s, d):  # noqa: ANN001, ANN201
    return C.with_hits(bands(s, d)).withColumn("miss", 1 - F.col("inside"))


def q_kupiec(s, d):  # noqa: ANN001, ANN201
    g = misses(s, d).groupBy("regime_pub", "tau_bps", "tau").agg(F.count("*").alias("n"), F.sum("miss").alias("x"))
    return g.select("regime_pub", "tau_bps", "n", "x", F.round(S.kupiec_lr(F.col("x"), F.col("n"), 1 - F.col("tau")), 5).alias("lr"))


def q_kupiec_p(s, d):  # noqa: ANN001, ANN201
    g = misses(s, d).groupBy("symbol", "tau_bps", "tau").agg(F.count("*").alias("n"), F.sum("miss").alias("x"))
    g = g.withColumn("lr", S.kupiec_lr(F.col("x"), F.col("n"), 1 - F.col("tau")))
    return g.select("symbol", "tau_bps", "n", "x", F.round("lr", 5).alias("lr"), F.round(chi2_column(F.col("lr"), F.lit(1)), 6).alias("p"))


def q_independence(s, d):  # noqa: ANN001, ANN201
    t = S.transitions(misses(s, d), ["symbol", "tau_bps"], ["fri_ts"], "miss")
    return t.select("symbol", "tau_bps", "n00", "n01", "n10", "n11", F.round(S.independence_lr(t), 5).alias("lr_ind"))


def q_wilson(s, d):  # noqa: ANN001, ANN201
    g = misses(s, d).groupBy("symbol", "tau_bps").agg(F.count("*").alias("n"), F.sum("inside").alias("h"))
    lo, hi = scalar.wilson(F.col("h"), F.col("n"))
    return g.select("symbol", "tau_bps", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def q_breach_shares(s, d):  # noqa: ANN001, ANN201
    out = S.breach_shares(S.breach_counts(misses(s, d), "fri_ts", "miss", "tau_bps"), "tau_bps")
    return out.select("tau_bps", "k", F.round("share", 6).alias("share"), F.round("at_least", 6).alias("at_least"))


def q_threshold(s, d):  # noqa: ANN001, ANN201
    """The fewest misses a date that at most one date in twenty reaches, 10 if none; and, of those that at most half reach, the
    number whose share comes nearest to one in twenty."""
    out = S.breach_shares(S.breach_counts(misses(s, d), "fri_ts", "miss", "tau_bps"), "tau_bps").withColumn("p", F.round("at_least", 9)).where("p <= 0.5")
    near = F.min(F.struct(F.round(F.abs(F.col("p") - 0.05), 9).alias("off"), "k"))["k"]
    return out.groupBy("tau_bps").agg(F.coalesce(F.min(F.when(F.col("p") <= 0.05, F.col("k"))), F.lit(10)).alias("k_below"), near.alias("k_close"))


def q_slices(s, d):  # noqa: ANN001, ANN201
    """Coverage pooled, by regime and by year in one pass of grouping sets."""
    rows = C.with_hits(bands(s, d)).withColumn("year", F.year("fri_ts")).select("regime_pub", "year", "tau_bps", "inside", "hw_bps")
    g = rows.groupingSets([["tau_bps"], ["tau_bps", "regime_pub"], ["tau_bps", "year"]], "tau_bps", "regime_pub", "year")
    return g.agg(F.count("*").alias("n"), F.round(F.avg(F.col("inside").cast("double")), 5).alias("realised"), F.round(F.avg("hw_bps"), 3).alias("hw"))


def q_crps(s, d):  # noqa: ANN001, ANN201
    wide = bands(s, d).groupBy("symbol", "fri_ts", "mon_open", "fri_close").pivot("tau_bps", [6800, 9500]).agg(F.first("lower").alias("lo"), F.first("upper").alias("hi"))
    points = [(0.025, F.col("9500_lo")), (0.16, F.col("6800_lo")), (0.84, F.col("6800_hi")), (0.975, F.col("9500_hi"))]
    return wide.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg(S.crps(points, F.col("mon_open")) / F.col("fri_close")), 5).alias("crps"))


def q_bootstrap(s, d):  # noqa: ANN001, ANN201
    rows = C.with_hits(bands(s, d)).select("fri_ts", "tau_bps", F.col("inside").cast("double").alias("v"))
    return R.block_bootstrap(rows, "fri_ts", ["tau_bps"], "v", draws=200, seed=11, kind="multinomial").select("tau_bps", F.round("mean", 6).alias("mean"), F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


_LR = f"greatest(2 * ({_x('(n - x)', '1 - x / n')} + {_x('x', 'x / n')} - (n - x) * ln(1 - (1 - tau)) - x * ln(1 - tau)), 0)"
_T = """l AS (SELECT symbol, tau_bps, 1 - inside AS m, lag(1 - inside) OVER (PARTITION BY symbol, tau_bps ORDER BY fri_ts) AS p FROM hits),
t AS (SELECT symbol, tau_bps, count(*) FILTER (p = 0 AND m = 0)::DOUBLE AS n00, count(*) FILTER (p = 0 AND m = 1)::DOUBLE AS n01, count(*) FILTER (p = 1 AND m = 0)::DOUBLE AS n10, count(*) FILTER (p = 1 AND m = 1)::DOUBLE AS n11 FROM l WHERE p IS NOT NULL GROUP BY 1, 2)"""
_K = """c AS (SELECT tau_bps, fri_ts, count(*) AS n_w, sum(1 - inside)::BIGINT AS k_w FROM hits GROUP BY 1, 2),
u AS (SELECT tau_bps, count(*) AS dates, max(n_w) AS top FROM c GROUP BY 1),
sp AS (SELECT tau_bps, dates, unnest(range(0, top + 1)) AS k FROM u),
b AS (SELECT sp.tau_bps, sp.k, (SELECT count(*) FROM c WHERE c.tau_bps = sp.tau_bps AND k_w = k) / dates AS share, (SELECT count(*) FROM c WHERE c.tau_bps = sp.tau_bps AND k_w >= k) / dates AS at_least FROM sp)"""
_PIN = lambda a, q: f"CASE WHEN mon_open >= {q} THEN (mon_open - {q}) * {a} ELSE ({q} - mon_open) * (1 - {a}) END"



def chi2_sql(x: str, k: str) -> str:
    """The tail of a chi-square variable with k degrees, x and k being columns or plain terms, by the same published fit."""
    odd = f"{erfc_sql(f'sqrt({x} / 2)')} + coalesce(list_sum(list_transform(range(1, ({k} - 1) // 2 + 1), lambda j: sqrt(2 * {x} / pi()) * exp(-{x} / 2) * pow({x}, j - 1) / list_product(list_transform(range(1, j + 1), lambda i: 2 * i - 1)))), 0)"
    even = f"list_sum(list_transform(range(0, {k} // 2), lambda j: exp(-{x} / 2) * pow({x} / 2, j) / gamma(j + 1)))"
    return f"CASE WHEN {k} >= 1 THEN least(greatest(CASE WHEN {k} % 2 = 1 THEN {odd} ELSE {even} END, 0), 1) END"


QUERIES = {
    "k1_kupiec": (q_kupiec, f"WITH {SERVED}, g AS (SELECT regime_pub, tau_bps, tau, count(*) AS n, sum(1 - inside)::BIGINT AS x FROM hits GROUP BY 1, 2, 3) SELECT regime_pub, tau_bps, n, x, round({_LR}, 5) AS lr FROM g"),
    "k11_kupiec_by_symbol": (q_kupiec_p, f"WITH {SERVED}, g AS (SELECT symbol, tau_bps, tau, count(*) AS n, sum(1 - inside)::BIGINT AS x FROM hits GROUP BY 1, 2, 3), r AS (SELECT *, {_LR} AS lr FROM g) SELECT symbol, tau_bps, n, x, round(lr, 5) AS lr, round({chi2_sql('lr', '1')}, 6) AS p FROM r"),
    "k2_independence": (q_independence, f"WITH {SERVED}, {_T} SELECT symbol, tau_bps, n00::BIGINT AS n00, n01::BIGINT AS n01, n10::BIGINT AS n10, n11::BIGINT AS n11, round({_IND}, 5) AS lr_ind FROM t"),
    "k17_wilson": (q_wilson, f"WITH {SERVED}, g AS (SELECT symbol, tau_bps, count(*) AS n, sum(inside)::DOUBLE / count(*) AS p FROM hits GROUP BY 1, 2), w AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS m, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n) AS h FROM g) SELECT symbol, tau_bps, n, round(greatest(m - h, 0), 6) AS lo, round(least(m + h, 1), 6) AS hi FROM w"),
    "d12_breach_shares": (q_breach_shares, f"WITH {SERVED}, {_K} SELECT tau_bps, k, round(share, 6) AS share, round(at_least, 6) AS at_least FROM b"),
    "k14_threshold": (q_threshold, f"WITH {SERVED}, {_K} SELECT tau_bps, coalesce(min(CASE WHEN round(at_least, 9) <= 0.05 THEN k END), 10) AS k_below, arg_min(k, (round(abs(round(at_least, 9) - 0.05), 9), k)) AS k_close FROM b WHERE round(at_least, 9) <= 0.5 GROUP BY 1"),
    "k20_slices": (q_slices, f"WITH {SERVED} SELECT tau_bps, regime_pub, year(fri_ts) AS year, count(*) AS n, round(avg(inside), 5) AS realised, round(avg(hw_bps), 3) AS hw FROM hits GROUP BY GROUPING SETS ((tau_bps), (tau_bps, regime_pub), (tau_bps, year(fri_ts)))"),
    "k8_crps": (q_crps, f"WITH {SERVED}, w AS (SELECT symbol, fri_ts, mon_open, fri_close, max(CASE WHEN tau_bps = 6800 THEN lower END) AS l68, max(CASE WHEN tau_bps = 6800 THEN upper END) AS u68, max(CASE WHEN tau_bps = 9500 THEN lower END) AS l95, max(CASE WHEN tau_bps = 9500 THEN upper END) AS u95 FROM bands GROUP BY 1, 2, 3, 4), p AS (SELECT *, {_PIN(0.025, 'l95')} AS a, {_PIN(0.16, 'l68')} AS b, {_PIN(0.84, 'u68')} AS c, {_PIN(0.975, 'u95')} AS e FROM w) SELECT symbol, count(*) AS n, round(avg(2 * ((a + b) / 2 * 0.135 + (b + c) / 2 * 0.68 + (c + e) / 2 * 0.135) / fri_close), 5) AS crps FROM p GROUP BY 1"),
    "l1_block_bootstrap": (q_bootstrap, None),
}
