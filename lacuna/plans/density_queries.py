"""Queries of densities, forecasters and coverage tests, each with the same rows in SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.special import chi2_column, student_two_sided
from ..operators import calibrate as C
from ..operators import density as D
from ..operators import online as O
from ..operators import panel as P
from ..operators import resample as R
from ..operators import stats as S
from ..operators import tails as TL
from ..operators.shared import order_statistics, percentiles, sized
from ..sources import market as M
from .panel_queries import BARS, PANEL, SERVED, SPLIT, TAUS, _bump_sql, _table_sql, bands, panel, r_signed
from .policy_queries import rounded
from .serve_queries import early, late, table
from .stat_queries import _IND, _LR, _T, chi2_sql, misses

#: Unit quantiles of the normal distribution for the served coverages, as text for SQL.
Z = {t: D.normal_quantile((1 + t) / 2) for t in C.TAUS}
GRID = tuple(round(0.10 + 0.05 * i, 2) for i in range(18))


def q_conditional(s, d):  # noqa: ANN001, ANN201
    """Pooled coverage and the sum of the symbols' independence ratios."""
    rows = misses(s, d)
    t = S.transitions(rows, ["symbol", "tau_bps"], ["fri_ts"], "miss")
    uc = rows.groupBy("tau_bps", "tau").agg(F.count("*").alias("n"), F.sum("miss").alias("x"))
    return rounded(S.conditional(uc, t, ["tau_bps"]).select("tau_bps", "n", "k", "lr_uc", "lr_ind", "lr_cc"), 4)


def q_conditional_p(s, d):  # noqa: ANN001, ANN201
    rows = misses(s, d)
    t = S.transitions(rows, ["symbol", "tau_bps"], ["fri_ts"], "miss")
    uc = rows.groupBy("tau_bps", "tau").agg(F.count("*").alias("n"), F.sum("miss").alias("x"))
    return rounded(S.conditional(uc, t, ["tau_bps"]).select("tau_bps", "k", "lr_uc", "lr_ind", "lr_cc", "p_uc", "p_ind", "p_cc"), 6)


def q_conditional_symbol(s, d):  # noqa: ANN001, ANN201
    """Both ratios of each symbol and their joint tail on two degrees."""
    rows = misses(s, d)
    t = S.transitions(rows, ["symbol", "tau_bps"], ["fri_ts"], "miss")
    uc = rows.groupBy("symbol", "tau_bps", "tau").agg(F.count("*").alias("n"), F.sum("miss").alias("x"))
    both = uc.withColumn("lr_uc", S.kupiec_lr(F.col("x"), F.col("n"), 1 - F.col("tau"))).join(t.withColumn("lr_ind", S.independence_lr(t)), ["symbol", "tau_bps"], "left")
    return rounded(both.select("symbol", "tau_bps", "lr_uc", "lr_ind", F.exp(-(F.col("lr_uc") + F.col("lr_ind")) / 2).alias("p_cc")), 5)


def pits(s, d):  # noqa: ANN001, ANN201
    """PITs of late gaps against the frozen quantiles of their regime, scaled, on the served coverages."""
    wide = table(s, d).groupBy("regime_pub").pivot("tau_bps", [6800, 8500, 9500, 9900]).agg(F.first("q"))
    rows = late(s, d).where("sigma > 0").join(sized(wide), "regime_pub")
    unit = F.col("sigma") * F.col("fri_close")
    return rows.withColumn("pit", D.pit_from_grid(F.col("mon_open") - F.col("point"), [F.col(str(int(round(t * 10_000)))) * unit for t in C.TAUS], C.TAUS))


def q_pits(s, d):  # noqa: ANN001, ANN201
    return rounded(pits(s, d).select("symbol", "fri_ts", "pit"), 5)


def q_pit_quantiles(s, d):  # noqa: ANN001, ANN201
    """PITs between the edges of two served bands, taken as quantiles."""
    wide = bands(s, d).groupBy("symbol", "fri_ts", "mon_open").pivot("tau_bps", [6800, 9500]).agg(F.first("lower").alias("lo"), F.first("upper").alias("hi"))
    return rounded(wide.select("symbol", "fri_ts", D.pit_from_quantiles(F.col("mon_open"), (0.025, 0.16, 0.84, 0.975), [F.col(c) for c in ("9500_lo", "6800_lo", "6800_hi", "9500_hi")]).alias("pit")), 5)


def _tested(key: str):  # noqa: ANN202
    def run(s, d):  # noqa: ANN001, ANN202
        rows = D.normal_scores(pits(s, d).withColumn("_k", F.lit("pooled") if key == "pooled" else F.col(key)).select("_k", "symbol", "fri_ts", "pit"), "pit")
        out = D.berkowitz(D.score_sums(rows, ["_k"], ["fri_ts", "symbol"]))
        out = out.withColumn("p", chi2_column(F.col("lr"), F.lit(3)))
        return rounded(out.select(F.col("_k").alias("key"), "n", "rho", "lr", "p", "lr_mean", "lr_var", "lr_ar1", "share_mean", "share_var", "share_ar1"), 6)

    return run


def q_dynamic(s, d):  # noqa: ANN001, ANN201
    return rounded(D.dynamic_quantile(misses(s, d), ["symbol", "tau_bps"], ["fri_ts"], "miss", "tau", covariate="vix"), 5)


def q_joint_tail(s, d):  # noqa: ANN001, ANN201
    counts = S.breach_counts(misses(s, d), "fri_ts", "miss", "tau_bps")
    return rounded(S.binomial_tails(counts, "tau_bps", 1 - F.col("tau_bps") / 10_000), 5)


def q_gaussian(s, d):  # noqa: ANN001, ANN201
    """Gaussian bands of three scales: valid rows, coverage and half-width."""
    rows = D.rolling_sigma(D.gaussian_sigma(panel(s, d)))
    out = None
    for kind, sigma, point in (("f0", "sigma_f0", "fri_close"), ("vix", "sigma_vix", "fri_close"), ("f1", "sigma_f1", "point")):
        own = C.coverage_by(D.gaussian_bands(rows, sigma, C.TAUS, point), "tau_bps").withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return rounded(out, 4)


def q_gaussian_curve(s, d):  # noqa: ANN001, ANN201
    rows = D.gaussian_bands(D.gaussian_sigma(panel(s, d)), "sigma_f0", GRID, "fri_close")
    return rounded(C.coverage_by(rows, "tau_bps").select("tau_bps", "n", "realised"), 5)


def q_sigmas(s, d):  # noqa: ANN001, ANN201
    rows = D.rolling_sigma(D.gaussian_sigma(panel(s, d), [f"Brand#{i}" for i in range(1, 14)]))
    z = scalar.realised_z(F.col("mon_open"), F.col("fri_close"), F.col("fri_vol_20d"))
    return rounded(rows.select("symbol", "fri_ts", "sigma_f0", "sigma_vix", "sigma_f1", z.alias("z")), 4)


def q_realised_bucket(s, d):  # noqa: ANN001, ANN201
    rows = panel(s, d).withColumn("z", scalar.realised_z(F.col("mon_open"), F.col("fri_close"), F.col("fri_vol_20d")))
    cut = percentiles(rows, [], F.col("z"), {"a": 0.33, "b": 0.67})
    bucket = F.when(F.col("z") <= F.col("a"), "calm").when(F.col("z") <= F.col("b"), "normal").otherwise("shock")
    return rows.where("z IS NOT NULL").crossJoin(sized(cut)).groupBy("regime_pub", bucket.alias("realized_bucket")).agg(F.count("*").alias("n"), F.round(F.avg("z"), 5).alias("mean_z"))


def q_index_quantiles(s, d):  # noqa: ANN001, ANN201
    return rounded(P.residual_quantiles(panel(s, d), [0.68, 0.95], by="vix").drop("mon_open"), 3)


def q_daily_har(s, d):  # noqa: ANN001, ANN201
    return D.daily_har(M.daily_bars(s, d)).where("rv_m IS NOT NULL").select("symbol", "ts", *[F.round(c, 6).alias(c) for c in ("rv_d", "rv_w", "rv_m")])


def q_har_sigma(s, d):  # noqa: ANN001, ANN201
    return rounded(D.har_sigma(panel(s, d), M.daily_bars(s, d)).where("sigma_har IS NOT NULL").select("symbol", "fri_ts", "sigma_har"), 4)


def q_forecasters(s, d):  # noqa: ANN001, ANN201
    """Coverage and width of all forecasters at one coverage."""
    rows = D.har_sigma(D.rolling_sigma(D.gaussian_sigma(panel(s, d))), M.daily_bars(s, d))
    out = None
    for kind, sigma, point in (("f0", "sigma_f0", "fri_close"), ("f1", "sigma_f1", "point"), ("har", "sigma_har", "point")):
        own = C.coverage_by(D.gaussian_bands(rows, sigma, C.TAUS, point), "tau_bps").withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    for kind, made in (("empirical", P.residual_quantiles(panel(s, d), list(C.TAUS))), ("loglog", D.loglog_bounds(panel(s, d), list(C.TAUS)))):
        own = C.coverage_by(made.join(panel(s, d).select("symbol", "fri_ts", "fri_close"), ["symbol", "fri_ts"]), "tau_bps").withColumn("kind", F.lit(kind))
        out = out.unionByName(own)
    return rounded(out, 4)


def q_garch(s, d):  # noqa: ANN001, ANN201
    out = None
    for kind in ("normal", "student"):
        own = C.coverage_by(O.garch_bands(panel(s, d), SPLIT, Z, student=kind == "student").join(panel(s, d).select("symbol", "fri_ts", "fri_close"), ["symbol", "fri_ts"]), "tau_bps").withColumn("errors", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return rounded(out, 3)


def q_crps_grid(s, d):  # noqa: ANN001, ANN201
    """CRPS on all served edges and the point: nine anchors a gap."""
    wide = bands(s, d).groupBy("symbol", "fri_ts", "mon_open", "fri_close", "point").pivot("tau_bps", [6800, 8500, 9500, 9900]).agg(F.first("lower").alias("lo"), F.first("upper").alias("hi"))
    points = [((1 - t) / 2, F.col(f"{int(round(t * 10_000))}_lo")) for t in reversed(C.TAUS)] + [(0.5, F.col("point"))] + [((1 + t) / 2, F.col(f"{int(round(t * 10_000))}_hi")) for t in C.TAUS]
    return wide.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg(S.crps(points, F.col("mon_open")) / F.col("fri_close")), 5).alias("crps"))


def q_metrics_row(s, d):  # noqa: ANN001, ANN201
    """A row a coverage: what was realised, at what width, and all three ratios."""
    rows = misses(s, d)
    g = rows.groupBy("tau_bps", "tau").agg(F.count("*").alias("n"), F.avg(F.col("inside").cast("double")).alias("realised"), F.avg("hw_bps").alias("mean_hw"), F.sum("miss").alias("x"))
    out = S.conditional(g, S.transitions(rows, ["symbol", "tau_bps"], ["fri_ts"], "miss"), ["tau_bps"])
    return rounded(out.select("tau_bps", "n", "realised", "mean_hw", "k", "lr_uc", "lr_ind", "lr_cc", "p_uc", "p_ind"), 4)


def q_residual_t(s, d):  # noqa: ANN001, ANN201
    """Whether log residuals have mean zero: mean, spread, t and 1.96 standard errors by symbol."""
    r = panel(s, d).withColumn("r", F.log(F.col("mon_open") / F.col("point")))
    g = r.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.avg(F.col("r") / scalar.gap_scale(F.col("gap_days"))).alias("mean_scaled"))
    return rounded(g.withColumns({"t": F.col("mean") / (F.col("sd") / F.sqrt("n")), "half": 1.96 * F.col("sd") / F.sqrt("n")}), 5)


def q_residual_p(s, d):  # noqa: ANN001, ANN201
    return rounded(q_residual_t(s, d).select("symbol", "n", "t").withColumn("p", student_two_sided(F.col("t"), (F.col("n") - 1).cast("double"))), 6)


def q_permutations(s, d):  # noqa: ANN001, ANN201
    return rounded(R.permuted_lag(panel(s, d).where("score IS NOT NULL").select("symbol", "fri_ts", "score"), ["symbol"], "fri_ts", "score", 200), 5)


def breach_series(s, d):  # noqa: ANN001, ANN201
    return S.breach_counts(misses(s, d), "fri_ts", "miss", "tau_bps")


def q_tail_bootstrap(s, d):  # noqa: ANN001, ANN201
    rows = breach_series(s, d).withColumn("tail", (F.col("k_w") >= 2).cast("double"))
    return rounded(R.block_bootstrap(rows, "fri_ts", ["tau_bps"], "tail", 200, 3, kind="multinomial"), 6)


def q_moving_blocks(s, d):  # noqa: ANN001, ANN201
    return rounded(R.moving_blocks(breach_series(s, d).withColumn("k", F.col("k_w").cast("double")), ["tau_bps"], "fri_ts", "k", 8, 200), 5)


def q_method_grid(s, d):  # noqa: ANN001, ANN201
    """Every symbol by every method: coverage, width and its ratio at one coverage."""
    scaled, raw = (C.with_hits(bands(s, d, k)).withColumn("method", F.lit(k)) for k in ("score", "score_raw"))
    keep = ["method", "symbol", "tau_bps", "tau", "inside", "hw_bps"]
    g = scaled.select(*keep).unionByName(raw.select(*keep)).groupBy("method", "symbol", "tau_bps", "tau").agg(F.count("*").alias("n"), F.avg(F.col("inside").cast("double")).alias("realised"), F.avg("hw_bps").alias("mean_hw"), F.sum(1 - F.col("inside")).alias("x"))
    return rounded(g.withColumn("lr_uc", S.kupiec_lr(F.col("x"), F.col("n"), 1 - F.col("tau"))).drop("tau", "x"), 4)


def q_mondrian_correction(s, d):  # noqa: ANN001, ANN201
    """How far each symbol's lower and upper misses reach: ranks ceil((1 - a/2)(n + 1)) of the bands' train-side excess."""
    rows = D.gaussian_bands(D.rolling_sigma(early(s, d)), "sigma_f1", (0.68, 0.95))
    rows = rows.withColumns({"below": F.greatest(F.col("lower") - F.col("mon_open"), F.lit(0.0)), "above": F.greatest(F.col("mon_open") - F.col("upper"), F.lit(0.0))})
    out = None
    for side in ("below", "above"):
        got = order_statistics(rows, ["symbol", "tau_bps"], side, [(1 - (1 - t) / 2, lambda n, t=t: F.least(F.ceil(F.lit(1 - (1 - t) / 2) * (n + 1)), n)) for t in (0.68, 0.95)])
        own = got.where(F.element_at(F.array(F.lit(6800), F.lit(9500)), F.col("ask") + 1) == F.col("tau_bps")).select("symbol", "tau_bps", F.lit(side).alias("side"), "n", F.round("q", 4).alias("q"))
        out = own if out is None else out.unionByName(own)
    return out


def q_cross_section(s, d):  # noqa: ANN001, ANN201
    """Features of each date over its symbols, with the week before's: mean, spread, share of high index, first and lags."""
    rows = panel(s, d).where("sigma > 0").withColumn("r", F.col("rel_resid") / F.col("sigma"))
    g = rows.groupBy("fri_ts").agg(F.count("*").alias("n"), F.avg("r").alias("r_bar"), F.stddev_samp("r").alias("r_sd"), F.min_by("vix", "symbol").alias("vix"), F.avg((F.col("regime_pub") == "high_vol").cast("double")).alias("share_high"), F.sum("gap_days").alias("days"))
    line = Window.partitionBy(F.lit(0)).orderBy("fri_ts")  # one row a date
    return g.withColumns({"r_bar_lag1": F.lag("r_bar").over(line), "delta_vix": F.col("vix") - F.lag("vix").over(line)})


def q_cross_section_out(s, d):  # noqa: ANN001, ANN201
    out = q_cross_section(s, d)
    return out.select(*[r_signed(c, 5) if t == "double" else F.col(c) for c, t in out.dtypes])


def q_ridge(s, d):  # noqa: ANN001, ANN201
    """A ridge regression of a date's mean residual on what the date before knew: shares explained in and out of sample."""
    return rounded(P.ridge_forward(q_cross_section(s, d), ["r_bar_lag1", "vix", "delta_vix", "share_high"], "r_bar", SPLIT, 1.0), 6)


_DAYS = "(greatest(gap_days - 3, 0) + 1)"
_SIG = f"sg AS (SELECT *, fri_vol_20d * sqrt({_DAYS}::DOUBLE) * fri_close AS sigma_f0, vix / 100 * sqrt({_DAYS} / 252.0::DOUBLE) * fri_close AS sv, CASE WHEN count(*) OVER w >= 13 THEN stddev_samp(ln(mon_open / point)) OVER w * point END AS sigma_f1 FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY fri_ts ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING))"
_ZT = "zt AS (SELECT * FROM (VALUES " + ", ".join(f"({int(round(t * 10_000))}, {z!r}::DOUBLE)" for t, z in Z.items()) + ") t(tau_bps, z))"
_PIT = """pw AS (SELECT regime_pub, max(q) FILTER (tau_bps = 6800) AS a, max(q) FILTER (tau_bps = 8500) AS b, max(q) FILTER (tau_bps = 9500) AS c, max(q) FILTER (tau_bps = 9900) AS e FROM qt GROUP BY 1),
pu AS (SELECT symbol, fri_ts, mon_open - point AS r, abs(mon_open - point) / (sigma * fri_close) AS u, pw.* FROM panel JOIN pw USING (regime_pub) WHERE sigma > 0 AND fri_ts >= DATE '1999-01-01'),
pit AS (SELECT symbol, fri_ts, 0.5 + 0.5 * (CASE WHEN u < a THEN u / a * 0.68 WHEN u < b THEN 0.68 + (u - a) / (b - a) * 0.17 WHEN u < c THEN 0.85 + (u - b) / (c - b) * 0.10 WHEN u < e THEN 0.95 + (u - c) / (e - c) * 0.04 ELSE 0.99 END) * CASE WHEN r >= 0 THEN 1 ELSE -1 END AS pit FROM pu)"""
_COV = lambda src, point, sigma, kind: f"SELECT tau_bps, count(*) AS n, round(avg(CASE WHEN mon_open >= {point} - z * {sigma} AND mon_open <= {point} + z * {sigma} THEN 1.0 ELSE 0 END), 4) AS realised, round(avg((({point} + z * {sigma}) - ({point} - z * {sigma})) / 2 / fri_close * 10000), 4) AS mean_hw_bps, '{kind}' AS kind FROM {src}, zt WHERE {sigma} > 0 GROUP BY 1"
_EDGES = [(0.005, "l99"), (0.025, "l95"), (0.075, "l85"), (0.16, "l68"), (0.5, "point"), (0.84, "u68"), (0.925, "u85"), (0.975, "u95"), (0.995, "u99")]
_PL = lambda a, q: f"(CASE WHEN mon_open >= {q} THEN (mon_open - {q}) * {a}::DOUBLE ELSE ({q} - mon_open) * (1 - {a}::DOUBLE) END)"
_CRPS = " + ".join(f"({_PL(a, x)} + {_PL(b, y)}) / 2 * ({b}::DOUBLE - {a}::DOUBLE)" for (a, x), (b, y) in zip(_EDGES[:-1], _EDGES[1:], strict=True))
_BINOM = ", ".join(f"pow(1 - p, n) * " + " * ".join(f"greatest(n - {i - 1}, 0) / {i} * p / (1 - p)" for i in range(1, k + 1)) + f" AS b{k}" for k in range(1, 7))
_XS = "xs AS (SELECT fri_ts, count(*) AS n, avg(rel_resid / sigma) AS r_bar, stddev_samp(rel_resid / sigma) AS r_sd, min_by(vix, symbol) AS vix, avg(CASE WHEN regime_pub = 'high_vol' THEN 1.0 ELSE 0 END) AS share_high, sum(gap_days)::BIGINT AS days FROM panel WHERE sigma > 0 GROUP BY 1)"



def q_tails(s, d):  # noqa: ANN001, ANN201
    """The next score's quantile of each symbol by peaks over a threshold, quantile recursions and self-exciting tails."""
    return rounded(TL.tail_quantiles(early(s, d), 0.95), 4)


QUERIES = {
    "i18_tail_quantiles": (q_tails, None),
    "k4_conditional_coverage": (q_conditional, f"WITH {SERVED}, {_T}, i AS (SELECT tau_bps, sum({_IND}) AS lr_ind, count({_IND})::INT AS k FROM t GROUP BY 1), g AS (SELECT tau_bps, tau, count(*) AS n, sum(1 - inside)::BIGINT AS x FROM hits GROUP BY 1, 2) SELECT tau_bps, n, k, round({_LR}, 4) AS lr_uc, round(lr_ind, 4) AS lr_ind, round({_LR} + lr_ind, 4) AS lr_cc FROM g JOIN i USING (tau_bps)"),
    "k4_conditional_tails": (q_conditional_p, f"WITH {SERVED}, {_T}, i AS (SELECT tau_bps, sum({_IND}) AS lr_ind, count({_IND})::INT AS k FROM t GROUP BY 1), g AS (SELECT tau_bps, tau, count(*) AS n, sum(1 - inside)::BIGINT AS x FROM hits GROUP BY 1, 2), r AS (SELECT tau_bps, k, {_LR} AS lr_uc, lr_ind, {_LR} + coalesce(lr_ind, 0) AS lr_cc, k + 1 AS k1 FROM g JOIN i USING (tau_bps)) SELECT tau_bps, k, round(lr_uc, 6) AS lr_uc, round(lr_ind, 6) AS lr_ind, round(lr_cc, 6) AS lr_cc, round({chi2_sql('lr_uc', '1')}, 6) AS p_uc, round({chi2_sql('lr_ind', 'k')}, 6) AS p_ind, round({chi2_sql('lr_cc', 'k1')}, 6) AS p_cc FROM r"),
    "k3_conditional_by_symbol": (q_conditional_symbol, f"WITH {SERVED}, {_T}, g AS (SELECT symbol, tau_bps, tau, count(*) AS n, sum(1 - inside)::BIGINT AS x FROM hits GROUP BY 1, 2, 3) SELECT symbol, tau_bps, round({_LR}, 5) AS lr_uc, round({_IND}, 5) AS lr_ind, round(exp(-(({_LR}) + ({_IND})) / 2), 5) AS p_cc FROM g LEFT JOIN t USING (symbol, tau_bps)"),
    "h2_pits": (q_pits, f"WITH {PANEL}, {TAUS}, {_table_sql('qt', 'score')}, {_PIT} SELECT symbol, fri_ts, round(pit, 5) AS pit FROM pit"),
    "h3_pit_quantiles": (q_pit_quantiles, f"WITH {SERVED}, w AS (SELECT symbol, fri_ts, mon_open AS y, max(lower) FILTER (tau_bps = 9500) AS a, max(lower) FILTER (tau_bps = 6800) AS b, max(upper) FILTER (tau_bps = 6800) AS c, max(upper) FILTER (tau_bps = 9500) AS e FROM bands GROUP BY 1, 2, 3) SELECT symbol, fri_ts, round(CASE WHEN y <= a THEN 0.025 WHEN y <= b THEN 0.025 + (y - a) / (b - a) * 0.135 WHEN y <= c THEN 0.16 + (y - b) / (c - b) * 0.68 WHEN y <= e THEN 0.84 + (y - c) / (e - c) * 0.135 ELSE 0.975 END::DOUBLE, 5) AS pit FROM w"),
    "k5_berkowitz": (_tested("symbol"), None),
    "k6_berkowitz_pooled": (_tested("pooled"), None),
    "k7_dynamic_quantile": (q_dynamic, None),
    "k13_joint_tail": (q_joint_tail, f"WITH {SERVED}, c AS (SELECT tau_bps, fri_ts, count(*)::DOUBLE AS n, sum(1 - inside)::DOUBLE AS k, 1 - tau_bps / 10000.0::DOUBLE AS p FROM hits GROUP BY 1, 2), b AS (SELECT *, pow(1 - p, n) AS b0, {_BINOM} FROM c) SELECT tau_bps, count(*) AS dates, round(avg(k) / avg(n * p), 5) AS mean_ratio, round(var_samp(k) / avg(n * p * (1 - p)), 5) AS var_ratio, round(avg(CASE WHEN k >= 3 THEN 1.0 ELSE 0 END), 5) AS tail3, round(avg(1 - b0 - b1 - b2), 5) AS binom3, round(avg(CASE WHEN k >= 5 THEN 1.0 ELSE 0 END), 5) AS tail5, round(avg(1 - b0 - b1 - b2 - b3 - b4), 5) AS binom5, round(avg(CASE WHEN k >= 7 THEN 1.0 ELSE 0 END), 5) AS tail7, round(avg(1 - b0 - b1 - b2 - b3 - b4 - b5 - b6), 5) AS binom7, round(CASE WHEN sum(b0) >= 1 THEN pow(count(*) FILTER (k = 0) - sum(b0), 2) / sum(b0) ELSE 0 END + CASE WHEN sum(b1) >= 1 THEN pow(count(*) FILTER (k = 1) - sum(b1), 2) / sum(b1) ELSE 0 END + CASE WHEN sum(b2) >= 1 THEN pow(count(*) FILTER (k = 2) - sum(b2), 2) / sum(b2) ELSE 0 END + CASE WHEN sum(1 - b0 - b1 - b2) >= 1 THEN pow(count(*) FILTER (k >= 3) - sum(1 - b0 - b1 - b2), 2) / sum(1 - b0 - b1 - b2) ELSE 0 END, 5) AS chi2 FROM b GROUP BY 1"),
    "d2_gaussian_coverage": (q_gaussian, f"WITH {PANEL}, {_SIG}, {_ZT} {_COV('sg', 'fri_close', 'sigma_f0', 'f0')} UNION ALL {_COV('sg', 'fri_close', 'sv', 'vix')} UNION ALL {_COV('sg', 'point', 'sigma_f1', 'f1')}"),
    "d4_gaussian_curve": (q_gaussian_curve, f"WITH {PANEL}, {_SIG}, zt AS (SELECT * FROM (VALUES " + ", ".join(f"({int(round(t * 10_000))}, {D.normal_quantile((1 + t) / 2)!r}::DOUBLE)" for t in GRID) + ") t(tau_bps, z)) SELECT tau_bps, count(*) AS n, round(avg(CASE WHEN mon_open BETWEEN fri_close - z * sigma_f0 AND fri_close + z * sigma_f0 THEN 1.0 ELSE 0 END), 5) AS realised FROM sg, zt WHERE sigma_f0 > 0 GROUP BY 1"),
    "b10_sigmas": (q_sigmas, f"WITH {PANEL}, {_SIG} SELECT symbol, fri_ts, round(sigma_f0, 4) AS sigma_f0, round(CASE WHEN symbol IN ({', '.join(repr(f'Brand#{i}') for i in range(1, 14))}) THEN sv END, 4) AS sigma_vix, round(sigma_f1, 4) AS sigma_f1, round(CASE WHEN fri_vol_20d <> 0 THEN abs(ln(mon_open / fri_close)) / fri_vol_20d END, 4) AS z FROM sg"),
    "b19_realised_bucket": (q_realised_bucket, f"WITH {PANEL}, z AS (SELECT *, abs(ln(mon_open / fri_close)) / nullif(fri_vol_20d, 0) AS z FROM panel), c AS (SELECT quantile_cont(z, 0.33) AS a, quantile_cont(z, 0.67) AS b FROM z) SELECT regime_pub, CASE WHEN z <= a THEN 'calm' WHEN z <= b THEN 'normal' ELSE 'shock' END AS realized_bucket, count(*) AS n, round(avg(z), 5) AS mean_z FROM z, c WHERE z IS NOT NULL GROUP BY 1, 2"),
    "e11_index_quantiles": (q_index_quantiles, f"WITH {PANEL}, v AS (SELECT *, ln(mon_open / point) / nullif(vix, 0) AS x FROM panel), u AS (SELECT symbol, fri_ts, t.bps AS tau_bps, point, vix, count(x) OVER w AS c, quantile_cont(x, 0.16) OVER w AS l68, quantile_cont(x, 0.84) OVER w AS u68, quantile_cont(x, 0.025) OVER w AS l95, quantile_cont(x, 0.975) OVER w AS u95 FROM v, (VALUES (6800), (9500)) t(bps) WINDOW w AS (PARTITION BY symbol, t.bps ORDER BY fri_ts ROWS BETWEEN 105 PRECEDING AND 2 PRECEDING)) SELECT symbol, fri_ts, tau_bps, round(point * exp(vix * CASE WHEN tau_bps = 6800 THEN l68 ELSE l95 END), 3) AS lower, round(point * exp(vix * CASE WHEN tau_bps = 6800 THEN u68 ELSE u95 END), 3) AS upper FROM u WHERE c >= 26"),
    "c20_daily_har": (q_daily_har, f"""WITH {BARS}, r AS (SELECT symbol, ts, pow(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)), 2) AS rv_d FROM bars), h AS (SELECT symbol, ts, rv_d, CASE WHEN count(rv_d) OVER w5 = 5 THEN avg(rv_d) OVER w5 END AS rv_w, CASE WHEN count(rv_d) OVER w22 = 22 THEN avg(rv_d) OVER w22 END AS rv_m FROM r WINDOW w5 AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING), w22 AS (PARTITION BY symbol ORDER BY ts ROWS 21 PRECEDING)) SELECT symbol, ts, round(rv_d, 6) AS rv_d, round(rv_w, 6) AS rv_w, round(rv_m, 6) AS rv_m FROM h WHERE rv_m IS NOT NULL"""),
    "i14_har_sigma": (q_har_sigma, None),
    "i15_forecasters": (q_forecasters, None),
    "i16_garch": (q_garch, None),
    "k9_crps_grid": (q_crps_grid, f"WITH {SERVED}, w AS (SELECT symbol, fri_ts, mon_open, fri_close, point, " + ", ".join(f"max(lower) FILTER (tau_bps = {t}00) AS l{t}, max(upper) FILTER (tau_bps = {t}00) AS u{t}" for t in (68, 85, 95, 99)) + f" FROM bands GROUP BY ALL) SELECT symbol, count(*) AS n, round(avg(2 * ({_CRPS}) / fri_close), 5) AS crps FROM w GROUP BY 1"),
    "k12_metrics_row": (q_metrics_row, f"WITH {SERVED}, {_T}, i AS (SELECT tau_bps, sum({_IND}) AS lr_ind, count({_IND})::INT AS k FROM t GROUP BY 1), g AS (SELECT tau_bps, tau, count(*) AS n, avg(inside) AS realised, avg(hw_bps) AS mean_hw, sum(1 - inside)::BIGINT AS x FROM hits GROUP BY 1, 2), r AS (SELECT *, {_LR} AS lr_uc FROM g JOIN i USING (tau_bps)) SELECT tau_bps, n, round(realised, 4) AS realised, round(mean_hw, 4) AS mean_hw, k, round(lr_uc, 4) AS lr_uc, round(lr_ind, 4) AS lr_ind, round(lr_uc + lr_ind, 4) AS lr_cc, round({chi2_sql('lr_uc', '1')}, 4) AS p_uc, round({chi2_sql('lr_ind', 'k')}, 4) AS p_ind FROM r"),
    "k18_residual_t": (q_residual_t, f"WITH {PANEL}, g AS (SELECT symbol, count(*) AS n, avg(ln(mon_open / point)) AS m, stddev_samp(ln(mon_open / point)) AS s, avg(ln(mon_open / point) / sqrt({_DAYS}::DOUBLE)) AS ms FROM panel GROUP BY 1) SELECT symbol, n, round(m, 5) AS mean, round(s, 5) AS sd, round(ms, 5) AS mean_scaled, round(m / (s / sqrt(n)), 5) AS t, round(1.96 * s / sqrt(n), 5) AS half FROM g"),
    "k18_residual_p": (q_residual_p, None),
    "k15_permutations": (q_permutations, None),
    "l3_tail_bootstrap": (q_tail_bootstrap, None),
    "l5_moving_blocks": (q_moving_blocks, None),
    "k19_method_grid": (q_method_grid, f"WITH {SERVED}, {_table_sql('qr', 'score_raw')}, {_bump_sql('br', 'qr', 'score_raw')}, m AS (SELECT 'score' AS method, symbol, tau_bps, tau, inside, hw_bps AS hw FROM hits UNION ALL SELECT 'score_raw', symbol, tau_bps, tau, CASE WHEN mon_open BETWEEN point - c * q * point AND point + c * q * point THEN 1 ELSE 0 END, ((point + c * q * point) - (point - c * q * point)) / 2 / fri_close * 10000 FROM panel JOIN qr USING (regime_pub) JOIN br USING (tau_bps, tau) WHERE fri_ts >= DATE '{SPLIT}'), g AS (SELECT method, symbol, tau_bps, tau, count(*) AS n, avg(inside) AS r, avg(hw) AS hw, sum(1 - inside)::BIGINT AS x FROM m GROUP BY 1, 2, 3, 4) SELECT method, symbol, tau_bps, n, round(r, 4) AS realised, round(hw, 4) AS mean_hw, round({_LR}, 4) AS lr_uc FROM g"),
    "i21_mondrian_correction": (q_mondrian_correction, f"WITH {PANEL}, {_SIG}, e AS (SELECT symbol, t.b AS tau_bps, t.t AS tau, greatest(point - t.z * sigma_f1 - mon_open, 0) AS below, greatest(mon_open - (point + t.z * sigma_f1), 0) AS above FROM sg, (VALUES (6800, 0.68::DOUBLE, {D.normal_quantile(0.84)!r}::DOUBLE), (9500, 0.95::DOUBLE, {D.normal_quantile(0.975)!r}::DOUBLE)) t(b, t, z) WHERE fri_ts < DATE '{SPLIT}' AND sigma_f1 > 0), u AS (SELECT symbol, tau_bps, tau, 'below' AS side, below AS v FROM e UNION ALL SELECT symbol, tau_bps, tau, 'above', above FROM e), x AS (SELECT *, row_number() OVER (PARTITION BY symbol, tau_bps, side ORDER BY v) AS k, count(*) OVER (PARTITION BY symbol, tau_bps, side) AS n FROM u) SELECT symbol, tau_bps, side, n, round(v, 4) AS q FROM x WHERE k = least(ceil((1 - (1 - tau) / 2) * (n + 1)), n)"),
    "d17_cross_section": (q_cross_section_out, f"WITH {PANEL}, {_XS} SELECT fri_ts, n, round(r_bar, 5) AS r_bar, round(r_sd, 5) AS r_sd, round(vix, 5) AS vix, round(share_high, 5) AS share_high, days, round(lag(r_bar) OVER (ORDER BY fri_ts), 5) AS r_bar_lag1, round(vix - lag(vix) OVER (ORDER BY fri_ts), 5) AS delta_vix FROM xs"),
    "i17_ridge_forward": (q_ridge, None),
}
