"""Queries of anchored paths, several regressors, bundles of variants and functions in SQL text, each with the same rows in
DuckDB's SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql_functions
from ..operators import calibrate as C
from ..operators import density as D
from ..operators import factors as X
from ..operators import joins as J
from ..operators import panel as P
from ..operators import variants as V
from ..operators.shared import once, sized, written
from ..sources import market as M
from .panel_queries import PANEL, SPLIT, TAUS, _bump_sql, _table_sql, bands, panel
from .policy_queries import rounded
from .serve_queries import _EW, _LATE, late, table
from .stat_queries import _IND, _LR

TEST = "2000-01-01"
SHIFTS = (0.0, 0.005, 0.01, 0.02, 0.03, 0.05)


def minute_bars(s, d, symbols=None):  # noqa: ANN001, ANN201
    """Trades by brand and minute, of all brands or of some; a line's minute of its day comes from its order and number."""
    parts = M.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    if symbols is not None:
        parts = sized(parts.join(sized(symbols), "symbol", "left_semi"), 1_000_000)
    lines = M.table(s, d, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    at = F.to_date("l_shipdate").cast("timestamp") + F.make_dt_interval(mins=((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 1440).cast("int"))
    both = lines.join(parts, "l_partkey").select("symbol", at.alias("ts"), "p", F.struct("l_orderkey", "l_linenumber", "p").alias("t"))
    return both.groupBy("symbol", "ts").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.max("t")["p"].alias("close"))


def factor_minutes(s, d):  # noqa: ANN001, ANN201
    """The minute bars that paths are made of: those of every brand that is some gap's factor. No gap looks at others."""
    return once(s, "factor-minutes", d, lambda: minute_bars(s, d, X.path_factors(panel(s, d)).select(F.col("factor").alias("symbol")).distinct()))


def anchored(s, d):  # noqa: ANN001, ANN201
    """The gaps that have an anchored path, with its score."""
    return once(s, "anchored", d, lambda: P.with_path_score(X.anchored_paths(panel(s, d), factor_minutes(s, d))))


def q_anchored_paths(s, d):  # noqa: ANN001, ANN201
    out = anchored(s, d).select("symbol", "fri_ts", "factor", "n_bars", "anchor", "path_lo", "path_hi", "score_path")
    return rounded(out, 4)


def q_anchored_coverage(s, d):  # noqa: ANN001, ANN201
    """Bands fitted to paths that begin at the close: coverage of the gap's end and of its whole path."""
    fitted = C.one_shot(anchored(s, d), C.tau_table(s), SPLIT, "score_path")
    return rounded(C.path_coverage(fitted, "regime_pub", "tau_bps"), 4)


def q_band_minutes(s, d):  # noqa: ANN001, ANN201
    """Served bands on the minutes of late gaps: of a gap's anchored closes how many lie inside, and the first that doesn't."""
    gaps = anchored(s, d).where(F.col("fri_ts") >= SPLIT).select("symbol", "fri_ts", "factor", (F.col("fri_close") / F.col("anchor")).alias("scale"), X.local_time(F.col("fri_ts"), 16, 0, "America/New_York").alias("a"), X.local_time(F.col("mon_ts"), 9, 30, "America/New_York").alias("b"))
    days = sized(gaps.withColumn("day", F.explode(F.sequence(F.to_date("a"), F.to_date("b")))))
    bars = factor_minutes(s, d).select(F.col("symbol").alias("factor"), F.to_date("ts").alias("day"), "ts", "close")
    line = days.join(bars, ["factor", "day"]).where("ts BETWEEN a AND b").select("symbol", "fri_ts", "ts", (F.col("close") * F.col("scale")).alias("price"))
    both = line.join(sized(bands(s, d).select("symbol", "fri_ts", "tau_bps", "lower", "upper")), ["symbol", "fri_ts"])
    inside = F.col("price").between(F.col("lower"), F.col("upper"))
    return both.groupBy("symbol", "fri_ts", "tau_bps").agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"), F.min(F.when(~inside, F.col("ts"))).cast("timestamp_ntz").alias("first_out"))


def q_loglog(s, d):  # noqa: ANN001, ANN201
    return rounded(D.loglog_bounds(panel(s, d), [0.68, 0.95]).drop("mon_open"), 4)


def q_regressors(s, d):  # noqa: ANN001, ANN201
    """Widths by the index, an event in the week after the gap, a long weekend, and one less that flag, which depends on it."""
    rows = J.event_within(panel(s, d), M.calendar_events(s, d)).withColumn("long_weekend", (F.col("gap_days") >= 4).cast("int"))
    rows = rows.withColumn("short_weekend", 1 - F.col("long_weekend"))
    fits = D.loglog_fits(rows, (0.68, 0.95), extras=("earnings_next_week", "long_weekend", "short_weekend"))
    names = ("alpha", "beta", "event", "long", "short")
    out = fits.select("symbol", "fri_ts", "n_fit", "sigma_now", *[F.col("coefs")[i].alias(n) for i, n in enumerate(names)], *[F.col(c)[i].alias(f"{c}_{t}") for c in ("lower", "upper") for i, t in enumerate((68, 95))])
    return rounded(out, 4)


def rules(s):  # noqa: ANN001, ANN201
    return s.sql("""SELECT * FROM VALUES ('hl6', 'ewma', 6D, CAST(NULL AS INT), CAST(NULL AS DOUBLE), 'regime_pub'), ('hl8', 'ewma', 8D, NULL, NULL, 'regime_pub'), ('hl12', 'ewma', 12D, NULL, NULL, 'regime_pub'),
    ('k26', 'window', NULL, 26, NULL, 'regime_pub'), ('blend', 'blend', 8D, 26, 0.5D, 'regime_pub'), ('hl8_one_cell', 'ewma', 8D, NULL, NULL, NULL) AS t(variant, method, half_life, window, alpha, cell)""")


def bundle(s, d):  # noqa: ANN001, ANN201
    rows = written(V.scaled(panel(s, d), rules(s)), "variants")
    train, tune = rows.where(F.col("fri_ts") < SPLIT), rows.where((F.col("fri_ts") >= SPLIT) & (F.col("fri_ts") < TEST))
    return rows.where(F.col("fri_ts") >= TEST), V.fitted(train, tune, C.TAUS, SHIFTS)


def q_bundle(s, d):  # noqa: ANN001, ANN201
    """What six variants were frozen with: a row a variant, cell and tau."""
    return rounded(bundle(s, d)[1], 5)


def q_side_by_side(s, d):  # noqa: ANN001, ANN201
    """The six frozen variants on the gaps after both fits."""
    rows, frozen = bundle(s, d)
    return rounded(V.side_by_side(V.served(rows, written(frozen, "bundle")), "hl8"), 4)


def q_sql_bands(s, d):  # noqa: ANN001, ANN201
    """SQL text: bands of late gaps at asked coverages by the table function, and their statistics by registered functions."""
    sql_functions.register(s)
    q = table(s, d).groupBy("regime_pub").pivot("tau_bps", [6800, 8500, 9500, 9900]).agg(F.first("q"))
    q = q.select("regime_pub", F.array("6800", "8500", "9500", "9900").alias("qs"))
    text = """
    WITH b AS (
      SELECT g.symbol, g.mon_open, g.fri_close, t.tau, t.lower, t.upper
      FROM {gaps} g JOIN {q} q ON g.regime_pub = q.regime_pub,
      LATERAL lacuna_bands_at(g.point, g.sigma * g.fri_close, array(0.68D, 0.85D, 0.95D, 0.99D), q.qs, array(0.6D, 0.75D, 0.9D, 0.97D)) t
      WHERE g.sigma IS NOT NULL)
    SELECT symbol, CAST(round(tau * 10000) AS INT) AS tau_bps, count(*) AS n, avg(lacuna_winkler(lower, upper, mon_open, tau) / fri_close * 10000) AS winkler_bps,
      lacuna_kupiec_lr(count_if(mon_open NOT BETWEEN lower AND upper), count(*), max(tau)) AS lr_uc
    FROM b GROUP BY symbol, tau"""
    return rounded(s.sql(text, gaps=late(s, d), q=sized(q)), 4)


_MINUTES = """mb AS (SELECT p_brand AS k, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + to_minutes(CAST((l_orderkey * 7 + l_linenumber * 131) % 1440 AS INT)) AS ts, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high, max(struct_pack(o := l_orderkey, n := l_linenumber, p := l_extendedprice / l_quantity)).p AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
_NY = lambda day, h: f"timezone('UTC', timezone('America/New_York', CAST({day} AS TIMESTAMP) + INTERVAL '{h}' MINUTE))"
_LABEL = "CASE symbol " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.FACTORS.items()) + f" ELSE '{X.DEFAULT}' END"
_ANCHORED = f"""{PANEL.replace('panel AS (SELECT', 'panel0 AS (SELECT')}, {_MINUTES},
w AS (SELECT *, {_LABEL} AS factor, {_NY('fri_ts', 960)} AS a, {_NY('mon_ts', 570)} AS b FROM panel0 WHERE NOT (symbol = '{X.PIVOT[0]}' AND fri_ts >= DATE '{X.PIVOT[1]}')),
u AS (SELECT DISTINCT factor, a, b FROM w),
ins AS (SELECT factor, a, b, count(*) AS n_bars, min(low) AS lo, max(high) AS hi, arg_min(close, ts) AS c0 FROM u JOIN mb ON k = factor AND ts BETWEEN a AND b GROUP BY ALL),
pre AS (SELECT factor, a, b, arg_max(close, ts) AS c1 FROM u JOIN mb ON k = factor AND ts <= a + INTERVAL 60 SECOND GROUP BY ALL),
an AS (SELECT factor, a, b, n_bars, lo, hi, coalesce(c1, c0) AS anchor FROM ins LEFT JOIN pre USING (factor, a, b)),
panel AS (SELECT *, CASE WHEN sigma > 0 THEN greatest(point - path_lo, path_hi - point, abs(mon_open - point), 0) / (fri_close * sigma) END AS score_path FROM (SELECT w.*, n_bars, anchor, lo * (fri_close / anchor) AS path_lo, hi * (fri_close / anchor) AS path_hi FROM w JOIN an USING (factor, a, b) WHERE anchor > 0))"""
_ABANDS = f"{_ANCHORED}, {TAUS}, {_table_sql('qt', 'score_path')}, {_bump_sql('bump', 'qt', 'score_path')}, bands AS (SELECT panel.*, tau_bps, point - c * q * sigma * fri_close AS lower, point + c * q * sigma * fri_close AS upper FROM panel JOIN qt USING (regime_pub) JOIN bump USING (tau_bps, tau) WHERE sigma IS NOT NULL AND {_LATE})"
_SERVED0 = f"{_ANCHORED}, {TAUS}, {_table_sql('qt', 'score').replace('FROM panel ', 'FROM panel0 ')}, {_bump_sql('bump', 'qt', 'score').replace('FROM panel ', 'FROM panel0 ')}, bands AS (SELECT symbol, fri_ts, tau_bps, point - c * q * sigma * fri_close AS lower, point + c * q * sigma * fri_close AS upper FROM panel0 JOIN qt USING (regime_pub) JOIN bump USING (tau_bps, tau) WHERE sigma IS NOT NULL AND {_LATE})"
_ASKS = ", ".join(f"({i}, {int(round(t * 10_000))}, {t!r}::DOUBLE, {dl!r}::DOUBLE, {min(t + dl, 0.999)!r}::DOUBLE)" for i, (t, dl) in enumerate((t, dl) for t in C.TAUS for dl in SHIFTS))
_KINDS = {"hl6": ("s6", "regime_pub"), "hl8": ("sigma", "regime_pub"), "hl12": ("s12", "regime_pub"), "k26": ("sk", "regime_pub"), "blend": ("0.5 * sigma + 0.5 * sk", "regime_pub"), "hl8_one_cell": ("sigma", "'all'")}
_BUNDLE = f"""{PANEL}, n0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fri_ts) AS rn FROM panel),
s0 AS (SELECT *, {_EW(6)} AS s6, {_EW(12)} AS s12, CASE WHEN count(*) OVER v >= 8 THEN stddev_samp(rel_resid) OVER v END AS sk FROM n0 WINDOW w AS (PARTITION BY symbol ORDER BY fri_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY symbol ORDER BY fri_ts ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)),
e AS ({' UNION ALL '.join(f"SELECT '{k}' AS variant, {c} AS cell, symbol, fri_ts, point, fri_close, mon_open, {x} AS scale, score_raw / ({x}) AS s FROM s0 WHERE sigma > 0 AND sk > 0 AND s6 > 0 AND s12 > 0" for k, (x, c) in _KINDS.items())}),
asks AS (SELECT * FROM (VALUES {_ASKS}) t(ask, tau_bps, tau, shift, lvl)),
x AS (SELECT variant, cell, s, row_number() OVER (PARTITION BY variant, cell ORDER BY s) AS k, count(*) OVER (PARTITION BY variant, cell) AS n FROM e WHERE NOT ({_LATE})),
qa AS (SELECT variant, cell, tau_bps, tau, shift, n, s AS q FROM x, asks WHERE k = least(greatest(ceil(lvl * (n + 1)), 1), n)),
h AS (SELECT variant, tau_bps, tau, shift, avg(CASE WHEN s <= q THEN 1.0 ELSE 0 END) AS held FROM e JOIN qa USING (variant, cell) WHERE {_LATE} AND fri_ts < DATE '{TEST}' GROUP BY ALL),
pk AS (SELECT variant, tau_bps, coalesce(min(shift) FILTER (held >= tau), {SHIFTS[-1]!r}::DOUBLE) AS shift FROM h GROUP BY ALL),
fz AS (SELECT qa.* FROM qa JOIN pk USING (variant, tau_bps, shift))"""
_SIDE = f"""{_BUNDLE}, m AS (SELECT variant, symbol, fri_ts, tau_bps, tau, shift, CASE WHEN mon_open BETWEEN point - q * scale * fri_close AND point + q * scale * fri_close THEN 0 ELSE 1 END AS miss, q * scale * 10000 AS hw FROM e JOIN fz USING (variant, cell) WHERE fri_ts >= DATE '{TEST}'),
l AS (SELECT variant, symbol, tau_bps, miss AS m, lag(miss) OVER (PARTITION BY variant, symbol, tau_bps ORDER BY fri_ts) AS p FROM m),
t AS (SELECT variant, symbol, tau_bps, count(*) FILTER (p = 0 AND m = 0)::DOUBLE AS n00, count(*) FILTER (p = 0 AND m = 1)::DOUBLE AS n01, count(*) FILTER (p = 1 AND m = 0)::DOUBLE AS n10, count(*) FILTER (p = 1 AND m = 1)::DOUBLE AS n11 FROM l WHERE p IS NOT NULL GROUP BY ALL),
i AS (SELECT variant, tau_bps, sum({_IND}) AS lr_ind, count({_IND})::INT AS k FROM t GROUP BY ALL),
g AS (SELECT variant, tau_bps, tau, max(shift) AS shift, count(*) AS n, sum(miss)::BIGINT AS x, avg(hw) AS mean_hw FROM m GROUP BY 1, 2, 3)
SELECT variant, tau_bps, round(shift, 4) AS shift, n, round(1 - x / n, 4) AS realised, round(mean_hw, 4) AS mean_hw_bps, round(mean_hw / max(mean_hw) FILTER (variant = 'hl8') OVER (PARTITION BY tau_bps), 4) AS width_ratio, round({_LR}, 4) AS lr_uc, round(lr_ind, 4) AS lr_ind, k FROM g LEFT JOIN i USING (variant, tau_bps)"""
_LOGLOG = f"""WITH {PANEL}, a AS (SELECT symbol, fri_ts, point, vix, ln(mon_open / point) AS r, CASE WHEN vix > 0 THEN ln(vix) END AS x, row_number() OVER (PARTITION BY symbol ORDER BY fri_ts) AS i FROM panel),
f AS (SELECT *, CASE WHEN x IS NOT NULL AND abs(r) > 1e-10 THEN ln(abs(r)) END AS y FROM a),
p AS (SELECT now.symbol, now.i, regr_slope(o.y, o.x) AS b, regr_intercept(o.y, o.x) AS a FROM f now JOIN f o ON o.symbol = now.symbol AND o.i < now.i AND o.i >= now.i - 156 WHERE now.x IS NOT NULL GROUP BY 1, 2 HAVING count(o.y) >= 50),
z AS (SELECT p.symbol, p.i, any_value(p.a) AS a, any_value(p.b) AS b, quantile_cont(o.r / exp(p.a + p.b * o.x), [0.16, 0.84, 0.025, 0.975]) AS zs FROM p JOIN f o ON o.symbol = p.symbol AND o.i < p.i AND o.i >= p.i - 156 WHERE o.y IS NOT NULL GROUP BY 1, 2)
SELECT symbol, fri_ts, t AS tau_bps, round(point * exp(zs[j] * exp(a + b * x)), 4) AS lower, round(point * exp(zs[j + 1] * exp(a + b * x)), 4) AS upper FROM z JOIN f USING (symbol, i), (VALUES (6800, 1), (9500, 3)) v(t, j)"""
_AT = lambda tau: f"CASE WHEN {tau} <= 0.68 THEN q68 WHEN {tau} <= 0.85 THEN q68 + ({tau} - 0.68) / (0.85 - 0.68) * (q85 - q68) WHEN {tau} <= 0.95 THEN q85 + ({tau} - 0.85) / (0.95 - 0.85) * (q95 - q85) ELSE q95 + ({tau} - 0.95) / (0.99 - 0.95) * (q99 - q95) END"
_SQL_BANDS = f"""WITH {PANEL}, {TAUS}, {_table_sql('qt', 'score')}, q AS (SELECT regime_pub, {', '.join(f'max(q) FILTER (tau_bps = {b}00) AS q{b}' for b in (68, 85, 95, 99))} FROM qt GROUP BY 1),
b AS (SELECT symbol, mon_open, fri_close, t.tau, point - {_AT('t.tau')} * sigma * fri_close AS lower, point + {_AT('t.tau')} * sigma * fri_close AS upper FROM panel JOIN q USING (regime_pub), (VALUES (0.6::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE), (0.97::DOUBLE)) t(tau) WHERE {_LATE} AND sigma IS NOT NULL),
g AS (SELECT symbol, tau, count(*) AS n, avg((upper - lower + 2 / (1 - tau) * (greatest(lower - mon_open, 0) + greatest(mon_open - upper, 0))) / fri_close * 10000) AS wk, count(*) FILTER (NOT mon_open BETWEEN lower AND upper) AS x FROM b GROUP BY 1, 2)
SELECT symbol, CAST(round(tau * 10000) AS INT) AS tau_bps, n, round(wk, 4) AS winkler_bps, round({_LR}, 4) AS lr_uc FROM g"""

QUERIES = {
    "i24_anchored_paths": (q_anchored_paths, f"WITH {_ANCHORED} SELECT symbol, fri_ts, factor, n_bars, round(anchor, 4) AS anchor, round(path_lo, 4) AS path_lo, round(path_hi, 4) AS path_hi, round(score_path, 4) AS score_path FROM panel"),
    "i24_anchored_coverage": (q_anchored_coverage, f"WITH {_ABANDS}, e AS (SELECT regime_pub, tau_bps, CASE WHEN mon_open BETWEEN lower AND upper THEN 1.0 ELSE 0 END AS x, CASE WHEN path_lo >= lower AND path_hi <= upper THEN 1.0 ELSE 0 END AS y FROM bands) SELECT regime_pub, tau_bps, count(*) AS n, round(avg(x), 4) AS endpoint_cov, round(avg(y), 4) AS path_cov, round((avg(x) - avg(y)) * 100, 4) AS gap_pp FROM e GROUP BY 1, 2"),
    "e21_band_minutes": (q_band_minutes, f"WITH {_SERVED0}, z AS (SELECT p.symbol, p.fri_ts, ts, close * (fri_close / anchor) AS price FROM panel p JOIN mb ON k = factor AND ts BETWEEN a AND b WHERE {_LATE}) SELECT symbol, fri_ts, tau_bps, count(*) AS n, count(*) FILTER (price BETWEEN lower AND upper) AS n_inside, min(ts) FILTER (NOT price BETWEEN lower AND upper) AS first_out FROM z JOIN bands USING (symbol, fri_ts) GROUP BY 1, 2, 3"),
    "i13_regressors": (q_regressors, None),
    "i13_loglog_bounds": (q_loglog, _LOGLOG),
    "o15_bundle": (q_bundle, f"WITH {_BUNDLE} SELECT variant, cell, tau_bps, round(tau, 5) AS tau, round(shift, 5) AS shift, n, round(q, 5) AS q FROM fz"),
    "o15_side_by_side": (q_side_by_side, f"WITH {_SIDE}"),
    "t1_sql_bands": (q_sql_bands, _SQL_BANDS),
}
