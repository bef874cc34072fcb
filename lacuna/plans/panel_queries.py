"""Queries over the gap panel, each with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.special import erfc_column
from ..operators import calibrate as C
from ..operators import panel as P
from ..operators.shared import once, percentiles, running, sized, written
from ..operators.stats import conditional, kupiec_lr, transitions
from ..sources import market as M

SPLIT = "1999-01-01"

BARS = """bars AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS ts,
  min(struct_pack(k := l_orderkey, n := l_linenumber, p := l_extendedprice / l_quantity)).p AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  max(struct_pack(k := l_orderkey, n := l_linenumber, p := l_extendedprice / l_quantity)).p AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE dayofweek(l_shipdate) NOT IN (0, 6) GROUP BY 1, 2)"""
FACTOR = """f0 AS (SELECT CAST(l_shipdate AS DATE) AS ts, sum(l_extendedprice) / sum(l_quantity) AS level FROM lineitem WHERE dayofweek(l_shipdate) NOT IN (0, 6) GROUP BY 1),
f1 AS (SELECT *, ln(level / lag(level) OVER (ORDER BY ts)) AS r FROM f0),
factor AS (SELECT ts, level, CASE WHEN count(r) OVER w >= 10 THEN stddev_samp(r) OVER w * 100 * sqrt(252.0) END AS vol FROM f1 WINDOW w AS (ORDER BY ts ROWS 19 PRECEDING))"""
PAIRS = """b1 AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars),
b2 AS (SELECT *, CASE WHEN count(r) OVER w >= 10 THEN stddev_samp(r) OVER w END AS v FROM b1 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
b3 AS (SELECT symbol, lag(ts) OVER w AS fri_ts, ts AS mon_ts, lag(close) OVER w AS fri_close, open AS mon_open, lag(v) OVER w AS v, lag(v) OVER w AS fri_vol_20d FROM b2 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
pairs AS (SELECT * EXCLUDE (v), CAST(mon_ts - fri_ts AS INT) AS gap_days FROM b3 WHERE v IS NOT NULL AND mon_ts - fri_ts >= 3)"""
PANEL = f"""{BARS}, {FACTOR}, {PAIRS},
p1 AS (SELECT p.*, a.vol AS vix, b.level / a.level - 1 AS factor_ret, fri_close * (1 + (b.level / a.level - 1)) AS point
  FROM pairs p JOIN factor a ON p.fri_ts = a.ts JOIN factor b ON p.mon_ts = b.ts WHERE a.vol IS NOT NULL),
d1 AS (SELECT DISTINCT fri_ts, vix FROM p1),
d2 AS (SELECT fri_ts, count(vix) OVER w >= 20 AND vix > quantile_cont(vix, 0.75) OVER w AS high FROM d1 WINDOW w AS (ORDER BY fri_ts ROWS 51 PRECEDING)),
p2 AS (SELECT p1.*, CASE WHEN high THEN 'high_vol' WHEN gap_days >= 4 THEN 'long_weekend' ELSE 'normal' END AS regime_pub, (mon_open - point) / fri_close AS rel_resid FROM p1 JOIN d2 USING (fri_ts)),
p3 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fri_ts) AS rn FROM p2),
p4 AS (SELECT *, count(*) OVER w AS cnt, sqrt(sum(rel_resid * rel_resid * pow(2.0, rn / 8.0)) OVER w / sum(pow(2.0, rn / 8.0)) OVER w) AS s FROM p3 WINDOW w AS (PARTITION BY symbol ORDER BY fri_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
panel AS (SELECT * EXCLUDE (rn, cnt, s), CASE WHEN cnt >= 8 THEN s END AS sigma, abs(mon_open - point) / fri_close AS score_raw,
  CASE WHEN cnt >= 8 AND s > 0 THEN abs(mon_open - point) / fri_close / s END AS score, CASE WHEN cnt >= 8 AND s > 0 THEN (point - mon_open) / (fri_close * s) END AS downside FROM p4)"""
TAUS = "taus AS (SELECT * FROM (VALUES (6800, 0.68::DOUBLE), (8500, 0.85::DOUBLE), (9500, 0.95::DOUBLE), (9900, 0.99::DOUBLE)) t(tau_bps, tau))"


def _table_sql(name: str, score: str, cell: str = "regime_pub", where: str = f"fri_ts < DATE '{SPLIT}'") -> str:
    return f"""{name}_r AS (SELECT {cell}, {score} AS s, row_number() OVER (PARTITION BY {cell} ORDER BY {score}) AS k, count(*) OVER (PARTITION BY {cell}) AS n FROM panel WHERE {score} IS NOT NULL AND {where}),
{name} AS (SELECT {cell}, tau_bps, tau, n, s AS q FROM {name}_r, taus WHERE k = least(greatest(ceil(tau * (n + 1)), 1), n))"""


def _bump_sql(name: str, table: str, score: str, cell: str = "regime_pub") -> str:
    return f"""{name} AS (SELECT tau_bps, tau, coalesce(min(CASE WHEN held >= tau THEN c END), 5.0) AS c FROM (
  SELECT tau_bps, tau, 1.0::DOUBLE + g * 0.001::DOUBLE AS c, avg(CASE WHEN {score} <= q * (1.0::DOUBLE + g * 0.001::DOUBLE) THEN 1.0 ELSE 0.0 END) AS held
  FROM panel JOIN {table} USING ({cell}), range(0, 4001) r(g) WHERE {score} IS NOT NULL AND fri_ts >= DATE '{SPLIT}' GROUP BY ALL) GROUP BY 1, 2)"""


SERVED = f"""{PANEL}, {TAUS}, {_table_sql('qt', 'score')}, {_bump_sql('bump', 'qt', 'score')},
bands AS (SELECT panel.*, tau_bps, tau, point - c * q * sigma * fri_close AS lower, point + c * q * sigma * fri_close AS upper
  FROM panel JOIN qt USING (regime_pub) JOIN bump USING (tau_bps, tau) WHERE sigma IS NOT NULL AND fri_ts >= DATE '{SPLIT}'),
hits AS (SELECT *, CASE WHEN mon_open >= lower AND mon_open <= upper THEN 1 ELSE 0 END AS inside, (upper - lower) / 2 / fri_close * 10000 AS hw_bps FROM bands)"""


def panel(s: SparkSession, d: str) -> DataFrame:
    """The gap panel, which most queries read: made once a session and folder."""
    return once(s, "panel", d, lambda: P.weekend_panel(M.daily_bars(s, d), M.market_factor(s, d)))


def bands(s: SparkSession, d: str, kind: str = "score") -> DataFrame:
    """Out-of-sample bands: quantiles from before the split, c and bands from after it; made once a session and folder."""
    return once(s, f"bands-{kind}", d, lambda: C.one_shot(panel(s, d), C.tau_table(s), SPLIT, kind))


def r(c: str, n: int = 6):  # noqa: ANN201
    return F.round(F.col(c), n).alias(c)


def r_signed(c: str, n: int = 6):  # noqa: ANN201
    """Rounded in binary, so that a small negative value keeps its sign as -0.0, like SQL's round of a double."""
    return (F.rint(F.col(c) * 10.0**n) / 10.0**n).alias(c)


def q_daily_bars(s, d):  # noqa: ANN001, ANN201
    return M.daily_bars(s, d).select("symbol", "ts", r("open"), r("high"), r("low"), r("close"), F.round("volume", 2).alias("volume"))


def q_gap_panel(s, d):  # noqa: ANN001, ANN201
    return panel(s, d).select("symbol", "fri_ts", "mon_ts", "gap_days", r("fri_close", 8), r("mon_open", 8), r("fri_vol_20d"), r("factor_ret"), r("vix", 4), "regime_pub", r_signed("rel_resid"), r("sigma"), r("score", 4))


def q_overnight_pairs(s, d):  # noqa: ANN001, ANN201
    return P.gap_pairs(M.daily_bars(s, d), "overnight").groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg(F.col("mon_open") / F.col("fri_close") - 1), 6).alias("mean_gap"))


def q_scale_variants(s, d):  # noqa: ANN001, ANN201
    rows = P.window_scale(panel(s, d))
    blend = 0.5 * F.col("sigma") + 0.5 * F.col("sigma_k")
    return rows.where("sigma IS NOT NULL AND sigma_k IS NOT NULL").select("symbol", "fri_ts", r("sigma"), r("sigma_k"), F.round(blend, 6).alias("blend"), F.round(scalar.gap_scale(F.col("gap_days")), 6).alias("gap_scale"))


def q_residual_quantiles(s, d):  # noqa: ANN001, ANN201
    return P.residual_quantiles(panel(s, d), [0.68, 0.95]).select("symbol", "fri_ts", "tau_bps", r("lower", 3), r("upper", 3))


def q_har_features(s, d):  # noqa: ANN001, ANN201
    return P.har_features(panel(s, d)).where("rv_m IS NOT NULL").select("symbol", "fri_ts", r("rv_d"), r("rv_w"), r("rv_m"))


def q_expanding_quantile(s, d):  # noqa: ANN001, ANN201
    return P.expanding_quantile(panel(s, d), 0.95).select("fri_ts", "n", r("q"))


def q_leave_one_out(s, d):  # noqa: ANN001, ANN201
    return P.leave_one_out(panel(s, d), "rel_resid", ["fri_ts"]).where("loo_mean IS NOT NULL").select("symbol", "fri_ts", r("loo_mean"), r("loo_median"))


def q_partial_out(s, d):  # noqa: ANN001, ANN201
    rows = P.leave_one_out(panel(s, d), "rel_resid", ["fri_ts"]).where("loo_mean IS NOT NULL")
    x, y = F.col("loo_mean"), F.col("rel_resid")
    beta = F.sum(x * y) / F.sum(x * x)
    out = rows.groupBy("symbol").agg(F.count("*").alias("n"), beta.alias("beta"), (1 - (F.sum(y * y) - beta * F.sum(x * y)) / F.sum(y * y)).alias("r2"))
    return out.select("symbol", "n", F.when(F.col("n") >= 30, F.round("beta", 5)).alias("beta"), F.when(F.col("n") >= 30, F.round("r2", 5)).alias("r2"))


def q_regime_counts(s, d):  # noqa: ANN001, ANN201
    rows = panel(s, d)
    z = F.abs("rel_resid")
    cut = percentiles(rows, [], z, {"a": 0.33, "b": 0.67})
    bucket = F.when(z <= F.col("a"), "calm").when(z <= F.col("b"), "normal").otherwise("shock")
    return rows.crossJoin(F.broadcast(cut)).groupBy("regime_pub", bucket.alias("realized_bucket")).agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("fri_ts").alias("n_dates"))


def q_quantile_table(s, d):  # noqa: ANN001, ANN201
    rows, taus = panel(s, d).where(F.col("fri_ts") < SPLIT), C.tau_table(s)
    a = C.quantile_table(rows, taus, ["regime_pub"], "score").withColumn("kind", F.lit("scaled"))
    b = C.quantile_table(rows, taus, ["regime_pub"], "score_raw").withColumn("kind", F.lit("raw"))
    e = C.quantile_table(rows, taus, ["regime_pub"], "downside").withColumn("kind", F.lit("downside"))
    return a.unionByName(b).unionByName(e).select("kind", "regime_pub", "tau_bps", "n", r("q", 5))


def q_symbol_quantiles(s, d):  # noqa: ANN001, ANN201
    return C.quantile_table(panel(s, d).where(F.col("fri_ts") < SPLIT), C.tau_table(s), ["symbol"], "score").select("symbol", "tau_bps", "n", r("q", 5))


def q_tail_quantiles(s, d):  # noqa: ANN001, ANN201
    return C.tail_quantiles(panel(s, d), C.tau_table(s), ["regime_pub"], "rel_resid").select("regime_pub", "tau_bps", "n", "kind", r("q"))


def q_shrinkage(s, d):  # noqa: ANN001, ANN201
    rows, taus = panel(s, d).where(F.col("fri_ts") < SPLIT), C.tau_table(s)
    own = C.quantile_table(rows, taus, ["symbol"], "score")
    pool = C.quantile_table(rows.withColumn("symbol", F.lit(None).cast("string")).withColumn("_all", F.lit(1)), taus, ["_all"], "score").select(F.lit(None).cast("string").alias("symbol"), "tau_bps", "tau", "n", "q")
    return C.shrunk_table(own.unionByName(pool), ["symbol"]).select("symbol", "tau_bps", "n", r("q_shrunk", 5))


def q_bump(s, d):  # noqa: ANN001, ANN201
    rows, taus = panel(s, d), C.tau_table(s)
    table = C.quantile_table(rows.where(F.col("fri_ts") < SPLIT), taus, ["regime_pub"], "score")
    return C.fit_bump(rows.where(F.col("fri_ts") >= SPLIT), table, ["regime_pub"], "score").select("tau_bps", F.round("c", 4).alias("c"))


def q_serve_scaled(s, d):  # noqa: ANN001, ANN201
    return bands(s, d).select("symbol", "fri_ts", "regime_pub", "tau_bps", r("lower", 3), r("upper", 3))


def q_coverage(s, d):  # noqa: ANN001, ANN201
    return C.coverage_by(bands(s, d), "regime_pub", "tau_bps").select("regime_pub", "tau_bps", "n", r("realised", 5), r("mean_hw_bps", 3))


def q_coverage_wide(s, d):  # noqa: ANN001, ANN201
    wide = C.with_hits(bands(s, d)).groupBy("symbol").pivot("tau_bps", [6800, 9500]).agg(F.round(F.avg(F.col("inside").cast("double")), 5).alias("cov"), F.round(F.avg("hw_bps"), 3).alias("hw"))
    return wide.select("symbol", F.col("6800_cov").alias("cov68"), F.col("6800_hw").alias("hw68"), F.col("9500_cov").alias("cov95"), F.col("9500_hw").alias("hw95"))


def q_point_accuracy(s, d):  # noqa: ANN001, ANN201
    e = (F.col("mon_open") - F.col("point")) / F.col("point") * 10_000
    g = panel(s, d).groupBy("regime_pub").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae_bps"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse_bps"))
    return g.join(percentiles(panel(s, d), ["regime_pub"], e, {"m": 0.5}), "regime_pub").withColumn("median_bias_bps", F.round("m", 4)).drop("m")


def q_exceedance(s, d):  # noqa: ANN001, ANN201
    over = F.greatest(F.col("lower") - F.col("mon_open"), F.col("mon_open") - F.col("upper")) / F.col("fri_close") * 10_000
    out = bands(s, d).withColumn("over", over).where("over > 0")
    told = out.groupBy("tau_bps").agg(F.count("*").alias("n"), F.round(F.avg("over"), 3).alias("mean_bps"), F.round(F.max("over"), 3).alias("max_bps"))
    at = percentiles(out, ["tau_bps"], F.col("over"), {"median_bps": 0.5, "p95_bps": 0.95})
    return told.join(at, "tau_bps").select("tau_bps", "n", "mean_bps", r("median_bps", 3), r("p95_bps", 3), "max_bps")


def q_winkler(s, d):  # noqa: ANN001, ANN201
    score = scalar.winkler(F.col("lower"), F.col("upper"), F.col("mon_open"), F.col("tau")) / F.col("fri_close")
    return bands(s, d).groupBy("symbol", "tau_bps").agg(F.count("*").alias("n"), F.round(F.avg(score), 5).alias("winkler"))


def q_leave_symbol_out(s, d):  # noqa: ANN001, ANN201
    """Each symbol served by quantiles of all the others: one plan for all held-out symbols."""
    rows = panel(s, d).where("score IS NOT NULL").select("symbol", "fri_ts", "score")
    train = running(rows.where(F.col("fri_ts") < SPLIT), ["score", "symbol", "fri_ts"], {"before": "1"})  # how many scores stand before each
    line = Window.partitionBy("symbol").orderBy("before")
    train = written(train.withColumn("own", F.row_number().over(line) - 1), "ranked-scores")
    n = train.groupBy("symbol").agg(F.count("*").alias("n_own")).withColumn("n", F.lit(train.count()) - F.col("n_own"))
    want = n.crossJoin(C.tau_table(s, (0.68, 0.95))).withColumn("k", F.least(F.greatest(F.ceil(F.col("tau") * (F.col("n") + 1)), F.lit(1)), F.col("n")))
    # the k-th of the others is the (k + j)-th of all, j own scores standing before it
    ahead = train.join(sized(want), "symbol").groupBy("symbol", "tau_bps", "k").agg(F.count_if(F.col("before") - F.col("own") < F.col("k")).alias("j"))
    ahead = ahead.select(F.col("symbol").alias("held"), "tau_bps", (F.col("k") + F.col("j") - 1).alias("before"))
    table = train.select("before", F.col("score").alias("q")).join(sized(ahead), "before").drop("before")
    test = rows.where(F.col("fri_ts") >= SPLIT).join(sized(table), F.col("symbol") == F.col("held"))
    return test.groupBy("held", "tau_bps").agg(F.count("*").alias("n"), F.round(F.avg((F.col("score") <= F.col("q")).cast("double")), 5).alias("realised"))


def q_delta_sweep(s, d):  # noqa: ANN001, ANN201
    """Six expanding splits by year and a grid of shifts of tau: coverage of q at the shifted tau, deficits, Kupiec's ratio."""
    rows = panel(s, d).where("score IS NOT NULL").select("regime_pub", "fri_ts", "score")
    splits = s.sql("SELECT * FROM VALUES (1996), (1997), (1998), (1999), (2000), (2001) AS t(split_year)")
    grid = s.sql("SELECT CAST(b AS INT) AS base_bps, CAST(least(b + d * 50, 9990) AS INT) AS tau_bps, least(b + d * 50, 9990) / 10000D AS tau, CAST(d * 50 AS INT) AS delta_bps FROM VALUES (6800), (8500), (9500), (9900) AS t(b) CROSS JOIN VALUES (0), (1), (2), (3), (4), (6), (8) AS g(d)")
    train = rows.crossJoin(F.broadcast(splits)).where(F.year("fri_ts") < F.col("split_year"))
    table = C.quantile_table(train, grid.select("tau_bps", "tau").distinct(), ["split_year", "regime_pub"], "score").drop("tau", "n").join(F.broadcast(grid.select("base_bps", "tau_bps", "delta_bps")), "tau_bps")
    test = rows.crossJoin(F.broadcast(splits)).where(F.year("fri_ts") == F.col("split_year")).join(sized(table), ["split_year", "regime_pub"])
    out = test.groupBy("split_year", "base_bps", "delta_bps").agg(F.count("*").alias("n"), F.count_if(F.col("score") > F.col("q")).alias("x"))
    realised, tau = 1 - F.col("x") / F.col("n"), F.col("base_bps") / 10_000
    return out.select("split_year", "base_bps", "delta_bps", "n", F.round(realised, 5).alias("realised"), F.round(F.greatest(tau - realised, F.lit(0.0)), 5).alias("deficit"), F.round(kupiec_lr(F.col("x"), F.col("n"), 1 - tau), 4).alias("lr_uc"))


def q_ablation(s, d):  # noqa: ANN001, ANN201
    """Partition (all or regime) by scale (raw or by sigma), out of sample: shares, Kupiec's ratio, the symbols' ratios of
    independence together, and how many symbols, and regimes, alone would pass Kupiec's at 5%."""
    rows, taus = panel(s, d).where("score IS NOT NULL").withColumn("everything", F.lit("_all")), C.tau_table(s)
    out = None
    for cell in ("everything", "regime_pub"):
        for score in ("score_raw", "score"):
            table = C.quantile_table(rows.where(F.col("fri_ts") < SPLIT), taus, [cell], score)
            test = rows.where(F.col("fri_ts") >= SPLIT).join(sized(table), cell).withColumn("miss", (F.col(score) > F.col("q")).cast("int"))
            own = test.groupBy("symbol", "tau_bps", "tau").agg(F.count("*").alias("m"), F.sum("miss").alias("y"))
            passed = kupiec_lr(F.col("y"), F.col("m"), 1 - F.col("tau")) < 3.841458820694124
            g = own.withColumn("pass", passed).groupBy("tau_bps", "tau").agg(F.sum("m").alias("n"), F.sum("y").alias("x"), F.count_if("pass").alias("symbols_pass"))
            regimes = test.groupBy("regime_pub", "tau_bps", "tau").agg(F.count("*").alias("m"), F.sum("miss").alias("y")).withColumn("pass", passed).groupBy("tau_bps").agg(F.count_if("pass").alias("regimes_pass"))
            out_of = conditional(g, transitions(test, ["symbol", "tau_bps"], ["fri_ts"], "miss"), ["tau_bps"]).join(regimes, "tau_bps")
            part = out_of.select(F.lit(cell).alias("cell"), F.lit(score).alias("scale"), "tau_bps", "n", F.round(1 - F.col("x") / F.col("n"), 5).alias("realised"), F.round("lr_uc", 4).alias("lr_uc"), F.round("lr_ind", 4).alias("lr_ind"), "k", "symbols_pass", "regimes_pass")
            out = part if out is None else out.unionByName(part)
    return out


def q_vol_split(s, d):  # noqa: ANN001, ANN201
    """Normal rows split in three by the index's train-side tertiles; other regimes as they are."""
    rows = panel(s, d)
    cut = rows.where((F.col("regime_pub") == "normal") & (F.col("fri_ts") < SPLIT))
    cut = percentiles(cut, [], F.col("vix"), {"a": 1 / 3, "b": 2 / 3})
    cell = F.when(F.col("regime_pub") != "normal", F.col("regime_pub")).when(F.col("vix") <= F.col("a"), "normal_calm").when(F.col("vix") < F.col("b"), "normal_mid").otherwise("normal_heavy")
    return rows.crossJoin(F.broadcast(cut)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean_score"))


def q_lag_correlation(s, d):  # noqa: ANN001, ANN201
    """Correlation of a scaled residual with the one before it: of each symbol's gaps, of all pairs inside symbols, and of all
    pairs of neighbouring symbols inside a gap's date; its error, and a two-sided tail. Thirty pairs at least."""
    z = panel(s, d).where("score IS NOT NULL").withColumn("z", F.col("rel_resid") / F.col("sigma"))
    inside = lambda by, order: z.withColumn("lz", F.lag("z").over(Window.partitionBy(by).orderBy(order))).where("lz IS NOT NULL")
    own, week = inside("symbol", "fri_ts"), inside("fri_ts", "symbol")
    pairs = own.select(F.explode(F.array("symbol", F.lit("within symbols"))).alias("scope"), "z", "lz").unionByName(week.select(F.lit("within dates").alias("scope"), "z", "lz"))
    g = pairs.groupBy("scope").agg(F.count("*").alias("n"), F.corr("z", "lz").alias("rho")).where("n >= 30")
    g = g.withColumn("se", (1 - F.col("rho") * F.col("rho")) / F.sqrt(F.col("n") - 2))
    return g.select("scope", "n", F.round("rho", 5).alias("rho"), F.round("se", 5).alias("se"), F.round(erfc_column(F.abs(F.col("rho") / F.col("se")) / 2**0.5), 5).alias("p"))


HAR = """h AS (SELECT symbol, fri_ts, abs(rel_resid) AS a FROM panel),
h2 AS (SELECT symbol, fri_ts, lag(a) OVER w AS rv_d, CASE WHEN count(a) OVER w5 = 5 THEN avg(a) OVER w5 END AS rv_w, CASE WHEN count(a) OVER w22 = 22 THEN avg(a) OVER w22 END AS rv_m FROM h
  WINDOW w AS (PARTITION BY symbol ORDER BY fri_ts), w5 AS (PARTITION BY symbol ORDER BY fri_ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w22 AS (PARTITION BY symbol ORDER BY fri_ts ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING))"""
LOO = """o AS (SELECT a.symbol, a.fri_ts, any_value(a.rel_resid) AS rel_resid, avg(b.rel_resid) AS loo_mean, median(b.rel_resid) AS loo_median FROM panel a JOIN panel b ON a.fri_ts = b.fri_ts AND a.symbol <> b.symbol GROUP BY 1, 2)"""

def _x(p: str, q: str) -> str:
    return f"CASE WHEN {p} > 0 THEN {p} * ln(greatest({q}, 1e-12)) ELSE 0 END"


_IND = f"""CASE WHEN n00 + n01 > 0 AND n10 + n11 > 0 THEN greatest(2 * ({_x('n00', '1 - n01 / (n00 + n01)')} + {_x('n01', 'n01 / (n00 + n01)')} + {_x('n10', '1 - n11 / nullif(n10 + n11, 0)')} + {_x('n11', 'n11 / nullif(n10 + n11, 0)')}
  - {_x('(n00 + n10)', '1 - (n01 + n11) / (n00 + n01 + n10 + n11)')} - {_x('(n01 + n11)', '(n01 + n11) / (n00 + n01 + n10 + n11)')}), 0) END"""


def erfc_sql(x: str) -> str:
    """The complementary error function of x >= 0 by its published fit."""
    t, inner = f"(1 / (1 + 0.5 * ({x})))", "0.17087277"
    for a in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):  # Fixed values: the fit's coefficients
        inner = f"({a} + {t} * {inner})"
    return f"{t} * exp(-({x}) * ({x}) + {inner})"


def _lr(x: str, n: str, p: str) -> str:
    own = f"CASE WHEN {n} - {x} > 0 THEN ({n} - {x}) * ln(greatest(1 - {x} / {n}, 1e-12)) ELSE 0 END + CASE WHEN {x} > 0 THEN {x} * ln(greatest({x} / {n}, 1e-12)) ELSE 0 END"
    return f"greatest(2 * ({own} - ({n} - {x}) * ln(1 - ({p})) - {x} * ln({p})), 0)"




def _ablation_sql(cell: str, score: str, ind: str) -> str:
    rows = f"SELECT symbol, regime_pub, fri_ts, tau_bps, tau, CASE WHEN {score} > q THEN 1.0::DOUBLE ELSE 0 END AS miss FROM (SELECT *, '_all' AS everything FROM panel WHERE score IS NOT NULL) JOIN t_{cell}_{score} USING ({cell}) WHERE fri_ts >= DATE '{SPLIT}'"
    by = lambda k: f"(SELECT tau_bps, count(*) FILTER ({_lr('y', 'm', '1 - tau')} < 3.841458820694124) AS pass FROM (SELECT {k}, tau_bps, tau, count(*)::DOUBLE AS m, sum(miss) AS y FROM x GROUP BY 1, 2, 3) GROUP BY 1)"
    t = "(SELECT symbol, tau_bps, count(*) FILTER (p = 0 AND m = 0)::DOUBLE AS n00, count(*) FILTER (p = 0 AND m = 1)::DOUBLE AS n01, count(*) FILTER (p = 1 AND m = 0)::DOUBLE AS n10, count(*) FILTER (p = 1 AND m = 1)::DOUBLE AS n11 FROM (SELECT symbol, tau_bps, miss AS m, lag(miss) OVER (PARTITION BY symbol, tau_bps ORDER BY fri_ts) AS p FROM x) WHERE p IS NOT NULL GROUP BY 1, 2)"
    return f"""(WITH x AS ({rows}) SELECT '{cell}' AS cell, '{score}' AS scale, g.tau_bps, n::BIGINT AS n, round(1 - y / n, 5) AS realised, round({_lr('y', 'n', '1 - tau')}, 4) AS lr_uc, round(lr_ind, 4) AS lr_ind, k, a.pass AS symbols_pass, b.pass AS regimes_pass
FROM (SELECT tau_bps, tau, count(*)::DOUBLE AS n, sum(miss) AS y FROM x GROUP BY 1, 2) g JOIN {by('symbol')} a USING (tau_bps) JOIN {by('regime_pub')} b USING (tau_bps) JOIN (SELECT tau_bps, sum({ind}) AS lr_ind, count({ind})::INT AS k FROM {t} GROUP BY 1) i USING (tau_bps))"""


_ABLATION_TABLES = ", ".join(
    f"""t_{cell}_{score}_r AS (SELECT {cell}, {score} AS s, row_number() OVER (PARTITION BY {cell} ORDER BY {score}) AS k, count(*) OVER (PARTITION BY {cell}) AS n FROM (SELECT *, '_all' AS everything FROM panel) WHERE score IS NOT NULL AND fri_ts < DATE '{SPLIT}'),
t_{cell}_{score} AS (SELECT {cell}, tau_bps, tau, s AS q FROM t_{cell}_{score}_r, taus WHERE k = least(greatest(ceil(tau * (n + 1)), 1), n))"""
    for cell in ("everything", "regime_pub") for score in ("score_raw", "score")
)

QUERIES = {
    "a6_daily_bars": (q_daily_bars, f"WITH {BARS} SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 2) AS volume FROM bars"),
    "e1_gap_panel": (q_gap_panel, f"WITH {PANEL} SELECT symbol, fri_ts, mon_ts, gap_days, round(fri_close, 8) AS fri_close, round(mon_open, 8) AS mon_open, round(fri_vol_20d, 6) AS fri_vol_20d, round(factor_ret, 6) AS factor_ret, round(vix, 4) AS vix, regime_pub, round(rel_resid, 6) AS rel_resid, round(sigma, 6) AS sigma, round(score, 4) AS score FROM panel"),
    "b1_overnight_pairs": (q_overnight_pairs, f"WITH {BARS}, {PAIRS.replace('>= 3)', '= 1)')} SELECT symbol, count(*) AS n, round(avg(mon_open / fri_close - 1), 6) AS mean_gap FROM pairs GROUP BY 1"),
    "e6_scale_variants": (q_scale_variants, f"WITH {PANEL}, v AS (SELECT *, count(rel_resid) OVER w AS c, stddev_samp(rel_resid) OVER w AS sk FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY fri_ts ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)) SELECT symbol, fri_ts, round(sigma, 6) AS sigma, round(sk, 6) AS sigma_k, round(0.5 * sigma + 0.5 * sk, 6) AS blend, round(sqrt(greatest(gap_days - 3, 0) + 1.0), 6) AS gap_scale FROM v WHERE sigma IS NOT NULL AND c >= 8"),
    "e10_residual_quantiles": (q_residual_quantiles, f"WITH {PANEL}, v AS (SELECT *, ln(mon_open / point) AS x FROM panel), u AS (SELECT symbol, fri_ts, t.bps AS tau_bps, point, count(x) OVER w AS c, quantile_cont(x, 0.16) OVER w AS l68, quantile_cont(x, 0.84) OVER w AS u68, quantile_cont(x, 0.025) OVER w AS l95, quantile_cont(x, 0.975) OVER w AS u95 FROM v, (VALUES (6800), (9500)) t(bps) WINDOW w AS (PARTITION BY symbol, t.bps ORDER BY fri_ts ROWS BETWEEN 105 PRECEDING AND 2 PRECEDING)) SELECT symbol, fri_ts, tau_bps, round(point * exp(CASE WHEN tau_bps = 6800 THEN l68 ELSE l95 END), 3) AS lower, round(point * exp(CASE WHEN tau_bps = 6800 THEN u68 ELSE u95 END), 3) AS upper FROM u WHERE c >= 26"),
    "e12_har_features": (q_har_features, f"WITH {PANEL}, {HAR} SELECT symbol, fri_ts, round(rv_d, 6) AS rv_d, round(rv_w, 6) AS rv_w, round(rv_m, 6) AS rv_m FROM h2 WHERE rv_m IS NOT NULL"),
    "e13_expanding_quantile": (q_expanding_quantile, f"WITH {PANEL}, v AS (SELECT fri_ts, count(*) OVER w AS n, quantile_cont(abs(rel_resid), 0.95) OVER w AS q FROM panel WINDOW w AS (ORDER BY fri_ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)) SELECT DISTINCT fri_ts, n, round(q, 6) AS q FROM v WHERE n >= 100"),
    "e14_leave_one_out": (q_leave_one_out, f"WITH {PANEL}, {LOO} SELECT symbol, fri_ts, round(loo_mean, 6) AS loo_mean, round(loo_median, 6) AS loo_median FROM o"),
    "i12_partial_out": (q_partial_out, f"WITH {PANEL}, {LOO}, z AS (SELECT symbol, count(*) AS n, sum(loo_mean * rel_resid) AS xy, sum(loo_mean * loo_mean) AS xx, sum(rel_resid * rel_resid) AS yy FROM o GROUP BY 1) SELECT symbol, n, CASE WHEN n >= 30 THEN round(xy / xx, 5) END AS beta, CASE WHEN n >= 30 THEN round(1 - (yy - xy / xx * xy) / yy, 5) END AS r2 FROM z"),
    "e5_regime_buckets": (q_regime_counts, f"WITH {PANEL}, c AS (SELECT quantile_cont(abs(rel_resid), 0.33) AS a, quantile_cont(abs(rel_resid), 0.67) AS b FROM panel) SELECT regime_pub, CASE WHEN abs(rel_resid) <= a THEN 'calm' WHEN abs(rel_resid) <= b THEN 'normal' ELSE 'shock' END AS realized_bucket, count(*) AS n, count(DISTINCT symbol) AS n_symbols, count(DISTINCT fri_ts) AS n_dates FROM panel, c GROUP BY 1, 2"),
    "i1_quantile_table": (q_quantile_table, f"WITH {PANEL}, {TAUS}, {_table_sql('a', 'score')}, {_table_sql('b', 'score_raw')}, {_table_sql('e', 'downside')} SELECT 'scaled' AS kind, regime_pub, tau_bps, n, round(q, 5) AS q FROM a UNION ALL SELECT 'raw', regime_pub, tau_bps, n, round(q, 5) FROM b UNION ALL SELECT 'downside', regime_pub, tau_bps, n, round(q, 5) FROM e"),
    "i7_symbol_quantiles": (q_symbol_quantiles, f"WITH {PANEL}, {TAUS}, {_table_sql('a', 'score', 'symbol')} SELECT symbol, tau_bps, n, round(q, 5) AS q FROM a"),
    "i9_tail_quantiles": (q_tail_quantiles, f"WITH {PANEL}, {TAUS}, x AS (SELECT regime_pub, rel_resid AS s, row_number() OVER (PARTITION BY regime_pub ORDER BY rel_resid) AS k, count(*) OVER (PARTITION BY regime_pub) AS n FROM panel), y AS (SELECT DISTINCT regime_pub, n, tau_bps, tau FROM x, taus), z AS (SELECT *, 'lower' AS kind, floor((1 - tau) / 2 * (n + 1)) AS r FROM y UNION ALL SELECT *, 'upper', ceil((1 - (1 - tau) / 2) * (n + 1)) FROM y UNION ALL SELECT *, 'one_lower', floor((1 - tau) * (n + 1)) FROM y UNION ALL SELECT *, 'one_upper', ceil(tau * (n + 1)) FROM y) SELECT z.regime_pub, tau_bps, z.n, kind, CASE WHEN z.n >= 5 THEN round(s, 6) END AS q FROM z JOIN x ON x.regime_pub = z.regime_pub AND x.k = least(greatest(r, 1), z.n)"),
    "i10_shrinkage": (q_shrinkage, f"WITH {PANEL}, {TAUS}, {_table_sql('a', 'score', 'symbol')}, pr AS (SELECT score AS s, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM panel WHERE score IS NOT NULL AND fri_ts < DATE '{SPLIT}'), p AS (SELECT tau_bps, s AS qp FROM pr, taus WHERE k = least(greatest(ceil(tau * (n + 1)), 1), n)), m AS (SELECT a.*, qp, median(q / qp) OVER (PARTITION BY symbol) AS m FROM a JOIN p USING (tau_bps)) SELECT symbol, tau_bps, n, round(n / (n + 30.0) * q + (1 - n / (n + 30.0)) * m * qp, 5) AS q_shrunk FROM m"),
    "i2_bump": (q_bump, f"WITH {PANEL}, {TAUS}, {_table_sql('qt', 'score')}, {_bump_sql('bump', 'qt', 'score')} SELECT tau_bps, round(c, 4) AS c FROM bump"),
    "j2_serve_scaled": (q_serve_scaled, f"WITH {SERVED} SELECT symbol, fri_ts, regime_pub, tau_bps, round(lower, 3) AS lower, round(upper, 3) AS upper FROM bands"),
    "d3_coverage": (q_coverage, f"WITH {SERVED} SELECT regime_pub, tau_bps, count(*) AS n, round(avg(inside), 5) AS realised, round(avg(hw_bps), 3) AS mean_hw_bps FROM hits GROUP BY 1, 2"),
    "d7_coverage_wide": (q_coverage_wide, f"WITH {SERVED} SELECT symbol, round(avg(CASE WHEN tau_bps = 6800 THEN inside END), 5) AS cov68, round(avg(CASE WHEN tau_bps = 6800 THEN hw_bps END), 3) AS hw68, round(avg(CASE WHEN tau_bps = 9500 THEN inside END), 5) AS cov95, round(avg(CASE WHEN tau_bps = 9500 THEN hw_bps END), 3) AS hw95 FROM hits GROUP BY 1"),
    "d6_point_accuracy": (q_point_accuracy, f"WITH {PANEL}, e AS (SELECT regime_pub, (mon_open - point) / point * 10000 AS e FROM panel) SELECT regime_pub, count(*) AS n, round(avg(abs(e)), 4) AS mae_bps, round(sqrt(avg(e * e)), 4) AS rmse_bps, round(median(e), 4) AS median_bias_bps FROM e GROUP BY 1"),
    "d18_exceedance": (q_exceedance, f"WITH {SERVED}, e AS (SELECT tau_bps, greatest(lower - mon_open, mon_open - upper) / fri_close * 10000 AS o FROM bands) SELECT tau_bps, count(*) AS n, round(avg(o), 3) AS mean_bps, round(median(o), 3) AS median_bps, round(quantile_cont(o, 0.95), 3) AS p95_bps, round(max(o), 3) AS max_bps FROM e WHERE o > 0 GROUP BY 1"),
    "b24_winkler": (q_winkler, f"WITH {SERVED} SELECT symbol, tau_bps, count(*) AS n, round(avg(((upper - lower) + CASE WHEN mon_open < lower THEN (lower - mon_open) * 2 / (1 - tau) WHEN mon_open > upper THEN (mon_open - upper) * 2 / (1 - tau) ELSE 0 END) / fri_close), 5) AS winkler FROM bands GROUP BY 1, 2"),
    "g8_leave_symbol_out": (q_leave_symbol_out, f"WITH {PANEL}, t AS (SELECT * FROM (VALUES (6800, 0.68::DOUBLE), (9500, 0.95::DOUBLE)) t(tau_bps, tau)), h AS (SELECT DISTINCT symbol AS held FROM panel WHERE score IS NOT NULL), x AS (SELECT held, score AS s, row_number() OVER (PARTITION BY held ORDER BY score) AS k, count(*) OVER (PARTITION BY held) AS n FROM panel, h WHERE symbol <> held AND score IS NOT NULL AND fri_ts < DATE '{SPLIT}'), q AS (SELECT held, tau_bps, s AS q FROM x, t WHERE k = least(greatest(ceil(tau * (n + 1)), 1), n)) SELECT held, tau_bps, count(*) AS n, round(avg(CASE WHEN score <= q THEN 1.0 ELSE 0.0 END), 5) AS realised FROM panel JOIN q ON symbol = held WHERE score IS NOT NULL AND fri_ts >= DATE '{SPLIT}' GROUP BY 1, 2"),
    "i6_delta_sweep": (q_delta_sweep, f"WITH {PANEL}, y AS (SELECT unnest(range(1996, 2002))::INT AS split_year), g AS (SELECT b AS base_bps, d * 50 AS delta_bps, least(b + d * 50, 9990) / 10000.0::DOUBLE AS tau FROM (VALUES (6800), (8500), (9500), (9900)) t(b), (VALUES (0), (1), (2), (3), (4), (6), (8)) u(d)), x AS (SELECT split_year, regime_pub, score AS s, row_number() OVER (PARTITION BY split_year, regime_pub ORDER BY score) AS k, count(*) OVER (PARTITION BY split_year, regime_pub) AS n FROM panel, y WHERE score IS NOT NULL AND year(fri_ts) < split_year), q AS (SELECT split_year, regime_pub, base_bps, delta_bps, s AS q FROM x, g WHERE k = least(greatest(ceil(tau * (n + 1)), 1), n)), a AS (SELECT split_year, base_bps, delta_bps, count(*) AS n, count(*) FILTER (score > q)::DOUBLE AS x FROM panel JOIN q ON year(fri_ts) = split_year AND panel.regime_pub = q.regime_pub WHERE score IS NOT NULL GROUP BY 1, 2, 3) SELECT split_year, base_bps, delta_bps, n, round(1 - x / n, 5) AS realised, round(greatest(base_bps / 10000.0 - (1 - x / n), 0), 5) AS deficit, round({_lr('x', 'n', '1 - base_bps / 10000.0::DOUBLE')}, 4) AS lr_uc FROM a"),
    "i11_ablation": (q_ablation, f"WITH {PANEL}, {TAUS}, {_ABLATION_TABLES} " + " UNION ALL ".join(_ablation_sql(c, x, _IND) for c in ("everything", "regime_pub") for x in ("score_raw", "score"))),
    "i27_vol_split": (q_vol_split, f"WITH {PANEL}, c AS (SELECT quantile_cont(vix, 1.0 / 3) AS a, quantile_cont(vix, 2.0 / 3) AS b FROM panel WHERE regime_pub = 'normal' AND fri_ts < DATE '{SPLIT}') SELECT CASE WHEN regime_pub <> 'normal' THEN regime_pub WHEN vix <= a THEN 'normal_calm' WHEN vix < b THEN 'normal_mid' ELSE 'normal_heavy' END AS cell, count(*) AS n, round(avg(score), 5) AS mean_score FROM panel, c GROUP BY 1"),
    "e17_lag_correlation": (q_lag_correlation, f"WITH {PANEL}, z AS (SELECT symbol, fri_ts, rel_resid / sigma AS z FROM panel WHERE score IS NOT NULL), o AS (SELECT symbol, z, lag(z) OVER (PARTITION BY symbol ORDER BY fri_ts) AS lz FROM z), p AS (SELECT unnest([symbol, 'within symbols']) AS scope, z, lz FROM o WHERE lz IS NOT NULL UNION ALL SELECT 'within dates', z, lz FROM (SELECT z, lag(z) OVER (PARTITION BY fri_ts ORDER BY symbol) AS lz FROM z) WHERE lz IS NOT NULL), g AS (SELECT scope, count(*) AS n, corr(z, lz) AS rho FROM p GROUP BY 1 HAVING count(*) >= 30), e AS (SELECT *, (1 - rho * rho) / sqrt(n - 2) AS se, abs(rho / ((1 - rho * rho) / sqrt(n - 2))) / sqrt(2) AS x FROM g) SELECT scope, n, round(rho, 5) AS rho, round(se, 5) AS se, round({erfc_sql('x')}, 5) AS p FROM e"),
}
