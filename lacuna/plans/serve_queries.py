"""Queries of serving, adaptive state, path and refit studies, each with the same rows in SQL where it can."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import calibrate as C
from ..operators import joins as J
from ..operators import online as O
from ..operators import panel as P
from ..operators import stats as S
from ..operators.prefix import prefix_quantiles
from ..operators.shared import percentiles, sized, written
from ..sources import market as M
from .market_queries import EVENTS_Q
from .panel_queries import PANEL, SERVED, SPLIT, TAUS, _bump_sql, _table_sql, bands, panel
from .policy_queries import rounded
from .stat_queries import _IND

# The published schedules by coverage (shift of tau, bump of q).
SHIFT = {0.68: 0.05, 0.85: 0.02, 0.95: 0.0, 0.99: 0.0}
BUMP = {0.68: 1.498, 0.85: 1.455, 0.95: 1.3, 0.99: 1.076}


def early(s, d):  # noqa: ANN001, ANN201
    return panel(s, d).where(F.col("fri_ts") < SPLIT)


def late(s, d):  # noqa: ANN001, ANN201
    return panel(s, d).where(F.col("fri_ts") >= SPLIT)


def table(s, d, score: str = "score", rows=None):  # noqa: ANN001, ANN201
    return written(C.quantile_table(early(s, d) if rows is None else rows, C.tau_table(s), ["regime_pub"], score), "quantiles")


def q_raw_serve(s, d):  # noqa: ANN001, ANN201
    out = C.serve_shifted(late(s, d), table(s, d, "score_raw"), C.tau_table(s).select("tau_bps", "tau"), SHIFT, BUMP)
    return rounded(out.select("symbol", "fri_ts", "tau_bps", "served", "lower", "upper"), 3)


def q_downside_fit(s, d):  # noqa: ANN001, ANN201
    q = table(s, d, "downside")
    c = C.fit_bump(late(s, d), q, ["regime_pub"], "downside")
    return q.join(c.select("tau_bps", "c"), "tau_bps").select("regime_pub", "tau_bps", "n", F.round("q", 5).alias("q"), F.round("c", 4).alias("c"))


def q_downside_serve(s, d):  # noqa: ANN001, ANN201
    q = table(s, d, "downside")
    out = C.serve_downside(late(s, d), q, C.fit_bump(late(s, d), q, ["regime_pub"], "downside"), ["regime_pub"])
    return rounded(out.where("lower IS NOT NULL").select("symbol", "fri_ts", "tau_bps", "lower"), 3)


def requests(s, d):  # noqa: ANN001, ANN201
    """What clients ask: each late gap at one of seven coverages, and for every symbol a date that has no gap."""
    targets = F.array(*[F.lit(t) for t in (0.5, 0.68, 0.75, 0.85, 0.9, 0.97, 0.999)])
    rows = late(s, d).select("symbol", "fri_ts", F.element_at(targets, (F.datediff("fri_ts", F.lit("1970-01-01")) % 7 + 1).cast("int")).alias("target"))
    return rows.unionByName(panel(s, d).select("symbol").distinct().select("symbol", F.lit("1970-01-01").cast("date").alias("fri_ts"), F.lit(0.95).alias("target")))


def _lookup(kind: str, score: str):  # noqa: ANN202
    def run(s, d):  # noqa: ANN001, ANN202
        out = C.looked_up(requests(s, d), late(s, d).select("symbol", "fri_ts", "regime_pub", "fri_close", "point", "sigma"), table(s, d, score), SHIFT, BUMP, kind)
        return rounded(out.select("symbol", "fri_ts", "target", "error", "claimed", "served", "lower", "upper", "sharpness_bps", "half_width_bps"), 3)

    return run


def q_available(s, d):  # noqa: ANN001, ANN201
    return C.available(panel(s, d))


def replay_scores(s, d):  # noqa: ANN001, ANN201
    """Moves of the open from the point, over what the scale makes of the close; null without a scale."""
    unit, move = F.col("sigma") * F.col("fri_close"), F.abs(F.col("mon_open") - F.col("point"))
    score = F.when(unit > 0, move / unit).when((unit == 0) & (move > 0), F.lit(float("inf"))).when(unit == 0, F.lit(0.0))
    return late(s, d).withColumn("score", score)


def replayed(s, d):  # noqa: ANN001, ANN201
    return O.adaptive_replay(replay_scores(s, d), table(s, d).select("regime_pub", "tau_bps", "tau", "q"), "regime_pub", "fri_ts", "score")


def q_adaptive(s, d):  # noqa: ANN001, ANN201
    return rounded(replayed(s, d), 8)


def q_adaptive_serve(s, d):  # noqa: ANN001, ANN201
    """Overnight-style serving: the frozen quantile times the cell's multiplier before the gap, exact anchors only."""
    m = replayed(s, d).select(F.col("cell").alias("regime_pub"), "tau_bps", F.col("period").alias("fri_ts"), "m_served")
    rows = late(s, d).where("sigma > 0").join(sized(table(s, d)), "regime_pub").join(sized(m), ["regime_pub", "tau_bps", "fri_ts"])
    half = F.col("m_served") * F.col("q") * F.col("sigma") * F.col("fri_close")
    return rounded(rows.select("symbol", "fri_ts", "tau_bps", (F.col("point") - half).alias("lower"), (F.col("point") + half).alias("upper")), 3)


def q_multipliers(s, d):  # noqa: ANN001, ANN201
    """Multipliers looked up in a sealed checkpoint, after it was read back from its text."""
    import json

    state = json.loads(O.canonical(O.sealed(replayed(s, d), "weekend", "none")))
    asked = panel(s, d).select(F.col("regime_pub").alias("cell")).distinct().unionByName(s.sql("SELECT 'unseen' AS cell")).crossJoin(C.tau_table(s).select("tau_bps"))
    return rounded(O.multipliers(asked, state), 8)


def q_online(s, d):  # noqa: ANN001, ANN201
    out = None
    for name, key in (("pooled", F.lit("all")), ("symbol", F.col("symbol"))):
        own = O.conformal_radii(panel(s, d).withColumn("_key", key), "_key", "fri_ts", "score").withColumn("scope", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return rounded(out, 6)


def paths(s, d):  # noqa: ANN001, ANN201
    """Late gaps with the lowest and highest price of the whole market's trades inside the gap, as moves of the close."""
    lines = M.table(s, d, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    part = M.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    day = lines.join(part, "l_partkey").groupBy("symbol", "ts").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    spread = panel(s, d).withColumn("ts", F.explode(F.sequence(F.date_add("fri_ts", 1), "mon_ts")))
    span = spread.join(day, ["symbol", "ts"]).groupBy("symbol", "fri_ts").agg(F.min("lo").alias("path_lo"), F.max("hi").alias("path_hi"))
    return P.with_path_score(panel(s, d).join(span, ["symbol", "fri_ts"], "left"))


def q_path_score(s, d):  # noqa: ANN001, ANN201
    return paths(s, d).where("score_path IS NOT NULL").select("symbol", "fri_ts", F.round("path_lo", 8).alias("path_lo"), F.round("path_hi", 8).alias("path_hi"), F.round("score_path", 4).alias("score_path"))


def path_bands(s, d):  # noqa: ANN001, ANN201
    rows = written(paths(s, d), "paths")
    return C.one_shot(rows.where("fri_ts < '1999-01-01' OR path_lo IS NOT NULL"), C.tau_table(s), SPLIT, "score_path")


def q_path_coverage(s, d):  # noqa: ANN001, ANN201
    return rounded(C.path_coverage(path_bands(s, d), "regime_pub", "tau_bps"), 4)


def q_path_wide(s, d):  # noqa: ANN001, ANN201
    wide = path_bands(s, d).groupBy("symbol", "fri_ts").pivot("tau_bps", [6800, 8500, 9500, 9900]).agg(F.first("lower").alias("lo"), F.first("upper").alias("hi"))
    return rounded(wide, 3)


def q_nested_holdout(s, d):  # noqa: ANN001, ANN201
    """Quantiles from before the split, c from the year after it, coverage on what no fit has seen."""
    q = table(s, d)
    tune = panel(s, d).where(f"fri_ts >= '{SPLIT}' AND fri_ts < '2000-01-01'")
    c = C.fit_bump(tune, q, ["regime_pub"], "score")
    test = panel(s, d).where("fri_ts >= '2000-01-01' AND score IS NOT NULL").join(sized(q.join(c.select("tau_bps", "c"), "tau_bps")), "regime_pub")
    rows = test.withColumns({"miss": (F.col("score") > F.col("q") * F.col("c")).cast("int"), "hw": F.col("q") * F.col("c") * F.col("sigma") * 10_000})
    g = rows.groupBy("tau_bps", "tau").agg(F.count("*").alias("n"), F.sum("miss").alias("x"), F.avg("hw").alias("mean_hw"))
    t = S.pooled_transitions(rows, ["tau_bps"], "fri_ts", "symbol", "miss")
    g = g.join(percentiles(rows, ["tau_bps"], F.col("hw"), {"median_hw": 0.5}), "tau_bps").join(t.select("tau_bps", S.independence_lr(t).alias("lr_ind")), "tau_bps")
    return rounded(g.withColumn("lr_uc", S.kupiec_lr(F.col("x"), F.col("n"), 1 - F.col("tau"))).drop("tau"), 4)


def q_matched_history(s, d):  # noqa: ANN001, ANN201
    """A refit for every late date with at least four earlier ones, on the scores strictly before it, by regime and pooled:
    the quantile, and whether its rank was saturated."""
    taus = (0.68, 0.85, 0.95, 0.99)
    rows = panel(s, d).where("score IS NOT NULL").withColumn("cell", F.explode(F.array(F.col("regime_pub"), F.lit("pooled"))))
    dates = panel(s, d).select("fri_ts").distinct().withColumn("past", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("fri_ts")) - 1)  # a row a date
    dates = dates.where((F.col("past") >= 4) & (F.col("fri_ts") >= SPLIT)).select(F.col("fri_ts").alias("as_of"))
    found = prefix_quantiles(rows, "cell", "fri_ts", "score", dates, [lambda n, t=t: F.least(F.greatest(F.ceil(F.lit(t) * (n + 1)), F.lit(1)), n) for t in taus])
    tau = F.element_at(F.array(*[F.lit(t) for t in taus]), F.col("ask") + 1)
    return found.select("as_of", F.col("cell").alias("scope"), F.round(tau * 10_000).cast("int").alias("tau_bps"), "n", F.round("q", 5).alias("q"), (F.ceil(tau * (F.col("n") + 1)) > F.col("n")).alias("saturated"))


def q_scale_sweep(s, d):  # noqa: ANN001, ANN201
    """Scores with the scale to a power between none and whole, and what that does to coverage and width."""
    rows = panel(s, d).where("sigma > 0").withColumn("rho", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0)])))
    rows = rows.withColumn("unit", F.pow("sigma", "rho")).withColumn("s", F.col("score_raw") / F.col("unit"))
    q = C.quantile_table(rows.where(F.col("fri_ts") < SPLIT), C.tau_table(s), ["rho", "regime_pub"], "s")
    test = rows.where(F.col("fri_ts") >= SPLIT).join(sized(q), ["rho", "regime_pub"])
    return rounded(test.groupBy("rho", "tau_bps").agg(F.count("*").alias("n"), F.avg((F.col("s") <= F.col("q")).cast("double")).alias("realised"), F.avg(F.col("q") * F.col("unit") * 10_000).alias("mean_hw_bps")), 4)


def q_scale_variants(s, d):  # noqa: ANN001, ANN201
    """Scales side by side on the rows that all of them have: coverage and width out of sample."""
    rows = P.window_scale(panel(s, d))
    for h in (6, 12):
        rows = P.ewma_scale(rows, float(h), name=f"sigma_{h}")
    rows = rows.withColumn("blend", 0.5 * F.col("sigma") + 0.5 * F.col("sigma_k")).where("sigma > 0 AND sigma_k > 0 AND sigma_6 > 0 AND sigma_12 > 0")
    kinds = {"k26": "sigma_k", "hl6": "sigma_6", "hl8": "sigma", "hl12": "sigma_12", "blend": "blend"}
    each = rows.withColumn("v", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.col(c).alias("scale")) for k, c in kinds.items()]))).select("fri_ts", "regime_pub", "score_raw", "v.*")
    each = each.withColumn("s", F.col("score_raw") / F.col("scale"))
    q = C.quantile_table(each.where(F.col("fri_ts") < SPLIT), C.tau_table(s), ["variant", "regime_pub"], "s")
    test = each.where(F.col("fri_ts") >= SPLIT).join(sized(q), ["variant", "regime_pub"])
    return rounded(test.groupBy("variant", "tau_bps").agg(F.count("*").alias("n"), F.avg((F.col("s") <= F.col("q")).cast("double")).alias("realised"), F.avg(F.col("q") * F.col("scale") * 10_000).alias("mean_hw_bps")), 4)


def q_regime_sensitivity(s, d):  # noqa: ANN001, ANN201
    """The regime flag at other quantiles of the index: how often each regime, and its score."""
    out = None
    for q in (0.6, 0.75, 0.9):
        own = P.with_regime(panel(s, d).drop("regime_pub"), quantile=q).groupBy("regime_pub").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean_score")).withColumn("quantile", F.lit(q))
        out = own if out is None else out.unionByName(own)
    return out


def q_overnight(s, d):  # noqa: ANN001, ANN201
    """Overnight gaps: an event at night goes before the index in the regime, and stays out of the scale."""
    rows = J.event_overnight(P.gap_pairs(M.daily_bars(s, d), "overnight"), M.calendar_events(s, d))
    rows = P.with_factor(rows, M.market_factor(s, d))
    rows = P.with_residual(P.with_regime(rows, night="earnings_night"))
    rows = P.with_scores(P.ewma_scale(rows, keep=~F.col("earnings_night")))
    return rounded(rows.where("score IS NOT NULL").select("symbol", "fri_ts", "regime_pub", "sigma", "score"), 4)


def q_paired_forecasters(s, d):  # noqa: ANN001, ANN201
    """Bands of unscaled and scaled scores over the same gaps: how their widths compare and how often just one holds."""
    a = C.with_hits(bands(s, d)).select("symbol", "fri_ts", "tau_bps", F.col("hw_bps").alias("hw_a"), F.col("inside").alias("in_a"))
    b = C.with_hits(bands(s, d, "score_raw")).select("symbol", "fri_ts", "tau_bps", F.col("hw_bps").alias("hw_b"), F.col("inside").alias("in_b"))
    both = a.join(b, ["symbol", "fri_ts", "tau_bps"])
    return rounded(both.groupBy("tau_bps").agg(F.count("*").alias("n"), F.avg(F.col("hw_a") / F.col("hw_b")).alias("width_ratio"), F.count_if(F.col("in_a") > F.col("in_b")).alias("only_a"), F.count_if(F.col("in_b") > F.col("in_a")).alias("only_b")), 4)


def q_melted(s, d):  # noqa: ANN001, ANN201
    """Served bands, a column a coverage, and back to rows."""
    wide = bands(s, d).groupBy("symbol", "fri_ts").pivot("tau_bps", [6800, 8500, 9500, 9900]).agg(F.first("lower").alias("lo"), F.first("upper").alias("hi"))
    return rounded(C.melted(wide, [6800, 8500, 9500, 9900]), 3)


def q_class_quantiles(s, d):  # noqa: ANN001, ANN201
    """Quantiles by class of symbol instead of regime: classes are the last word of a part's type."""
    word = F.element_at(F.split("p_type", " "), -1)
    classes = M.table(s, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.min(word).alias("class"))
    return C.quantile_table(early(s, d).join(sized(classes), "symbol"), C.tau_table(s), ["class"], "score").select("class", "tau_bps", "n", F.round("q", 5).alias("q"))


def q_parity(s, d):  # noqa: ANN001, ANN201
    """Served edges against the same edges looked up one by one: how many differ, and the most."""
    q = table(s, d)
    a = C.serve(late(s, d), q, None, ["regime_pub"]).select("symbol", "fri_ts", "tau_bps", "lower", "upper")
    asked = late(s, d).select("symbol", "fri_ts").crossJoin(sized(C.tau_table(s))).select("symbol", "fri_ts", F.col("tau").alias("target"), "tau_bps")
    b = C.looked_up(asked, late(s, d).select("symbol", "fri_ts", "regime_pub", "fri_close", "point", "sigma"), q, {0.68: 0.0}, {0.68: 1.0}).where("error IS NULL")
    return A.differing(a, b.select("symbol", "fri_ts", "tau_bps", "lower", "upper"), ["symbol", "fri_ts", "tau_bps"], ["lower", "upper"])


_SH = "CASE tau_bps WHEN 6800 THEN 0.05::DOUBLE WHEN 8500 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END"


def _interp(x: str, points: list[tuple[float, str]]) -> str:
    out = f"CASE WHEN {x} <= {points[0][0]}::DOUBLE THEN {points[0][1]}"
    for (a, u), (b, v) in zip(points[:-1], points[1:], strict=True):
        out += f" WHEN {x} <= {b}::DOUBLE THEN {u} + ({x} - {a}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE) * ({v} - {u})"
    return out + f" ELSE {points[-1][1]} END"


_C = _interp("served", [(t, f"{v}::DOUBLE") for t, v in BUMP.items()])
_Q = _interp("served", [(t, f"q{int(t * 10_000 + 0.5)}") for t in BUMP])
_WIDE = lambda name, src: f"{name} AS (SELECT regime_pub, " + ", ".join(f"max(q) FILTER (tau_bps = {b}) AS q{b}" for b in (6800, 8500, 9500, 9900)) + f" FROM {src} GROUP BY 1)"
_LATE = f"fri_ts >= DATE '{SPLIT}'"


def _lookup_sql(kind: str, score: str) -> str:
    unit = {"raw": "point", "lending": "fri_close"}.get(kind, "sigma * fri_close")
    bad = "WHEN coalesce(sigma, 0) <= 0 THEN 'no scale'" if kind in ("scaled", "downside") else ""
    served = "claimed" if kind == "downside" else f"least(claimed + {_interp('claimed', [(t, f'{v}::DOUBLE') for t, v in SHIFT.items()])}, 0.99::DOUBLE)"
    return f"""WITH {PANEL}, {TAUS}, {_table_sql('qt', score)}, {_WIDE('w', 'qt')}, fb AS (SELECT * FROM w WHERE regime_pub = 'high_vol'),
rq AS (SELECT symbol, fri_ts, [0.5, 0.68, 0.75, 0.85, 0.9, 0.97, 0.999][(fri_ts - DATE '1970-01-01') % 7 + 1]::DOUBLE AS target FROM panel WHERE {_LATE} UNION ALL SELECT DISTINCT symbol, DATE '1970-01-01', 0.95::DOUBLE FROM panel),
a AS (SELECT rq.*, p.regime_pub, fri_close, point, sigma, least(greatest(target, 0.68::DOUBLE), 0.99::DOUBLE) AS claimed FROM rq LEFT JOIN (SELECT * FROM panel WHERE {_LATE}) p ON rq.symbol = p.symbol AND rq.fri_ts = p.fri_ts),
b AS (SELECT a.*, {served} AS served, CASE WHEN fri_close IS NULL THEN 'absent' {bad} END AS error, {', '.join(f'coalesce(w.q{x}, fb.q{x}) AS q{x}' for x in (6800, 8500, 9500, 9900))} FROM a LEFT JOIN w USING (regime_pub), fb),
c AS (SELECT *, CASE WHEN error IS NULL THEN {_C} * {_Q} * {unit} END AS half FROM b)
SELECT symbol, fri_ts, round(target, 3) AS target, error, round(claimed, 3) AS claimed, round(served, 3) AS served, round(point - half, 3) AS lower, {'CAST(NULL AS DOUBLE)' if kind == 'downside' else 'round(point + half, 3)'} AS upper, round(half / fri_close * 10000, 3) AS sharpness_bps, round(half / point * 10000, 3) AS half_width_bps FROM c"""


_PATHS = """dl AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS ts, min(l_extendedprice / l_quantity) AS lo, max(l_extendedprice / l_quantity) AS hi FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
ph AS (SELECT p.symbol, p.fri_ts, min(lo) AS path_lo, max(hi) AS path_hi FROM panel p JOIN dl ON dl.symbol = p.symbol AND dl.ts > p.fri_ts AND dl.ts <= p.mon_ts GROUP BY 1, 2)"""
_PSCORE = "CASE WHEN sigma > 0 AND path_lo IS NOT NULL THEN greatest(point - path_lo, path_hi - point, abs(mon_open - point), 0) / (fri_close * sigma) END"
_PANEL_PATH = PANEL.replace("panel AS (SELECT", "panel0 AS (SELECT") + ", " + _PATHS.replace("FROM panel p", "FROM panel0 p") + f", panel AS (SELECT panel0.*, path_lo, path_hi, {_PSCORE} AS score_path FROM panel0 LEFT JOIN ph USING (symbol, fri_ts))"
_PATH_BANDS = f"""{_PANEL_PATH}, {TAUS}, {_table_sql('qt', 'score_path')}, {_bump_sql('bump', 'qt', 'score_path')},
bands AS (SELECT panel.*, tau_bps, tau, point - c * q * sigma * fri_close AS lower, point + c * q * sigma * fri_close AS upper FROM panel JOIN qt USING (regime_pub) JOIN bump USING (tau_bps, tau) WHERE sigma IS NOT NULL AND path_lo IS NOT NULL AND {_LATE})"""
_REGIME = lambda q: f"r{int(q * 100)} AS (SELECT fri_ts, count(vix) OVER w >= 20 AND vix > quantile_cont(vix, {q}) OVER w AS high FROM d1 WINDOW w AS (ORDER BY fri_ts ROWS 51 PRECEDING))"
_TUNE = _bump_sql("bump", "qt", "score").replace(f"fri_ts >= DATE '{SPLIT}'", f"fri_ts >= DATE '{SPLIT}' AND fri_ts < DATE '2000-01-01'")
_LRX = "CASE WHEN x > 0 THEN x * ln(greatest(x / n, 1e-12)) ELSE 0 END + CASE WHEN n - x > 0 THEN (n - x) * ln(greatest(1 - x / n, 1e-12)) ELSE 0 END"
_EW = lambda h: f"CASE WHEN count(*) OVER w >= 8 THEN sqrt(sum(rel_resid * rel_resid * pow(2.0, rn / {h}.0)) OVER w / sum(pow(2.0, rn / {h}.0)) OVER w) END"

_REPLAY = f"""{PANEL}, {TAUS}, {_table_sql('qt', 'score')},
sc AS (SELECT regime_pub AS cell, fri_ts AS period, CASE WHEN sigma * fri_close > 0 THEN abs(mon_open - point) / (sigma * fri_close) WHEN mon_open <> point THEN 'inf'::DOUBLE ELSE 0 END AS x FROM panel WHERE {_LATE} AND sigma IS NOT NULL),
pd AS (SELECT cell, period, list(x) AS xs, row_number() OVER (PARTITION BY cell ORDER BY period) AS i FROM sc GROUP BY 1, 2),
rp AS (SELECT cell, tau_bps, tau, q, 0::BIGINT AS i, CAST(NULL AS DATE) AS period, 0::BIGINT AS n, 1.0::DOUBLE AS m_served, 1.0::DOUBLE AS m_next FROM (SELECT DISTINCT cell FROM pd) JOIN qt ON cell = regime_pub
  UNION ALL SELECT r.cell, r.tau_bps, r.tau, r.q, pd.i, pd.period, len(xs), r.m_next, least(greatest(r.m_next * exp(0.05 * (len(list_filter(xs, lambda v: v > r.m_next * r.q)) / len(xs) - (1 - r.tau))), 0.25), 4.0) FROM rp r JOIN pd ON pd.cell = r.cell AND pd.i = r.i + 1)"""

QUERIES = {
    "j1_raw_serve": (q_raw_serve, f"WITH {PANEL}, {TAUS}, {_table_sql('qt', 'score_raw')}, {_WIDE('w', 'qt')}, a AS (SELECT symbol, fri_ts, tau_bps, point, least(tau + {_SH}, 0.99::DOUBLE) AS served, w.* FROM panel JOIN w USING (regime_pub), taus WHERE {_LATE}) SELECT symbol, fri_ts, tau_bps, round(served, 3) AS served, round(point * (1 - {_C} * {_Q}), 3) AS lower, round(point * (1 + {_C} * {_Q}), 3) AS upper FROM a"),
    "i8_downside_fit": (q_downside_fit, f"WITH {PANEL}, {TAUS}, {_table_sql('qt', 'downside')}, {_bump_sql('bump', 'qt', 'downside')} SELECT regime_pub, tau_bps, n, round(q, 5) AS q, round(c, 4) AS c FROM qt JOIN bump USING (tau_bps)"),
    "j4_downside_serve": (q_downside_serve, f"WITH {PANEL}, {TAUS}, {_table_sql('qt', 'downside')}, {_bump_sql('bump', 'qt', 'downside')} SELECT symbol, fri_ts, tau_bps, round(point - c * q * sigma * fri_close, 3) AS lower FROM panel JOIN qt USING (regime_pub) JOIN bump USING (tau_bps) WHERE {_LATE} AND sigma IS NOT NULL"),
    "j6_lookup_raw": (_lookup("raw", "score_raw"), _lookup_sql("raw", "score_raw")),
    "j6_lookup_lending": (_lookup("lending", "score_raw"), _lookup_sql("lending", "score_raw")),
    "j7_lookup_scaled": (_lookup("scaled", "score"), _lookup_sql("scaled", "score")),
    "j8_lookup_downside": (_lookup("downside", "downside"), _lookup_sql("downside", "downside")),
    "g5_melted": (q_melted, f"WITH {SERVED} SELECT symbol, fri_ts, tau_bps, round(lower, 3) AS lower, round(upper, 3) AS upper FROM bands"),
    "i7_class_quantiles": (q_class_quantiles, f"WITH {PANEL.replace('panel AS (SELECT', 'panel1 AS (SELECT')}, kl AS (SELECT p_brand AS symbol, min(list_last(string_split(p_type, ' '))) AS class FROM part GROUP BY 1), panel AS (SELECT * FROM panel1 JOIN kl USING (symbol)), {TAUS}, {_table_sql('a', 'score', 'class')} SELECT class, tau_bps, n, round(q, 5) AS q FROM a"),
    "k22_parity": (q_parity, f"WITH {PANEL}, {TAUS}, {_table_sql('qt', 'score')}, c AS (SELECT count(*) AS n FROM panel JOIN qt USING (regime_pub) WHERE sigma IS NOT NULL AND {_LATE}) SELECT unnest(['lower', 'upper']) AS field, n, 0::BIGINT AS one_side, 0::BIGINT AS differing FROM c"),
    "j10_available": (q_available, f"WITH {PANEL} SELECT DISTINCT symbol, fri_ts, regime_pub FROM panel"),
    "o1_adaptive_replay": (q_adaptive, f"WITH RECURSIVE {_REPLAY} SELECT cell, tau_bps, period, n, round(m_served, 8) AS m_served, round(m_next, 8) AS m_next FROM rp WHERE i > 0"),
    "j9_adaptive_serve": (q_adaptive_serve, f"WITH RECURSIVE {_REPLAY} SELECT symbol, fri_ts, rp.tau_bps, round(point - m_served * q * sigma * fri_close, 3) AS lower, round(point + m_served * q * sigma * fri_close, 3) AS upper FROM panel JOIN rp ON cell = regime_pub AND period = fri_ts WHERE sigma > 0"),
    "o3_multipliers": (q_multipliers, f"WITH RECURSIVE {_REPLAY}, last AS (SELECT cell, tau_bps, round(round(arg_max(m_next, i), 10), 8) AS m FROM rp GROUP BY 1, 2), c AS (SELECT DISTINCT regime_pub AS cell FROM panel UNION ALL SELECT 'unseen') SELECT c.cell, taus.tau_bps, coalesce(m, 1) AS m FROM c CROSS JOIN taus LEFT JOIN last ON last.cell = c.cell AND last.tau_bps = taus.tau_bps"),
    "o4_online_radii": (q_online, None),
    "b17_path_score": (q_path_score, f"WITH {_PANEL_PATH} SELECT symbol, fri_ts, round(path_lo, 8) AS path_lo, round(path_hi, 8) AS path_hi, round(score_path, 4) AS score_path FROM panel WHERE score_path IS NOT NULL"),
    "d13_path_coverage": (q_path_coverage, f"WITH {_PATH_BANDS} SELECT regime_pub, tau_bps, count(*) AS n, round(avg(CASE WHEN mon_open BETWEEN lower AND upper THEN 1.0 ELSE 0 END), 4) AS endpoint_cov, round(avg(CASE WHEN path_lo >= lower AND path_hi <= upper THEN 1.0 ELSE 0 END), 4) AS path_cov, round((avg(CASE WHEN mon_open BETWEEN lower AND upper THEN 1.0 ELSE 0 END) - avg(CASE WHEN path_lo >= lower AND path_hi <= upper THEN 1.0 ELSE 0 END)) * 100, 4) AS gap_pp FROM bands GROUP BY 1, 2"),
    "j11_path_wide": (q_path_wide, f"WITH {_PATH_BANDS} SELECT symbol, fri_ts, " + ", ".join(f'round(max(lower) FILTER (tau_bps = {b}), 3) AS "{b}_lo", round(max(upper) FILTER (tau_bps = {b}), 3) AS "{b}_hi"' for b in (6800, 8500, 9500, 9900)) + " FROM bands GROUP BY 1, 2"),
    "i25_nested_holdout": (q_nested_holdout, f"WITH {PANEL}, {TAUS}, {_table_sql('qt', 'score')}, {_TUNE}, t0 AS (SELECT symbol, fri_ts, tau_bps, tau, CASE WHEN score > q * c THEN 1 ELSE 0 END AS miss, q * c * sigma * 10000 AS hw FROM panel JOIN qt USING (regime_pub) JOIN bump USING (tau_bps, tau) WHERE fri_ts >= DATE '2000-01-01' AND score IS NOT NULL), l AS (SELECT tau_bps, miss AS m, lag(miss) OVER (PARTITION BY tau_bps ORDER BY fri_ts, symbol) AS p FROM t0), w AS (SELECT tau_bps, count(*) FILTER (p = 0 AND m = 0)::DOUBLE AS n00, count(*) FILTER (p = 0 AND m = 1)::DOUBLE AS n01, count(*) FILTER (p = 1 AND m = 0)::DOUBLE AS n10, count(*) FILTER (p = 1 AND m = 1)::DOUBLE AS n11 FROM l WHERE p IS NOT NULL GROUP BY 1), g AS (SELECT tau_bps, tau, count(*) AS n, sum(miss)::BIGINT AS x, avg(hw) AS mean_hw, median(hw) AS median_hw FROM t0 GROUP BY 1, 2) SELECT tau_bps, n, x, round(mean_hw, 4) AS mean_hw, round(median_hw, 4) AS median_hw, round(greatest(2 * ({_LRX} - (n - x) * ln(tau) - x * ln(1 - tau)), 0), 4) AS lr_uc, round({_IND}, 4) AS lr_ind FROM g JOIN w USING (tau_bps)"),
    "i22_matched_history": (q_matched_history, f"WITH {PANEL}, {TAUS}, m AS (SELECT fri_ts AS as_of FROM (SELECT fri_ts, row_number() OVER (ORDER BY fri_ts) - 1 AS past FROM (SELECT DISTINCT fri_ts FROM panel)) WHERE past >= 4 AND {_LATE}), c AS (SELECT fri_ts, score, unnest([regime_pub, 'pooled']) AS scope FROM panel WHERE score IS NOT NULL), x AS (SELECT as_of, scope, score AS q, row_number() OVER (PARTITION BY as_of, scope ORDER BY score) AS k, count(*) OVER (PARTITION BY as_of, scope) AS n FROM c JOIN m ON fri_ts < as_of) SELECT as_of, scope, tau_bps, n, round(q, 5) AS q, ceil(tau * (n + 1)) > n AS saturated FROM x, taus WHERE k = least(greatest(ceil(tau * (n + 1)), 1), n)"),
    "b18_scale_power": (q_scale_sweep, f"WITH {PANEL}, {TAUS}, e AS (SELECT *, pow(sigma, rho) AS unit, score_raw / pow(sigma, rho) AS s FROM panel, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) r(rho) WHERE sigma > 0), x AS (SELECT rho, regime_pub, s, row_number() OVER (PARTITION BY rho, regime_pub ORDER BY s) AS k, count(*) OVER (PARTITION BY rho, regime_pub) AS n FROM e WHERE NOT ({_LATE})), q AS (SELECT rho, regime_pub, tau_bps, s AS q FROM x, taus WHERE k = least(greatest(ceil(tau * (n + 1)), 1), n)) SELECT rho, tau_bps, count(*) AS n, round(avg(CASE WHEN s <= q THEN 1.0 ELSE 0 END), 4) AS realised, round(avg(q * unit * 10000), 4) AS mean_hw_bps FROM e JOIN q USING (rho, regime_pub) WHERE {_LATE} GROUP BY 1, 2"),
    "i28_scale_variants": (q_scale_variants, f"WITH {PANEL}, {TAUS}, n0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fri_ts) AS rn FROM panel), s0 AS (SELECT *, {_EW(6)} AS s6, {_EW(12)} AS s12, CASE WHEN count(*) OVER v >= 8 THEN stddev_samp(rel_resid) OVER v END AS sk FROM n0 WINDOW w AS (PARTITION BY symbol ORDER BY fri_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY symbol ORDER BY fri_ts ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)), f AS (SELECT * FROM s0 WHERE sigma > 0 AND sk > 0 AND s6 > 0 AND s12 > 0), e AS (SELECT 'k26' AS variant, fri_ts, regime_pub, score_raw, sk AS scale FROM f UNION ALL SELECT 'hl6', fri_ts, regime_pub, score_raw, s6 FROM f UNION ALL SELECT 'hl8', fri_ts, regime_pub, score_raw, sigma FROM f UNION ALL SELECT 'hl12', fri_ts, regime_pub, score_raw, s12 FROM f UNION ALL SELECT 'blend', fri_ts, regime_pub, score_raw, 0.5 * sigma + 0.5 * sk FROM f), x AS (SELECT variant, regime_pub, score_raw / scale AS s, row_number() OVER (PARTITION BY variant, regime_pub ORDER BY score_raw / scale) AS k, count(*) OVER (PARTITION BY variant, regime_pub) AS n FROM e WHERE NOT ({_LATE})), q AS (SELECT variant, regime_pub, tau_bps, s AS q FROM x, taus WHERE k = least(greatest(ceil(tau * (n + 1)), 1), n)) SELECT variant, tau_bps, count(*) AS n, round(avg(CASE WHEN score_raw / scale <= q THEN 1.0 ELSE 0 END), 4) AS realised, round(avg(q * scale * 10000), 4) AS mean_hw_bps FROM e JOIN q USING (variant, regime_pub) WHERE {_LATE} GROUP BY 1, 2"),
    "i26_regime_sensitivity": (q_regime_sensitivity, f"WITH {PANEL}, {', '.join(_REGIME(q) for q in (0.6, 0.75, 0.9))}, u AS (SELECT 0.6::DOUBLE AS quantile, * FROM r60 UNION ALL SELECT 0.75, * FROM r75 UNION ALL SELECT 0.9, * FROM r90) SELECT CASE WHEN high THEN 'high_vol' WHEN gap_days >= 4 THEN 'long_weekend' ELSE 'normal' END AS regime_pub, count(*) AS n, round(avg(score), 5) AS mean_score, quantile FROM panel JOIN u USING (fri_ts) GROUP BY 1, 4"),
    "i5_overnight_scores": (q_overnight, f"WITH {PANEL.replace('>= 3)', '= 1)')}, {EVENTS_Q}, f AS (SELECT *, EXISTS (SELECT 1 FROM ev WHERE ev.symbol = panel.symbol AND coalesce(confirmed, true) AND ((session = 'amc' AND event_date = fri_ts) OR (session = 'bmo' AND event_date = mon_ts))) AS night FROM panel), k AS (SELECT *, count(*) FILTER (NOT night) OVER (PARTITION BY symbol ORDER BY fri_ts) AS kn FROM f), e AS (SELECT symbol, fri_ts, CASE WHEN night THEN 'earnings_night' ELSE regime_pub END AS regime_pub, score_raw, CASE WHEN count(*) FILTER (NOT night) OVER w >= 8 THEN sqrt(sum(CASE WHEN NOT night THEN rel_resid * rel_resid * pow(2.0, kn / 8.0) END) OVER w / sum(CASE WHEN NOT night THEN pow(2.0, kn / 8.0) END) OVER w) END AS sg FROM k WINDOW w AS (PARTITION BY symbol ORDER BY fri_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT symbol, fri_ts, regime_pub, round(sg, 4) AS sigma, round(score_raw / sg, 4) AS score FROM e WHERE sg > 0"),
    "c13_paired_forecasters": (q_paired_forecasters, f"WITH {SERVED}, {_table_sql('qr', 'score_raw')}, {_bump_sql('br', 'qr', 'score_raw')}, rb AS (SELECT symbol, fri_ts, tau_bps, c * q * point / fri_close * 10000 AS hw, CASE WHEN mon_open BETWEEN point - c * q * point AND point + c * q * point THEN 1 ELSE 0 END AS inside FROM panel JOIN qr USING (regime_pub) JOIN br USING (tau_bps, tau) WHERE {_LATE}) SELECT tau_bps, count(*) AS n, round(avg(h.hw_bps / rb.hw), 4) AS width_ratio, count(*) FILTER (h.inside > rb.inside) AS only_a, count(*) FILTER (rb.inside > h.inside) AS only_b FROM hits h JOIN rb USING (symbol, fri_ts, tau_bps) GROUP BY 1"),
}
