"""Queries of joins in time, policies, routing and online recursions, with the same rows in SQL where it can."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import calibrate as C
from ..operators import joins as J
from ..operators import online as O
from ..operators import panel as P
from ..operators import policy as L
from ..operators import route as R
from ..operators.shared import order_statistics, percentiles
from ..sources import market as M
from .panel_queries import BARS, PAIRS, PANEL, SERVED, TAUS, _table_sql, bands, panel, r

def asks(s, d):  # noqa: ANN001, ANN201
    """Points in time to ask at: purchases."""
    return M.table(s, d, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("user"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ask_id"))


def ticks(s, d):  # noqa: ANN001, ANN201
    return M.table(s, d, "events").where("event_type <> 'purchase'").select(F.col("user_id").cast("string").alias("user"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def q_as_of(s, d):  # noqa: ANN001, ANN201
    return J.as_of(asks(s, d), ticks(s, d), "user", "ts", ["event_id", "value"], "event_id").select("ask_id", F.col("event_id").alias("seen_id"), r("value"))


def q_as_of_lookback(s, d):  # noqa: ANN001, ANN201
    out = J.as_of(asks(s, d), ticks(s, d), "user", "ts", ["event_id"], "event_id", within_s=86_400)
    return out.select("ask_id", F.coalesce("event_id", F.lit(-1)).alias("seen_id"))


def q_next_bar(s, d):  # noqa: ANN001, ANN201
    """The next tick within seven days, by reversing time."""
    line = Window.partitionBy("user").orderBy(F.desc("ts"), "_side", F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    both = asks(s, d).select("user", "ts", "ask_id", F.lit(0).alias("_side"), F.lit(None).cast("long").alias("event_id")).unionByName(ticks(s, d).select("user", "ts", F.lit(None).cast("long").alias("ask_id"), F.lit(1).alias("_side"), "event_id"))
    ahead = both.withColumn("_n", F.last(F.when(F.col("_side") == 1, F.struct("ts", "event_id")), ignorenulls=True).over(line)).where("_side = 0")
    return ahead.select("ask_id", F.coalesce(F.when(F.unix_micros("_n.ts") - F.unix_micros("ts") <= 7 * 86_400_000_000, F.col("_n.event_id")), F.lit(-1)).alias("next_id"))


def q_nearest(s, d):  # noqa: ANN001, ANN201
    return J.nearest(asks(s, d), ticks(s, d), "user", "ts", "value", "event_id", within_s=43_200).select("ask_id", F.coalesce("off_us", F.lit(-1)).alias("off_us"))


def q_interval(s, d):  # noqa: ANN001, ANN201
    windows = asks(s, d).select("user", "ask_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("end"))
    return J.interval_extrema(windows, ticks(s, d), "user", "start", "end", "ts", "value").select("ask_id", "n", r("low"), r("high"))


def q_event_week(s, d):  # noqa: ANN001, ANN201
    return J.event_within(P.gap_pairs(M.daily_bars(s, d)), M.calendar_events(s, d)).select("symbol", "fri_ts", "mon_ts", "earnings_next_week")


def q_event_night(s, d):  # noqa: ANN001, ANN201
    return J.event_overnight(P.gap_pairs(M.daily_bars(s, d), "overnight"), M.calendar_events(s, d)).select("symbol", "fri_ts", "mon_ts", "earnings_night")


def q_confirmation_health(s, d):  # noqa: ANN001, ANN201
    e = M.calendar_events(s, d)
    return e.groupBy("session").agg(F.count("*").alias("n"), F.count_if(F.coalesce("confirmed", F.lit(False))).alias("confirmed"), F.max(F.when(F.col("confirmed"), F.col("event_date"))).alias("last_confirmed"))


def q_resample(s, d):  # noqa: ANN001, ANN201
    out = M.resampled(M.tape(s, d))
    return out.select("symbol", F.to_date("bar").alias("day"), r("open"), r("high"), r("low"), r("close"), "n")


def q_coverage_stats(s, d):  # noqa: ANN001, ANN201
    return M.coverage(M.tape(s, d), "ts", ["symbol"]).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


def q_blend(s, d):  # noqa: ANN001, ANN201
    """Closes by brand and day from returned lines, and from all lines on the days that had no return."""
    closes = lambda flag: M.daily_bars(s, d, flag).select("symbol", "ts", r("close"))
    return M.blended(closes("R").withColumn("source", F.lit("returned")), closes(None).withColumn("source", F.lit("all")), ["symbol", "ts"])


def q_append_dedup(s, d):  # noqa: ANN001, ANN201
    """A customer and day's first order, from an archive up to 1996 and then from all orders."""
    rows = M.table(s, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey")
    old = rows.where("day < '1997-01-01'").groupBy("o_custkey", "day").agg(F.min("o_orderkey").alias("o_orderkey"))
    return M.append_new(old, rows, ["o_custkey", "day"])


def q_sessions(s, d):  # noqa: ANN001, ANN201
    return M.tape(s, d).groupBy("symbol", scalar.session_of(F.col("ts")).alias("session")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"))


def q_tape_stats(s, d):  # noqa: ANN001, ANN201
    """Each symbol's ticks by month: number, different values, median seconds between, spread of log moves in bps and share of
    repeats; and over symbols, as "all": sums, medians and the mean."""
    key = ["window", "symbol"]
    line = Window.partitionBy(*key).orderBy("ts", "event_id")
    rows = M.tape(s, d).withColumn("window", F.date_trunc("month", "ts").cast("date"))
    rows = rows.withColumns({"dt": (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(line))) / 1e6, "before": F.lag("value").over(line)})
    rows = rows.withColumns({"same": (F.col("value") == F.col("before")).cast("double"), "move": F.when((F.col("value") > 0) & (F.col("before") > 0), F.log(F.col("value") / F.col("before")))})
    g = rows.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("value").cast("double").alias("n_values"), F.avg("same").alias("stale"), (F.stddev_pop("move") * 1e4).alias("move_bps"))
    own = g.join(percentiles(rows, key, F.col("dt"), {"median_dt": 0.5}), key, "left")
    mid = lambda c: F.percentile(c, F.lit(0.5)).alias(c)  # noqa: E731  of a row a symbol
    pooled = own.groupBy("window").agg(F.sum("n").alias("n"), mid("n_values"), F.avg("stale").alias("stale"), mid("move_bps"), mid("median_dt")).withColumn("symbol", F.lit("all"))
    return own.unionByName(pooled).select(*key, "n", "n_values", r("stale"), r("move_bps", 4), r("median_dt", 4))


def q_witching(s, d):  # noqa: ANN001, ANN201
    days = M.table(s, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return days.groupBy(scalar.triple_witching(F.col("day")).alias("witching")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_total"))


def q_reserve(s, d):  # noqa: ANN001, ANN201
    rows = bands(s, d).withColumn("state", L.reserve_state(F.col("lower"), F.col("mon_open"), F.col("fri_close")))
    return rows.groupBy("tau_bps", "state").agg(F.count("*").alias("n"))


def q_band_state(s, d):  # noqa: ANN001, ANN201
    price = F.col("fri_close") * F.lit(0.9)
    return bands(s, d).withColumn("state", L.band_state(price, F.col("lower"), F.col("upper"))).groupBy("tau_bps", "state").agg(F.count("*").alias("n"))


def reads(s, d):  # noqa: ANN001, ANN201
    """Quotes of a part by its suppliers, in cents, with a confidence that some lack."""
    l = M.table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"), "l_quantity", "l_linenumber")
    return l.select(F.col("l_partkey").alias("asset"), "l_suppkey", F.col("l_shipdate").cast("timestamp").alias("ts"), "price", F.when(F.col("l_linenumber") > 1, F.expr("CAST(price * l_linenumber DIV 200 AS BIGINT)")).alias("confidence"))


def q_quorum(s, d):  # noqa: ANN001, ANN201
    rows = R.filtered(reads(s, d), ["asset"], F.expr("TIMESTAMP '2000-06-01 00:00:00'"), 3 * 365 * 86_400, 250, 5_000)
    return R.aggregated(rows, ["asset"], 3)


def q_swaps(s, d):  # noqa: ANN001, ANN201
    l = M.table(s, d, "lineitem").select("l_partkey", "l_quantity", "l_discount", "l_extendedprice").join(M.table(s, d, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    l = l.select("p_brand", (F.col("p_size") * 1_000_000).cast("long").alias("rin"), (cents("p_retailprice") * 1000).alias("rout"), cents("l_extendedprice").alias("amount"), F.round(F.col("l_discount") * 1000).cast("long").alias("fee"))
    l = l.withColumn("extra", R.surcharge_bps(F.col("amount"), F.lit(500_000).cast("long"), F.lit(2_000_000).cast("long"), 100, 300))
    l = l.withColumn("out", R.swap_out(F.col("rin"), F.col("rout"), F.col("amount"), F.col("fee") + F.col("extra")))
    return l.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("out").alias("paid"), F.sum("extra").alias("extra_bps"))


def q_cusum(s, d):  # noqa: ANN001, ANN201
    rows = panel(s, d).where("score IS NOT NULL").withColumn("z", F.col("rel_resid") / F.col("sigma"))
    return O.cusum(rows, "symbol", "fri_ts", "z", 0.5, 4.0).select("symbol", "fri_ts", r("s_up", 5), r("s_down", 5), "alarm")


def q_monotone(s, d):  # noqa: ANN001, ANN201
    return O.monotone(M.table(s, d, "events").select("event_type", "event_id", "ts"), "event_type", ["event_id"], "ts").select("event_id", "accepted")


def q_buffer(s, d):  # noqa: ANN001, ANN201
    """The constant buffer, in a grid of 5 bps, that covers tau of the gaps' moves: an order statistic rounded up."""
    rows = panel(s, d).where("score_raw IS NOT NULL").select("regime_pub", (F.col("score_raw") * 10_000).alias("dev"))
    found = order_statistics(rows, ["regime_pub"], "dev", [(t, lambda n, t=t: F.ceil((n - 1) * F.lit(t)) + 1) for t in (0.68, 0.85, 0.95, 0.99)])
    tau = F.element_at(F.array(*[F.lit(t) for t in (6800, 8500, 9500, 9900)]), F.col("ask") + 1)
    return found.select("regime_pub", tau.alias("tau_bps"), "n", (F.ceil(F.col("q") / 5) * 5).cast("long").alias("buffer_bps"))


def q_recency(s, d):  # noqa: ANN001, ANN201
    """Coverage of one sigma weighted to the recent: weights fall by e in twelve months."""
    rows = panel(s, d).where("score IS NOT NULL")
    w = F.exp(-F.datediff(F.lit("2001-12-31").cast("date"), "fri_ts") / F.lit(12 * 30.5))
    return rows.groupBy("symbol", "regime_pub").agg(F.round(F.sum(w * (F.col("score") <= 1).cast("double")) / F.sum(w), 6).alias("weighted"), F.count("*").alias("n"))


def q_audit(s, d):  # noqa: ANN001, ANN201
    """Served bands as commitments against publications by quantiles of a longer history, all taus."""
    committed = bands(s, d).select("symbol", "fri_ts", "tau_bps", "half", "fri_close")
    table = C.quantile_table(panel(s, d).where("fri_ts < '2000-01-01'"), C.tau_table(s), ["regime_pub"], "score")
    made = C.serve(panel(s, d).where("fri_ts >= '2000-01-01' OR fri_ts < '1999-01-15'"), table, None, ["regime_pub"]).where("fri_ts >= '1998-12-01'")
    made = made.withColumn("upper", F.when(F.dayofmonth("fri_ts") == 7, F.col("upper") * 1.01).otherwise(F.col("upper")))  # some are skewed after
    out = J.commitment_audit(committed, made.select("symbol", "fri_ts", "tau_bps", "half", "lower", "upper", "point"), ["symbol", "fri_ts", "tau_bps"], "half")
    return out.select("symbol", "fri_ts", "tau_bps", "verdict", "asymmetric", F.round("implied_factor", 8).alias("implied_factor"))


EV = "a AS (SELECT user_id AS u, ts, event_id AS ask_id FROM events WHERE event_type = 'purchase'), k AS (SELECT user_id AS u, ts, event_id, value FROM events WHERE event_type <> 'purchase')"
EVENTS_Q = """ev AS (SELECT DISTINCT p_brand AS symbol, CAST(o_orderdate AS DATE) AS event_date, CASE left(o_orderpriority, 1) WHEN '1' THEN 'amc' WHEN '2' THEN 'bmo' WHEN '3' THEN 'dmh' ELSE 'unknown' END AS session,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS confirmed FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)"""


AUDIT = "fri_ts < DATE '2000-01-01'"

QUERIES = {
    "c7_as_of": (q_as_of, f"WITH {EV} SELECT ask_id, max_by(event_id, (k.ts, event_id)) AS seen_id, round(max_by(value, (k.ts, event_id)), 6) AS value FROM a LEFT JOIN k ON a.u = k.u AND k.ts <= a.ts GROUP BY 1"),
    "n1_as_of_lookback": (q_as_of_lookback, f"WITH {EV} SELECT ask_id, coalesce(max_by(event_id, (k.ts, event_id)), -1) AS seen_id FROM a LEFT JOIN k ON a.u = k.u AND k.ts <= a.ts AND k.ts >= a.ts - INTERVAL 1 DAY GROUP BY 1"),
    "c8_next_within": (q_next_bar, f"WITH {EV} SELECT ask_id, coalesce(min_by(event_id, (k.ts, event_id)), -1) AS next_id FROM a LEFT JOIN k ON a.u = k.u AND k.ts > a.ts AND k.ts <= a.ts + INTERVAL 7 DAY GROUP BY 1"),
    "c9_nearest": (q_nearest, f"WITH {EV} SELECT ask_id, coalesce(min(abs(epoch_us(k.ts) - epoch_us(a.ts))), -1)::BIGINT AS off_us FROM a LEFT JOIN k ON a.u = k.u AND abs(epoch_us(k.ts) - epoch_us(a.ts)) <= 43200000000 GROUP BY 1"),
    "c11_interval_extrema": (q_interval, f"WITH {EV} SELECT ask_id, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM a JOIN k ON a.u = k.u AND k.ts BETWEEN a.ts AND a.ts + INTERVAL 2 DAY GROUP BY 1"),
    "c4_event_week": (q_event_week, f"WITH {BARS}, {PAIRS}, {EVENTS_Q} SELECT symbol, fri_ts, mon_ts, EXISTS (SELECT 1 FROM ev WHERE ev.symbol = pairs.symbol AND event_date BETWEEN mon_ts AND mon_ts + 4) AS earnings_next_week FROM pairs"),
    "c5_event_night": (q_event_night, f"WITH {BARS}, {PAIRS.replace('>= 3)', '= 1)')}, {EVENTS_Q} SELECT symbol, fri_ts, mon_ts, EXISTS (SELECT 1 FROM ev WHERE ev.symbol = pairs.symbol AND coalesce(confirmed, true) AND ((session = 'amc' AND event_date = fri_ts) OR (session = 'bmo' AND event_date = mon_ts))) AS earnings_night FROM pairs"),
    "d20_confirmation_health": (q_confirmation_health, f"WITH {EVENTS_Q} SELECT session, count(*) AS n, count(*) FILTER (coalesce(confirmed, false)) AS confirmed, max(CASE WHEN confirmed THEN event_date END) AS last_confirmed FROM ev GROUP BY 1"),
    "a6_resample": (q_resample, "SELECT event_type AS symbol, CAST(ts AS DATE) AS day, round(min_by(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(max_by(value, (ts, event_id)), 6) AS close, count(*) AS n FROM events GROUP BY 1, 2"),
    "a17_coverage_stats": (q_coverage_stats, "SELECT event_type AS symbol, count(*) AS n_rows, count(DISTINCT CAST(ts AS DATE)) AS n_days, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1"),
    "a18_source_blend": (q_blend, f"WITH {BARS.replace('WHERE dayofweek', chr(87)+'HERE l_returnflag = ' + chr(39) + 'R' + chr(39) + ' AND dayofweek').replace('bars AS', 'rb AS')}, {BARS} SELECT symbol, ts, round(close, 6) AS close, 'returned' AS source FROM rb UNION ALL SELECT symbol, ts, round(close, 6), 'all' FROM bars WHERE NOT EXISTS (SELECT 1 FROM rb WHERE rb.symbol = bars.symbol AND rb.ts = bars.ts)"),
    "a22_append_dedup": (q_append_dedup, "SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2"),
    "b21_sessions": (q_sessions, "WITH x AS (SELECT event_type AS symbol, value, ts - INTERVAL 5 HOUR AS lt, hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts - INTERVAL 5 HOUR) AS m FROM events) SELECT symbol, CASE WHEN dayofweek(lt) IN (0, 6) THEN 'weekend' WHEN m >= 570 AND m < 960 THEN 'rth' WHEN m >= 240 AND m < 570 THEN 'premarket' WHEN m >= 960 AND m < 1200 THEN 'afterhours' ELSE 'overnight' END AS session, count(*) AS n, round(avg(value), 5) AS mean FROM x GROUP BY 1, 2"),
    "d22_tape_stats": (q_tape_stats, "WITH y AS (SELECT event_type AS symbol, date_trunc('month', ts)::DATE AS window, value, ts, event_id FROM events), x AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt, lag(value) OVER w AS before FROM y WINDOW w AS (PARTITION BY symbol, \"window\" ORDER BY ts, event_id)), g AS (SELECT \"window\", symbol, count(*) AS n, count(DISTINCT value)::DOUBLE AS n_values, avg(CASE WHEN before IS NOT NULL THEN CASE WHEN value = before THEN 1.0 ELSE 0.0 END END) AS stale, stddev_pop(CASE WHEN value > 0 AND before > 0 THEN ln(value / before) END) * 1e4 AS move_bps, median(dt) AS median_dt FROM x GROUP BY 1, 2), a AS (SELECT * FROM g UNION ALL SELECT \"window\", 'all', sum(n)::BIGINT, median(n_values), avg(stale), median(move_bps), median(median_dt) FROM g GROUP BY 1) SELECT \"window\", symbol, n, n_values, round(stale, 6) AS stale, round(move_bps, 4) AS move_bps, round(median_dt, 4) AS median_dt FROM a"),
    "b20_triple_witching": (q_witching, "SELECT month(o_orderdate) IN (3, 6, 9, 12) AND dayofweek(o_orderdate) = 5 AND day(o_orderdate) BETWEEN 15 AND 21 AS witching, count(*) AS n, round(avg(o_totalprice), 2) AS mean_total FROM orders GROUP BY 1"),
    "m9_reserve": (q_reserve, f"WITH {SERVED}, b AS (SELECT tau_bps, lower < fri_close * (0.75::DOUBLE / 0.85::DOUBLE) AS w, mon_open < fri_close * (0.75::DOUBLE / 0.85::DOUBLE) AS c FROM bands) SELECT tau_bps, CASE WHEN w AND c THEN 'matched' WHEN w THEN 'preemptive' WHEN c THEN 'missed' ELSE 'silent_safe' END AS state, count(*) AS n FROM b GROUP BY 1, 2"),
    "m15_band_state": (q_band_state, f"WITH {SERVED}, b AS (SELECT tau_bps, fri_close * 0.9::DOUBLE AS p, lower, upper FROM bands) SELECT tau_bps, CASE WHEN p < lower THEN 'exit_below' WHEN p > upper THEN 'exit_above' WHEN (p - lower) / lower * 10000 <= 100 THEN 'approaching_lower' WHEN (upper - p) / upper * 10000 <= 100 THEN 'approaching_upper' ELSE 'in_band' END AS state, count(*) AS n FROM b GROUP BY 1, 2"),
    "p4_quorum": (q_quorum, "WITH x AS (SELECT l_partkey AS asset, l_shipdate AS ts, round(l_extendedprice * 100)::BIGINT AS price, CASE WHEN l_linenumber > 1 THEN round(l_extendedprice * 100)::BIGINT * l_linenumber // 200 END AS confidence FROM lineitem), f AS (SELECT *, CASE WHEN epoch(TIMESTAMP '2000-06-01 00:00:00') - epoch(ts) > 94608000 THEN 'stale' WHEN confidence IS NOT NULL AND price > 0 AND confidence * 10000 // price > 250 THEN 'unsure' END AS r1 FROM x), m AS (SELECT asset, list_sort(list(price))[(count(*) + 1) // 2] AS m FROM f WHERE r1 IS NULL GROUP BY 1), g AS (SELECT f.*, coalesce(r1, CASE WHEN abs(trunc((price - m) * 10000 / m)) > 5000 THEN 'far' END) AS reason FROM f LEFT JOIN m USING (asset)) SELECT asset, count(*) FILTER (reason IS NULL) AS n, min(price) FILTER (reason IS NULL) AS low, max(price) FILTER (reason IS NULL) AS high, (list_sort(list(price) FILTER (reason IS NULL)))[(count(*) FILTER (reason IS NULL) + 1) // 2] AS median, CASE WHEN count(*) FILTER (reason IS NULL) = 0 THEN 'AllStale' WHEN count(*) FILTER (reason IS NULL) < 3 THEN 'LowQuorum' ELSE 'Ok' END AS state FROM g GROUP BY 1"),
    "p9_swaps": (q_swaps, "WITH l AS (SELECT p_brand, (p_size * 1000000)::HUGEINT AS rin, (round(p_retailprice * 100)::BIGINT * 1000)::HUGEINT AS rout, round(l_extendedprice * 100)::BIGINT AS amount, round(l_discount * 1000)::BIGINT AS fee FROM lineitem JOIN part ON l_partkey = p_partkey), e AS (SELECT *, least(greatest(500000 - amount, amount - 2000000, 0) * 100 // 1500000, 300) AS extra FROM l), n AS (SELECT *, (amount * (10000 - fee - extra) // 10000)::HUGEINT AS net FROM e) SELECT p_brand, count(*) AS n, sum(net * rout // (rin + net))::BIGINT AS paid, sum(extra)::BIGINT AS extra_bps FROM n GROUP BY 1"),
    "o7_cusum": (q_cusum, f"WITH {PANEL}, z AS (SELECT symbol, fri_ts, rel_resid / sigma AS z FROM panel WHERE score IS NOT NULL), u AS (SELECT symbol, fri_ts, sum(z - 0.5) OVER w AS u, sum(-z - 0.5) OVER w AS d FROM z WINDOW w AS (PARTITION BY symbol ORDER BY fri_ts)), c AS (SELECT symbol, fri_ts, u - least(0, min(u) OVER w) AS a, d - least(0, min(d) OVER w) AS b FROM u WINDOW w AS (PARTITION BY symbol ORDER BY fri_ts)) SELECT symbol, fri_ts, round(a, 5) AS s_up, round(b, 5) AS s_down, a >= 4 OR b >= 4 AS alarm FROM c"),
    "o13_monotone": (q_monotone, "WITH x AS (SELECT event_id, ts, max(ts) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) SELECT event_id, b IS NULL OR ts >= b AS accepted FROM x"),
    "n4_buffer": (q_buffer, f"WITH {PANEL}, {TAUS}, x AS (SELECT regime_pub, score_raw * 10000 AS dev, row_number() OVER (PARTITION BY regime_pub ORDER BY score_raw) AS k, count(*) OVER (PARTITION BY regime_pub) AS n FROM panel WHERE score_raw IS NOT NULL) SELECT regime_pub, tau_bps, n, (ceil(dev / 5) * 5)::BIGINT AS buffer_bps FROM x, taus WHERE k = ceil((n - 1) * tau) + 1"),
    "n5_recency": (q_recency, f"WITH {PANEL}, x AS (SELECT *, exp(-(DATE '2001-12-31' - fri_ts) / (12 * 30.5)) AS w FROM panel WHERE score IS NOT NULL) SELECT symbol, regime_pub, round(sum(w * CASE WHEN score <= 1 THEN 1.0 ELSE 0.0 END) / sum(w), 6) AS weighted, count(*) AS n FROM x GROUP BY 1, 2"),
    "q4_commitment_audit": (q_audit, f"WITH {SERVED}, {_table_sql('q2', 'score', where=AUDIT)}, a AS (SELECT symbol, fri_ts, tau_bps, (upper - lower) / 2 AS half, fri_close FROM bands), b AS (SELECT symbol, fri_ts, tau_bps, q * sigma * fri_close AS half, point, point + CASE WHEN day(fri_ts) = 7 THEN 0.01 * (point + q * sigma * fri_close) / 2 ELSE 0 END AS mid FROM panel JOIN q2 USING (regime_pub) WHERE sigma IS NOT NULL AND (fri_ts >= DATE '2000-01-01' OR (fri_ts >= DATE '1998-12-01' AND fri_ts < DATE '1999-01-15'))) SELECT symbol, fri_ts, tau_bps, CASE WHEN a.half IS NULL THEN 'unbacked' WHEN b.half IS NULL THEN 'lapsed' WHEN abs(a.half - b.half) > 1e-6 * greatest(abs(a.half), abs(b.half)) THEN 'width_mismatch' ELSE 'matched' END AS verdict, CASE WHEN a.half IS NOT NULL AND b.half IS NOT NULL THEN abs(mid - point) > 1e-6 * greatest(abs(point), 1e-12) END AS asymmetric, CASE WHEN a.half IS NOT NULL AND b.half IS NOT NULL THEN round(point / fri_close - 1, 8) END AS implied_factor FROM a FULL JOIN b USING (symbol, fri_ts, tau_bps)"),
}
