"""Queries of tapes, factors, anchors, archives and audits, each with the same rows in SQL where it can."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import audit as A
from ..operators import calibrate as C
from ..operators import factors as X
from ..operators import joins as J
from ..operators import panel as P
from ..operators.shared import fresh_path, once, order_statistics, percentiles, sized
from ..sources import market as M
from ..sources import tapes as T
from .market_queries import EV, asks, ticks
from .panel_queries import BARS, FACTOR, PAIRS, PANEL, SERVED, SPLIT, TAUS, _table_sql, bands, panel
from .policy_queries import rounded
from .serve_queries import late, table
from .stat_queries import _IND, _LR, _T, chi2_sql

FROM, TO = dt.date(2024, 1, 5), dt.date(2024, 1, 20)


def meta(df, *key):  # noqa: ANN001, ANN201
    """The columns that every tape carries."""
    return df.withColumns({"_schema_version": F.lit("v1"), "_fetched_at": F.lit("2024-03-01").cast("timestamp"), "_source": F.lit("made"), "_dedup_key": F.concat_ws("|", *key)})


def typed(df, kind: str, *more):  # noqa: ANN001, ANN201
    """df in a tape's columns, those it lacks null, and more."""
    fields = df.sparkSession.createDataFrame([], T.TAPES[kind].schema).schema
    return df.select(*more, *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def stored_once(s, d, kind: str, make, key: str | None = None, by: str | None = None) -> str:  # noqa: ANN001
    """The root of a tape made of the driver's tables, written once a session, under a key, or all keys that a column has."""

    def write():  # noqa: ANN202
        root = fresh_path(s, f"tape-{kind}")
        rows = make()
        if by is None:
            T.stored(typed(rows, kind), kind, root, key)
        else:
            T.stored(typed(rows, kind, F.col(by).alias("_by")), kind, root, F.col("_by"))
        return s.createDataFrame([(root,)], "root string")

    return once(s, f"root-{kind}-{key}-{by}", d, write).first()["root"]


def _ticks(s, d):  # noqa: ANN001, ANN202
    e = M.tape(s, d)
    return meta(e.withColumn("unix", F.unix_seconds("ts")), "event_id")


def pyth(s, d):  # noqa: ANN001, ANN201
    rows = lambda: _ticks(s, d).select("symbol", F.col("ts").cast("string").alias("poll_ts"), F.col("unix").alias("poll_unix"), F.when(scalar.session_of(F.col("ts")) == "rth", "regular").otherwise("extended").alias("session"), F.col("value").alias("pyth_price"), (F.col("value") * 0.001 + 0.01).alias("pyth_conf"), F.col("event_id").alias("slot"), "_schema_version", "_fetched_at", "_source", "_dedup_key")
    return stored_once(s, d, "pyth", rows)


def q_pyth_scan(s, d):  # noqa: ANN001, ANN201
    return T.scanned(s, "pyth", pyth(s, d), FROM, TO).select("symbol", "poll_unix", F.round("pyth_price", 6).alias("pyth_price"), "slot")


def q_scope_scan(s, d):  # noqa: ANN001, ANN201
    root = stored_once(s, d, "scope", lambda: _ticks(s, d).select("symbol", F.col("unix").alias("scope_unix_ts"), F.col("value").alias("scope_price"), F.when(F.col("value") > 100, "stale").alias("scope_err"), F.col("event_id").alias("scope_slot")))
    return T.scanned(s, "scope", root, FROM, TO).select("symbol", "scope_unix_ts", "scope_slot", F.round("scope_price", 6).alias("price"))


def q_redstone_scan(s, d):  # noqa: ANN001, ANN201
    root = stored_once(s, d, "redstone", lambda: _ticks(s, d).select("symbol", F.col("ts").alias("redstone_ts"), "value", F.col("event_id").cast("double").alias("minutes_age")))
    return T.scanned(s, "redstone", root, FROM, TO).select("symbol", F.unix_seconds("redstone_ts").alias("unix"), F.round("value", 6).alias("value"), F.col("minutes_age").cast("long").alias("event_id"))


def q_joined_scan(s, d):  # noqa: ANN001, ANN201
    root = stored_once(s, d, "joined", lambda: _ticks(s, d).select("symbol", F.col("unix").alias("poll_ts"), F.col("event_id").alias("cl_obs_ts"), F.col("value").alias("jup_mid"), F.when(F.col("value") > 100, "timeout").otherwise("").alias("jup_err"), F.col("value").alias("cl_tokenized_px")))
    return T.scanned(s, "joined", root, FROM, TO).select("symbol", "poll_ts", F.col("cl_obs_ts").alias("event_id"), F.round("jup_mid", 6).alias("jup_mid"), F.round("cl_tokenized_px", 6).alias("px"))


def _keyed(kind: str, key: str, when: str, price: str):  # noqa: ANN202
    def run(s, d):  # noqa: ANN001, ANN202
        root = stored_once(s, d, kind, lambda: _ticks(s, d).select("symbol", F.col("unix").alias(when), F.col("value").alias(price), F.col("event_id").cast("string").alias("_dedup_key")), by="symbol")
        return T.scanned(s, kind, root, FROM, TO, key).select(F.col(when).alias("unix"), F.round(price, 6).alias("price"), F.col("_dedup_key").alias("event_id"))

    return run


def q_bars_scan(s, d):  # noqa: ANN001, ANN201
    """Daily bars of one symbol from yearly files of the older place, where all symbols lie, both ends in."""
    root = stored_once(s, d, "legacy_bars", lambda: M.daily_bars(s, d), by="symbol")
    return T.scanned(s, "bars", root, "1994-03-01", dt.date(1996, 6, 30), "Brand#12").select("symbol", "ts", F.round("close", 6).alias("close"), F.round("volume", 2).alias("volume"))


def q_index_scan(s, d):  # noqa: ANN001, ANN201
    root = stored_once(s, d, "indices", lambda: M.market_factor(s, d).select(F.lit("VIX").alias("index"), F.col("ts").alias("date"), F.col("vol").alias("close")), "VIX")
    return T.scanned(s, "indices", root, "1995-01-01", "1997-12-31", "VIX").select("symbol", "ts", F.round("close", 4).alias("close"))


def q_earnings_scan(s, d):  # noqa: ANN001, ANN201
    root = stored_once(s, d, "earnings", lambda: M.calendar_events(s, d).select("symbol", F.col("event_date").alias("earnings_date"), "session", F.col("confirmed").alias("session_confirmed")), by="symbol")
    return T.scanned(s, "earnings", root, "1994-03-01", "1996-06-30", "Brand#12").select("symbol", "earnings_date", "session", "session_confirmed")


def q_empty_scans(s, d):  # noqa: ANN001, ANN201
    """Windows without files: no rows, all columns, for every tape."""
    out = None
    for kind in sorted(T.TAPES):
        df = T.scanned(s, kind, fresh_path(s, "nothing"), "2001-01-01", "2001-02-01", "X")
        own = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("tape"), "n", F.lit(len(df.columns)).alias("n_columns"))
        out = own if out is None else out.unionByName(own)
    return out


def q_one_tape(s, d):  # noqa: ANN001, ANN201
    """Five sources as one tape, and what each holds."""
    e, l = M.tape(s, d), M.table(s, d, "lineitem")
    frames = {"ticks": (e, "symbol", F.col("ts"), F.col("value")), "marks": (e.where("value < 50"), "symbol", F.col("ts"), F.col("value") * 2)}
    frames |= {"lines": (l, "l_returnflag", F.col("l_shipdate").cast("timestamp"), F.col("l_extendedprice")), "orders": (M.table(s, d, "orders"), "o_orderstatus", F.col("o_orderdate").cast("timestamp"), F.col("o_totalprice")), "status": (l, "l_linestatus", F.col("l_shipdate").cast("timestamp"), F.col("l_quantity"))}
    g = T.one_tape(frames).groupBy("source", "symbol")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean"))


def q_path_summary(s, d):  # noqa: ANN001, ANN201
    """Each source's path: number, least, greatest, mean, first and last value and when the extremes came first."""
    rows = M.tape(s, d)
    at, first = F.struct("ts", "event_id", "value"), lambda v: F.min(F.struct(v, "ts"))["ts"].cast("timestamp_ntz")
    g = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.min(at)["value"].alias("first"), F.max(at)["value"].alias("last"), first(F.col("value")).alias("low_ts"), first(-F.col("value")).alias("high_ts"))
    return rounded(g, 5)


def q_minute_panel(s, d):  # noqa: ANN001, ANN201
    """A minute grid over windows of an hour after each purchase, with the user's last tick before each minute."""
    out = J.minutes_after(asks(s, d), ticks(s, d), "user", "ts", "event_id")
    return out.select("ask_id", F.col("ts").cast("timestamp_ntz").alias("minute"), "event_id")


def q_changes(s, d):  # noqa: ANN001, ANN201
    line = Window.partitionBy("symbol").orderBy("ts")
    rows = M.daily_bars(s, d).withColumn("change", F.try_divide(F.col("close"), F.lag("close").over(line)) - 1)
    return rows.where("change IS NOT NULL").select("symbol", "ts", F.round("change", 6).alias("change"))


def q_week_medians(s, d):  # noqa: ANN001, ANN201
    """Sizes of basis on weekends and weekdays: median and 90th."""
    basis = F.abs(F.col("value") - F.avg("value").over(Window.partitionBy("symbol", F.to_date("ts"))))
    rows = M.tape(s, d).withColumn("basis", basis).withColumn("weekend", F.dayofweek("ts").isin(1, 7))
    g = rows.groupBy("symbol", "weekend").agg(F.count("*").alias("n"))
    return rounded(g.join(percentiles(rows, ["symbol", "weekend"], F.col("basis"), {"median": 0.5, "p90": 0.9}), ["symbol", "weekend"]), 5)


def q_dispersion(s, d):  # noqa: ANN001, ANN201
    z = F.abs(F.col("rel_resid") / F.col("sigma"))
    rows = panel(s, d).where("sigma > 0")
    g = rows.groupBy("regime_pub").agg(F.count("*").alias("n"), F.avg(z).alias("mean"))
    return rounded(g.join(percentiles(rows, ["regime_pub"], z, {"p95": 0.95, "p99": 0.99}), "regime_pub"), 5)


def q_trading_days(s, d):  # noqa: ANN001, ANN201
    """For each order day the latest Friday that has bars, and the next day with bars after it."""
    days = M.table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return X.around(days, M.daily_bars(s, d).select("ts").distinct())


def q_factors(s, d):  # noqa: ANN001, ANN201
    """One factor a symbol and date, with a switch for one symbol, its move over the gap, and the symbol's own index or the
    common one."""
    rows = X.with_switchboard(P.gap_pairs(M.daily_bars(s, d)), M.daily_bars(s, d))
    return rounded(rows.select("symbol", "fri_ts", "factor", "factor_ret", "vol_idx", "vol_idx_close", "stale_point", "point"), 6)


def q_dividends(s, d):  # noqa: ANN001, ANN201
    """Opens with the dividends of their day put back: every Monday of a month's first week pays by symbol."""
    pairs = P.gap_pairs(M.daily_bars(s, d))
    paid = pairs.where("dayofmonth(mon_ts) <= 7").select("symbol", F.col("mon_ts").alias("event_date"), (F.col("fri_close") * 0.01).alias("dividend_amount"))
    return rounded(X.with_dividends(pairs, paid).select("symbol", "fri_ts", "dividend", "mon_open"), 6)


def truths(s, d):  # noqa: ANN001, ANN201
    """Bands against opens that are known for most of them: of the rest those of the last year are pending."""
    known = panel(s, d).where("dayofmonth(fri_ts) > 3").select("symbol", "fri_ts", F.col("mon_open").alias("truth"))
    return A.with_truth(bands(s, d).drop("mon_open"), known, "2001-01-01")


def q_truth_join(s, d):  # noqa: ANN001, ANN201
    return truths(s, d).select("symbol", "fri_ts", "tau_bps", "status", F.round("truth", 6).alias("truth"), F.round("lower", 3).alias("lower"))


def q_coverage_audit(s, d):  # noqa: ANN001, ANN201
    return rounded(A.coverage_audit(truths(s, d).where("status = 'known'")), 4)


def anchors(s, d):  # noqa: ANN001, ANN201
    """16:00 UTC of every tick day and symbol, as asked times."""
    return M.tape(s, d).select("symbol", F.to_date("ts").alias("day")).distinct().withColumn("ts", X.local_time(F.col("day"), 15, 55, "America/New_York"))


def q_anchor(s, d):  # noqa: ANN001, ANN201
    return anchors(s, d).select("symbol", "day", F.unix_seconds("ts").alias("unix"))


def q_oracle_bands(s, d):  # noqa: ANN001, ANN201
    """The last quote in eight hours before each day's anchor, of the regular session if there is one, and bands of k times
    its confidence about it: which k is the least that covers a share of the next day's first ticks."""
    quotes = T.scanned(s, "pyth", pyth(s, d), dt.date(2024, 1, 1), dt.date(2024, 3, 1))
    quotes = quotes.select("symbol", F.timestamp_seconds("poll_unix").alias("ts"), F.col("pyth_price").alias("price"), F.col("pyth_conf").alias("conf"), "session", "slot")
    seen = J.session_as_of(anchors(s, d), quotes, "symbol", "ts", ["price", "conf"], "slot", "session", "regular", 8 * 3600, by_day=True)
    truth = M.resampled(M.tape(s, d)).select("symbol", F.date_sub(F.to_date("bar"), 1).alias("day"), F.col("open").alias("truth"))
    rows = seen.where("price IS NOT NULL").join(truth, ["symbol", "day"])
    return rounded(X.swept(rows, F.abs(F.col("truth") - F.col("price")), F.col("conf"), [1, 2, 5, 10, 50, 100, 200, 500, 1000, 5000], [0.5, 0.68, 0.85]), 6)


def q_percent_bands(s, d):  # noqa: ANN001, ANN201
    """The same for a share of the last value within a day, as feeds without a confidence have it."""
    seen = J.as_of_by_day(anchors(s, d), M.tape(s, d).withColumnRenamed("value", "price"), "symbol", "ts", ["price"], "event_id", within_s=86_400)
    truth = M.resampled(M.tape(s, d)).select("symbol", F.date_sub(F.to_date("bar"), 1).alias("day"), F.col("open").alias("truth"))
    rows = seen.where("price IS NOT NULL").join(truth, ["symbol", "day"])
    return rounded(X.swept(rows, F.abs(F.col("truth") - F.col("price")), F.col("price") / 100, [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000], [0.5, 0.68, 0.85]), 6)


def q_session_nearest(s, d):  # noqa: ANN001, ANN201
    """The last regular-session tick within a day before each purchase, else the last of any."""
    t = ticks(s, d).withColumn("session", scalar.session_of(F.col("ts")))
    out = J.session_as_of(asks(s, d), t, "user", "ts", ["event_id"], "event_id", "session", "rth", 86_400)
    return out.select("ask_id", F.coalesce("event_id", F.lit(-1)).alias("event_id"))


def q_vix_buffer(s, d):  # noqa: ANN001, ANN201
    """Constant buffers that grow with the index: the order statistic of moves over index by its median, rounded up."""
    rows = panel(s, d).where("score_raw IS NOT NULL")
    mid = percentiles(rows, [], F.col("vix"), {"mid": 0.5})
    scaled = rows.crossJoin(sized(mid)).withColumn("x", F.col("score_raw") * 10_000 / (F.col("vix") / F.col("mid")))
    found = order_statistics(scaled, ["regime_pub"], "x", [(t, lambda n, t=t: F.ceil((n - 1) * F.lit(t)) + 1) for t in (0.68, 0.95)])
    return found.select("regime_pub", F.element_at(F.array(F.lit(6800), F.lit(9500)), F.col("ask") + 1).alias("tau_bps"), "n", (F.ceil(F.col("q") / 5) * 5).cast("long").alias("buffer_bps"))


def q_buffer_pick(s, d):  # noqa: ANN001, ANN201
    """Walk-forward by year: the smallest buffer of a grid that covers and passes its tests, with which criteria."""
    return A.buffer_pick(panel(s, d).where("score IS NOT NULL"), "score", [x / 4 for x in range(1, 41)], 0.85)


def q_walk_forward_buffers(s, d):  # noqa: ANN001, ANN201
    """A buffer of a symbol's scale chosen on a year before each quarter, and a year of it."""
    return rounded(A.walk_forward_buffers(panel(s, d), "score", [x / 4 for x in range(1, 41)], 0.85), 4)


def q_forward(s, d):  # noqa: ANN001, ANN201
    """The tape of gaps with what came after the freeze marked, and twenty gaps of context before it."""
    return A.forward_tape(panel(s, d), SPLIT, 20).select("symbol", "fri_ts", "is_forward")


def q_partitions(s, d):  # noqa: ANN001, ANN201
    """Which day partitions of a tape are missing next to what is expected: hard for some symbols, soft for others."""
    there = M.tape(s, d).select("symbol", F.to_date("ts").alias("day"))
    days = s.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-02-05')) AS day")
    symbols = there.select("symbol").distinct().withColumn("hard", F.col("symbol").isin("view", "click"))
    return A.missing_partitions(there, days, symbols).groupBy("symbol", "kind").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


def q_latest_pair(s, d):  # noqa: ANN001, ANN201
    """The gate before each month's run: the latest gap that the leading brand has closed, and which brands lack an edge."""
    bars = M.daily_bars(s, d).select("symbol", F.col("ts").alias("day"))
    asked = bars.select(F.trunc("day", "month").alias("today")).distinct()
    pairs = A.latest_pairs(bars.where("symbol = 'Brand#12'").select(F.col("day").alias("ts")), asked, "1996-06-30")
    symbols = bars.select("symbol").distinct().withColumn("hard", F.col("symbol") < "Brand#2")
    return A.missing_edges(pairs, bars, symbols)


def q_refusals(s, d):  # noqa: ANN001, ANN201
    """Publications tried at times around the open: those from 09:25 New York time on are refused."""
    committed = A.commitments(late(s, d), table(s, d), "America/New_York")
    tried = F.to_utc_timestamp(F.col("mon_ts").cast("timestamp") + F.make_dt_interval(mins=540 + F.dayofmonth("mon_ts") % 6 * 5), "America/New_York")
    out = A.publications(committed.where("accepted"), panel(s, d).select("symbol", "fri_ts", "factor_ret"), tried)
    return rounded(out.select("symbol", "fri_ts", "tau_bps", "refused", F.when(~F.col("refused"), F.col("lower")).alias("lower"), F.when(~F.col("refused"), F.col("upper")).alias("upper")), 3)


def q_freshness(s, d):  # noqa: ANN001, ANN201
    """Whether each source's last success is within its hours of the newest event: errors are no successes."""
    runs = M.table(s, d, "events").select(F.col("user_id").cast("string").alias("manifest"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"))
    now = runs.agg(F.max("ts").alias("now"))
    out = A.freshness(runs.crossJoin(sized(now)), "manifest", F.col("now"), 26.0)
    return out.select("manifest", F.col("last_success").cast("timestamp_ntz").alias("last_success"), "fresh")


def q_commitments(s, d):  # noqa: ANN001, ANN201
    """Friday's commitments (widths without an open), refused after Sunday 17:45 New York time, and Monday's publications:
    the committed width about a new centre."""
    committed = A.commitments(late(s, d), table(s, d), "America/New_York")
    return rounded(A.publications(committed.where("accepted"), panel(s, d).select("symbol", "fri_ts", "factor_ret")).select("symbol", "fri_ts", "tau_bps", "half", "lower", "upper"), 3)


def q_archive(s, d):  # noqa: ANN001, ANN201
    """Served bands archived twice in two overlapping halves: what the second adds, and what is there."""
    rows = bands(s, d).select(F.col("fri_ts").cast("string").alias("weekend_date"), "symbol", F.col("tau_bps").cast("string").alias("tau"), F.format_string("%.4f", "lower").alias("lower"))
    path = fresh_path(s, "archive")
    first = T.archived(s, rows.where("weekend_date < '2000-06-01'"), ["weekend_date", "symbol", "tau"], path)
    second = T.archived(s, rows.where("weekend_date >= '2000-01-01'"), ["weekend_date", "symbol", "tau"], path)
    return s.createDataFrame([(1, *first), (2, *second)], "run int, appended long, total long")


def q_artefact(s, d):  # noqa: ANN001, ANN201
    """An artefact frozen and read back: its tables, served from the sidecar, and whether its seal holds."""
    path = fresh_path(s, "artefact")
    text = T.artefact_written(panel(s, d).select("symbol", "fri_ts", "score").where("score IS NOT NULL"), table(s, d), path, c_bump_schedule={"0.68": 1.0, "0.95": 1.05})
    sealed = A.frozen(text, A.content_hash(s.read.parquet(f"{path}/rows"), ["symbol", "fri_ts", "score"]))
    tables = T.sidecar_tables(s, sealed)
    ok = A.artefact_intact(sealed, A.content_hash(s.read.parquet(f"{path}/rows"), ["symbol", "fri_ts", "score"]))
    bad = A.artefact_intact(sealed.replace('"0.95":1.05', '"0.95":1.06'), A.content_hash(s.read.parquet(f"{path}/rows"), ["symbol", "fri_ts", "score"]))
    return tables["quantile_table"].select(F.col("cell").alias("regime_pub"), "tau_bps", F.round("value", 5).alias("q"), F.lit(ok).alias("intact"), F.lit(bad).alias("changed_intact"))


def q_frozen_serve(s, d):  # noqa: ANN001, ANN201
    """Serving from a sidecar's tables: cells it lacks take high_vol's quantiles, taus without a c take one."""
    q = table(s, d).where("regime_pub <> 'long_weekend'")
    return rounded(A.frozen_serve(late(s, d), q, s.sql("SELECT 9500 AS tau_bps, 1.1D AS c")).select("symbol", "fri_ts", "tau_bps", "lower", "upper"), 3)


def q_tracking(s, d):  # noqa: ANN001, ANN201
    """Bands scored against a second price, the open with a drift: coverage, width, Winkler score and Kupiec's ratio."""
    rows = C.with_hits(bands(s, d).withColumn("mon_open", F.col("mon_open") * F.when(F.dayofmonth("fri_ts") > 15, 1.02).otherwise(0.98)))
    g = rows.withColumn("w", scalar.winkler(F.col("lower"), F.col("upper"), F.col("mon_open"), F.col("tau")) / F.col("fri_close"))
    return rounded(g.groupBy("regime_pub", "tau_bps").agg(F.count("*").alias("n"), F.avg(F.col("inside").cast("double")).alias("realised"), F.avg("hw_bps").alias("hw"), F.avg("w").alias("winkler")), 4)


def q_band_scores(s, d):  # noqa: ANN001, ANN201
    """Of each band: half-width and gap in bps of the close, coverage and what width is left over."""
    gap = (F.col("mon_open") - F.col("fri_close")) / F.col("fri_close") * 10_000
    rows = C.with_hits(bands(s, d)).withColumn("gap_bps", gap).withColumn("excess_bps", F.col("hw_bps") - F.abs("gap_bps"))
    return rounded(rows.select("symbol", "fri_ts", "tau_bps", "hw_bps", "gap_bps", "inside", "excess_bps"), 3)


def q_symbols(s, d):  # noqa: ANN001, ANN201
    """Symbols of a token tape as those of their underliers, with class; unknown ones have none."""
    tokens = panel(s, d).select(F.concat("symbol", F.lit("x")).alias("token")).distinct().unionByName(s.sql("SELECT 'otherx' AS token"))
    classes = M.table(s, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_type").alias("class"))
    return X.canonical(tokens, "token", classes)


def q_safe_median(s, d):  # noqa: ANN001, ANN201
    """The median of the others of a symbol's cluster on a date: those outside clusters have none."""
    cluster = F.when(F.substring("symbol", -1, 1).isin("1", "2", "3", "4", "5"), "low").when(F.substring("symbol", -1, 1).isin("6", "7", "8"), "high")
    rows = panel(s, d).withColumn("cluster", cluster)
    inside = P.leave_one_out(rows.where("cluster IS NOT NULL"), "rel_resid", ["fri_ts", "cluster"]).select("symbol", "fri_ts", "loo_median")
    return rows.join(inside, ["symbol", "fri_ts"], "left").select("symbol", "fri_ts", "cluster", F.round("loo_median", 6).alias("loo_median"))


_WIN = "CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"
_UNIX = "epoch_us(ts) // 1000000"
_ANCH = "an AS (SELECT DISTINCT event_type AS symbol, CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1255 MINUTE AS due FROM events)"
_OPEN = "tr AS (SELECT event_type AS symbol, CAST(ts AS DATE) - 1 AS day, min_by(value, (ts, event_id)) AS truth FROM events GROUP BY 1, 2)"


def _sweep_sql(src: str, unit: str, ks: list[int]) -> str:
    return f"kk AS (SELECT unnest({ks}) AS k), tt AS (SELECT unnest([0.5, 0.68, 0.85])::DOUBLE AS tau), cv AS (SELECT k, count(*) AS n, avg(CASE WHEN abs(truth - price) <= k * {unit} THEN 1.0::DOUBLE ELSE 0 END) AS c, avg(k * {unit}) AS w FROM {src}, kk GROUP BY 1) SELECT round(tau, 6) AS tau, min(k)::DOUBLE AS k, round(min_by(c, k), 6) AS realised, round(min_by(w, k), 6) AS mean_half FROM cv, tt WHERE c >= tau GROUP BY 1"


SERVED_KNOWN = SERVED.replace("AS hw_bps FROM bands)", "AS hw_bps FROM bands WHERE day(fri_ts) > 3)")
_DAYS = """ev AS (SELECT event_type AS symbol, event_id, ts, value, date_trunc('second', ts) AS at, dayofweek(ts - INTERVAL 5 HOUR) NOT IN (0, 6) AND hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts - INTERVAL 5 HOUR) BETWEEN 570 AND 959 AS regular FROM events),
an AS (SELECT DISTINCT symbol, CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1255 MINUTE AS at FROM ev),
tr AS (SELECT symbol, CAST(ts AS DATE) - 1 AS day, min_by(value, (ts, event_id)) AS truth FROM ev GROUP BY 1, 2)"""

_FORWARD = f"""WITH {PANEL}, r AS (SELECT symbol, fri_ts, score, year(fri_ts) * 4 + quarter(fri_ts) - 1 AS p FROM panel WHERE score IS NOT NULL),
cu AS (SELECT unnest(range(min(p) + 4, max(p) + 1)) AS cut FROM r),
w AS (SELECT cut, 'tune' AS kind, r.* FROM r JOIN cu ON p >= cut - 4 AND p < cut UNION ALL SELECT cut, 'test', r.* FROM r JOIN cu ON p >= cut AND p < cut + 4),
e AS (SELECT cut, kind, symbol, fri_ts, b / 4.0::DOUBLE AS buffer, 0.85::DOUBLE AS tau, CASE WHEN score > b / 4.0::DOUBLE THEN 1 ELSE 0 END AS m FROM w, range(1, 41) v(b)),
g AS (SELECT cut, kind, buffer, tau, count(*) AS n, sum(m)::BIGINT AS x FROM e GROUP BY 1, 2, 3, 4),
l AS (SELECT *, lag(m) OVER (PARTITION BY cut, kind, buffer, symbol ORDER BY fri_ts) AS p FROM e),
t AS (SELECT cut, kind, buffer, symbol, count(*) FILTER (p = 0 AND m = 0)::DOUBLE AS n00, count(*) FILTER (p = 0 AND m = 1)::DOUBLE AS n01, count(*) FILTER (p = 1 AND m = 0)::DOUBLE AS n10, count(*) FILTER (p = 1 AND m = 1)::DOUBLE AS n11 FROM l WHERE p IS NOT NULL GROUP BY ALL),
i AS (SELECT cut, kind, buffer, sum({_IND}) AS li, count({_IND})::INT AS k FROM t GROUP BY ALL),
h AS (SELECT g.*, {_LR} AS lu, li, coalesce(k, 0) AS k, 1 - x / n AS realised FROM g LEFT JOIN i USING (cut, kind, buffer)),
q AS (SELECT *, {chi2_sql('lu', '1')} AS p_uc, CASE WHEN k > 0 THEN {chi2_sql('li', 'k')} END AS p_ind FROM h),
z AS (SELECT *, CASE WHEN realised >= tau - 0.005 AND p_uc > 0.10 AND coalesce(p_ind > 0.05, false) THEN 0 WHEN realised >= tau - 0.005 AND p_uc > 0.05 THEN 1 WHEN realised >= tau THEN 2 ELSE 3 END AS rank FROM q WHERE kind = 'tune'),
b AS (SELECT *, row_number() OVER (PARTITION BY cut ORDER BY rank, CASE WHEN rank < 3 THEN buffer ELSE -buffer END) AS pos FROM z)
SELECT make_date((b.cut // 4)::INT, (b.cut % 4 * 3 + 1)::INT, 1) AS cutoff, b.buffer, ['PASS', 'MARGINAL', 'CEILING', 'CEILING'][b.rank + 1] AS status, b.n AS n_tune, round(b.realised, 4) AS realised_tune, q.n, round(q.realised, 4) AS realised, round(q.p_uc, 4) AS p_uc, round(q.p_ind, 4) AS p_ind FROM b JOIN q ON q.cut = b.cut AND q.buffer = b.buffer AND q.kind = 'test' WHERE pos = 1"""

QUERIES = {
    "a10_pyth_scan": (q_pyth_scan, f"SELECT event_type AS symbol, {_UNIX} AS poll_unix, round(value, 6) AS pyth_price, event_id AS slot FROM events WHERE {_WIN}"),
    "a9_scope_scan": (q_scope_scan, f"SELECT event_type AS symbol, {_UNIX} AS scope_unix_ts, event_id AS scope_slot, round(value, 6) AS price FROM events WHERE {_WIN} AND NOT value > 100"),
    "a11_redstone_scan": (q_redstone_scan, f"SELECT event_type AS symbol, {_UNIX} AS unix, round(value, 6) AS value, event_id FROM events WHERE {_WIN}"),
    "a12_joined_scan": (q_joined_scan, f"SELECT event_type AS symbol, {_UNIX} AS poll_ts, event_id, CASE WHEN NOT value > 100 THEN round(value, 6) END AS jup_mid, round(value, 6) AS px FROM events WHERE {_WIN}"),
    **{f"{n}_scan": (_keyed(kind, key, when, price), f"SELECT {_UNIX} AS unix, round(value, 6) AS price, event_id::VARCHAR AS event_id FROM events WHERE {_WIN} AND event_type = '{key}'") for n, kind, key, when, price in (("a13_trades", "trades", "view", "ts", "price_usd"), ("a14_minutes", "minutes", "click", "ts", "close"), ("a15_perps", "perps", "error", "bar_open_ts", "close"), ("a16_swaps", "swaps", "signup", "block_time", "price_per_xstock"))},
    "a4_bars_scan": (q_bars_scan, f"WITH {BARS} SELECT symbol, ts, round(close, 6) AS close, round(volume, 2) AS volume FROM bars WHERE symbol = 'Brand#12' AND ts BETWEEN DATE '1994-03-01' AND DATE '1996-06-30'"),
    "a5_index_scan": (q_index_scan, f"WITH {FACTOR} SELECT 'VIX' AS symbol, ts, round(vol, 4) AS close FROM factor WHERE ts BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'"),
    "a7_earnings_scan": (q_earnings_scan, "SELECT DISTINCT p_brand AS symbol, CAST(o_orderdate AS DATE) AS earnings_date, CASE left(o_orderpriority, 1) WHEN '1' THEN 'amc' WHEN '2' THEN 'bmo' WHEN '3' THEN 'dmh' ELSE 'unknown' END AS session, CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS session_confirmed FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#12' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1994-03-01' AND DATE '1996-06-30'"),
    "a8_empty_scans": (q_empty_scans, "SELECT * FROM (VALUES ('actions', 0::BIGINT, 12), ('bars', 0, 12), ('earnings', 0, 8), ('indices', 0, 10), ('joined', 0, 18), ('legacy_bars', 0, 12), ('minutes', 0, 11), ('perps', 0, 17), ('pyth', 0, 21), ('redstone', 0, 15), ('scope', 0, 15), ('swaps', 0, 16), ('trades', 0, 14)) t(tape, n, n_columns)"),
    "g7_one_tape": (q_one_tape, "SELECT 'ticks' AS source, event_type AS symbol, count(*) AS n, round(avg(value), 3) AS mean FROM events GROUP BY 2 UNION ALL SELECT 'marks', event_type, count(*), round(avg(value * 2), 3) FROM events WHERE value < 50 GROUP BY 2 UNION ALL SELECT 'lines', l_returnflag, count(*), round(avg(l_extendedprice), 3) FROM lineitem GROUP BY 2 UNION ALL SELECT 'orders', o_orderstatus, count(*), round(avg(o_totalprice), 3) FROM orders GROUP BY 2 UNION ALL SELECT 'status', l_linestatus, count(*), round(avg(l_quantity), 3) FROM lineitem GROUP BY 2"),
    "d15_path_summary": (q_path_summary, "SELECT event_type AS symbol, count(*) AS n, round(min(value), 5) AS low, round(max(value), 5) AS high, round(avg(value), 5) AS mean, round(min_by(value, (ts, event_id)), 5) AS first, round(max_by(value, (ts, event_id)), 5) AS last, min_by(ts, (value, ts)) AS low_ts, min_by(ts, (-value, ts)) AS high_ts FROM events GROUP BY 1"),
    "e21_minute_panel": (q_minute_panel, f"WITH {EV}, g AS (SELECT u, ask_id, date_trunc('minute', ts) + to_minutes(m) AS at FROM a, range(1, 61) r(m)), z AS (SELECT g.ask_id, g.at, max_by(k.event_id, (k.ts, k.event_id)) AS e FROM g JOIN k ON g.u = k.u AND k.ts <= g.at AND k.ts >= g.at - INTERVAL 1 DAY GROUP BY 1, 2) SELECT ask_id, z.at AS minute, e AS event_id FROM z"),
    "e22_changes": (q_changes, f"WITH {BARS}, c AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS change FROM bars) SELECT symbol, ts, round(change, 6) AS change FROM c WHERE change IS NOT NULL"),
    "d21_week_medians": (q_week_medians, "WITH b AS (SELECT event_type AS symbol, dayofweek(ts) IN (0, 6) AS weekend, abs(value - avg(value) OVER (PARTITION BY event_type, CAST(ts AS DATE))) AS basis FROM events) SELECT symbol, weekend, count(*) AS n, round(median(basis), 5) AS median, round(quantile_cont(basis, 0.9), 5) AS p90 FROM b GROUP BY 1, 2"),
    "d19_dispersion": (q_dispersion, f"WITH {PANEL}, z AS (SELECT regime_pub, abs(rel_resid / sigma) AS z FROM panel WHERE sigma > 0) SELECT regime_pub, count(*) AS n, round(avg(z), 5) AS mean, round(quantile_cont(z, 0.95), 5) AS p95, round(quantile_cont(z, 0.99), 5) AS p99 FROM z GROUP BY 1"),
    "f6_trading_days": (q_trading_days, f"WITH {BARS}, b AS (SELECT DISTINCT ts FROM bars), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT day, (SELECT max(ts) FROM b WHERE ts <= day AND dayofweek(ts) = 5) AS last_friday, (SELECT min(ts) FROM b WHERE ts > day) AS next_day FROM o"),
    "b2_factors": (q_factors, f"WITH {BARS}, {PAIRS}, ix AS (SELECT symbol, ts, CASE WHEN count(x) OVER w >= 10 THEN stddev_samp(x) OVER w END AS vol FROM (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS x FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)), l AS (SELECT *, CASE WHEN symbol = 'Brand#4' AND fri_ts >= DATE '1998-01-01' THEN 'Brand#14' WHEN symbol IN ('Brand#1', 'Brand#2') THEN 'Brand#11' WHEN symbol = 'Brand#3' THEN 'Brand#12' ELSE 'Brand#13' END AS factor, CASE symbol WHEN 'Brand#1' THEN 'Brand#15' WHEN 'Brand#5' THEN 'Brand#16' END AS own FROM pairs), j AS (SELECT l.*, b.open / a.close - 1 AS fr, o.vol AS ov, c.vol AS cv FROM l JOIN bars a ON a.symbol = factor AND a.ts = fri_ts JOIN bars b ON b.symbol = factor AND b.ts = mon_ts LEFT JOIN ix o ON o.symbol = own AND o.ts = fri_ts LEFT JOIN ix c ON c.symbol = 'Brand#13' AND c.ts = fri_ts) SELECT symbol, fri_ts, factor, round(fr, 6) AS factor_ret, CASE WHEN ov IS NOT NULL THEN own ELSE 'Brand#13' END AS vol_idx, round(coalesce(ov, cv), 6) AS vol_idx_close, round(fri_close, 6) AS stale_point, round(fri_close * (1 + fr), 6) AS point FROM j WHERE coalesce(ov, cv) IS NOT NULL"),
    "c17_dividends": (q_dividends, f"WITH {BARS}, {PAIRS}, x AS (SELECT *, CASE WHEN day(mon_ts) <= 7 THEN fri_close * 0.01 ELSE 0 END AS dv FROM pairs) SELECT symbol, fri_ts, round(dv, 6) AS dividend, round(mon_open + dv, 6) AS mon_open FROM x"),
    "c19_truth_join": (q_truth_join, f"WITH {SERVED} SELECT symbol, fri_ts, tau_bps, CASE WHEN day(fri_ts) > 3 THEN 'known' WHEN mon_ts >= DATE '2001-01-01' THEN 'pending' ELSE 'missing' END AS status, CASE WHEN day(fri_ts) > 3 THEN round(mon_open, 6) END AS truth, round(lower, 3) AS lower FROM bands"),
    "q3_coverage_audit": (q_coverage_audit, f"WITH {SERVED_KNOWN}, {_T}, i AS (SELECT tau_bps, sum({_IND}) AS lr_ind, count({_IND})::INT AS k FROM t GROUP BY 1), g AS (SELECT tau_bps, tau, count(*) AS n, sum(1 - inside)::BIGINT AS x FROM hits GROUP BY 1, 2), r AS (SELECT tau_bps, n, x, 1 - x / n AS realised, k, {_LR} AS lr_uc, lr_ind, {_LR} + coalesce(lr_ind, 0) AS lr_cc, k + 1 AS k1 FROM g JOIN i USING (tau_bps)) SELECT tau_bps, n, x, round(realised, 4) AS realised, k, round(lr_uc, 4) AS lr_uc, round(lr_ind, 4) AS lr_ind, round(lr_cc, 4) AS lr_cc, round({chi2_sql('lr_uc', '1')}, 4) AS p_uc, round({chi2_sql('lr_ind', 'k')}, 4) AS p_ind, round({chi2_sql('lr_cc', 'k1')}, 4) AS p_cc FROM r"),
    "n3_anchor": (q_anchor, f"WITH {_ANCH} SELECT symbol, day, epoch_us(due) // 1000000 AS unix FROM an"),
    "n1_oracle_bands": (q_oracle_bands, f"WITH {_DAYS}, o AS (SELECT a.symbol, a.day, coalesce(max_by(e.value, (e.at, event_id)) FILTER (regular), max_by(e.value, (e.at, event_id))) AS price FROM an a JOIN ev e ON e.symbol = a.symbol AND e.at <= a.at AND e.at >= a.at - INTERVAL 8 HOUR AND CAST(e.ts AS DATE) <= DATE '2024-03-01' GROUP BY 1, 2), x AS (SELECT abs(truth - price) AS m, price * 0.001 + 0.01 AS u FROM o JOIN tr USING (symbol, day)), h AS (SELECT k, avg(CASE WHEN m <= k * u THEN 1.0 ELSE 0.0 END) AS realised, avg(k * u) AS mean_half FROM x, (SELECT unnest([1, 2, 5, 10, 50, 100, 200, 500, 1000, 5000])::DOUBLE AS k) GROUP BY 1), b AS (SELECT tau, min(k) AS k FROM h, (SELECT unnest([0.5, 0.68, 0.85])::DOUBLE AS tau) WHERE realised >= tau GROUP BY 1) SELECT tau, k, round(realised, 6) AS realised, round(mean_half, 6) AS mean_half FROM b JOIN h USING (k)"),
    "n2_percent_bands": (q_percent_bands, f"WITH {_ANCH}, {_OPEN}, sn AS (SELECT an.symbol, an.day, max_by(value, (ts, event_id)) AS price FROM an JOIN events ON event_type = an.symbol AND ts <= due AND ts >= due - INTERVAL 1 DAY GROUP BY 1, 2), pp AS (SELECT * FROM sn JOIN tr USING (symbol, day)), {_sweep_sql('pp', '(price / 100)', [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000])}"),
    "c10_session_nearest": (q_session_nearest, f"WITH {EV}, k2 AS (SELECT *, ts - INTERVAL 5 HOUR AS lt FROM k), z AS (SELECT ask_id, max_by(event_id, (k2.ts, event_id)) FILTER (dayofweek(lt) NOT IN (0, 6) AND hour(lt) * 60 + minute(lt) >= 570 AND hour(lt) * 60 + minute(lt) < 960) AS r, max_by(event_id, (k2.ts, event_id)) AS e FROM a LEFT JOIN k2 ON a.u = k2.u AND k2.ts <= a.ts AND k2.ts >= a.ts - INTERVAL 1 DAY GROUP BY 1) SELECT ask_id, coalesce(r, e, -1) AS event_id FROM z"),
    "n4_index_buffer": (q_vix_buffer, f"WITH {PANEL}, m AS (SELECT median(vix) AS mid FROM panel WHERE score_raw IS NOT NULL), x AS (SELECT regime_pub, score_raw * 10000 / (vix / mid) AS x FROM panel, m WHERE score_raw IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY regime_pub ORDER BY x) AS k, count(*) OVER (PARTITION BY regime_pub) AS n FROM x) SELECT regime_pub, tau_bps, n, (ceil(x / 5) * 5)::BIGINT AS buffer_bps FROM r, (VALUES (6800, 0.68::DOUBLE), (9500, 0.95::DOUBLE)) t(tau_bps, tau) WHERE k = ceil((n - 1) * tau) + 1"),
    "n6_walk_forward": (q_walk_forward_buffers, _FORWARD),
    "n6_buffer_pick": (q_buffer_pick, f"WITH {PANEL}, e AS (SELECT symbol, fri_ts, year(fri_ts) AS year, b / 4.0::DOUBLE AS buffer, 0.85::DOUBLE AS tau, CASE WHEN score > b / 4.0::DOUBLE THEN 1 ELSE 0 END AS m FROM panel, range(1, 41) r(b) WHERE score IS NOT NULL), g AS (SELECT year, buffer, tau, count(*) AS n, sum(m)::BIGINT AS x FROM e GROUP BY 1, 2, 3), l AS (SELECT *, lag(m) OVER (PARTITION BY year, buffer, symbol ORDER BY fri_ts) AS p FROM e), t AS (SELECT year, buffer, symbol, count(*) FILTER (p = 0 AND m = 0)::DOUBLE AS n00, count(*) FILTER (p = 0 AND m = 1)::DOUBLE AS n01, count(*) FILTER (p = 1 AND m = 0)::DOUBLE AS n10, count(*) FILTER (p = 1 AND m = 1)::DOUBLE AS n11 FROM l WHERE p IS NOT NULL GROUP BY 1, 2, 3), i AS (SELECT year, buffer, sum({_IND}) AS li, count({_IND})::INT AS k FROM t GROUP BY 1, 2), r AS (SELECT g.*, {_LR} AS lu, li, coalesce(k, 0) AS k, 1 - x / n AS realised FROM g LEFT JOIN i USING (year, buffer)), q AS (SELECT *, {chi2_sql('lu', '1')} AS p_uc, CASE WHEN k > 0 THEN {chi2_sql('li', 'k')} ELSE 1 END AS p_ind FROM r), w AS (SELECT *, CASE WHEN realised >= tau - 0.005 AND p_uc > 0.10 AND p_ind > 0.05 THEN 0 WHEN realised >= tau - 0.005 AND p_uc > 0.05 THEN 1 WHEN realised >= tau THEN 2 ELSE 3 END AS rank FROM q) SELECT year, arg_min(buffer, (rank, CASE WHEN rank < 3 THEN buffer ELSE -buffer END)) AS buffer, round(arg_min(realised, (rank, CASE WHEN rank < 3 THEN buffer ELSE -buffer END)), 5) AS realised, ['PASS', 'MARGINAL', 'CEILING', 'CEILING'][min(rank) + 1] AS status FROM w GROUP BY 1"),
    "o8_forward_tape": (q_forward, f"WITH {PANEL}, x AS (SELECT symbol, fri_ts, fri_ts >= DATE '{SPLIT}' AS f, row_number() OVER (PARTITION BY symbol, fri_ts >= DATE '{SPLIT}' ORDER BY fri_ts DESC) AS k FROM panel) SELECT symbol, fri_ts, f AS is_forward FROM x WHERE f OR k <= 20"),
    "o9_missing_partitions": (q_partitions, "WITH t AS (SELECT DISTINCT event_type AS symbol, CAST(ts AS DATE) AS day FROM events), g AS (SELECT symbol, d::DATE AS day FROM (SELECT DISTINCT symbol FROM t), range(DATE '2024-01-01', DATE '2024-02-06', INTERVAL 1 DAY) r(d)) SELECT symbol, CASE WHEN symbol IN ('view', 'click') THEN 'hard' ELSE 'soft' END AS kind, count(*) AS n, min(day) AS first, max(day) AS last FROM g WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.symbol = g.symbol AND t.day = g.day) GROUP BY 1, 2"),
    "o9_latest_pair": (q_latest_pair, f"WITH {BARS}, l AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS f FROM bars WHERE symbol = 'Brand#12'), g AS (SELECT f, ts FROM l WHERE ts - f >= 3 AND f > DATE '1996-06-30'), a AS (SELECT DISTINCT date_trunc('month', ts)::DATE AS today FROM bars), p AS (SELECT today, max(f) AS fri, max(ts) AS mon FROM a JOIN g ON g.ts <= today GROUP BY 1), e AS (SELECT today, 'fri' AS edge, fri AS day FROM p UNION ALL SELECT today, 'mon', mon FROM p) SELECT today, y.symbol, edge, day, CASE WHEN y.symbol < 'Brand#2' THEN 'hard' ELSE 'soft' END AS kind FROM e CROSS JOIN (SELECT DISTINCT symbol FROM bars) y WHERE NOT EXISTS (SELECT 1 FROM bars WHERE bars.symbol = y.symbol AND bars.ts = e.day)"),
    "o12_refusals": (q_refusals, f"WITH {PANEL}, {TAUS}, {_table_sql('qt', 'score')}, x AS (SELECT *, 540 + day(mon_ts) % 6 * 5 >= 565 AS refused, q * sigma * fri_close AS half FROM panel JOIN qt USING (regime_pub) WHERE sigma > 0 AND fri_ts >= DATE '{SPLIT}') SELECT symbol, fri_ts, tau_bps, refused, CASE WHEN NOT refused THEN round(fri_close * (1 + factor_ret) - half, 3) END AS lower, CASE WHEN NOT refused THEN round(fri_close * (1 + factor_ret) + half, 3) END AS upper FROM x"),
    "o10_freshness": (q_freshness, "WITH n AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id::VARCHAR AS manifest, max(ts) FILTER (event_type <> 'error') AS last_success FROM events GROUP BY 1) SELECT manifest, last_success, coalesce(epoch_us(now) - epoch_us(last_success) <= 26 * 3600000000, false) AS fresh FROM s, n"),
    "o12_publications": (q_commitments, f"WITH {PANEL}, {TAUS}, {_table_sql('qt', 'score')} SELECT symbol, fri_ts, tau_bps, round(q * sigma * fri_close, 3) AS half, round(fri_close * (1 + factor_ret) - q * sigma * fri_close, 3) AS lower, round(fri_close * (1 + factor_ret) + q * sigma * fri_close, 3) AS upper FROM panel JOIN qt USING (regime_pub) WHERE sigma > 0 AND fri_ts >= DATE '{SPLIT}'"),
    "q6_archive": (q_archive, f"WITH {SERVED}, c AS (SELECT count(*) FILTER (fri_ts < DATE '2000-06-01') AS a, count(*) FILTER (fri_ts >= DATE '2000-06-01') AS b FROM bands) SELECT 1 AS run, a AS appended, a AS total FROM c UNION ALL SELECT 2, b, a + b FROM c"),
    "q2_artefact": (q_artefact, f"WITH {PANEL}, {TAUS}, {_table_sql('qt', 'score')} SELECT regime_pub, tau_bps, round(q, 5) AS q, true AS intact, false AS changed_intact FROM qt"),
    "j5_frozen_serve": (q_frozen_serve, f"WITH {PANEL}, {TAUS}, {_table_sql('qt', 'score')}, h AS (SELECT tau_bps, q FROM qt WHERE regime_pub = 'high_vol') SELECT symbol, fri_ts, h.tau_bps, round(point - CASE WHEN h.tau_bps = 9500 THEN 1.1 ELSE 1.0 END::DOUBLE * coalesce(w.q, h.q) * sigma * fri_close, 3) AS lower, round(point + CASE WHEN h.tau_bps = 9500 THEN 1.1 ELSE 1.0 END::DOUBLE * coalesce(w.q, h.q) * sigma * fri_close, 3) AS upper FROM panel p CROSS JOIN h LEFT JOIN (SELECT * FROM qt WHERE regime_pub <> 'long_weekend') w ON w.regime_pub = p.regime_pub AND w.tau_bps = h.tau_bps WHERE sigma IS NOT NULL AND fri_ts >= DATE '{SPLIT}'"),
    "k21_tracking": (q_tracking, f"WITH {SERVED}, t AS (SELECT *, mon_open * CASE WHEN day(fri_ts) > 15 THEN 1.02 ELSE 0.98 END::DOUBLE AS y FROM bands) SELECT regime_pub, tau_bps, count(*) AS n, round(avg(CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0 END), 4) AS realised, round(avg((upper - lower) / 2 / fri_close * 10000), 4) AS hw, round(avg(((upper - lower) + CASE WHEN y < lower THEN (lower - y) * 2 / (1 - tau) WHEN y > upper THEN (y - upper) * 2 / (1 - tau) ELSE 0 END) / fri_close), 4) AS winkler FROM t GROUP BY 1, 2"),
    "b25_band_scores": (q_band_scores, f"WITH {SERVED} SELECT symbol, fri_ts, tau_bps, round(hw_bps, 3) AS hw_bps, round((mon_open - fri_close) / fri_close * 10000, 3) AS gap_bps, inside, round(hw_bps - abs((mon_open - fri_close) / fri_close * 10000), 3) AS excess_bps FROM hits"),
    "b23_symbols": (q_symbols, f"WITH {PANEL}, k AS (SELECT p_brand AS symbol, min(p_type) AS class FROM part GROUP BY 1), t AS (SELECT DISTINCT symbol || 'x' AS token FROM panel UNION ALL SELECT 'otherx') SELECT token, k.symbol, class FROM t LEFT JOIN k ON token = k.symbol || 'x'"),
    "e16_cluster_median": (q_safe_median, f"WITH {PANEL}, c AS (SELECT symbol, fri_ts, rel_resid, CASE WHEN right(symbol, 1) IN ('1', '2', '3', '4', '5') THEN 'low' WHEN right(symbol, 1) IN ('6', '7', '8') THEN 'high' END AS cluster FROM panel), m AS (SELECT a.symbol, a.fri_ts, median(b.rel_resid) AS m FROM c a JOIN c b ON a.fri_ts = b.fri_ts AND a.cluster = b.cluster AND a.symbol <> b.symbol GROUP BY 1, 2) SELECT c.symbol, c.fri_ts, cluster, round(m, 6) AS loo_median FROM c LEFT JOIN m ON m.symbol = c.symbol AND m.fri_ts = c.fri_ts"),
}
