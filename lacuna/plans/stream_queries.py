"""Streams run over all that is there, held against SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.shared import fresh_path
from ..sources import market as M
from ..streaming import adaptive, live
from .panel_queries import SPLIT
from .policy_queries import rounded
from .serve_queries import _REPLAY, replay_scores, table


def q_live_bars(s, d):  # noqa: ANN001, ANN201
    at = fresh_path(s, "stream")
    live.drain(live.live_bars(live.event_stream(s, f"{d}/events.parquet"), late="400 days"), f"{at}/out", f"{at}/checkpoint", "update")
    rows = s.read.parquet(f"{at}/out")
    last = rows.groupBy("symbol", "bar").agg(F.max_by(F.struct("open", "high", "low", "close", "n"), "batch").alias("v"))
    return last.select("symbol", F.to_date("bar").alias("day"), *[F.round(f"v.{c}", 6).alias(c) for c in ("open", "high", "low", "close")], F.col("v.n").alias("n"))


def q_forward_only(s, d):  # noqa: ANN001, ANN201
    at = fresh_path(s, "stream")
    live.forward_only(live.event_stream(s, f"{d}/events.parquet"), f"{at}/out", f"{at}/checkpoint")
    return s.read.parquet(f"{at}/out").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("accepted").alias("accepted"))


def _in_slices(s, d, shaped, columns):  # noqa: ANN001, ANN202
    """A stream over the events in three files by time, each but the first with all rows of the one before again; the
    stream is stopped after each file and goes on from its checkpoint."""
    at = fresh_path(s, "stream")
    e = M.table(s, d, "events")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    third = (hi - lo) / 3
    edges = [lo, lo + third, lo + 2 * third, hi + third]
    part = lambda i: e.where((F.col("ts") >= F.lit(edges[i]).cast("timestamp_ntz")) & (F.col("ts") < F.lit(edges[i + 1]).cast("timestamp_ntz")))
    for i in range(3):
        rows = part(i) if i == 0 else part(i).unionByName(part(i - 1))
        rows.write.mode("append").parquet(f"{at}/in")
        live.drain(shaped(live.event_stream(s, f"{at}/in")), f"{at}/out", f"{at}/checkpoint")
    return s.read.parquet(f"{at}/out").select(*columns)


def q_sessions(s, d):  # noqa: ANN001, ANN201
    """Sessions of users that are over a day before the last tick."""
    day = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return _in_slices(s, d, live.sessions, ["user_id", day("start"), day("end"), "n", F.round("total", 4).alias("total")])


def q_sliding(s, d):  # noqa: ANN001, ANN201
    """Spreads of three-day windows that are over a day before the last tick."""
    return _in_slices(s, d, live.sliding_spread, ["symbol", F.to_date("start").alias("start"), F.to_date("end").alias("end"), "n", F.round("spread", 6).alias("spread")])


def q_adaptive(s, d):  # noqa: ANN001, ANN201
    """The adaptive multipliers of late gaps as a stream in three parts, stopped after each: all periods but the last, which
    stays open."""
    at, quantiles = fresh_path(s, "stream"), table(s, d)
    rows = replay_scores(s, d).select("regime_pub", "fri_ts", "score")
    edges = [SPLIT, "1999-06-01", "2000-03-01", "2100-01-01"]
    # a state's parts cost a worker and a store each at every batch, and hold whole cells: no more of them than cells
    cells = quantiles.select("regime_pub").distinct().count()
    own = {"spark.sql.streaming.stateStore.providerClass": adaptive.STORE, "spark.sql.shuffle.partitions": str(max(1, min(cells, int(s.conf.get("spark.sql.shuffle.partitions")))))}
    old = {k: s.conf.get(k, None) for k in own}
    for k, v in own.items():
        s.conf.set(k, v)
    try:
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            rows.where((F.col("fri_ts") >= lo) & (F.col("fri_ts") < hi)).write.mode("append").parquet(f"{at}/in")
            part = s.readStream.schema(rows.schema).parquet(f"{at}/in")
            live.drain(adaptive.adaptive_stream(part, quantiles, "regime_pub", "fri_ts", "score"), f"{at}/out", f"{at}/checkpoint")
    finally:
        for k, v in old.items():
            s.conf.set(k, v) if v else s.conf.unset(k)
    return rounded(s.read.parquet(f"{at}/out").drop("batch"), 8)


QUERIES = {
    "s3_adaptive_stream": (q_adaptive, f"WITH RECURSIVE {_REPLAY} SELECT cell, tau_bps, period, n, round(m_served, 8) AS m_served, round(m_next, 8) AS m_next FROM rp WHERE i > 0 AND period < (SELECT max(period) FROM pd)"),
    "s1_user_sessions": (q_sessions, "WITH x AS (SELECT *, lag(ts) OVER w AS b FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, sum(CASE WHEN b IS NULL OR ts > b + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, count(*) AS n, round(sum(value), 4) AS total FROM y GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"),
    "s2_sliding_spread": (q_sliding, "WITH x AS (SELECT event_type AS symbol, value, unnest([CAST(ts AS DATE) - 2, CAST(ts AS DATE) - 1, CAST(ts AS DATE)]) AS start FROM events WHERE value > 0) SELECT symbol, start, start + 3 AS end, count(*) AS n, round(stddev_samp(ln(value)), 6) AS spread FROM x GROUP BY 1, 2 HAVING start + 3 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events WHERE value > 0)"),
    "o8_live_bars": (q_live_bars, "SELECT event_type AS symbol, CAST(ts AS DATE) AS day, round(min_by(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(max_by(value, (ts, event_id)), 6) AS close, count(*) AS n FROM events GROUP BY 1, 2"),
    "o13_forward_only": (q_forward_only, "WITH x AS (SELECT event_type AS symbol, ts, max(ts) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) SELECT symbol, count(*) AS n, count(*) FILTER (b IS NULL OR ts >= b) AS accepted FROM x GROUP BY 1"),
}
