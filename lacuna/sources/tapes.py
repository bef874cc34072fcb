"""Typed scans of dated tapes, sidecars and sinks: what is missing gives no rows, but all columns."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import fresh_path
from .market import append_new, daily_paths, read_existing, yearly_paths

_META = "_schema_version string, _fetched_at timestamp, _source string, _dedup_key string"


@dataclass(frozen=True)
class Tape:
    """A kind of dated file: its place under a root, whether a day or a year a file, its partition key, its own time
    column and how that tells a date, and its columns."""

    place: str
    every: str
    key: str | None
    when: str
    unit: str
    columns: str

    @property
    def schema(self) -> str:
        return f"{self.columns}, {_META}"


# Places and columns of the tapes.
TAPES = {
    "bars": Tape("yahoo/equities_daily/v1", "year", "symbol", "ts", "date", "symbol string, ts date, open double, high double, low double, close double, adj_close double, volume double"),
    "legacy_bars": Tape("yahoo/bars/v1", "year", "symbol", "ts", "date", "symbol string, ts date, open double, high double, low double, close double, adj_close double, volume double"),
    "indices": Tape("cboe/indices/v1", "year", "index", "date", "date", "index string, date date, open double, high double, low double, close double"),
    "earnings": Tape("yahoo/earnings/v2", "year", "symbol", "earnings_date", "date", "symbol string, earnings_date date, session string, session_confirmed boolean"),
    "actions": Tape("yahoo/corp_actions/v1", "year", "symbol", "event_date", "date", "symbol string, event_date date, event_type string, dividend_amount double, split_ratio_num double, split_ratio_den double, dividend_currency string, announce_date date"),
    "scope": Tape("kamino_scope/oracle_tape/v1", "day", None, "scope_unix_ts", "s", "poll_ts string, symbol string, feed_pda string, chain_id int, scope_value_raw long, scope_exp int, scope_price double, scope_slot long, scope_unix_ts long, scope_age_s long, scope_err string"),
    "pyth": Tape("pyth/oracle_tape/v1", "day", None, "poll_unix", "s", "poll_ts string, poll_unix long, symbol string, session string, pyth_feed_id string, pyth_price double, pyth_conf double, pyth_expo int, pyth_publish_time long, pyth_age_s long, pyth_half_width_bps double, pyth_ema_price double, pyth_ema_conf double, pyth_ema_publish_time long, pyth_ema_half_width_bps double, slot long, pyth_err string"),
    "redstone": Tape("redstone/oracle_tape/v1", "day", None, "redstone_ts", "ts", "poll_ts timestamp, poll_label string, symbol string, redstone_ts timestamp, minutes_age double, value double, provider_pubkey string, signature string, source_json string, permaweb_tx string, raw_json string"),
    "joined": Tape("joined/tape/v1", "day", None, "poll_ts", "s", "poll_ts long, symbol string, cl_obs_ts long, cl_age_s long, cl_tokenized_px double, cl_venue_px double, cl_market_status int, cl_err string, jup_bid double, jup_ask double, jup_mid double, spread_bp double, jup_err string, basis_bp double"),
    "trades": Tape("geckoterminal/trades/v1", "day", "pool", "ts", "s", "ts long, tx_hash string, block_number long, kind string, from_token string, to_token string, from_amount double, to_amount double, price_usd double, volume_usd double"),
    "minutes": Tape("cme/intraday_1m/v1", "day", "symbol", "ts", "s", "symbol string, ts long, open double, high double, low double, close double, volume double"),
    "perps": Tape("cex_stock_perp/ohlcv/v1", "day", "underlier", "bar_open_ts", "s", "exchange string, exchange_symbol string, underlier_symbol string, backing_kind string, bar_open_ts long, bar_close_ts long, open double, high double, low double, close double, volume_base double, volume_quote double, trade_count long"),
    "swaps": Tape("dex_xstock/swaps/v1", "day", "symbol", "block_time", "s", "signature string, slot long, block_time long, dex_program string, xstock_mint string, xstock_symbol string, counter_mint string, counter_symbol string, xstock_amount_lamports long, counter_amount_lamports long, price_per_xstock double, trader string"),
}


def day_of(when: Column, unit: str) -> Column:
    """The UTC date of a tape's own time."""
    return {"date": when.cast("date"), "ts": F.to_date(when), "s": F.to_date(F.timestamp_seconds(when))}[unit] if unit != "s" else F.date_from_unix_date((F.floor(when / 86_400)).cast("int"))


def as_date(x: dt.date | dt.datetime | str) -> dt.date:
    """A date from a date, a time (in UTC, if it has a zone) or ISO text."""
    if isinstance(x, str):
        x = dt.datetime.fromisoformat(x.replace("Z", "+00:00"))
    if isinstance(x, dt.datetime):
        return (x.astimezone(dt.timezone.utc) if x.tzinfo else x).date()
    return x


def escaped(key: str) -> str:
    """A key as writers by partition put it into a path."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^\x7f" or c < " " else c for c in key)


def paths_of(tape: Tape, root: str, start: dt.date, end: dt.date, key: str | None) -> list[str]:
    """Where a tape's files of some dates may lie; a key whose name paths don't take, as it is or escaped."""
    base, of = f"{root}/{tape.place}", daily_paths if tape.every == "day" else yearly_paths
    names = [(tape.key, k) for k in dict.fromkeys((key, escaped(key)))] if tape.key and key is not None else [None]
    return [p for name in names for p in of(base, start, end, name)]


def scanned(spark: SparkSession, kind: str, root: str, start: dt.date | str, end: dt.date | str, key: str | None = None) -> DataFrame:
    """Rows of a tape whose date lies in [start, end], both ends in. Bars fall back to the older place. Rows of the joined
    tape whose quote failed have no quotes, whatever the file says."""
    tape, start, end = TAPES[kind], as_date(start), as_date(end)
    found = read_existing(spark, paths_of(tape, root, start, end, key), tape.schema)
    if kind == "bars" and not found.inputFiles():
        found = read_existing(spark, paths_of(TAPES["legacy_bars"], root, start, end, key), tape.schema)
    rows = found.where(day_of(F.col(tape.when), tape.unit).between(F.lit(start), F.lit(end)))
    if tape.key in rows.columns and key is not None:
        rows = rows.withColumn(tape.key, F.coalesce(F.col(tape.key), F.lit(key)))
    if kind == "joined":
        failed = F.coalesce(F.col("jup_err"), F.lit("")) != ""
        rows = rows.withColumns({c: F.when(~failed, F.col(c)) for c in ("jup_bid", "jup_ask", "jup_mid", "spread_bp", "basis_bp")})
    if kind == "scope":
        rows = rows.where(F.coalesce(F.col("scope_err"), F.lit("")) == "")
    if kind == "indices":
        rows = rows.withColumnsRenamed({"index": "symbol", "date": "ts"})
    return rows


def stored(df: DataFrame, kind: str, root: str, key: str | Column | None = None) -> None:
    """Writes rows as a tape's dated files, in one job, under one key, or, if it is a column, each under its own: that
    column goes into the path alone, and whoever reads a key fills it in."""
    tape = TAPES[kind]
    day = day_of(F.col(tape.when), tape.unit)
    text = lambda f: F.date_format("_day", f)
    rows = df.withColumn("_day", day)
    if tape.every == "day":
        rows, parts = rows.withColumns({"year": text("yyyy"), "month": text("MM"), "day": F.concat(text("dd"), F.lit(".parquet"))}), ["year", "month", "day"]
    else:
        rows, parts = rows.withColumn("year", F.concat(text("yyyy"), F.lit(".parquet"))), ["year"]
    base = f"{root}/{tape.place}"
    if tape.key and isinstance(key, Column):
        rows, parts = rows.withColumn(tape.key, key), [tape.key, *parts]
    elif tape.key and key is not None:
        base += f"/{tape.key}={key}"
    rows.drop("_day").repartition(*parts).write.mode("overwrite").partitionBy(*parts).parquet(base)


def one_tape(frames: Mapping[str, tuple[DataFrame, str, Column, Column]]) -> DataFrame:
    """Tapes of several sources as one: source, symbol, ts, value, from (frame, symbol column, time, value) each."""
    out = None
    for source, (df, symbol, ts, value) in sorted(frames.items()):
        own = df.select(F.lit(source).alias("source"), F.col(symbol).cast("string").alias("symbol"), ts.alias("ts"), value.cast("double").alias("value")).where("value IS NOT NULL")
        out = own if out is None else out.unionByName(own)
    return out


def appended_lines(events: DataFrame, path: str | None) -> str:
    """Appends events to a tape, a compact line of JSON each; gives the tape's folder."""
    path = path or fresh_path(events.sparkSession, "tape")
    events.write.mode("append").json(path)
    return path


def sidecar_tables(spark: SparkSession, text: str | None, names: tuple[str, ...] = ("quantile_table", "c_bump_schedule", "delta_shift_schedule")) -> dict[str, DataFrame]:
    """The tables of a sidecar (JSON): cell, tau_bps, value; those of schedules have a null cell. Keys of tau are text. No
    sidecar, or no such table: no rows."""
    made, got = {}, json.loads(text) if text else {}
    for name in names:
        rows = []
        for k, v in (got.get(name) or {}).items():
            rows += [(k, int(round(float(t) * 10_000)), float(x)) for t, x in v.items()] if isinstance(v, dict) else [(None, int(round(float(k) * 10_000)), float(v))]
        made[name] = spark.createDataFrame(rows, "cell string, tau_bps int, value double")
    return made


def artefact_written(rows: DataFrame, table: DataFrame, path: str, **facts: object) -> str:
    """An artefact: rows sorted by symbol and date beside a sidecar with the quantile table, and the sidecar's text."""
    rows.repartitionByRange("symbol", "fri_ts").sortWithinPartitions("symbol", "fri_ts").write.mode("overwrite").parquet(f"{path}/rows")
    cells: dict[str, dict[str, float]] = {}
    for r in table.orderBy("regime_pub", "tau_bps").collect():
        cells.setdefault(r["regime_pub"], {})[f"{r['tau_bps'] / 10_000:.2f}"] = r["q"]
    text = json.dumps({"quantile_table": cells, **facts}, sort_keys=True, separators=(",", ":"))
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")
    return text


def latest(names: list[str], stem: str) -> str | None:
    """The last by name of stem_frozen_YYYYMMDD.json; none of them, None."""
    own = [n for n in names if n.rsplit("/", 1)[-1].startswith(f"{stem}_frozen_") and n.endswith(".json")]
    return max(own, default=None)


# Columns of the archives.
ARCHIVES = {
    "bands": "weekend_date date, mon_date date, symbol string, tau double, lower double, upper double, point double, half_width_bps double, regime_code string, forecaster_code int, profile_code int, artefact_sha256 string, provenance string, computed_ts timestamp",
    "commitments": "weekend_date date, mon_date date, symbol string, tau double, fri_close double, sigma_hat double, regime_code string, half_width_bps double, half_width_abs double, forecaster_code int, profile_code int, artefact_sha256 string, computed_ts timestamp",
}


def archive(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """An archive's CSV files in its types; a field that isn't what it should be stops the job."""
    return spark.read.schema(ARCHIVES[kind]).option("header", True).option("mode", "FAILFAST").csv(path)


def archived(spark: SparkSession, new: DataFrame, key: list[str], path: str) -> tuple[int, int]:
    """Adds to a CSV archive the rows whose key, as text, it lacks: how many, and how many there are then. The new state
    is written beside the old and takes its place when whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    fs = at.getFileSystem(conf)
    old = spark.read.schema(new.schema).option("header", True).csv(path) if fs.exists(at) else spark.createDataFrame([], new.schema)
    before = old.count()
    append_new(old, new, key).orderBy(*key).write.mode("overwrite").option("header", True).csv(f"{path}.new")
    if fs.exists(at):
        fs.delete(at, True)
    fs.rename(temp, at)
    after = spark.read.schema(new.schema).option("header", True).csv(path).count()
    return after - before, after
