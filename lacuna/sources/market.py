"""Daily bars, factors, calendars and tapes from the driver's tables, and readers of dated files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    """symbol, ts, open, high, low, close, volume: trades of a brand's parts on weekdays, or those with one return flag.
    First and last go by order, line and price, as lines repeat."""
    trade = F.struct(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("price").alias("p"))
    lines = table(spark, sf_dir, "lineitem")
    lines = (lines if flag is None else lines.where(F.col("l_returnflag") == flag)).select("l_partkey", "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    both = lines.where(~F.dayofweek("ts").isin(1, 7)).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return both.groupBy("symbol", "ts").agg(F.min(trade)["p"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(trade)["p"].alias("close"), F.sum("l_quantity").alias("volume"))


def market_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, level and vol of the whole market: volume-weighted price, and its yearly volatility over 20 days in percent."""
    day = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("ts"), "l_extendedprice", "l_quantity").where(~F.dayofweek("ts").isin(1, 7))
    level = day.groupBy("ts").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("level"))
    order = Window.partitionBy(F.lit(0)).orderBy("ts")
    moved = level.withColumn("r", F.log(F.col("level") / F.lag("level").over(order)))
    near = order.rowsBetween(-19, 0)
    return moved.withColumn("vol", F.when(F.count("r").over(near) >= 10, F.stddev_samp("r").over(near) * 100 * F.sqrt(F.lit(252.0)))).select("ts", "level", "vol")


def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, event_date, session, confirmed: orders as announcements; confirmed is null where the status is open."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("event_date"), "o_orderpriority", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    both = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    session = F.when(F.col("o_orderpriority").startswith("1"), "amc").when(F.col("o_orderpriority").startswith("2"), "bmo").when(F.col("o_orderpriority").startswith("3"), "dmh").otherwise("unknown")
    confirmed = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False)
    return both.select("symbol", "event_date", session.alias("session"), confirmed.alias("confirmed")).distinct()


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, value, event_id: the event stream as a price tape."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id", "user_id")


def daily_paths(root: str, start: dt.date, end: dt.date, key: tuple[str, str] | None = None) -> list[str]:
    """Paths of dated files, root/[key=value/]year=Y/month=M/day=D.parquet, from start to end."""
    base = f"{root}/{key[0]}={key[1]}" if key else root
    days = [start + dt.timedelta(n) for n in range((end - start).days + 1)]
    return [f"{base}/year={d.year}/month={d.month:02d}/day={d.day:02d}.parquet" for d in days]


def yearly_paths(root: str, start: dt.date, end: dt.date, key: tuple[str, str] | None = None) -> list[str]:
    base = f"{root}/{key[0]}={key[1]}" if key else root
    return [f"{base}/year={y}.parquet" for y in range(start.year, end.year + 1)]


def read_existing(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The files among paths that exist, in the given schema; none of them: no rows, all columns."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [p for p in paths if (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)]
    return spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)


def blended(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Two sources of one series: the second only fills keys that the first lacks."""
    return first.unionByName(second.join(first.select(*key).distinct(), key, "left_anti"))


def coverage(df: DataFrame, ts: str, by: list[str]) -> DataFrame:
    """Rows, days and the first and last time of each surface."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.countDistinct(F.to_date(ts)).alias("n_days"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def append_new(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """existing and the rows of new whose key, as text, it lacks; of rows that repeat a key in new the first by all
    columns. The sink of archives: run again, it adds nothing."""
    as_text = [F.col(c).cast("string").alias(c) for c in key]
    first = Window.partitionBy(*key).orderBy(*new.columns)
    fresh = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    known = existing.select(*as_text).distinct().select(*[F.col(c).alias(f"_k_{c}") for c in key])
    cond = [F.col(c).cast("string").eqNullSafe(F.col(f"_k_{c}")) for c in key]
    return existing.unionByName(fresh.join(known, cond, "left_anti"))


def resampled(ticks: DataFrame, unit: str = "day") -> DataFrame:
    """Bars of symbol and UTC period: first, highest, lowest and last value by time and id, and counts."""
    at = F.struct("ts", "event_id", "value")
    return ticks.groupBy("symbol", F.date_trunc(unit, "ts").alias("bar")).agg(F.min(at)["value"].alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max(at)["value"].alias("close"), F.count("*").alias("n"))
