"""The same operators on streams: bars by event time, forward-only stores, appends without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Ticks (symbol, ts, value, event_id, user_id) of an events file or folder, as a stream in the file's own schema."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream's source is a folder
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    raw = reader.parquet(path)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id", "user_id")


def live_bars(ticks: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Bars of symbol and period by event time; a tick more than `late` behind the watermark is dropped, repeats too."""
    once = ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    at = F.struct("ts", "event_id", "value")
    bars = once.groupBy("symbol", F.window("ts", width)).agg(F.min(at).alias("a"), F.max("value").alias("high"), F.min("value").alias("low"), F.max(at).alias("z"), F.count("*").alias("n"))
    return bars.select("symbol", F.col("window.start").alias("bar"), F.col("a.value").alias("open"), "high", "low", F.col("z.value").alias("close"), "n")


def sessions(ticks: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of users: runs of ticks with no pause of gap, with start, end (the last tick and gap), number and sum. A tick
    more than `late` behind the watermark is dropped, repeats too; a session comes once the watermark has passed its end, and
    only open ones, and the ids of late's length, stay in state."""
    once = ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    g = once.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def sliding_spread(ticks: DataFrame, width: str = "3 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """The spread of log values by symbol over windows that slide, once the watermark has passed their end; values that
    aren't positive, and repeats, don't count."""
    once = ticks.where("value > 0").withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    g = once.groupBy("symbol", F.window("ts", width, slide)).agg(F.count("*").alias("n"), F.stddev_samp(F.log("value")).alias("spread"))
    return g.select("symbol", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "spread")


def forward_only(updates: DataFrame, path: str, checkpoint: str) -> None:
    """Per symbol, how many ticks a store takes that only moves forward in event time: runs over all that is there, then
    stops. A row a batch and symbol goes to path/batch=N, replaced if run again.

    Ticks of a batch come by event_id, equal ids by time; those without a time are not taken. A batch is range-sorted into
    parts and written; the newest time of each symbol in the parts before and the stored one go ahead of a running maximum
    in the part, so no task needs all ticks of a symbol. The newest times after each batch lie in path-newest/batch=N.
    """
    spark = updates.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        old = spark.read.parquet(f"{path}-newest/batch={n - 1}") if n > 0 else spark.createDataFrame([], "symbol string, last_us long")
        rows = batch.select("symbol", F.unix_micros("ts").alias("us"), "event_id")
        order, sorted_at = ["symbol", "event_id", "us"], f"{path}-sorted/batch={n}"
        dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(sorted_at)
        parts = spark.read.parquet(sorted_at)
        tops = parts.groupBy("_part", "symbol").agg(F.max("us").alias("_top"))
        earlier = Window.partitionBy("symbol").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        stored = old.select(F.col("symbol").alias("_symbol"), "last_us")
        tops = tops.withColumn("_before", F.max("_top").over(earlier)).join(stored, F.col("symbol").eqNullSafe(F.col("_symbol")), "left")
        before = tops.select(F.col("_part").alias("_p"), F.col("symbol").alias("_s"), F.greatest("_before", "last_us").alias("_before"), "last_us")
        inside = Window.partitionBy("_part", "symbol").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        lined = parts.withColumn("_own", F.max("us").over(inside)).join(before, (F.col("_part") == F.col("_p")) & F.col("symbol").eqNullSafe(F.col("_s")))
        newest = F.greatest("_before", "_own")
        taken = F.col("us").isNotNull() & (newest.isNull() | (F.col("us") >= newest))
        out = lined.groupBy("symbol").agg(F.count("*").alias("n"), F.count(F.when(taken, 1)).alias("accepted"), F.greatest(F.max("us"), F.max("last_us")).alias("last_us"))
        out.write.mode("overwrite").parquet(f"{path}/batch={n}")
        both = old.unionByName(spark.read.parquet(f"{path}/batch={n}").select("symbol", "last_us"))
        both.groupBy("symbol").agg(F.max("last_us").alias("last_us")).write.mode("overwrite").parquet(f"{path}-newest/batch={n}")

    updates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", key: list[str] | None = None) -> None:
    """Runs a stream over all that is there, then stops. Batches go to path/batch=N, replaced if run again; with a key,
    rows whose key came before are left out: the stream's own state keeps the keys, so no batch is read again."""
    if key is not None:
        stream = stream.dropDuplicates(key)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
