"""Where jobs of this subpackage keep what they must write, and the sums that run over sorted rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where a local session names none, as in tests, a temporary folder is set; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext.getCheckpointDir()
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that executors share")
        at = found or f"file://{tempfile.mkdtemp(prefix='lacuna-')}"
        if not found:
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lacuna/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost executor costs nothing done before. Row groups
    are small, so that writers hold little."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free(columns: Sequence[str], *names: str) -> list[str]:
    """Names like these that no column has, so that what an operator adds never meets what its caller brings."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def whole_ids(df: DataFrame, *columns: str) -> None:
    """Stops with a clear message if an id column is not of whole numbers: other ids would be cast away."""
    for f in df.schema.fields:
        if f.name in columns and not isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
            raise TypeError(f"{f.name} must hold whole numbers, not {f.dataType.simpleString()}: number the rows first")


def with_row_of(rows: DataFrame, table: DataFrame, key: str, many: str, most: int = 5000, total: int | None = None) -> DataFrame:
    """rows with the one row that table has for their key; rows without one go.

    many is the column of table that says how many of rows have the key. Keys with more than one row in most of all are
    fewer than most, whatever the input, so they go to every task; the others are joined by shuffle. So a key that holds
    a third of all rows stays where its rows are. total is the number of rows, if it is known.
    """
    limit = (int(table.agg(F.coalesce(F.sum(many), F.lit(0))).first()[0]) if total is None else total) // most
    often, seldom = table.where(F.col(many) > limit), table.where(F.col(many) <= limit)
    near = rows.join(F.broadcast(often), key)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(seldom, key)
    return near.unionByName(rest)


def running(df: DataFrame, order: list, sums: dict[str, str], name: str, within: list[str] | None = None) -> DataFrame:
    """Exclusive prefix sums over all rows in the given order, without a global window.

    df is range-sorted into parts and written; each part's totals, one row a part and group, are summed over the
    parts before it, and a window inside each part does the rest. sums maps a new column to the column it sums ("1"
    counts rows). within names columns, first in order, at whose change the sums begin anew. Rows wholly equal in order
    stand in one part, so order should end in something that tells rows apart. Other columns may have any names.
    """
    spark, within = df.sparkSession, within or []
    part, row, *own = free([*df.columns, *sums], "part", "row", *[f"{k}_{x}" for k in sums for x in ("total", "before")])
    total, before_ = dict(zip(sums, own[::2], strict=True)), dict(zip(sums, own[1::2], strict=True))
    dealt = df.repartitionByRange(tasks_for(spark), *order).sortWithinPartitions(*order)
    parts = written(dealt.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()), name)
    value = {k: F.lit(1).cast("long") if v == "1" else F.col(v).cast("long") for k, v in sums.items()}
    totals = parts.groupBy(part, *within).agg(*[F.sum(v).alias(total[k]) for k, v in value.items()])
    over_parts = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    over_parts = over_parts.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(part, *within, *[F.coalesce(F.sum(total[k]).over(over_parts), F.lit(0)).alias(before_[k]) for k in value])
    inside = Window.partitionBy(part, *within).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    here = parts.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(k) for k, v in value.items()])
    cond = F.col(f"h.{part}") == F.col(f"b.{part}")
    for c in within:
        cond = cond & F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = here.alias("h").join(before.alias("b"), cond)
    return both.select(*[F.col(f"h.{c}") for c in df.columns], *[(F.col(f"h.{k}") + F.col(f"b.{before_[k]}")).alias(k) for k in value])
