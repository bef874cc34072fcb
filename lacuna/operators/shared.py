"""What operators share: tables in the shared folder, checked broadcasts, running sums and exact order statistics."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that executors share, spark.checkpoint.dir. A local session without one takes a temporary folder; on a
    cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lacuna-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lacuna/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and not again when an executor is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: dict[tuple, tuple[str, object]] = {}


def _files(spark: SparkSession, folder: str) -> tuple:
    """What lies in a folder, with size and time; nothing if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))) if fs.exists(path) else ()


def once(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that many queries of a session read: made at the first, read from the shared folder by the others. It is made
    anew if the source folder's files have changed, or the table is gone."""
    key = (spark.sparkContext.applicationId, name, source, _files(spark, source))
    if key not in _made or not _files(spark, _made[key][0]):
        df, path = make(), fresh_path(spark, name)
        df.write.parquet(path)
        _made[key] = path, df.schema
    path, schema = _made[key]
    return spark.read.schema(schema).parquet(path)


def sized(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df for the small side of a join: sent to all tasks if it has at most so many rows, else joined by shuffle. It is
    written first, so counting costs little."""
    df = written(df, "side")
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free(columns: Sequence[str], *names: str) -> list[str]:
    """Names like these that no column has, so that what an operator adds never meets what its caller brings."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def running(df: DataFrame, order: Sequence, sums: dict[str, str], within: Sequence[str] = ()) -> DataFrame:
    """Exclusive prefix sums over all rows in the given order, begun anew for each value of the columns within (first in
    order), without a global window.

    df is range-sorted into parts and written; sums of the parts, a row a part and group, go ahead of a window in each
    part, so no task needs all rows. sums maps a new column to the one it sums ("1" counts rows). Rows wholly equal in order
    stand in one part, so order should end in something that tells rows apart. Other columns may have any names.
    """
    spark, within = df.sparkSession, list(within)
    part, row, *own = free([*df.columns, *sums], "part", "row", *[f"{k}_{x}" for k in sums for x in ("total", "before")])
    total, past = dict(zip(sums, own[::2], strict=True)), dict(zip(sums, own[1::2], strict=True))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    parts = written(dealt.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()), "running")
    value = {k: F.lit(1).cast("long") if v == "1" else F.col(v) for k, v in sums.items()}
    totals = parts.groupBy(part, *within).agg(*[F.sum(v).alias(total[k]) for k, v in value.items()])
    line = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    line = line.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(part, *within, *[F.coalesce(F.sum(total[k]).over(line), F.lit(0)).alias(past[k]) for k in value])
    inside = Window.partitionBy(part, *within).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    here = parts.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(k) for k, v in value.items()])
    cond = F.col(f"h.{part}") == F.col(f"b.{part}")
    for c in within:
        cond = cond & F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = here.alias("h").join(before.alias("b"), cond)
    return both.select(*[F.col(f"h.{c}") for c in df.columns], *[(F.col(f"h.{k}") + F.col(f"b.{past[k]}")).alias(k) for k in value])


def order_statistics(rows: DataFrame, cell: Sequence[str], value: str, asks: Sequence[tuple[float, Callable[[Column], Column]]], few: int = 50_000) -> DataFrame:
    """cell, ask, n and q: of each cell's n values that aren't null, the one at each asked rank, exactly. Rows without a
    cell are in none.

    An ask is a share of the cell and the rank, from 1, that it means among n. In a cell of more than `few` rows a
    mergeable sketch, right to a ten-thousandth of n, brackets each rank; what lies below is counted, and of what lies
    inside equal values are counted before they are put in line. So no task sees more than the different values of a
    bracket, however large or uniform a cell is, and no row is copied for each ask. A rank that isn't found is an error.
    """
    near, cell, each = max(5e-4, 2 / few), list(cell), range(len(asks))  # ranks of n + 1 may lie one off a share of n
    own = rows.where(F.col(value).isNotNull()).dropna(subset=cell).select(*cell, F.col(value).alias("_v"))
    edges = [float(min(max(share + d, 0.0), 1.0)) for share, _ in asks for d in (-near, near)]
    stats = own.groupBy(*cell).agg(F.count("*").alias("n"), F.percentile_approx("_v", edges, 10_000).alias("_a"))
    big = F.col("n") > few
    side = lambda j: F.when(big, F.array(*[F.col("_a")[2 * i + j] for i in each]))
    cells = sized(stats.select(*cell, "n", F.array(*[rank(F.col("n")).cast("long") for _, rank in asks]).alias("_k"), side(0).alias("_lo"), side(1).alias("_hi")))
    both = own.join(cells, cell)
    below = both.where("_lo IS NOT NULL").groupBy(*cell).agg(F.array(*[F.count_if(F.col("_v") < F.col("_lo")[i]) for i in each]).alias("_below"))
    known = sized(cells.join(below, cell, "left").select(*cell, "n", "_k", F.coalesce("_below", F.array(*[F.lit(0).cast("long") for _ in each])).alias("_below")))
    all_ = F.array(*[F.lit(i) for i in each])
    where = F.when(F.col("_lo").isNull(), F.array(F.lit(-1))).otherwise(F.filter(all_, lambda i: (F.col("_v") >= F.col("_lo")[i]) & (F.col("_v") <= F.col("_hi")[i])))
    counted = both.select(*cell, "_v", F.explode(where).alias("_part")).groupBy(*cell, "_part", "_v").agg(F.count("*").alias("_w"))
    line = Window.partitionBy(*cell, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_to", F.sum("_w").over(line)).join(known, cell)

    def meant(i: Column) -> Column:
        to = F.col("_to") + F.col("_below")[i]
        return ((F.col("_part") == -1) | (F.col("_part") == i)) & (F.col("_k")[i] <= to) & (F.col("_k")[i] > to - F.col("_w"))

    found = placed.select(*cell, F.explode(F.filter(all_, meant)).alias("ask"), F.col("_v").alias("q"))
    wanted = known.select(*cell, "n", F.explode(all_).alias("ask"))
    return wanted.join(found, [*cell, "ask"], "left").select(*cell, "ask", "n", F.coalesce("q", F.raise_error(F.lit("a rank lies outside its bracket"))).alias("q"))


def percentiles(rows: DataFrame, cell: Sequence[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """cell and a column a share: that quantile of the cell's values, between its two neighbours, exactly; see
    order_statistics. Without a cell, one row of all values. A cell without values has no row."""
    own = rows.select(*cell, F.lit(0).alias("_all"), value.alias("_x"))
    by = list(cell) or ["_all"]
    asks = [(p, lambda n, p=p, up=up: (F.ceil if up else F.floor)((n - 1) * F.lit(p)).cast("long") + 1) for p in shares.values() for up in (False, True)]
    found = order_statistics(own, by, "_x", asks)
    at = lambda i: F.max(F.when(F.col("ask") == i, F.col("q")))
    wide = found.groupBy(*by, "n").agg(*[at(i).alias(f"_{i}") for i in range(len(asks))])
    part = lambda p: (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
    return wide.select(*cell, *[(F.col(f"_{2 * i}") + (F.col(f"_{2 * i + 1}") - F.col(f"_{2 * i}")) * part(p)).alias(k) for i, (k, p) in enumerate(shares.items())])
