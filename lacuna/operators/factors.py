"""Factor switchboards, indices with fallback, dividends, calendars of days, and sweeps of bands made of quotes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import anchored_extrema
from .shared import sized

#: The factor of each symbol (others take the default), one that changes at a date, and symbols with an index of their own.
FACTORS: Mapping[str, str] = {"Brand#1": "Brand#11", "Brand#2": "Brand#11", "Brand#3": "Brand#12"}
DEFAULT, PIVOT = "Brand#13", ("Brand#4", "1998-01-01", "Brand#14")
OWN_INDEX: Mapping[str, str] = {"Brand#1": "Brand#15", "Brand#5": "Brand#16"}


def factor_label(symbol: Column, day: Column, factors: Mapping[str, str] = FACTORS, default: str = DEFAULT, pivot: tuple[str, str, str] = PIVOT) -> Column:
    """A symbol's factor on a day; the pivot's symbol takes its new one from the date on."""
    label = F.create_map(*[F.lit(x) for kv in factors.items() for x in kv])[symbol]
    return F.when((symbol == pivot[0]) & (day >= F.lit(pivot[1]).cast("date")), pivot[2]).otherwise(F.coalesce(label, F.lit(default)))


def with_switchboard(pairs: DataFrame, bars: DataFrame, window: int = 20) -> DataFrame:
    """Gaps with their factor's move (its close at the left edge, its open at the right one), the index of the symbol or
    else the common one, and two points: the stale close, and the close moved with the factor. Gaps without a factor or
    an index go."""
    line = Window.partitionBy("symbol").orderBy("ts")
    r = bars.withColumn("_r", F.log(F.col("close") / F.lag("close").over(line)))
    near = line.rowsBetween(1 - window, 0)
    index = r.select("symbol", "ts", F.when(F.count("_r").over(near) >= window // 2, F.stddev_samp("_r").over(near)).alias("vol"))
    labelled = pairs.withColumn("factor", factor_label(F.col("symbol"), F.col("fri_ts")))
    own = F.create_map(*[F.lit(x) for kv in OWN_INDEX.items() for x in kv])[F.col("symbol")]
    labelled = labelled.withColumn("_own", own)
    left = bars.select(F.col("symbol").alias("factor"), F.col("ts").alias("fri_ts"), F.col("close").alias("_l0"))
    right = bars.select(F.col("symbol").alias("factor"), F.col("ts").alias("mon_ts"), F.col("open").alias("_l1"))
    at = lambda name: index.select(F.col("symbol").alias(f"_s{name}"), F.col("ts").alias("fri_ts"), F.col("vol").alias(f"_v{name}"))
    rows = labelled.join(left, ["factor", "fri_ts"], "left").join(right, ["factor", "mon_ts"], "left")
    common = at("c").where(F.col("_sc") == DEFAULT).drop("_sc")
    rows = rows.join(common, "fri_ts", "left").join(at("o").withColumnRenamed("_so", "_own"), ["_own", "fri_ts"], "left")
    out = rows.withColumns({"factor_ret": F.try_divide(F.col("_l1"), F.col("_l0")) - 1, "vol_idx": F.when(F.col("_vo").isNotNull(), F.col("_own")).otherwise(F.lit(DEFAULT)), "vol_idx_close": F.coalesce("_vo", "_vc")})
    out = out.withColumns({"stale_point": F.col("fri_close"), "point": F.col("fri_close") * (1 + F.col("factor_ret"))})
    return out.dropna(subset=["factor_ret", "vol_idx_close"]).drop("_l0", "_l1", "_vo", "_vc", "_own")


def with_dividends(pairs: DataFrame, actions: DataFrame) -> DataFrame:
    """Gaps whose open has the dividends of the right edge put back; none is 0."""
    paid = actions.where(F.col("dividend_amount").isNotNull()).groupBy("symbol", F.col("event_date").alias("mon_ts")).agg(F.sum("dividend_amount").alias("dividend"))
    both = pairs.join(paid, ["symbol", "mon_ts"], "left").withColumn("dividend", F.coalesce("dividend", F.lit(0.0)))
    return both.withColumn("mon_open", F.col("mon_open") + F.col("dividend"))


def around(days: DataFrame, trading: DataFrame) -> DataFrame:
    """day, last_friday (the latest Friday with trading, that day in) and next_day (the first with trading after it).

    Days are few next to rows: both sides go into one line of dates."""
    both = days.select("day", F.lit(1).alias("_side")).unionByName(trading.select(F.col("ts").alias("day"), F.lit(0).alias("_side")))
    back = Window.partitionBy(F.lit(0)).orderBy("day", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(F.lit(0)).orderBy(F.desc("day"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    friday = F.last(F.when((F.col("_side") == 0) & (F.dayofweek("day") == 6), F.col("day")), ignorenulls=True).over(back)
    later = F.last(F.when(F.col("_side") == 0, F.col("day")), ignorenulls=True).over(ahead)
    return both.withColumns({"last_friday": friday, "next_day": later}).where("_side = 1").select("day", "last_friday", "next_day")


def local_time(day: Column, hour: int, minute: int, zone: str) -> Column:
    """A clock time of a day in a zone, as an instant."""
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr(f"INTERVAL {hour * 60 + minute} MINUTES"), zone)


def path_factors(panel: DataFrame, pivot: tuple[str, str, str] = PIVOT) -> DataFrame:
    """Gaps with the factor whose bars their path comes from; the pivot's go from its date on."""
    rows = panel.where(~((F.col("symbol") == pivot[0]) & (F.col("fri_ts") >= F.lit(pivot[1]).cast("date"))))
    return rows.withColumn("factor", factor_label(F.col("symbol"), F.col("fri_ts"), pivot=pivot))


def anchored_paths(panel: DataFrame, bars: DataFrame, zone: str = "America/New_York", pivot: tuple[str, str, str] = PIVOT, grace_s: int = 60) -> DataFrame:
    """Gaps with the path of their factor's bars (symbol, ts, low, high, close) from 16:00 on the left day to 09:30 on the
    right one, as if it began at the gap's close: factor, n_bars, anchor, path_lo and path_hi, times close / anchor.

    The pivot's symbol goes from its date on, as its new factor has no such bars; gaps go without a bar inside or a positive anchor."""
    rows = path_factors(panel, pivot).withColumns({"_from": local_time(F.col("fri_ts"), 16, 0, zone), "_to": local_time(F.col("mon_ts"), 9, 30, zone)})
    found = anchored_extrema(rows, bars.select(F.col("symbol").alias("factor"), "ts", "low", "high", "close"), "factor", "_from", "_to", grace_s).where("anchor > 0")
    scale = F.col("fri_close") / F.col("anchor")
    return found.withColumns({"path_lo": F.col("low") * scale, "path_hi": F.col("high") * scale}).withColumnRenamed("n", "n_bars").drop("low", "high", "_from", "_to")


def swept(rows: DataFrame, miss: Column, unit: Column, factors: Sequence[float], taus: Sequence[float]) -> DataFrame:
    """The least factor with which a band of factor units covers each share: tau, k, realised and mean_half."""
    each = rows.select(miss.alias("_m"), unit.alias("_u")).withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in factors])))
    held = each.groupBy("k").agg(F.avg((F.col("_m") <= F.col("k") * F.col("_u")).cast("double")).alias("realised"), F.avg(F.col("k") * F.col("_u")).alias("mean_half"))
    asked = held.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus]))).where(F.col("realised") >= F.col("tau"))
    best = asked.groupBy("tau").agg(F.min(F.struct("k", "realised", "mean_half")).alias("b"))
    return best.select("tau", "b.k", "b.realised", "b.mean_half")


def canonical(rows: DataFrame, column: str, known: DataFrame, suffix: str = "x") -> DataFrame:
    """rows with the underlying symbol of a token's (its suffix off) and its class, if it is known."""
    name = F.when(F.col(column).endswith(suffix), F.expr(f"left(`{column}`, length(`{column}`) - {len(suffix)})")).otherwise(F.col(column))
    return rows.withColumn("_s", name).join(sized(known.withColumn("_s", F.col("symbol"))), "_s", "left").drop("_s")
