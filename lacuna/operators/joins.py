"""Joins in time: as-of, nearest, interval, calendar flags, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import sized, written


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], order: str, within_s: int | None = None) -> DataFrame:
    """Each left row with the last right row at or before it (ties by order), not older than within_s seconds.

    Both sides go into one line a key, sorted once; the last right values are carried along. No pairs are made, however
    dense either side is.
    """
    kept = F.struct(F.col(ts).alias("at"), *values)
    r = right.select(key, ts, F.lit(0).alias("_side"), F.col(order).cast("long").alias("_o"), kept.alias("_v"))
    names = [c for c in left.columns if c not in (key, ts)]
    lone = left.select(key, ts, F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_o"), *[F.col(c) for c in names])
    both = lone.unionByName(r, allowMissingColumns=True)
    line = Window.partitionBy(key).orderBy(ts, "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_v", ignorenulls=True).over(line)).where("_side = 1")
    fresh = F.col("_last").isNotNull()
    if within_s is not None:
        fresh = fresh & (F.unix_micros(ts) - F.unix_micros(F.col("_last.at")) <= within_s * 1_000_000)
    return seen.select(key, ts, *names, *[F.when(fresh, F.col(f"_last.{v}")).alias(v) for v in values], F.when(fresh, F.col("_last.at")).alias("as_of"))


def session_as_of(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], order: str, session: str, wanted: str, within_s: int, by_day: bool = False) -> DataFrame:
    """as_of among right rows of the wanted session; where it has none in reach, among all. by_day: for keys that may hold
    a large part of all rows."""
    find = as_of_by_day if by_day else as_of
    best = find(left, right.where(F.col(session) == wanted), key, ts, values, order, within_s)
    held = best.select(key, ts, *[c for c in left.columns if c not in (key, ts)], *[F.col(v).alias(f"_held_{v}") for v in values], F.col("as_of").alias("_held_at"))
    both = find(held, right, key, ts, values, order, within_s)
    use = F.col("_held_at").isNotNull()
    return both.select(*left.columns, *[F.when(use, F.col(f"_held_{v}")).otherwise(F.col(v)).alias(v) for v in values], F.coalesce("_held_at", "as_of").alias("as_of"))


def nearest(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, order: str, within_s: int = 1800) -> DataFrame:
    """Each left row with the right row nearest in time, within_s at most; ties go to the earlier, then to the order."""
    back = as_of(left, right, key, ts, [value, order], order, within_s)
    back = back.select(*left.columns, F.struct(F.col("as_of").alias("at"), value, order).alias("_b"))
    ahead_rows = right.withColumn("_neg", -F.unix_micros(ts)).select(key, F.timestamp_micros("_neg").alias(ts), value, order, (-F.col(order).cast("long")).alias("_o"))
    ahead_left = back.withColumn(ts, F.timestamp_micros(-F.unix_micros(ts)))
    both = as_of(ahead_left, ahead_rows, key, ts, [value, order], "_o", within_s)
    both = both.withColumn(ts, F.timestamp_micros(-F.unix_micros(ts))).withColumn("as_of", F.timestamp_micros(-F.unix_micros("as_of")))
    lag = F.when(F.col("_b.at").isNotNull(), F.unix_micros(ts) - F.unix_micros("_b.at"))
    lead = F.unix_micros("as_of") - F.unix_micros(ts)
    use = lag.isNotNull() & (F.col("as_of").isNull() | (lag <= lead))
    return both.select(*left.columns, F.when(use, F.col(f"_b.{value}")).otherwise(F.col(value)).alias(value), F.when(use, lag).otherwise(lead).alias("off_us"))


def interval_extrema(windows: DataFrame, ticks: DataFrame, key: str, start: str, end: str, ts: str, value: str, least: int = 1) -> DataFrame:
    """Lowest, highest and number of ticks inside each [start, end] window, and the times of both.

    Windows are spread over the days that they touch and meet ticks by key and day, so no window meets all ticks of a key.
    """
    days = windows.withColumn("_day", F.explode(F.sequence(F.to_date(start), F.to_date(end))))
    own = ticks.select(key, F.to_date(ts).alias("_day"), F.col(ts).alias("_ts"), F.col(value).alias("_x"))
    both = days.join(own, [key, "_day"]).where((F.col("_ts") >= F.col(start)) & (F.col("_ts") <= F.col(end)))
    out = both.groupBy(*windows.columns).agg(F.count("*").alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"), F.min(F.struct("_x", "_ts"))["_ts"].alias("low_ts"), F.min(F.struct(-F.col("_x"), "_ts"))["_ts"].alias("high_ts"))
    return out.where(F.col("n") >= least)


def as_of_by_day(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], order: str, within_s: int | None = None) -> DataFrame:
    """What as_of gives, for keys that may hold a large part of all rows: a line holds one day of a key, and what was last
    seen on days before comes from a line of one row a key and day. Left rows without a key or a time see nothing."""
    kept = F.struct(F.col(ts).alias("at"), F.col(order).cast("long").alias("o"), *values)
    r = right.where(F.col(ts).isNotNull()).select(key, ts, F.to_date(ts).alias("_day"), F.lit(0).alias("_side"), kept.alias("_v"))
    names = [c for c in left.columns if c not in (key, ts)]
    lone = left.select(key, ts, F.to_date(ts).alias("_day"), F.lit(1).alias("_side"), *names)
    days = r.select(key, "_day", "_v").unionByName(lone.select(key, "_day"), allowMissingColumns=True).groupBy(key, "_day").agg(F.max("_v").alias("_v"))
    before = F.last("_v", ignorenulls=True).over(Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    held = days.select(key, "_day", before.alias("_before")).where("_before IS NOT NULL")
    line = Window.partitionBy(key, "_day").orderBy(ts, "_side", "_v.o").rowsBetween(Window.unboundedPreceding, 0)
    seen = lone.unionByName(r, allowMissingColumns=True).withColumn("_here", F.last("_v", ignorenulls=True).over(line)).where("_side = 1")
    seen = seen.join(held, [key, "_day"], "left").withColumn("_last", F.when(F.col(key).isNotNull() & F.col(ts).isNotNull(), F.coalesce("_here", "_before")))
    fresh = F.col("_last").isNotNull()
    if within_s is not None:
        fresh = fresh & (F.unix_micros(ts) - F.unix_micros(F.col("_last.at")) <= within_s * 1_000_000)
    return seen.select(key, ts, *names, *[F.when(fresh, F.col(f"_last.{v}")).alias(v) for v in values], F.when(fresh, F.col("_last.at")).alias("as_of"))


def anchored_extrema(windows: DataFrame, ticks: DataFrame, key: str, start: str, end: str, grace_s: int = 60) -> DataFrame:
    """windows with what their key's ticks (ts, low, high, close) did inside [start, end]: n, low and high, and the anchor:
    the last close up to grace_s seconds after the start, else the first inside. Windows without a tick inside go; of ticks
    at one time the greatest close counts.

    Windows that many rows share are looked at once, spread over the days that they touch. What is found in them is
    written before the anchors are looked for; ticks are read three times and should be a table by then.
    """
    own = windows.select(key, start, end).distinct()
    days = sized(own.withColumn("_day", F.explode(F.sequence(F.to_date(start), F.to_date(end)))))
    inside = ticks.select(key, F.to_date("ts").alias("_day"), F.col("ts").alias("_ts"), F.col("low").alias("_l"), F.col("high").alias("_h"), F.struct("ts", (-F.col("close")).alias("down")).alias("_c"))
    both = days.join(inside, [key, "_day"]).where((F.col("_ts") >= F.col(start)) & (F.col("_ts") <= F.col(end)))
    g = both.groupBy(key, start, end).agg(F.count("*").alias("n"), F.min("_l").alias("low"), F.max("_h").alias("high"), (-F.min("_c")["down"]).alias("_first"))
    g = written(g.withColumn("_at", F.timestamp_micros(F.unix_micros(start) + grace_s * 1_000_000)), "inside")
    last = ticks.groupBy(key, F.col("ts").alias("_at")).agg(F.max("close").alias("_pre")).withColumn("_o", F.lit(0))
    seen = as_of_by_day(g, last, key, "_at", ["_pre"], "_o")
    return windows.join(seen.select(key, start, end, "n", "low", "high", F.coalesce("_pre", "_first").alias("anchor")), [key, start, end])


def minutes_after(asks: DataFrame, ticks: DataFrame, key: str, ts: str, order: str, minutes: int = 60, within_s: int = 86_400) -> DataFrame:
    """asks once for each whole minute of the so many after their own, with the order of their key's last tick at or before
    the minute (ties by order); minutes whose last tick is older than within_s go.

    Ticks count by minutes, of which the last one is seen, and asks of one minute are looked up once: by what was seen at
    the first minute and the ticks that came later, at most one a minute. The grid is laid out from these pieces at the
    end, row by row, so that it is neither sorted nor sent around, however dense either side is.
    """
    us, step = 60_000_000, 60_000_000 * minutes
    down = lambda x, unit: x - F.pmod(x, F.lit(unit))
    first = down(F.unix_micros(ts), us) + us
    wanted = asks.withColumn("_first", first).where(F.col(key).isNotNull() & F.col("_first").isNotNull())
    up = down(F.unix_micros(ts) + (us - 1), us)
    known = ticks.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key, up.alias("_at")).agg(F.max(F.struct(F.unix_micros(ts).alias("us"), F.col(order).alias("o"))).alias("_v"))
    starts, line = wanted.select(key, "_first").distinct(), Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = known.withColumn("_side", F.lit(0)).unionByName(starts.select(key, F.col("_first").alias("_at"), F.lit(1).alias("_side")), allowMissingColumns=True)
    held = both.withColumn("_v", F.last("_v", ignorenulls=True).over(line)).where("_side = 1 AND _v IS NOT NULL").select(key, F.col("_at").alias("_first"), "_at", "_v")
    last = F.col("_first") + (step - us)
    spans = starts.withColumn("_span", F.explode(F.sequence(down(F.col("_first") + us, step), down(last, step), F.lit(step).cast("long"))))
    later = spans.join(known.withColumn("_span", down(F.col("_at"), step)), [key, "_span"]).where((F.col("_at") > F.col("_first")) & (F.col("_at") <= last))
    pieces = held.unionByName(later.select(key, "_first", "_at", "_v")).groupBy(key, "_first").agg(F.sort_array(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_v.us").alias("us"), F.col("_v.o").alias("o")))).alias("_p"))
    names = [c for c in asks.columns if c not in (ts, order)]
    until = lambda i: F.coalesce(F.get("_p", i + 1)["at"] - us, last)
    laid = wanted.join(pieces, [key, "_first"]).select(*names, "_first", F.explode(F.transform("_p", lambda p, i: F.struct(p.alias("p"), until(i).alias("to")))).alias("_x"))
    fresh = F.least(F.col("_x.to"), down(F.col("_x.p.us") + within_s * 1_000_000, us))
    laid = laid.withColumn("_to", fresh).where(F.col("_to") >= F.col("_x.p.at"))
    return laid.select(*names, F.col("_x.p.o").alias(order), F.explode(F.sequence("_x.p.at", "_to", F.lit(us).cast("long"))).alias("_m")).withColumn(ts, F.timestamp_micros("_m")).drop("_m")


def event_within(panel: DataFrame, events: DataFrame, days: int = 4) -> DataFrame:
    """earnings_next_week: whether the symbol has an event from the right edge on, so many days long."""
    spread = events.select("symbol", "event_date").distinct().withColumn("mon_ts", F.explode(F.sequence(F.date_sub("event_date", days), "event_date"))).select("symbol", "mon_ts").distinct().withColumn("_hit", F.lit(True))
    return panel.join(spread, ["symbol", "mon_ts"], "left").withColumn("earnings_next_week", F.coalesce("_hit", F.lit(False))).drop("_hit")


def event_overnight(panel: DataFrame, events: DataFrame) -> DataFrame:
    """earnings_night: an event after the left day's close or before the right day's open. One denied is left out; one
    that is neither confirmed nor denied counts."""
    kept = events.where(F.coalesce("confirmed", F.lit(True)))
    after = kept.where("session = 'amc'").select("symbol", F.col("event_date").alias("fri_ts")).distinct().withColumn("_a", F.lit(True))
    before = kept.where("session = 'bmo'").select("symbol", F.col("event_date").alias("mon_ts")).distinct().withColumn("_b", F.lit(True))
    both = panel.join(after, ["symbol", "fri_ts"], "left").join(before, ["symbol", "mon_ts"], "left")
    return both.withColumn("earnings_night", F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))).drop("_a", "_b")


def commitment_audit(committed: DataFrame, published: DataFrame, key: list[str], width: str, tolerance: float = 1e-6) -> DataFrame:
    """Each commitment or publication: matched, width_mismatch, unbacked (published alone) or lapsed (committed alone); of a
    publication with a commitment whether its middle lies off its point, and what factor the point implies on the
    committed close. published has lower, upper and point, committed fri_close."""
    a = committed.select(*key, F.col(width).alias("_cw"), "fri_close")
    b = published.select(*key, F.col(width).alias("_pw"), "point", ((F.col("lower") + F.col("upper")) / 2).alias("_mid"))
    off = F.abs(F.col("_cw") - F.col("_pw")) > tolerance * F.greatest(F.abs("_cw"), F.abs("_pw"))
    verdict = F.when(F.col("_cw").isNull(), "unbacked").when(F.col("_pw").isNull(), "lapsed").when(off, "width_mismatch").otherwise("matched")
    both = F.col("_cw").isNotNull() & F.col("_pw").isNotNull()
    skew = F.abs(F.col("_mid") - F.col("point")) > tolerance * F.greatest(F.abs("point"), F.lit(1e-12))
    return a.join(b, key, "full").select(*key, verdict.alias("verdict"), F.when(both, skew).alias("asymmetric"), F.when(both, F.col("point") / F.col("fri_close") - 1).alias("implied_factor"))
