"""Quorum routing of price reads, market regimes and receipts, and constant-product pools, in whole numbers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import cut, deviation_bps
from .shared import sized

# Kinds of upstream and whether they can be read, full closes and early closes of the exchange.
KINDS = {0: "pyth", 1: "chainlink_relay", 2: "switchboard", 3: "redstone"}
READABLE = ("pyth", "switchboard")
MOURNING = ("2025-01-09",)
EARLY = ("2024-07-03", "2024-11-29", "2024-12-24", "2025-07-03", "2025-11-28", "2025-12-24", "2026-11-27", "2026-12-24", "2027-11-26")


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday of a month (Monday is 0), counted from its end if n is negative."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def _easter(year: int) -> dt.date:
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    i = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * i) // 451
    n = h + i - 7 * m + 114
    return dt.date(year, n // 31, n % 31 + 1)


def full_closes(year: int) -> list[dt.date]:
    """The exchange's holidays of a year by its rules; one on a Saturday is kept the Friday before (but for New Year's
    Day), one on a Sunday the Monday after."""
    fixed = [dt.date(year, 1, 1), dt.date(year, 6, 19), dt.date(year, 7, 4), dt.date(year, 12, 25)]
    kept = [d + dt.timedelta({5: -1, 6: 1}.get(d.weekday(), 0)) for d in fixed if not (d.month == 1 and d.weekday() == 5)]
    moving = [_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), _easter(year) - dt.timedelta(2), _nth(year, 5, 0, -1), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4)]
    return sorted(kept + moving)


def holidays(spark: SparkSession, years: Sequence[int]) -> DataFrame:
    """day and early of the exchange's closes in some years: a few rows a year."""
    rows = [(d, False) for y in years for d in full_closes(y)] + [(d, False) for d in map(dt.date.fromisoformat, MOURNING) if d.year in years]
    closed = {d for d, _ in rows}
    rows += [(d, True) for d in map(dt.date.fromisoformat, EARLY) if d.year in years and d not in closed]
    return spark.createDataFrame(rows, "day date, early boolean")


def calendar_signal(rows: DataFrame, ts: str, days: DataFrame) -> DataFrame:
    """calendar: open from 9:30 to 16:00 New York time, to 13:00 on early closes, the right end out; closed on weekends
    and holidays."""
    local = F.from_utc_timestamp(ts, "America/New_York")
    both = rows.withColumn("_day", F.to_date(local)).withColumn("_min", F.hour(local) * 60 + F.minute(local)).join(sized(days.select(F.col("day").alias("_day"), "early")), "_day", "left")
    end = F.when(F.col("early"), 780).otherwise(960)
    shut = F.dayofweek("_day").isin(1, 7) | (F.col("early").isNotNull() & ~F.col("early"))
    return both.withColumn("calendar", F.when(shut | (F.col("_min") < 570) | (F.col("_min") >= end), "closed").otherwise("open")).drop("_day", "_min", "early")


def regime_of(oracle: Column, calendar: Column) -> Column:
    """open, closed, halted or unknown: a halt goes first; two signals that disagree, or none, give unknown; one alone is
    believed. oracle is open, extended, closed, halted or unknown, calendar open, closed or n/a."""
    opened = oracle.isin("open", "extended")
    return (
        F.when(oracle == "halted", "halted").when(opened & calendar.isin("open", "n/a"), "open").when((oracle == "closed") & calendar.isin("closed", "n/a"), "closed")
        .when((oracle == "unknown") & calendar.isin("open", "closed"), calendar).otherwise("unknown")
    )


def readable(reads: DataFrame) -> DataFrame:
    """Reads with the kind of their upstream, and why one can't be read: an unknown kind, or one without a reader."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("kind")]
    return reads.withColumn("upstream", kind).withColumn("unread", F.when(kind.isNull(), "unknown kind").when(~kind.isin(*READABLE), "not implemented"))


def lower_median(values: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The middle value of each group, the lower one of two."""
    line = Window.partitionBy(*by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*by))
    return values.select(*by, value, F.row_number().over(line).alias("_k"), n.alias("_n")).where("_k = (_n + 1) DIV 2").select(*by, F.col(value).alias(name))


def filtered(reads: DataFrame, by: list[str], now: Column, max_age_s: int, max_conf_bps: int, max_dev_bps: int) -> DataFrame:
    """Reads with why they are left out: stale, too unsure, too far from the provisional median; null if they count.

    A read without confidence, or with a price that isn't positive, passes the confidence test.
    """
    age = F.unix_seconds(now) - F.unix_seconds("ts")
    unsure = F.col("confidence").isNotNull() & (F.col("price") > 0) & (F.expr("confidence * 10000 DIV price") > max_conf_bps)
    first = reads.withColumn("reason", F.when(age > max_age_s, "stale").when(unsure, "unsure"))
    middle = lower_median(first.where("reason IS NULL"), by, "price", "_m")
    both = first.join(middle, by, "left")
    far = F.abs(deviation_bps(F.col("price"), F.col("_m"))) > max_dev_bps
    return both.withColumn("reason", F.coalesce("reason", F.when(far, "far"))).drop("_m")


def aggregated(reads: DataFrame, by: list[str], quorum: int) -> DataFrame:
    """For each group the median of the reads that count, their number, their range and the state of the quorum."""
    kept = reads.where("reason IS NULL")
    sums = reads.groupBy(*by).agg(F.count_if(F.col("reason").isNull()).alias("n"), F.min(F.when(F.col("reason").isNull(), F.col("price"))).alias("low"), F.max(F.when(F.col("reason").isNull(), F.col("price"))).alias("high"))
    state = F.when(F.col("n") == 0, "AllStale").when(F.col("n") < quorum, "LowQuorum").otherwise("Ok")
    return sums.join(lower_median(kept, by, "price", "median"), by, "left").withColumn("state", state)


def routed(aggregates: DataFrame, bands: DataFrame, by: list[str]) -> DataFrame:
    """Receipts: in an open regime the quorum's median, in a closed one the band's edges or BandUnavailable, else why
    there is none. aggregates has regime and what `aggregated` gives; bands point, lower and upper."""
    both = aggregates.join(bands.select(*by, "point", "lower", "upper"), by, "left")
    opened, closed = F.col("regime") == "open", F.col("regime") == "closed"
    fine = opened & (F.col("state") == "Ok")
    error = F.when(opened & ~fine, F.col("state")).when(closed & F.col("point").isNull(), "BandUnavailable").when(F.col("regime") == "halted", "Halted").when(F.col("regime") == "unknown", "RegimeAmbiguous")
    out = both.withColumns({"aggregate": F.when(fine, F.col("median")), "contributions": F.when(opened, F.col("n"))})
    return out.withColumns({"error": error, **{f"band_{c}": F.when(closed, F.col(c)) for c in ("point", "lower", "upper")}}).drop("point", "lower", "upper", "median", "low", "high", "n", "state")


def receipt_faults(receipts: DataFrame, quorum: int) -> Column:
    """What a receipt breaks, comma-joined: open ones have an aggregate, contributions of quorum size and no band; closed
    and halted ones the reverse; unknown ones say RegimeAmbiguous; no price without a reason."""
    c = F.col
    whole = c("error").isNull()
    rules = {
        "open without aggregate": (c("regime") == "open") & whole & c("aggregate").isNull(), "open under quorum": (c("regime") == "open") & whole & (F.coalesce("contributions", F.lit(0)) < quorum),
        "open with band": (c("regime") == "open") & c("band_point").isNotNull(), "closed with aggregate": c("regime").isin("closed", "halted") & (c("aggregate").isNotNull() | c("contributions").isNotNull()),
        "closed without band": (c("regime") == "closed") & whole & c("band_point").isNull(), "unknown without reason": (c("regime") == "unknown") & ~F.coalesce(c("error") == "RegimeAmbiguous", F.lit(False)),
        "band out of order": c("band_point").isNotNull() & ~((c("band_lower") <= c("band_point")) & (c("band_point") <= c("band_upper"))),
    }
    return F.array_join(F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull()), ", ")


def config_faults(configs: DataFrame) -> Column:
    """What an asset's configuration breaks: at most five upstreams, all of known kinds and active before inactive, a
    quorum within them, shares within 10,000."""
    kinds = F.col("kinds")
    active = F.transform(F.col("active"), lambda x: x.cast("int"))
    rules = {
        "upstreams": (F.size(kinds) < 1) | (F.size(kinds) > 5), "quorum": (F.col("quorum") < 1) | (F.col("quorum") > F.size(F.filter(F.col("active"), lambda x: x))),
        "kind": F.exists(kinds, lambda k: ~k.isin(*KINDS)), "order": active != F.sort_array(active, asc=False), "bps": (F.col("max_confidence_bps") > 10_000) | (F.col("max_deviation_bps") > 10_000),
    }
    return F.array_join(F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull()), ", ")


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def over(num: Column, den: Column) -> Column:
    """num / den, floored, of whole numbers that aren't negative; null over nothing."""
    return F.expr("0L") + F.when(den != 0, cut(num, den))


def swap_out(reserve_in: Column, reserve_out: Column, amount: Column, fee_bps: Column) -> Column:
    """What a constant-product pool pays, the fee taken from the input, all divisions floored."""
    net = F.floor(_wide(amount) * (10_000 - fee_bps).cast("decimal(10,0)") / 10_000).cast("decimal(18,0)")
    return cut((net * _wide(reserve_out)).cast("decimal(38,0)"), _wide(reserve_in) + net).cast("long")


def surcharge_bps(price: Column, lower: Column, upper: Column, slope_bps: int, most_bps: int) -> Column:
    """Inside the band nothing; outside, the distance in widths times the slope, up to a cap."""
    away = F.greatest(lower - price, price - upper, F.lit(0).cast("long"))
    return F.when(upper > lower, F.least(F.expr("0L") + cut(away.cast("decimal(24,0)") * slope_bps, _wide(upper - lower)).cast("long"), F.lit(most_bps))).otherwise(F.lit(most_bps))


def in_band(base: Column, quote: Column, lower: Column, upper: Column, exponent: int, base_decimals: int, quote_decimals: int) -> Column:
    """Whether quote / base stands between two fixed-point prices, by products, so that nothing is rounded."""
    k = quote_decimals - base_decimals + exponent
    q = quote.cast("decimal(38,0)") * F.lit(10 ** max(0, -k)).cast("decimal(19,0)") if k < 0 else quote.cast("decimal(38,0)")
    b = _wide(base) * F.lit(10**k).cast("decimal(10,0)") if k > 0 else _wide(base)
    product = lambda x: (x.cast("decimal(18,0)") * b).cast("decimal(38,0)")
    return (product(lower) <= q) & (q <= product(upper))


def quoted(swaps: DataFrame, exponent: int, base_decimals: int, quote_decimals: int, slope_bps: int, most_bps: int) -> DataFrame:
    """Swaps (reserves_base, reserves_quote, amount, side, lower, upper, fee) as a pool with a band would fill them.

    A first quote at the plain fee gives the price it would leave; if that is outside the band, the fee grows by the
    distance in widths times the slope, up to a cap and 9,999 at most, and the swap is quoted again. side is sell (base
    in) or buy. No amount, or a band upside down, gives the error and no quote.
    """
    c = F.col
    sell = c("side") == "sell"
    r_in, r_out = F.when(sell, c("reserves_base")).otherwise(c("reserves_quote")), F.when(sell, c("reserves_quote")).otherwise(c("reserves_base"))
    fine = (c("amount") > 0) & (c("lower") <= c("upper")) & (c("lower") >= 0)
    error = F.when(c("amount") <= 0, "ZeroAmountIn").when(c("lower") > c("upper"), "InvertedBand").when(c("lower") < 0, "NegativeBandValue")
    rows = swaps.withColumn("error", error).withColumn("_out", F.when(fine, swap_out(r_in, r_out, c("amount"), c("fee"))))
    base, quote = (F.when(sell, c("reserves_base") + c("amount")).otherwise(c("reserves_base") - c("_out")), F.when(sell, c("reserves_quote") - c("_out")).otherwise(c("reserves_quote") + c("amount")))
    rows = rows.withColumns({"_b": base, "_q": quote}).withColumn("in_band", F.when(fine, in_band(c("_b"), c("_q"), c("lower"), c("upper"), exponent, base_decimals, quote_decimals)))
    k = quote_decimals - base_decimals + exponent
    price = cut((c("_q").cast("decimal(38,0)") * F.lit(10 ** max(0, -k)).cast("decimal(19,0)")).cast("decimal(38,0)"), _wide(c("_b")) * F.lit(10 ** max(0, k)).cast("decimal(10,0)")).cast("long")
    extra = F.when(c("in_band"), 0).otherwise(surcharge_bps(price, c("lower"), c("upper"), slope_bps, most_bps))
    rows = rows.withColumn("fee_bps", F.when(fine, F.least(c("fee") + extra, F.lit(9_999)).cast("long")))
    out = F.when(c("in_band"), c("_out")).otherwise(swap_out(r_in, r_out, c("amount"), c("fee_bps")))
    net = F.floor(_wide(c("amount")) * (10_000 - c("fee_bps")).cast("decimal(10,0)") / 10_000).cast("long")
    rows = rows.withColumns({"out": F.when(fine, out), "fee_paid": c("amount") - net})
    return rows.drop("_out", "_b", "_q")


def root(x: Column) -> Column:
    """The whole square root of a whole number under 10^30: the float root put right by its neighbours."""
    r = F.floor(F.sqrt(x.cast("double"))).cast("decimal(18,0)")
    wide = x.cast("decimal(38,0)")
    square = lambda v: (v * v).cast("decimal(38,0)")
    near = [r + F.lit(i).cast("decimal(18,0)") for i in (2, 1, 0, -1)]
    out = r - F.lit(2).cast("decimal(18,0)")
    for v in reversed(near):
        out = F.when(square(v.cast("decimal(18,0)")) <= wide, v).otherwise(out)
    return out.cast("long")


def minted(deposits: DataFrame) -> DataFrame:
    """Deposits (base, quote, reserves_base, reserves_quote, supply) with the shares they get, the geometric mean for the
    first, else the smaller side's part, and what of both sides is used; nothing for nothing."""
    c = F.col
    first = c("supply") == 0
    part = lambda a, r: over((_wide(c(a)) * c("supply").cast("decimal(18,0)")).cast("decimal(38,0)"), _wide(c(r)))
    shares = F.when(first, root((_wide(c("base")) * c("quote").cast("decimal(18,0)")).cast("decimal(38,0)"))).otherwise(F.least(part("base", "reserves_base"), part("quote", "reserves_quote")).cast("long"))
    rows = deposits.withColumn("shares", F.when((c("base") > 0) & (c("quote") > 0) & (shares > 0), shares))
    used = lambda a, r: F.when(first, c(a)).otherwise(over((c("shares").cast("decimal(18,0)") * _wide(c(r))).cast("decimal(38,0)"), _wide(c("supply"))).cast("long"))
    return rows.withColumns({"base_used": F.when(c("shares").isNotNull(), used("base", "reserves_base")), "quote_used": F.when(c("shares").isNotNull(), used("quote", "reserves_quote"))})


def redeemed(redeems: DataFrame) -> DataFrame:
    """Redemptions (shares, reserves_base, reserves_quote, supply) with what they pay; null for none, or more than all."""
    c = F.col
    fine = (c("shares") > 0) & (c("shares") <= c("supply"))
    pay = lambda r: F.when(fine, over((c("shares").cast("decimal(18,0)") * _wide(c(r))).cast("decimal(38,0)"), _wide(c("supply"))).cast("long"))
    return redeems.withColumns({"base_out": pay("reserves_base"), "quote_out": pay("reserves_quote")})
