"""Binary price records as columns: words of big-endian reports, little-endian accounts, fixed point and code maps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cut

# Codes on the wire, layouts and limits of the records.
REGIMES = {"normal": 0, "long_weekend": 1, "high_vol": 2}
FORECASTERS = {"F1_emp_regime": 0, "F0_stale": 1, "mondrian": 2, "lwc": 3}
PROFILES = {"legacy": 0, "lending": 1, "amm": 2}
V10 = ("feed_id", "valid_from", "observed", "native_fee", "link_fee", "expires", "last_update_ns", "price", "market_status", "multiplier", "new_multiplier", "activation", "tokenized_price")
V11 = ("feed_id", "valid_from", "observed", "native_fee", "link_fee", "expires", "mid", "last_seen_ns", "bid", "bid_volume", "ask", "ask_volume", "last_traded", "market_status")
PRICES = {"price", "multiplier", "new_multiplier", "tokenized_price", "mid", "bid", "bid_volume", "ask", "ask_volume", "last_traded"}
WORD = 64  # hex digits


def _whole(n: int) -> Column:
    """A whole number too large for a literal."""
    return F.lit(str(n)).cast("decimal(38,0)")


def code_of(name: Column, codes: Mapping[str, int], other: int = 255) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[name], F.lit(other))


def name_of(code: Column, codes: Mapping[str, int]) -> Column:
    """The name of a code; null for one that has none."""
    return F.create_map(*[F.lit(x) for k, v in codes.items() for x in (v, k)])[code]


def _unsigned(digits: Column) -> Column:
    """A number of up to 30 hex digits, exactly."""
    part = lambda i: F.conv(F.substring(F.lpad(digits, 30, "0"), 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    return (part(0) * _whole(1 << 60).cast("decimal(19,0)") + part(1)).cast("decimal(38,0)")


def word(hexed: Column, i: int, signed: bool = False) -> Column:
    """The i-th 32-byte word of a report, as a whole number; one that 120 bits don't hold gives null."""
    digits = F.substring(hexed, 1 + WORD * i, WORD)
    low, high = F.substring(digits, 35, 30), F.substring(digits, 1, 34)
    small = F.when((F.length(digits) == WORD) & (high == "0" * 34), _unsigned(low))
    if not signed:
        return small
    negative = (high == "F" * 34) & (F.substring(low, 1, 1) >= "8")
    under = -(_unsigned(F.translate(low, "0123456789ABCDEF", "FEDCBA9876543210")) + 1)
    return F.when(negative, under).when(F.substring(low, 1, 1) < "8", small)


def report(rows: DataFrame, raw: str, layout: tuple[str, ...]) -> DataFrame:
    """A report's fields: feed id as hex, whole numbers, prices in units of 10^-18. Too few bytes, or a price beyond 18
    digits before the point, give nulls."""
    hexed = F.hex(raw)
    long_enough = F.octet_length(raw) >= 32 * len(layout)
    fields = {}
    for i, name in enumerate(layout):
        if name == "feed_id":
            value = F.lower(F.substring(hexed, 1, WORD))
        elif name in PRICES:
            value = (word(hexed, i, True) / F.lit(10**9).cast("decimal(10,0)") / F.lit(10**9).cast("decimal(10,0)")).cast("double")
        else:
            value = word(hexed, i).cast("long")
        fields[name] = F.when(long_enough, value)
    return rows.withColumns(fields)


def plausible(rows: DataFrame) -> Column:
    """Whether a v11 report may be what it claims: time between 2025 and 2028, mid between a cent and 100,000, a known
    status."""
    return F.coalesce(F.col("observed").between(1_735_689_600, 1_830_297_600) & F.col("mid").between(0.01, 100_000.0) & F.col("market_status").between(0, 5), F.lit(False))


def report_bytes(fields: Mapping[str, Column], layout: tuple[str, ...]) -> Column:
    """A report of whole-number columns (and a feed id in hex): the other way round."""
    made = []
    for name in layout:
        v = fields[name]
        if name == "feed_id":
            made.append(F.lpad(F.upper(v), WORD, "0"))
        else:
            made.append(F.lpad(F.hex(v.cast("long")), WORD, "0") if name not in PRICES else F.when(v < 0, F.concat(F.lit("F" * 48), F.hex(v.cast("long")))).otherwise(F.lpad(F.hex(v.cast("long")), WORD, "0")))
    return F.unhex(F.concat(*made))


def rescaled(raw: Column, from_exp: int, to_exp: int) -> Column:
    """A fixed-point number at another exponent, cut toward zero; null where a 64-bit number can't hold it, or the
    exponents are more than 38 apart."""
    gap = to_exp - from_exp
    if abs(gap) > 38:
        return F.lit(None).cast("long")
    wide = raw.cast("decimal(38,0)")
    if gap > 0:
        out = F.lit(0).cast("decimal(38,0)") if gap > 18 and gap >= 19 else cut(wide, F.lit(10**gap).cast("decimal(20,0)"))
    else:
        limit = (1 << 63) // 10**-gap
        out = F.when(F.abs(wide) <= F.lit(limit).cast("decimal(20,0)"), (wide * F.lit(10 ** min(-gap, 18)).cast("decimal(19,0)")).cast("decimal(38,0)")) if -gap <= 18 else F.when(wide == 0, wide)
    return F.when(out.between(F.lit(-(1 << 63)).cast("decimal(20,0)"), F.lit((1 << 63) - 1).cast("decimal(20,0)")), out.cast("long"))


def _reversed(hexed: Column, size: int) -> Column:
    """Hex of the bytes the other way round."""
    return F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])


def little(value: Column, size: int) -> Column:
    """A whole number in little-endian hex."""
    return _reversed(F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * size, 2 * size), size)


def little_read(hexed: Column, at: int, size: int, signed: bool = False) -> Column:
    """The whole number of some bytes, little end first."""
    digits = _reversed(F.substring(hexed, 1 + 2 * at, 2 * size), size)
    value = F.conv(digits, 16, 10).cast("decimal(20,0)")
    if signed:
        value = F.when(value >= _whole(1 << (8 * size - 1)), value - _whole(1 << (8 * size))).otherwise(value)
    return F.when(F.length(digits) == 2 * size, value.cast("long"))


def symbol_bytes(symbol: Column, size: int = 16) -> Column:
    """A symbol in hex, filled up with zero bytes; null if it is too long."""
    return F.when(F.octet_length(symbol) <= size, F.rpad(F.hex(symbol.cast("binary")), 2 * size, "0"))


def symbol_read(hexed: Column) -> Column:
    return F.decode(F.unhex(F.regexp_replace(hexed, "(00)+$", "")), "UTF-8")


def coverage_bps(x: Column) -> Column:
    """A share in whole basis points; null outside 0 to 10,000."""
    bps = F.round(x * 10_000).cast("int")
    return F.when(bps.between(0, 10_000), bps)


def payload(rows: DataFrame, exponent: int = -8) -> DataFrame:
    """rows (symbol, regime, forecaster, profile, target, served, buffer, point, lower, upper, fri_close, fri_ts) with
    payload, the 67 bytes that are published, little ends first; null where a field doesn't fit. fri_ts is 20:00 UTC."""
    fixed = lambda c: little(F.round(F.col(c) * 10.0**-exponent), 8)
    fields = [
        F.lit("01"), little(code_of(F.col("regime"), REGIMES), 1), little(code_of(F.col("forecaster"), FORECASTERS), 1), little(F.lit(exponent), 1), little(code_of(F.col("profile"), PROFILES), 1),
        *[little(coverage_bps(F.col(c)), 2) for c in ("target", "served", "buffer")], symbol_bytes(F.col("symbol")), *[fixed(c) for c in ("point", "lower", "upper", "fri_close")],
        little(F.unix_date("fri_ts").cast("long") * 86_400 + 72_000, 8),
    ]
    return rows.withColumn("payload", F.unhex(F.concat(*fields)))


def payload_read(rows: DataFrame, raw: str = "payload") -> DataFrame:
    """What a payload says, prices scaled by its exponent, and whether it may be trusted: lower <= point <= upper, shares
    within 10,000, known profile, exponent within [-12, 0], version 1."""
    h = F.hex(raw)
    whole = {
        "version": (0, 1, False), "regime_code": (1, 1, False), "forecaster_code": (2, 1, False), "exponent": (3, 1, True), "profile_code": (4, 1, False),
        "target_bps": (5, 2, False), "served_bps": (7, 2, False), "buffer_bps": (9, 2, False), "raw_point": (27, 8, True), "raw_lower": (35, 8, True), "raw_upper": (43, 8, True), "raw_close": (51, 8, True), "as_of": (59, 8, True),
    }
    out = rows.withColumns({k: little_read(h, *v) for k, v in whole.items()}).withColumn("symbol_read", symbol_read(F.substring(h, 23, 32)))
    unit = F.pow(F.lit(10.0), F.col("exponent"))
    out = out.withColumns({k: F.col(f"raw_{k}") * unit for k in ("point", "lower", "upper", "close")})
    fine = [
        ("version", F.col("version") == 1), ("band", (F.col("raw_lower") <= F.col("raw_point")) & (F.col("raw_point") <= F.col("raw_upper"))),
        ("coverage", F.greatest("target_bps", "served_bps", "buffer_bps") <= 10_000), ("exponent", F.col("exponent").between(-12, 0)), ("profile", F.col("profile_code").isin(1, 2)),
    ]
    error = None
    for name, good in fine:
        error = F.when(~F.coalesce(good, F.lit(False)), name) if error is None else error.when(~F.coalesce(good, F.lit(False)), name)
    half = F.when(F.col("raw_point") != 0, (F.col("upper") - F.col("lower")) / 2 / F.col("point") * 10_000)
    return out.withColumns({"regime": name_of(F.col("regime_code"), REGIMES), "forecaster": name_of(F.col("forecaster_code"), FORECASTERS), "half_width_bps": half, "error": error})


def published(rows: DataFrame, by: str, ts: str, least_s: int) -> DataFrame:
    """Records in order of time with why one is refused: its own error, or too soon after the last accepted one.

    Gaps are counted from the last accepted record. Records closer than least_s to the one before form a chain; a chain is
    folded, so that one group's records are read once in order.
    """
    from pyspark.sql import Window

    line = Window.partitionBy(by).orderBy(ts)
    good = rows.withColumn("_t", F.when(F.col("error").isNull(), F.unix_seconds(ts)))
    near = good.withColumn("_b", F.last("_t", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    chain = near.withColumn("_c", F.sum(F.when(F.col("_b").isNull() | (F.col("_t") - F.col("_b") >= least_s), 1).otherwise(0)).over(line))
    held = chain.where("_t IS NOT NULL").groupBy(by, "_c").agg(F.sort_array(F.collect_set("_t")).alias("_ts"))  # one chain: records within least_s of each other
    last = lambda a: F.element_at(a, -1)
    step = lambda a, t: F.when((F.size(a) == 0) | (t - last(a) >= least_s), F.concat(a, F.array(t))).otherwise(a)
    taken = held.select(by, "_c", F.aggregate("_ts", F.array().cast("array<bigint>"), step).alias("_taken"))
    both = chain.join(taken, [by, "_c"], "left")
    soon = F.col("error").isNull() & ~F.array_contains("_taken", F.col("_t"))
    return both.withColumn("error", F.coalesce("error", F.when(soon, "cadence"))).drop("_t", "_b", "_c", "_taken")
