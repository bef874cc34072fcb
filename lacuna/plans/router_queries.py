"""Queries of routing, regimes, receipts, pools and binary records, each with the same rows in SQL where it can."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import decode as B
from ..operators import route as R
from ..operators import wire as W
from ..operators.shared import sized
from ..sources import market as M
from .market_queries import QUERIES as _MARKET
from .market_queries import reads
from .panel_queries import PANEL, SERVED, bands, panel


def moved(s, d):  # noqa: ANN001, ANN201
    """Events, in the years that the exchange's calendar is known for: 2024 and after, by whole days."""
    return M.table(s, d, "events").select("event_id", "event_type", (F.col("ts").cast("timestamp") + F.expr("INTERVAL 180 DAYS")).alias("ts"), "value")


def q_calendar(s, d):  # noqa: ANN001, ANN201
    out = R.calendar_signal(moved(s, d), "ts", R.holidays(s, range(2020, 2030)))
    return out.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "calendar")


def q_holidays(s, d):  # noqa: ANN001, ANN201
    return R.holidays(s, range(2024, 2028))


def signalled(s, d):  # noqa: ANN001, ANN201
    """Events as an oracle's word next to the calendar's."""
    oracle = F.create_map(*[F.lit(x) for x in ("view", "open", "click", "extended", "purchase", "closed", "error", "halted", "signup", "unknown")])
    out = R.calendar_signal(moved(s, d), "ts", R.holidays(s, range(2020, 2030)))
    return out.withColumn("oracle", F.coalesce(oracle[F.col("event_type")], F.lit("unknown"))).withColumn("calendar", F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("calendar")))


def q_regimes(s, d):  # noqa: ANN001, ANN201
    rows = signalled(s, d)
    return rows.select("event_id", "oracle", "calendar", R.regime_of(F.col("oracle"), F.col("calendar")).alias("regime"))


def q_upstreams(s, d):  # noqa: ANN001, ANN201
    rows = R.readable(M.table(s, d, "lineitem").select((F.col("l_linenumber") - 1).alias("kind")))
    return rows.groupBy("kind", "upstream", "unread").agg(F.count("*").alias("n"))


def receipts(s, d):  # noqa: ANN001, ANN201
    """Each asset's receipt under a regime that its number stands for; bands exist for most assets."""
    regime = F.element_at(F.array(*[F.lit(x) for x in ("open", "closed", "halted", "unknown")]), (F.col("asset") % 4 + 1).cast("int"))
    rows = R.filtered(reads(s, d), ["asset"], F.expr("TIMESTAMP '2000-06-01 00:00:00'"), 3 * 365 * 86_400, 250, 5_000)
    agg = R.aggregated(rows, ["asset"], 3).withColumn("regime", regime)
    part = M.table(s, d, "part").where("p_size > 5")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    return R.routed(agg, part.select(F.col("p_partkey").alias("asset"), cents.alias("point"), (cents - F.col("p_size")).alias("lower"), (cents + F.col("p_size")).alias("upper")), ["asset"])


def q_receipts(s, d):  # noqa: ANN001, ANN201
    return receipts(s, d)


def q_receipt_faults(s, d):  # noqa: ANN001, ANN201
    """Receipts, and receipts whose regime was changed under them: what each breaks."""
    rows = receipts(s, d)
    turned = rows.withColumn("regime", F.when(F.col("regime") == "open", "closed").when(F.col("regime") == "closed", "open").otherwise("open"))
    both = rows.withColumn("changed", F.lit(False)).unionByName(turned.withColumn("changed", F.lit(True)))
    return both.groupBy("changed", R.receipt_faults(both, 3).alias("faults")).agg(F.count("*").alias("n"))


def q_configs(s, d):  # noqa: ANN001, ANN201
    """Configurations made of a part's suppliers: what each breaks."""
    l = M.table(s, d, "lineitem").groupBy("l_partkey").agg(F.sort_array(F.collect_set(F.col("l_linenumber") - 1)).alias("kinds"))
    rows = l.select("l_partkey", "kinds", F.transform("kinds", lambda k: k != 1).alias("active"), (F.col("l_partkey") % 6).cast("int").alias("quorum"), (F.col("l_partkey") % 12_000).alias("max_confidence_bps"), F.lit(500).alias("max_deviation_bps"))
    return rows.groupBy(R.config_faults(rows).alias("faults")).agg(F.count("*").alias("n"))


def pools(s, d):  # noqa: ANN001, ANN201
    """Swaps against a pool of each part, prices in cents per unit; lines sell or buy."""
    part = M.table(s, d, "part").select("p_partkey", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    l = M.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_discount") * 1000).cast("long").alias("fee"))
    both = l.join(part, F.col("l_partkey") == F.col("p_partkey"))
    base = F.col("p_size") * 100 + 400
    sell = (F.col("l_linenumber") % 2) == 1
    return both.select(
        "l_orderkey", "l_linenumber", "l_partkey", base.cast("long").alias("reserves_base"), (base * F.col("cents")).cast("long").alias("reserves_quote"), F.when(sell, F.col("quantity")).otherwise(F.col("quantity") * F.col("cents")).alias("amount"),
        F.when(sell, "sell").otherwise("buy").alias("side"), F.floor(F.col("cents") * 95 / 100).alias("lower"), F.floor(F.col("cents") * 105 / 100).alias("upper"), "fee",
    )


def q_quotes(s, d):  # noqa: ANN001, ANN201
    out = R.quoted(pools(s, d), 0, 0, 0, 100, 300)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "side", "in_band", F.col("out").cast("long").alias("paid"), F.col("fee_paid").cast("long").alias("fee_paid"), F.col("fee_bps").cast("long").alias("fee_bps"))


def q_in_band(s, d):  # noqa: ANN001, ANN201
    rows = pools(s, d).withColumn("k", F.when(F.col("side") == "sell", R.in_band(F.col("reserves_base") + F.col("amount"), F.col("reserves_quote"), F.col("lower"), F.col("upper"), 0, 0, 0)))
    return rows.where("side = 'sell'").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if("k").alias("inside"))


def q_mint(s, d):  # noqa: ANN001, ANN201
    """Shares of deposits, the first of a pool and later ones, and what they pay when they leave."""
    rows = pools(s, d).where("side = 'buy'").select("l_orderkey", "l_linenumber", F.col("fee").alias("base"), "amount", "reserves_base", "reserves_quote", F.when(F.col("l_linenumber") == 2, 0).otherwise(F.col("reserves_base") * 7).cast("long").alias("supply")).withColumnRenamed("amount", "quote")
    out = R.redeemed(R.minted(rows))
    return out.select("l_orderkey", "l_linenumber", "base", "quote", "supply", "shares", "base_used", "quote_used", "base_out", "quote_out")


def q_v10(s, d):  # noqa: ANN001, ANN201
    """Ticks written as v10 reports and decoded from their bytes."""
    e = M.tape(s, d)
    cents = F.round(F.col("value") * 100).cast("long")
    fields = {
        "feed_id": F.sha2("symbol", 256), "valid_from": F.unix_seconds("ts"), "observed": F.unix_seconds("ts"), "native_fee": F.lit(0), "link_fee": F.lit(0), "expires": F.unix_seconds("ts") + 3600, "last_update_ns": F.unix_micros("ts") * 1000,
        "price": cents * 10**14 - 50 * 10**16, "market_status": F.pmod(F.col("event_id"), F.lit(3)), "multiplier": F.lit(10**18), "new_multiplier": F.lit(10**18), "activation": F.lit(0), "tokenized_price": cents * 10**13,
    }
    small = e.where("value < 900")
    got = B.report(small.select("event_id", "symbol", "ts", "value", B.report_bytes(fields, B.V10).alias("raw")), "raw", B.V10)
    return got.select("event_id", "feed_id", "observed", F.timestamp_micros(F.expr("last_update_ns DIV 1000")).cast("timestamp_ntz").alias("updated"), F.round("price", 4).alias("price"), F.round("tokenized_price", 5).alias("tokenized_price"), (F.col("market_status") == 2).alias("is_open"))


def q_v11(s, d):  # noqa: ANN001, ANN201
    """Ticks written as v11 reports, some with absurd fields, and which of them are plausible."""
    e = moved(s, d).where("value < 90")
    cents = F.round(F.col("value") * 100).cast("long") * 10**15
    fields = {"feed_id": F.sha2("event_type", 256), "mid": cents, "last_seen_ns": F.unix_micros("ts") * 1000, "market_status": F.pmod(F.col("event_id"), F.lit(8)), "observed": F.unix_seconds("ts") + 400 * 86_400}
    fields |= {k: F.lit(0) for k in B.V11 if k not in fields}
    got = B.report(e.select("event_id", B.report_bytes(fields, B.V11).alias("raw")), "raw", B.V11)
    return got.select("event_id", F.round("mid", 4).alias("mid"), "market_status", B.plausible(got).alias("plausible"))


_FEEDS = [*W.V10_FEEDS, *W.V11_FEEDS, *W.ALTERNATES, "000c" + "0" * 60]
_FAULTS = ["no instruction", "not base58", "too short", "not snappy", "payload too short", "bad offset", "bad extent", "no feed"]


def q_verify(s, d):  # noqa: ANN001, ANN201
    """Ticks as v11 reports inside verify instructions, one in three spoilt in one of eight ways, parsed and decoded again.
    A row takes long next to its size, so rows are dealt over all tasks first, however few parts the file has."""
    e = M.tape(s, d).select("event_id", "value", "ts").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "event_id")
    feed = F.element_at(F.array(*[F.lit(f) for f in _FEEDS]), (F.col("event_id") % len(_FEEDS) + 1).cast("int"))
    fields = {"feed_id": feed, "mid": F.round(F.col("value") * 100).cast("long") * 10**13, "market_status": F.pmod(F.col("event_id"), F.lit(6)), "observed": F.unix_seconds("ts")}
    fields |= {k: F.lit(0) for k in B.V11 if k not in fields}
    fault = F.when(F.col("event_id") % 3 == 0, F.element_at(F.array(*[F.lit(f) for f in _FAULTS]), (F.col("event_id") % len(_FAULTS) + 1).cast("int")))
    rows = W.instructions(e.select("event_id", B.report_bytes(fields, B.V11).alias("raw"), fault.alias("fault")), "raw", "fault")
    got = W.parsed(rows.select("event_id", "instruction"), "instruction")
    out = B.report(got.drop("instruction"), "report", B.V11)
    return out.select("event_id", "schema", "error", "feed_id", W.feed_symbol(F.col("feed_id"), label=True).alias("label"), F.round("mid", 5).alias("mid"), "market_status", "observed", F.octet_length("context").alias("context_size"))


def q_returned(s, d):  # noqa: ANN001, ANN201
    """The same reports as return data, in the three forms it comes in and in none, read back."""
    e = M.tape(s, d)
    b64 = F.base64(F.unhex(F.element_at(F.array(*[F.lit(f) for f in _FEEDS]), (F.col("event_id") % len(_FEEDS) + 1).cast("int"))))
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, F.format_string('{"programId":"p","data":["%s","base64"]}', b64)).when(kind == 1, F.format_string('["p",["%s","base64"]]', b64)).when(kind == 2, F.format_string('{"data":"%s"}', b64)).when(kind == 3, F.lit('{"data":null}'))
    return e.select("event_id", F.lower(F.hex(W.returned(text))).alias("report"))


def q_feed_bytes(s, d):  # noqa: ANN001, ANN201
    """Feed ids, written in several ways, to symbols, and symbols back to the bytes of either schema."""
    feed = F.element_at(F.array(*[F.lit(f) for f in _FEEDS]), (F.col("p_partkey") % len(_FEEDS) + 1).cast("int"))
    told = F.when(F.col("p_size") % 3 == 0, F.upper(feed)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("0x"), feed)).otherwise(feed)
    rows = M.table(s, d, "part").select("p_partkey", W.feed_symbol(told).alias("symbol"), W.feed_symbol(told, label=True).alias("label"))
    return rows.select("*", *[F.lower(F.hex(W.feed_bytes(F.col("symbol"), v))).alias(f"v{v}_feed") for v in (10, 11)])


def q_payloads(s, d):  # noqa: ANN001, ANN201
    """Served bands as the bytes that would be published, and what a reader finds in them."""
    rows = bands(s, d).select("symbol", "fri_ts", F.col("regime_pub").alias("regime"), F.lit("lwc").alias("forecaster"), F.lit("amm").alias("profile"), F.col("tau").alias("target"), F.col("tau").alias("served"), F.lit(0.0).alias("buffer"), "point", "lower", "upper", "fri_close", "tau_bps")
    got = B.payload_read(B.payload(rows))
    return got.select(F.col("symbol_read").alias("symbol"), F.to_date(F.timestamp_seconds("as_of")).alias("fri_ts"), "tau_bps", F.octet_length("payload").alias("size"), F.col("regime"), F.col("forecaster"), "target_bps", F.round("point", 3).alias("point"), F.round("lower", 3).alias("lower"), F.round("half_width_bps", 3).alias("half_width_bps"), "error")


def q_publishing(s, d):  # noqa: ANN001, ANN201
    """Ticks as records with a least time between two of a user: which are taken."""
    rows = M.tape(s, d).select(F.col("user_id").cast("string").alias("symbol"), "ts", "event_id", F.when(F.col("value") > 100, "band").alias("error"))
    once = rows.groupBy("symbol", "ts").agg(F.min("error").alias("error"), F.min("event_id").alias("event_id"))
    return B.published(once, "symbol", "ts", 6 * 3600).select("event_id", "error")


def q_rescale(s, d):  # noqa: ANN001, ANN201
    price = F.round(F.col("l_extendedprice") * 100).cast("long")
    signed = F.when(F.col("l_linenumber") == 1, -price).otherwise(price)
    return M.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", B.rescaled(signed, -2, 1).alias("coarse"), B.rescaled(signed, -2, -8).alias("fine"), B.rescaled(signed, -2, -14).alias("too_fine")).distinct()


def q_encoded(s, d):  # noqa: ANN001, ANN201
    """Symbols filled up to sixteen bytes and cut back, prices as whole numbers of 10^-8, shares in basis points, codes."""
    rows = panel(s, d).select("symbol", "regime_pub", "fri_close", "fri_ts")
    filled = B.symbol_bytes(F.col("symbol"))
    return rows.select("symbol", "fri_ts", F.concat(F.lit("x"), filled).alias("filled"), B.symbol_read(filled).alias("cut"), scalar.fixed_point(F.col("fri_close"), -8).alias("fixed"), B.code_of(F.col("regime_pub"), B.REGIMES).alias("code"), F.when(F.length(B.symbol_bytes(F.concat(F.col("symbol"), F.lit("-and-much-more")))) > 0, 1).alias("long_fits"))


def q_canonical(s, d):  # noqa: ANN001, ANN201
    """The canonical text of each customer's facts, keys sorted and no blanks, and its hash."""
    c = M.table(s, d, "customer").select("c_custkey", F.to_json(F.struct(F.format_string("%.4f", "c_acctbal").alias("bal"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))).alias("text"))
    return c.select("c_custkey", "text", F.sha2("text", 256).alias("sha256"))


def q_fields(s, d):  # noqa: ANN001, ANN201
    """JSON of events as a struct, and feed labels from their hashes."""
    e = M.table(s, d, "events")
    labels = e.select(F.col("event_type").alias("label")).distinct().withColumn("feed", F.concat(F.lit("0x"), F.sha2("label", 256)))
    rows = e.select("event_id", F.concat(F.lit("0x"), F.sha2("event_type", 256)).alias("feed"), F.from_json(F.to_json(F.struct("event_type", "value")), "event_type string, value double").alias("j"))
    return rows.withColumnRenamed("feed", "own_feed").join(sized(labels), F.lower("own_feed") == F.col("feed")).select("event_id", "label", F.col("j.event_type").alias("said"), F.round("j.value", 6).alias("value"))


_CAL = """hol AS (SELECT unnest([DATE '2024-01-01', DATE '2024-01-15', DATE '2024-02-19', DATE '2024-03-29', DATE '2024-05-27', DATE '2024-06-19', DATE '2024-07-04', DATE '2024-09-02', DATE '2024-11-28', DATE '2024-12-25']) AS day),
loc AS (SELECT event_id, event_type, value, ts + INTERVAL 180 DAY AS ts, ts + INTERVAL 180 DAY - CASE WHEN CAST(ts + INTERVAL 180 DAY AS DATE) >= DATE '2024-03-10' AND CAST(ts + INTERVAL 180 DAY AS DATE) < DATE '2024-11-03' THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS lt FROM events),
cal AS (SELECT *, CASE WHEN dayofweek(lt) IN (0, 6) OR CAST(lt AS DATE) IN (SELECT day FROM hol) OR hour(lt) * 60 + minute(lt) < 570 OR hour(lt) * 60 + minute(lt) >= CASE WHEN CAST(lt AS DATE) IN (DATE '2024-07-03', DATE '2024-11-29', DATE '2024-12-24') THEN 780 ELSE 960 END THEN 'closed' ELSE 'open' END AS calendar FROM loc)"""
_POOL = """pl AS (SELECT l_orderkey, l_linenumber, l_partkey, (p_size * 100 + 400)::HUGEINT AS rb, ((p_size * 100 + 400)::HUGEINT * round(p_retailprice * 100)::BIGINT)::HUGEINT AS rq, l_quantity::BIGINT AS qty, round(p_retailprice * 100)::BIGINT AS cents, round(l_discount * 1000)::BIGINT AS fee,
  l_linenumber % 2 = 1 AS sell, floor(round(p_retailprice * 100)::BIGINT * 95 / 100.0)::HUGEINT AS lo, floor(round(p_retailprice * 100)::BIGINT * 105 / 100.0)::HUGEINT AS hi FROM lineitem JOIN part ON l_partkey = p_partkey),
p1 AS (SELECT *, CASE WHEN sell THEN qty ELSE qty * cents END::HUGEINT AS amount, CASE WHEN sell THEN rb ELSE rq END AS ri, CASE WHEN sell THEN rq ELSE rb END AS ro FROM pl),
p2 AS (SELECT *, (amount * (10000 - fee) // 10000) * ro // (ri + amount * (10000 - fee) // 10000) AS o1 FROM p1),
p3 AS (SELECT *, CASE WHEN sell THEN rb + amount ELSE rb - o1 END AS b, CASE WHEN sell THEN rq - o1 ELSE rq + amount END AS q FROM p2),
p4 AS (SELECT *, lo * b <= q AND q <= hi * b AS inb, q // b AS px FROM p3),
p5 AS (SELECT *, least(fee + CASE WHEN inb THEN 0 WHEN hi > lo THEN least(greatest(lo - px, px - hi, 0) * 100 // (hi - lo), 300) ELSE 300 END, 9999) AS fb FROM p4),
p6 AS (SELECT *, amount * (10000 - fb) // 10000 AS net FROM p5)"""

_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_NAMES = "fd AS (SELECT * FROM (VALUES " + ", ".join([*[f"('{k}', '{v}', '{v}')" for k, v in (W.V10_FEEDS | W.V11_FEEDS).items()], *[f"('{k}', '{v}', '{v}_alt')" for k, v in W.ALTERNATES.items()]]) + ") t(feed, symbol, label))"
P4 = _MARKET["p4_quorum"][1]

P6 = f"WITH agg AS ({P4}), r AS (SELECT agg.*, ['open', 'closed', 'halted', 'unknown'][asset % 4 + 1] AS regime, round(p_retailprice * 100)::BIGINT AS pt, p_size FROM agg LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON asset = p_partkey) SELECT asset, regime, CASE WHEN regime = 'open' AND state = 'Ok' THEN median END AS aggregate, CASE WHEN regime = 'open' THEN n END AS contributions, CASE WHEN regime = 'open' AND state <> 'Ok' THEN state WHEN regime = 'closed' AND pt IS NULL THEN 'BandUnavailable' WHEN regime = 'halted' THEN 'Halted' WHEN regime = 'unknown' THEN 'RegimeAmbiguous' END AS error, CASE WHEN regime = 'closed' THEN pt END AS band_point, CASE WHEN regime = 'closed' THEN pt - p_size END AS band_lower, CASE WHEN regime = 'closed' THEN pt + p_size END AS band_upper FROM r"

QUERIES = {
    "h10_calendar": (q_calendar, f"WITH {_CAL} SELECT event_id, ts, calendar FROM cal"),
    "h10_holidays": (q_holidays, "SELECT unnest(['2024-01-01', '2024-01-15', '2024-02-19', '2024-03-29', '2024-05-27', '2024-06-19', '2024-07-04', '2024-09-02', '2024-11-28', '2024-12-25', '2025-01-01', '2025-01-09', '2025-01-20', '2025-02-17', '2025-04-18', '2025-05-26', '2025-06-19', '2025-07-04', '2025-09-01', '2025-11-27', '2025-12-25', '2026-01-01', '2026-01-19', '2026-02-16', '2026-04-03', '2026-05-25', '2026-06-19', '2026-07-03', '2026-09-07', '2026-11-26', '2026-12-25', '2027-01-01', '2027-01-18', '2027-02-15', '2027-03-26', '2027-05-31', '2027-06-18', '2027-07-05', '2027-09-06', '2027-11-25', '2027-12-24'])::DATE AS day, false AS early UNION ALL SELECT unnest(['2024-07-03', '2024-11-29', '2024-12-24', '2025-07-03', '2025-11-28', '2025-12-24', '2026-11-27', '2026-12-24', '2027-11-26'])::DATE, true"),
    "p5_regimes": (q_regimes, f"WITH {_CAL}, o AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'extended' WHEN 'purchase' THEN 'closed' WHEN 'error' THEN 'halted' ELSE 'unknown' END AS oracle, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE calendar END AS calendar FROM cal) SELECT event_id, oracle, calendar, CASE WHEN oracle = 'halted' THEN 'halted' WHEN oracle = 'unknown' THEN CASE calendar WHEN 'n/a' THEN 'unknown' ELSE calendar END WHEN calendar = 'n/a' THEN CASE oracle WHEN 'closed' THEN 'closed' ELSE 'open' END WHEN (oracle = 'closed') = (calendar = 'closed') THEN calendar ELSE 'unknown' END AS regime FROM o"),
    "p1_upstreams": (q_upstreams, "SELECT l_linenumber - 1 AS kind, CASE l_linenumber WHEN 1 THEN 'pyth' WHEN 2 THEN 'chainlink_relay' WHEN 3 THEN 'switchboard' WHEN 4 THEN 'redstone' END AS upstream, CASE WHEN l_linenumber IN (1, 3) THEN NULL WHEN l_linenumber IN (2, 4) THEN 'not implemented' ELSE 'unknown kind' END AS unread, count(*) AS n FROM lineitem GROUP BY 1, 2, 3"),
    "p6_receipts": (q_receipts, P6),
    "p7_receipt_faults": (q_receipt_faults, f"WITH rc AS ({P6}), b AS (SELECT *, false AS changed FROM rc UNION ALL SELECT * REPLACE (CASE regime WHEN 'open' THEN 'closed' WHEN 'closed' THEN 'open' ELSE 'open' END AS regime), true FROM rc), f AS (SELECT changed, array_to_string(list_filter([CASE WHEN regime = 'open' AND error IS NULL AND aggregate IS NULL THEN 'open without aggregate' END, CASE WHEN regime = 'open' AND error IS NULL AND coalesce(contributions, 0) < 3 THEN 'open under quorum' END, CASE WHEN regime = 'open' AND band_point IS NOT NULL THEN 'open with band' END, CASE WHEN regime IN ('closed', 'halted') AND (aggregate IS NOT NULL OR contributions IS NOT NULL) THEN 'closed with aggregate' END, CASE WHEN regime = 'closed' AND error IS NULL AND band_point IS NULL THEN 'closed without band' END, CASE WHEN regime = 'unknown' AND error IS DISTINCT FROM 'RegimeAmbiguous' THEN 'unknown without reason' END, CASE WHEN band_point IS NOT NULL AND NOT band_point BETWEEN band_lower AND band_upper THEN 'band out of order' END], lambda x: x IS NOT NULL), ', ') AS faults FROM b) SELECT changed, faults, count(*) AS n FROM f GROUP BY 1, 2"),
    "p8_configs": (q_configs, "WITH l AS (SELECT l_partkey, list_sort(list(DISTINCT l_linenumber - 1)) AS kinds, (l_partkey % 6)::INT AS quorum, l_partkey % 12000 AS conf FROM lineitem GROUP BY 1), a AS (SELECT *, list_transform(kinds, lambda k: CASE WHEN k <> 1 THEN 1 ELSE 0 END) AS active FROM l), f AS (SELECT array_to_string(list_filter([CASE WHEN len(kinds) < 1 OR len(kinds) > 5 THEN 'upstreams' END, CASE WHEN quorum < 1 OR quorum > list_sum(active) THEN 'quorum' END, CASE WHEN list_max(kinds) > 3 THEN 'kind' END, CASE WHEN active <> list_reverse_sort(active) THEN 'order' END, CASE WHEN conf > 10000 THEN 'bps' END], lambda x: x IS NOT NULL), ', ') AS faults FROM a) SELECT faults, count(*) AS n FROM f GROUP BY 1"),
    "p12_quotes": (q_quotes, f"WITH {_POOL} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN sell THEN 'sell' ELSE 'buy' END AS side, inb AS in_band, (net * ro // (ri + net))::BIGINT AS paid, (amount - net)::BIGINT AS fee_paid, fb::BIGINT AS fee_bps FROM p6"),
    "p10_in_band": (q_in_band, f"WITH {_POOL} SELECT l_partkey, count(*) AS n, count(*) FILTER (lo * (rb + amount) <= rq AND rq <= hi * (rb + amount)) AS inside FROM p1 WHERE sell GROUP BY 1"),
    "p13_shares": (q_mint, f"WITH {_POOL}, z AS (SELECT l_orderkey, l_linenumber, fee AS base, amount AS quote, rb, rq, CASE WHEN l_linenumber = 2 THEN 0 ELSE rb * 7 END AS supply FROM p1 WHERE NOT sell), m AS (SELECT *, CASE WHEN base > 0 AND quote > 0 THEN nullif(CASE WHEN supply = 0 THEN floor(sqrt((base * quote)::DOUBLE))::HUGEINT ELSE least(base * supply // rb, quote * supply // rq) END, 0) END AS shares FROM z) SELECT l_orderkey, l_linenumber, base, quote::BIGINT AS quote, supply::BIGINT AS supply, shares::BIGINT AS shares, CASE WHEN shares IS NOT NULL THEN CASE WHEN supply = 0 THEN base ELSE shares * rb // supply END END::BIGINT AS base_used, CASE WHEN shares IS NOT NULL THEN CASE WHEN supply = 0 THEN quote ELSE shares * rq // supply END END::BIGINT AS quote_used, CASE WHEN shares > 0 AND shares <= supply THEN shares * rb // supply END::BIGINT AS base_out, CASE WHEN shares > 0 AND shares <= supply THEN shares * rq // supply END::BIGINT AS quote_out FROM m"),
    "h14_v10_reports": (q_v10, "SELECT event_id, sha256(event_type) AS feed_id, epoch_us(ts) // 1000000 AS observed, ts AS updated, round(round(value * 100) / 10000 - 0.5, 4) AS price, round(round(value * 100) / 100000, 5) AS tokenized_price, event_id % 3 = 2 AS is_open FROM events WHERE value < 900"),
    "h15_v11_reports": (q_v11, "SELECT event_id, round(round(value * 100) / 1000, 4) AS mid, event_id % 8 AS market_status, round(value * 100) / 1000 BETWEEN 0.01 AND 100000 AND event_id % 8 <= 5 AND epoch_us(ts) // 1000000 + 580 * 86400 BETWEEN 1735689600 AND 1830297600 AS plausible FROM events WHERE value < 90"),
    "h16_verify_parse": (q_verify, f"WITH {_NAMES}, x AS (SELECT event_id, value, ts, {_LIST(_FEEDS)}[event_id % {len(_FEEDS)} + 1] AS f, CASE WHEN event_id % 3 = 0 THEN {_LIST(_FAULTS)}[event_id % {len(_FAULTS)} + 1] END AS error FROM events) SELECT event_id, CASE WHEN error IS NULL THEN ('0x' || f[1:4])::INT END AS schema, error, CASE WHEN error IS NULL THEN f END AS feed_id, CASE WHEN error IS NULL THEN label END AS label, CASE WHEN error IS NULL THEN round(round(value * 100) / 100000, 5) END AS mid, CASE WHEN error IS NULL THEN event_id % 6 END AS market_status, CASE WHEN error IS NULL THEN epoch_us(ts) // 1000000 END AS observed, CASE WHEN error IS NULL THEN 96 END AS context_size FROM x LEFT JOIN fd ON f = feed"),
    "h16_return_data": (q_returned, f"SELECT event_id, CASE WHEN event_id % 5 < 3 THEN {_LIST(_FEEDS)}[event_id % {len(_FEEDS)} + 1] END AS report FROM events"),
    "h17_feed_symbols": (q_feed_bytes, f"WITH {_NAMES}, x AS (SELECT p_partkey, {_LIST(_FEEDS)}[p_partkey % {len(_FEEDS)} + 1] AS f FROM part) SELECT p_partkey, fd.symbol, fd.label, a.feed AS v10_feed, b.feed AS v11_feed FROM x LEFT JOIN fd ON f = fd.feed LEFT JOIN fd a ON a.symbol = fd.symbol AND a.feed LIKE '000a%' LEFT JOIN fd b ON b.symbol = fd.symbol AND b.feed LIKE '000b%' AND b.label = b.symbol"),
    "j12_payloads": (q_payloads, f"WITH {SERVED} SELECT symbol, fri_ts, tau_bps, 67 AS size, regime_pub AS regime, 'lwc' AS forecaster, tau_bps::BIGINT AS target_bps, round(point, 3) AS point, round(lower, 3) AS lower, round((upper - lower) / 2 / point * 10000, 3) AS half_width_bps, CAST(NULL AS VARCHAR) AS error FROM bands"),
    "j13_publishing": (q_publishing, None),
    "h13_rescaled": (q_rescale, "WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, (round(l_extendedprice * 100)::BIGINT * CASE WHEN l_linenumber = 1 THEN -1 ELSE 1 END)::HUGEINT AS p FROM lineitem) SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, trunc(p / 1000.0)::BIGINT AS coarse, (p * 1000000)::BIGINT AS fine, CASE WHEN abs(p) <= 9223372 THEN (p * 1000000000000)::BIGINT END AS too_fine FROM x"),
    "h11_encoded": (q_encoded, f"WITH {PANEL} SELECT symbol, fri_ts, 'x' || rpad(hex(symbol), 32, '0') AS filled, symbol AS cut, round(fri_close * 100000000)::BIGINT AS fixed, CASE regime_pub WHEN 'normal' THEN 0 WHEN 'long_weekend' THEN 1 ELSE 2 END AS code, CAST(NULL AS INT) AS long_fits FROM panel"),
    "h20_canonical": (q_canonical, """SELECT c_custkey, '{"bal":"' || printf('%.4f', c_acctbal) || '","key":' || c_custkey || ',"segment":"' || c_mktsegment || '"}' AS text, sha256('{"bal":"' || printf('%.4f', c_acctbal) || '","key":' || c_custkey || ',"segment":"' || c_mktsegment || '"}') AS sha256 FROM customer"""),
    "h23_fields": (q_fields, "SELECT event_id, event_type AS label, event_type AS said, round(value, 6) AS value FROM events"),
}
