"""What the third round's findings asked for: quotients that are next to a whole number, minutes by their pieces, base58 in batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lacuna.functions import scalar
from lacuna.operators import decode as B
from lacuna.operators import joins as J
from lacuna.operators import route as R
from lacuna.operators import wire as W


def test_quotients_just_under_a_whole_number_are_cut(spark):
    got = spark.sql("SELECT 10000000L AS rin, 10000000L AS rout, 1L AS amount, 0L AS fee, 9999999L AS num, 10000000L AS den").selectExpr("*", "CAST(num AS DECIMAL(38,0)) AS n", "CAST(den AS DECIMAL(20,0)) AS d")
    c = lambda name: got[name]
    row = got.select(
        R.swap_out(c("rin"), c("rout"), c("amount"), c("fee")).alias("out"), R.over(c("n"), c("d")).alias("over"), R.over(c("n"), c("d") - 10_000_000).alias("none"),
        R.surcharge_bps(c("den") + c("num"), c("den") - c("den"), c("den"), 1, 300).alias("extra"), B.rescaled(c("num") * 1000 + 999, 0, 10).alias("up"), B.rescaled(-(c("num") * 1000 + 999), 0, 10).alias("down"),
        scalar.deviation_bps(c("den") * 10_000 - c("fee") + c("num"), c("den") * 10_000).alias("bps"),
    ).first()
    # 10^7 / (10^7 + 1), 9,999,999 / 10^7 three times, +-9,999,999,999 / 10^10: all under one
    assert (row["out"], row["over"], row["none"], row["extra"], row["up"], row["down"], row["bps"]) == (0, 0, None, 0, 0, 0, 0)


def test_paths_read_minutes_of_factors_only(spark):
    from lacuna.plans import variant_queries as V

    d = "/root/testdata/sf0.001"
    own, whole = V.factor_minutes(spark, d), V.minute_bars(spark, d)
    factors = {r["factor"] for r in V.anchored(spark, d).select("factor").distinct().collect()}
    kept = {r["symbol"] for r in own.select("symbol").distinct().collect()}
    assert factors and factors <= kept < {r["symbol"] for r in whole.select("symbol").distinct().collect()}
    assert sorted(own.collect()) == sorted(whole.where(F.col("symbol").isin(*kept)).collect())


def test_minutes_after_by_pieces(spark):
    random.seed(5)
    at = lambda s: dt.datetime(2024, 1, 1, 10) + dt.timedelta(seconds=s)
    # a dense key, a sparse one with ties and whole minutes, one without ticks, and rows without a key or a time
    asks = [("a", at(random.randrange(0, 9000)), i) for i in range(60)] + [("b", at(60 * i), 100 + i) for i in range(0, 300, 7)] + [("c", at(5), 900), (None, at(5), 901), ("a", None, 902)]
    ticks = [("a", at(random.randrange(-500, 9000)), 1000 + i) for i in range(900)] + [("b", at(t), 3000 + i) for i, t in enumerate((-3600, 0, 0, 60, 61, 4000, 4000, 4020, 9000))] + [(None, at(0), 4000), ("b", None, 4001)]
    a = spark.createDataFrame(asks, "user string, ts timestamp, ask_id long")
    t = spark.createDataFrame(ticks, "user string, ts timestamp, event_id long")
    for minutes, within in ((60, 86_400), (7, 90), (60, 1800)):
        got = [(r["user"], r["ask_id"], r["ts"], r["event_id"]) for r in J.minutes_after(a, t, "user", "ts", "event_id", minutes, within).collect()]
        want = []
        for user, ts, i in asks:
            for m in range(1, minutes + 1) if user and ts else ():
                minute = ts.replace(second=0) + dt.timedelta(minutes=m)
                seen = [(x, o) for u, x, o in ticks if u == user and x is not None and x <= minute]
                if seen and minute - max(seen)[0] <= dt.timedelta(seconds=within):
                    want.append((user, i, minute, max(seen)[1]))
        assert len(want) > 50 and sorted(got) == sorted(want)


def test_base58_in_batches(spark):
    random.seed(3)
    blocks = [b"", b"\0", b"\0\0a", *[bytes(random.randrange(256) for _ in range(n)) for n in range(1, 200)]]

    def plain(data):  # noqa: ANN001, ANN202
        n, out = int.from_bytes(data, "big"), ""
        while n:
            n, r = divmod(n, 58)
            out = W.BASE58[r] + out
        return "1" * (len(data) - len(data.lstrip(b"\0"))) + out

    assert W.base58_texts([*blocks, None]) == [*map(plain, blocks), None]
    assert W.base58_many(["0", *map(plain, blocks), None, "1é", "zl", "111"]) == [None, *blocks, None, None, None, b"\0\0\0"]


def test_verify_rows_are_dealt_over_all_tasks(spark):
    from lacuna.plans import router_queries as Q

    got = Q.q_verify(spark, "/root/testdata/sf0.001")
    assert got.select("event_id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_adaptive_stream_keeps_no_more_state_than_cells(spark, monkeypatch):
    from lacuna.plans import stream_queries as S

    seen, run = [], S.live.drain
    monkeypatch.setattr(S.live, "drain", lambda *a, **k: (seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))), run(*a, **k)))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert S.q_adaptive(spark, "/root/testdata/sf0.001").count()
        assert len(seen) == 3 and max(seen) <= 3 and spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
