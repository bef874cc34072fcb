"""Closed forms, recursions and order-independence of the library's own operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.functions import scalar, special
from lacuna.operators import calibrate, joins, online, panel, policy, resample, route, stats
from lacuna.sources import market


def test_chi2_tail():
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert special.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert special.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.interpolated(F.lit(0.9), {0.85: 1.0, 0.95: 2.0}).alias("a"), scalar.interpolated(F.lit(0.1), {0.85: 1.0, 0.95: 2.0}).alias("b"),
        scalar.deviation_bps(F.lit(-105).cast("long"), F.lit(-100).cast("long")).alias("c"), scalar.deviation_bps(F.lit(99).cast("long"), F.lit(100).cast("long")).alias("d"),
        scalar.fixed_point(F.lit(1.5), 0).alias("e"), scalar.fixed_point(F.lit(-1.5), 0).alias("f"),
        F.unix_seconds(scalar.epoch_to_utc(F.lit(1_700_000_000_000).cast("long"))).alias("g"), scalar.triple_witching(F.lit("2024-03-15").cast("date")).alias("h"),
    ).first()
    assert row["a"] == pytest.approx(1.5) and row["b"] == 1.0
    assert (row["c"], row["d"], row["e"], row["f"], row["g"], row["h"]) == (500, -100, 2, -2, 1_700_000_000, True)


def test_scale_is_causal_and_equals_the_fold(spark):
    rng = np.random.default_rng(2)
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(7 * i), float(x)) for i, x in enumerate(rng.normal(0, 0.02, 40))]
    df = spark.createDataFrame(rows, "symbol string, fri_ts date, rel_resid double").repartition(3)
    got = [r["sigma"] for r in panel.ewma_scale(df).orderBy("fri_ts").collect()]
    for i, g in enumerate(got):
        w = 0.5 ** (np.arange(i, 0, -1) / 8.0)
        want = math.sqrt(sum(w * np.array([r[2] for r in rows[:i]]) ** 2) / w.sum()) if i >= 8 else None
        assert (g is None) == (want is None) and (want is None or g == pytest.approx(want, rel=1e-9))


def test_quantile_ranks(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", 5.0), ("c", None)], "cell string, s double")
    got = {(r["cell"], r["tau_bps"]): (r["n"], r["q"]) for r in calibrate.quantile_table(df, calibrate.tau_table(spark), ["cell"], "s").collect()}
    assert got[("a", 6800)] == (10, 8.0) and got[("a", 9900)] == (10, 10.0) and got[("b", 6800)] == (1, 5.0) and ("c", 6800) not in got


def test_kupiec_edges(spark):
    df = spark.createDataFrame([(0, 100), (100, 100), (5, 100), (0, 0)], "x long, n long")
    lr = [r[0] for r in df.select(stats.kupiec_lr(F.col("x"), F.col("n"), F.lit(0.05))).collect()]
    assert lr[0] == pytest.approx(-2 * 100 * math.log(0.95)) and lr[2] == pytest.approx(0, abs=1e-9) and lr[3] is None and lr[1] > 500


def test_lower_median_and_quorum(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [("x", now, p, c) for p, c in ((100, None), (101, 1), (102, 1), (500, 1))] + [("x", now - dt.timedelta(hours=2), 100, None), ("y", now, 7, 7)]
    df = spark.createDataFrame(rows, "asset string, ts timestamp, price long, confidence long")
    out = route.filtered(df, ["asset"], F.lit(now), 3600, 500, 1000)
    assert sorted(r["reason"] or "" for r in out.where("asset = 'x'").collect()) == ["", "", "", "far", "stale"]
    got = {r["asset"]: (r["n"], r["median"], r["low"], r["high"], r["state"]) for r in route.aggregated(out, ["asset"], 3).collect()}
    assert got == {"x": (3, 101, 100, 102, "Ok"), "y": (0, None, None, None, "AllStale")}


def test_swap_floors(spark):
    row = spark.range(1).select(route.swap_out(F.lit(10**12).cast("long"), F.lit(10**13).cast("long"), F.lit(12345).cast("long"), F.lit(30)).alias("o")).first()
    net = 12345 * 9970 // 10000
    assert row["o"] == net * 10**13 // (10**12 + net)


def test_adaptive_replay_ignores_row_order(spark):
    rng = np.random.default_rng(4)
    rows = [(f"c{i % 2}", dt.date(2024, 1, 1) + dt.timedelta(i // 4), float(x)) for i, x in enumerate(abs(rng.normal(0, 1, 160)))]
    df = spark.createDataFrame(rows, "cell string, day date, s double")
    table = calibrate.quantile_table(df, calibrate.tau_table(spark, (0.68, 0.95)), ["cell"], "s").select("cell", "tau_bps", "tau", "q")
    run = lambda d: sorted(map(tuple, online.adaptive_replay(d, table, "cell", "day", "s").collect()))
    assert run(df) == run(df.orderBy(F.desc("s")).repartition(5))
    one = spark.createDataFrame([("c", dt.date(2024, 1, d), s) for d, s in ((1, 2.0), (1, None), (1, float("nan")), (2, None), (3, float("inf")), (3, 0.5))], "cell string, day date, s double")
    got = online.adaptive_replay(one, spark.sql("SELECT 'c' AS cell, 9500 AS tau_bps, 0.95D AS tau, 1.0D AS q"), "cell", "day", "s").orderBy("period").collect()
    first = math.exp(0.05 * 0.95)  # rows without a score don't dilute the share, a period without any isn't there
    assert [(r["period"].day, r["n"]) for r in got] == [(1, 1), (3, 2)]
    assert [r["m_next"] for r in got] == pytest.approx([first, first * math.exp(0.05 * 0.45)])


def test_cusum_equals_the_recursion(spark):
    x = [0.2, 1.5, 1.2, -3.0, 2.0, 2.0, 0.1]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)], "key string, i long, z double")
    got = [(r["s_up"], r["s_down"]) for r in online.cusum(df, "key", "i", "z", 0.5, 3.0).orderBy("i").collect()]
    up = down = 0.0
    for v, (a, b) in zip(x, got, strict=True):
        up, down = max(0.0, up + v - 0.5), max(0.0, down - v - 0.5)
        assert (a, b) == (pytest.approx(up), pytest.approx(down))


def test_as_of_takes_the_last_at_or_before(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    left = spark.createDataFrame([("a", t(5), 1), ("a", t(0), 2), ("b", t(5), 3)], "k string, ts timestamp, id long")
    right = spark.createDataFrame([("a", t(1), 10.0, 1), ("a", t(5), 11.0, 2), ("a", t(5), 12.0, 3), ("a", t(9), 13.0, 4)], "k string, ts timestamp, v double, o long")
    got = {r["id"]: r["v"] for r in joins.as_of(left, right, "k", "ts", ["v"], "o").collect()}
    assert got == {1: 12.0, 2: None, 3: None}
    near = {r["id"]: (r["v"], r["off_us"]) for r in joins.nearest(left, right, "k", "ts", "v", "o", 120).collect()}
    assert near[2] == (10.0, 60_000_000) and near[1][1] == 0 and near[3] == (None, None)


def test_append_new_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "z"), (2, "b"), (2, "c")], "k long, v string")
    once = market.append_new(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "b")]
    assert market.append_new(once, new, ["k"]).count() == 2


def test_dated_paths_and_empty_reads(spark, tmp_path):
    paths = market.daily_paths(str(tmp_path), dt.date(2024, 2, 28), dt.date(2024, 3, 1), ("pool", "x"))
    assert len(paths) == 3 and paths[1].endswith("pool=x/year=2024/month=02/day=29.parquet")
    spark.range(2).write.parquet(paths[1])
    assert market.read_existing(spark, paths, "id long").count() == 2
    assert market.read_existing(spark, paths[:1], "id long, x string").columns == ["id", "x"]


def test_policy_ladder(spark):
    df = spark.createDataFrame([(0.5,), (0.8,), (0.9,), (2.0,)], "debt double")
    assert [r[0] for r in df.select(policy.decide(F.col("debt"), F.lit(1.0), F.lit(0.85))).collect()] == ["Safe", "Caution", "Liquidate", "Liquidate"]
    assert df.select(policy.decide(F.col("debt"), F.lit(-1.0), F.lit(0.85))).first()[0] == "Liquidate"


def test_bootstrap_repeats_and_brackets(spark):
    df = spark.createDataFrame([(i % 30, float(i % 7 == 0)) for i in range(900)], "d long, v double").withColumn("g", F.lit(1))
    a, b = (resample.block_bootstrap(x, "d", ["g"], "v").first() for x in (df, df.repartition(7)))
    assert a["lo"] == pytest.approx(b["lo"]) and a["lo"] < a["mean"] < a["hi"]


def test_forward_only_deals_out_a_symbol_and_keeps_its_newest_time(spark, tmp_path):
    from lacuna.streaming import live

    rng, folder, out = np.random.default_rng(4), f"{tmp_path}/in", f"{tmp_path}/out"
    newest, schema = {}, "event_id long, ts timestamp, user_id long, event_type string, value double"
    for n in range(2):
        rows = []
        for i in rng.permutation(400).tolist():
            t = None if i % 50 == 0 else pd.Timestamp(2024, 1, 1) + pd.Timedelta(seconds=i + 300 * n + int(rng.integers(0, 60)))
            rows.append((i + 1000 * n, t, 1, "view" if i % 8 else None if i % 16 else "rare", 1.0))
        spark.createDataFrame([(i, None if t is None else t.to_pydatetime(), *x) for i, t, *x in rows], schema).write.mode("append").parquet(folder)
        live.forward_only(live.event_stream(spark, folder), out, f"{tmp_path}/checkpoint")
        want = {}
        for _, t, _, s, _ in sorted(rows, key=lambda r: r[0]):
            seen, taken = want.get(s, (0, 0))
            ok = t is not None and (s not in newest or t >= newest[s])
            newest |= {s: t} if ok else {}
            want[s] = (seen + 1, taken + ok)
        assert {r["symbol"]: (r["n"], r["accepted"]) for r in spark.read.parquet(f"{out}/batch={n}").collect()} == want
        parts = spark.read.parquet(f"{out}-sorted/batch={n}").where("symbol = 'view'").groupBy("_part").count().collect()
        assert len(parts) > 1 and max(r["count"] for r in parts) < 300
