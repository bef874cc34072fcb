"""Operators that SQL cannot say, against plain loops and numpy; order statistics, sealed state, decoding, tapes, streams."""

import datetime as dt
import hashlib
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.functions.special import chi2_column, chi2_tail, normal_quantile, student_cdf, student_quantile
from lacuna.operators import audit as A
from lacuna.operators import decode as B
from lacuna.operators import density as D
from lacuna.operators import joins as J
from lacuna.operators import online as O
from lacuna.operators import panel as P
from lacuna.operators import policy as L
from lacuna.operators import resample as R
from lacuna.operators import route as X
from lacuna.operators import tails as TL
from lacuna.operators.prefix import prefix_quantiles
from lacuna.operators.shared import order_statistics, percentiles, running
from lacuna.sources import tapes as T
from lacuna.streaming import live


def day(i: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(i)


def test_order_statistics_in_brackets(spark):
    rng = np.random.default_rng(1)
    values = {"a": np.round(rng.exponential(1, 3000), 2), "b": np.full(500, 7.0), "c": rng.standard_normal(37)}
    rows = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("a", None)], "cell string, v double").repartition(5)
    asks = [(t, lambda n, t=t: F.least(F.ceil(F.lit(t) * (n + 1)), n)) for t in (0.01, 0.5, 0.95, 0.999)]
    for few in (10, 1_000_000):
        for r in order_statistics(rows, ["cell"], "v", asks, few=few).collect():
            x = np.sort(values[r["cell"]])
            assert (r["n"], r["q"]) == (len(x), x[min(math.ceil((0.01, 0.5, 0.95, 0.999)[r["ask"]] * (len(x) + 1)), len(x)) - 1])


def test_order_statistics_of_many_ties(spark):
    rows = spark.range(400_000, numPartitions=8).select(F.lit("a").alias("cell"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") / 7).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1.0), ("a", None)], "cell string, v double"))
    asks = [(t, lambda n, t=t: F.ceil(F.lit(t) * n)) for t in (0.25, 0.5, 0.500001, 0.75, 1.0)]
    got = order_statistics(rows, ["cell"], "v", asks)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.rindex("HashAggregate")  # equal values are counted before they are put in line
    want = np.sort(np.where(np.arange(400_000) % 2 == 0, 0.0, np.arange(400_000) / 7))
    assert {r["ask"]: r["q"] for r in got.collect()} == {i: pytest.approx(want[math.ceil(t * 400_000) - 1]) for i, t in enumerate((0.25, 0.5, 0.500001, 0.75, 1.0))}
    one = percentiles(rows, ["cell"], F.col("v"), {"m": 0.9, "lo": 0.0}).first()
    assert one["m"] == pytest.approx(np.quantile(want, 0.9)) and one["lo"] == 0.0


@pytest.mark.parametrize("bits", [2, 8])
def test_prefix_quantiles_are_those_of_all_earlier_rows(spark, bits):
    rng = np.random.default_rng(6)
    rows = [("ab"[int(rng.integers(0, 2))], day(int(rng.integers(0, 60))), float(rng.choice([0.0, 1.0, round(rng.exponential(), 3)]))) for _ in range(900)]
    rows += [("a", day(3), None), (None, day(3), 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "cell string, d date, v double").repartition(5)
    dates = spark.createDataFrame([(day(i),) for i in (0, 1, 7, 7, 33, 59, 90)], "as_of date")
    shares = (0.1, 0.5, 0.95)
    asks = [lambda n, t=t: F.least(F.greatest(F.ceil(F.lit(t) * (n + 1)), F.lit(1)), n) for t in shares]
    got = {(r["cell"], r["as_of"], r["ask"]): (r["n"], r["q"]) for r in prefix_quantiles(df, "cell", "d", "v", dates, asks, least=5, bits=bits).collect()}
    want = {}
    for c in "ab":
        for i in (0, 1, 7, 33, 59, 90):
            x = np.sort([r[2] for r in rows if r[0] == c and r[1] is not None and r[2] is not None and r[1] < day(i)])
            for k, t in enumerate(shares):
                if len(x) >= 5:
                    want[c, day(i), k] = (len(x), x[min(max(math.ceil(t * (len(x) + 1)), 1), len(x)) - 1])
    assert got == want
    assert prefix_quantiles(df.limit(0), "cell", "d", "v", dates, asks).count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([("ab"[i % 2], i * 7 % 50, i) for i in range(200)], "g string, o int, v int").repartition(4)
    got = {r["v"]: (r["s"], r["k"]) for r in running(df, ["g", "o", "v"], {"s": "v", "k": "1"}, ["g"]).collect()}
    for g in "ab":
        own = sorted((i * 7 % 50, i) for i in range(200) if "ab"[i % 2] == g)
        for k, (_, v) in enumerate(own):
            assert got[v] == (sum(x for _, x in own[:k]), k)


def test_scales_of_long_series_do_not_overflow(spark):
    rng, n = np.random.default_rng(2), 3000
    r = rng.standard_normal(n)
    df = spark.createDataFrame([("A", day(i), float(r[i])) for i in range(n)], "symbol string, fri_ts date, rel_resid double")
    got = {x["fri_ts"]: x["sigma"] for x in P.ewma_scale(df, half_life=1.0).where(F.col("fri_ts") > F.lit(day(2500))).collect()}
    for i in (2600, 2815, 2999):
        w = 0.5 ** np.arange(i)
        assert got[day(i)] == pytest.approx(math.sqrt((w * r[:i][::-1] ** 2).sum() / w.sum()), rel=1e-9)


def test_chi2_and_student_tails(spark):
    df = spark.createDataFrame([(x, k) for x in (0.0, 0.3, 2.5, 9.0, 40.0) for k in (1, 2, 3, 5, 8, 25, 26)], "x double, k int")
    for r in df.withColumn("p", chi2_column(F.col("x"), F.col("k"))).collect():
        assert r["p"] == pytest.approx(chi2_tail(r["x"], r["k"]), abs=2e-7)
    assert student_quantile(0.975, 5) == pytest.approx(2.570582, abs=1e-5) and student_cdf(1.0, 1.0) == pytest.approx(0.75)


def adaptive(rows, table):
    """A plain loop: m of each cell and tau over the periods."""
    out = {}
    for (cell, tau), q in table.items():
        m = 1.0
        for p in sorted({r[0] for r in rows if r[1] == cell and r[2] is not None}):
            s = np.array([r[2] for r in rows if r[0] == p and r[1] == cell and r[2] is not None], float)
            if len(s):
                m = min(max(m * math.exp(0.05 * ((s > m * q).mean() - (1 - tau))), 0.25), 4.0)
            out[cell, tau, p] = m
    return out


def test_adaptive_replay_resume_and_seal(spark):
    rng = np.random.default_rng(3)
    rows = [(day(i), "stress" if i % 5 == 0 else "normal", None if j == 2 and i % 7 == 0 else float(abs(rng.normal(0, 1.5)))) for i in range(40) for j in range(3)]
    table = {("normal", 0.68): 1.0, ("normal", 0.95): 2.0, ("stress", 0.68): 2.0, ("stress", 0.95): 4.0}
    scores = spark.createDataFrame(rows, "period date, cell string, score double")
    tab = spark.createDataFrame([(c, int(round(t * 10_000)), t, q) for (c, t), q in table.items()], "cell string, tau_bps int, tau double, q double")
    want = adaptive(rows, table)
    whole = O.adaptive_replay(scores.repartition(7), tab, "cell", "period", "score")
    got = {(r["cell"], r["tau_bps"] / 10_000, r["period"]): r["m_next"] for r in whole.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    first = O.sealed(O.adaptive_replay(scores.where(F.col("period") < day(20)), tab, "cell", "period", "score"), "weekend", "x")
    rest = O.adaptive_replay(scores.where(F.col("period") >= day(20)), tab, "cell", "period", "score", start=O.resumed(json.loads(O.canonical(first))))
    last = {(r["cell"], r["tau_bps"] / 10_000): r["m"] for r in rest.groupBy("cell", "tau_bps").agg(F.max_by("m_next", "period").alias("m")).collect()}
    assert all(v == pytest.approx(want[c, t, max(p for a, b, p in want if (a, b) == (c, t))], abs=1e-8) for (c, t), v in last.items())
    assert O.intact(first) and first["checkpoint_sha256"] == hashlib.sha256(O.canonical({k: v for k, v in first.items() if k != "checkpoint_sha256"}).encode()).hexdigest()
    changed = json.loads(json.dumps(first))
    changed["m"]["0.9500"]["normal"] = "1.0000000001"
    assert not O.intact(changed)
    with pytest.raises(ValueError):
        O.resumed(changed)
    asked = spark.createDataFrame([("normal", 9500), ("unseen", 9500)], "cell string, tau_bps int")
    got = {r["cell"]: r["m"] for r in O.multipliers(asked, first).collect()}
    assert got["unseen"] == 1.0 and got["normal"] == pytest.approx(float(first["m"]["0.9500"]["normal"]))
    with pytest.raises(Exception, match="no state for tau"):
        O.multipliers(asked.withColumn("tau_bps", F.lit(9000)), first).collect()


def test_adaptive_stream_equals_the_replay_wherever_it_is_cut(spark, tmp_path):
    from lacuna.streaming import adaptive

    rng, name = np.random.default_rng(3), "spark.sql.streaming.stateStore.providerClass"
    rows = [(f"c{j % 2}", day(i), None if j == 5 and i % 4 == 0 else float(abs(rng.normal(0, 1.5)))) for i in range(24) for j in range(6)]
    df = spark.createDataFrame(rows, "cell string, d date, s double")
    tab = spark.createDataFrame([("c0", 9500, 0.95, 1.0), ("c1", 9500, 0.95, 2.0), ("c0", 6800, 0.68, 0.5)], "cell string, tau_bps int, tau double, q double")
    told = lambda x: {(r["cell"], r["tau_bps"], r["period"]): (r["n"], round(r["m_served"], 8), round(r["m_next"], 8)) for r in x.collect()}
    spark.conf.set(name, adaptive.STORE)
    try:
        first = O.sealed(O.adaptive_replay(df.where(F.col("d") < day(7)), tab, "cell", "d", "s"), "night", "x")
        want = {k: v for k, v in told(O.adaptive_replay(df.where(F.col("d") >= day(7)), tab, "cell", "d", "s", start=O.resumed(first))).items() if k[2] < day(23)}
        for cuts in ((7, 24), (7, 9, 24)):
            at = f"{tmp_path}/{len(cuts)}"
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                new = df.where((F.col("d") >= day(lo)) & (F.col("d") < day(hi)))
                if lo > 7:
                    new = new.unionByName(spark.createDataFrame([("c0", day(7), 99.0)], "cell string, d date, s double"))  # too late
                new.coalesce(1).write.mode("append").parquet(f"{at}/in")
                stream = spark.readStream.schema(df.schema).parquet(f"{at}/in")
                live.drain(adaptive.adaptive_stream(stream, tab, "cell", "d", "s", checkpoint=first), f"{at}/out", f"{at}/checkpoint")
            assert told(spark.read.parquet(f"{at}/out")) == want
        with pytest.raises(ValueError, match="hash"):
            adaptive.adaptive_stream(df, tab, "cell", "d", "s", checkpoint=first | {"n_periods_replayed": 1})
    finally:
        spark.conf.unset(name)


def test_verify_instructions_and_feeds(spark):
    from lacuna.operators import wire as W

    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 40):
        data = bytes(n % 3) + rng.integers(0, 256, n).astype(np.uint8).tobytes()
        assert W.base58_bytes(W.base58_text(data)) == data
    assert W.base58_text(b"hello world") == "StV1DL6CwTryKyV" and W.base58_bytes("11") == b"\0\0"  # published pairs
    kinds = [None, "no instruction", "not base58", "too short", "not snappy", "payload too short", "bad offset", "bad extent", "no feed"]
    report = bytes.fromhex(next(iter(W.V11_FEEDS))) + bytes(416)
    rows = spark.createDataFrame([(k, bytearray(report), "clash") for k in kinds] + [(None, bytearray(b"\0\x0a" + bytes(400)), "clash")], "fault string, raw binary, kind string")
    got = W.parsed(W.instructions(rows, "raw", "fault"), "instruction").collect()
    assert [r["error"] for r in got] == [*kinds, None]
    assert bytes(got[0]["report"]) == report and got[0]["schema"] == 11 and got[-1]["schema"] == 10 and len(got[0]["context"]) == 96
    assert W.signed_report("") == (None, None, "too short") and W.signed_report(W.base58_text(b"x" * 8 + b"\5\0\0\0" + b"\xff\xff\xff\xff\x7f"))[2] == "not snappy"
    one = spark.range(1).select(W.feed_symbol(F.lit("0X" + next(iter(W.ALTERNATES)).upper())).alias("a"), W.feed_symbol(F.lit(next(iter(W.ALTERNATES))), label=True).alias("b"), W.feed_symbol(F.lit("00")).alias("c"), F.hex(W.feed_bytes(F.lit("SPYx"), 10)).alias("d"), W.feed_bytes(F.lit("AAPLx"), 11).alias("e")).first()
    assert (one["a"], one["b"], one["c"], one["e"]) == ("NVDAx", "NVDAx_alt", None, None) and W.V10_FEEDS[one["d"].lower()] == "SPYx"


def test_online_radii_against_plain_loops(spark):
    rng, warm, alpha = np.random.default_rng(4), 5, 0.1
    periods = [np.abs(rng.standard_normal(3)) * (1 + i / 30) for i in range(60)]
    df = spark.createDataFrame([("A", day(i), float(x)) for i, s in enumerate(periods) for x in s], "k string, d date, s double").repartition(3)
    got = {r["period"]: r for r in O.conformal_radii(df, "k", "d", "s", 0.9, 0.01, warm).collect()}
    quantile = lambda past, a: np.inf if a <= 0 or not len(past) else 0.0 if a >= 1 else float(np.quantile(past, 1 - a))
    level, bank, weight = alpha, np.full(7, alpha), np.full(7, 1 / 7)
    steps = np.array([0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1])
    eta = math.sqrt(3 / 100 * (math.log(700) + 2))
    start = np.concatenate(periods[:warm])
    q, step, debt = float(np.quantile(start, 0.9)), float(np.quantile(start, 0.95)) * 0.05, 0.0
    for t, s in enumerate(periods):
        past = np.concatenate(periods[:t]) if t else np.zeros(0)
        a, radii = quantile(past, level), np.array([quantile(past, x) for x in bank])
        if t >= warm:
            r = got[day(t)]
            assert (r["aci"], r["dtaci"], r["pi"]) == pytest.approx((a, quantile(past, float(weight @ bank)), max(q, 0.0)))
        loss = np.array([s.max() * alpha if not np.isfinite(x) else np.where(s > x, alpha * (s - x), (alpha - 1) * (s - x)).mean() for x in radii])
        weight = weight * np.exp(-eta * loss)
        weight = 0.995 * weight / weight.sum() + 0.005 / 7
        level = float(np.clip(level + 0.01 * (alpha - (s > a).mean()), -1, 2))
        bank = np.clip(bank + steps * (alpha - np.array([(s > x).mean() for x in radii])), -1, 2)
        off = (s > q).mean() - alpha
        debt += off
        n = max(t + 1, 2)
        q += step * off + step * math.tan(np.clip(debt * math.log(n) / (n * 5), -1.5, 1.5))


def test_density_tests_against_numpy(spark):
    rng = np.random.default_rng(5)
    u = np.clip(rng.beta(1.3, 0.9, 80), 0.001, 0.999)
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(u)] + [("A", 900, 1.0), ("A", 901, None)], "k string, i int, pit double")
    got = D.berkowitz(D.score_sums(D.normal_scores(df, "pit"), ["k"], ["i"])).first()
    z = np.array([normal_quantile(v) for v in u])
    x, y, m = z[:-1], z[1:], len(z) - 1
    rho = np.cov(y, x, ddof=0)[0, 1] / x.var()
    e = y - y.mean() - rho * (x - x.mean())
    base = -0.5 * (y**2).sum() - 0.5 * m * math.log(2 * math.pi)
    full = 2 * (-0.5 * m * (math.log(2 * math.pi * (e**2).mean()) + 1) - base)
    lr_mean = 2 * (-0.5 * ((y - y.mean()) ** 2).sum() - 0.5 * m * math.log(2 * math.pi) - base)
    ar = (x * y).sum() / (x**2).sum()
    lr_ar = 2 * (-0.5 * ((y - ar * x) ** 2).sum() - 0.5 * m * math.log(2 * math.pi) - base)
    assert (got["n"], got["lr"], got["rho"], got["lr_mean"], got["lr_ar1"]) == pytest.approx((80, full, rho, lr_mean, lr_ar))
    miss = (rng.random(60) < 0.15).astype(int)
    cov = rng.standard_normal(60)
    rows = spark.createDataFrame([("A", i, int(v), 0.85, float(c)) for i, (v, c) in enumerate(zip(miss, cov, strict=True))], "k string, i int, miss int, tau double, c double")
    dq = D.dynamic_quantile(rows, ["k"], ["i"], "miss", "tau", covariate="c").first()
    v = miss.astype(float)
    design = np.column_stack([np.ones(56), *[v[4 - k : 60 - k] for k in range(1, 5)], cov[4:]])
    h = design.T @ (v[4:] - 0.15)
    want = float(h @ np.linalg.inv(design.T @ design) @ h / (0.15 * 0.85))
    assert (dq["n"], dq["df"], dq["dq"], dq["p"]) == pytest.approx((56, 6, want, chi2_tail(want, 6)))
    assert D.dynamic_quantile(rows.where("i < 8"), ["k"], ["i"], "miss", "tau").first()["dq"] is None


def test_causal_regressions_against_numpy(spark):
    rng, n = np.random.default_rng(6), 90
    p = pd.DataFrame({"symbol": "A", "fri_ts": [day(7 * i) for i in range(n)], "mon_ts": [day(7 * i + 3) for i in range(n)], "fri_close": 100.0, "point": 100.0, "vix": np.exp(rng.normal(3, 0.3, n)), "mon_open": 100 * np.exp(rng.normal(0, 0.02, n))})
    got = {r["fri_ts"]: r for r in D.loglog_bounds(spark.createDataFrame(p), [0.9]).collect()}
    r = np.log(p["mon_open"] / 100).to_numpy()
    for i in (50, 70, 89):
        x = np.column_stack([np.ones(i), np.log(p["vix"][:i])])
        b = np.linalg.lstsq(x, np.log(np.abs(r[:i])), rcond=None)[0]
        z = r[:i] / np.exp(x @ b)
        now = math.exp(b[0] + b[1] * math.log(p["vix"][i]))
        assert got[day(7 * i)]["lower"] == pytest.approx(100 * math.exp(np.quantile(z, 0.05) * now), rel=1e-6)
    bars = pd.DataFrame({"symbol": "A", "ts": [day(i) for i in range(7 * n)], "close": 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 7 * n)))})
    sig = {x["fri_ts"]: x["sigma_har"] for x in D.har_sigma(spark.createDataFrame(p), spark.createDataFrame(bars)).collect()}
    rv = np.concatenate([[np.nan], np.diff(np.log(bars["close"])) ** 2])
    feats = np.array([[rv[k], rv[k - 4 : k + 1].mean(), rv[k - 21 : k + 1].mean()] if k > 21 else [np.nan] * 3 for k in range(0, 7 * n, 7)])
    i = 80
    fine = np.isfinite(feats[:i]).all(axis=1)
    x = np.column_stack([np.ones(fine.sum()), feats[:i][fine]])
    b = np.linalg.solve(x.T @ x + 1e-10 * np.eye(4), x.T @ (r[:i][fine] ** 2))
    assert sig[day(7 * i)] == pytest.approx(100 * math.sqrt(max(b @ np.r_[1, feats[i]], 1e-8)), rel=1e-4)


def test_garch_and_tails_recover_what_made_them():
    rng = np.random.default_rng(7)
    e, s = [], 1.0
    for _ in range(3000):
        e.append(rng.normal(0, math.sqrt(s)))
        s = 0.05 + 0.1 * e[-1] ** 2 + 0.85 * s
    omega, alpha, beta, _ = O.garch_fit(np.array(e), False)
    assert alpha == pytest.approx(0.1, abs=0.05) and beta == pytest.approx(0.85, abs=0.1) and omega / (1 - alpha - beta) == pytest.approx(1.0, abs=0.3)
    x = (rng.random(4000) ** -0.3 - 1) / 0.3 * 2
    shape, scale = TL.pareto_fit(x)
    assert shape == pytest.approx(0.3, abs=0.08) and scale == pytest.approx(2.0, rel=0.1)
    assert TL.pareto_quantile(1.0, 0.0, 2.0, math.exp(-1)) == pytest.approx(3.0)
    y = np.abs(rng.standard_normal(600))
    beta, nxt = TL.caviar(y, 0.9)
    q = TL.recursion(y, beta, float(np.quantile(y[:60], 0.9)), False)[:-1]
    assert (y > q).mean() == pytest.approx(0.1, abs=0.03) and nxt > 0


def test_resampling(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([("A", day(i), float(v)) for i, v in enumerate(rng.normal(5, 1, 300))], "k string, d date, v double")
    for kind in ("poisson", "multinomial"):
        r = R.block_bootstrap(rows, "d", ["k"], "v", 300, 1, kind=kind).first()
        assert r["lo"] < r["mean"] < r["hi"] and (r["hi"] - r["lo"]) == pytest.approx(2 * 1.96 / math.sqrt(300), rel=0.3)
    m = R.moving_blocks(rows, ["k"], "d", "v", 10, 200).first()
    assert m["n"] == 300 and m["lo"] < m["mean"] < m["hi"]
    walk = spark.createDataFrame([("A", day(i), float(v)) for i, v in enumerate(np.cumsum(rng.normal(0, 1, 200)))], "k string, d date, v double")
    assert R.permuted_lag(walk, ["k"], "d", "v").first()["p"] < 0.02 and R.permuted_lag(rows, ["k"], "d", "v").first()["p"] > 0.02
    assert R.permuted_lag(rows.limit(50), ["k"], "d", "v").count() == 0


def test_ladder_borders_and_costs(spark):
    df = spark.createDataFrame([(74.99, 0.85), (75.0, 0.85), (84.99, 0.85), (85.0, 0.85), (73.0, 0.7225)], "debt double, lim double")
    said = [r[0] for r in df.select(L.decide(F.col("debt"), F.lit(100.0), F.col("lim"))).collect()]
    assert said == ["Safe", "Caution", "Caution", "Liquidate", "Liquidate"]
    assert df.limit(1).select(L.decide(F.col("debt"), F.lit(100.0), F.col("lim"), clipped=F.lit(True))).first()[0] == "Caution"
    assert df.limit(1).select(L.cost(F.lit("Safe"), F.lit("Liquidate"))).first()[0] == 4.0
    with pytest.raises(ValueError):
        L.variants(df, df, "neither")
    with pytest.raises(ValueError):
        L.weighted_grid(df, "none")


def test_calendar_regimes_and_configs(spark):
    assert [str(d) for d in X.full_closes(2027)] == ["2027-01-01", "2027-01-18", "2027-02-15", "2027-03-26", "2027-05-31", "2027-06-18", "2027-07-05", "2027-09-06", "2027-11-25", "2027-12-24"]
    times = ["2025-03-10 13:29:59", "2025-03-10 13:30:00", "2025-03-10 19:59:59", "2025-03-10 20:00:00", "2025-11-28 17:59:59", "2025-11-28 18:00:00", "2025-01-09 15:00:00", "2025-03-08 15:00:00", "2025-11-03 14:29:59", "2025-11-03 14:30:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r["t"]: r["calendar"] for r in X.calendar_signal(df, "ts", X.holidays(spark, [2025])).collect()}
    assert [got[t] for t in times] == ["closed", "open", "open", "closed", "open", "closed", "closed", "closed", "closed", "open"]
    signals = {("halted", "open"): "halted", ("extended", "open"): "open", ("open", "closed"): "unknown", ("closed", "open"): "unknown", ("unknown", "closed"): "closed", ("closed", "n/a"): "closed", ("unknown", "n/a"): "unknown"}
    df = spark.createDataFrame([(*k, v) for k, v in signals.items()], "o string, c string, want string")
    assert df.where(X.regime_of(F.col("o"), F.col("c")) != F.col("want")).count() == 0
    cfg = spark.createDataFrame([([0, 2], [True, True], 2, 100, 500), ([0, 9], [True, False], 1, 100, 500), ([0, 2], [False, True], 1, 20_000, 500), ([0] * 6, [True] * 6, 7, 1, 1)], "kinds array<int>, active array<boolean>, quorum int, max_confidence_bps int, max_deviation_bps int")
    assert [r[0] for r in cfg.select(X.config_faults(cfg)).collect()] == ["", "kind", "order, bps", "upstreams, quorum"]


def test_pools_shares_and_roots(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 3, 4, 10**18 - 1, 10**18, (3 * 10**9 + 7) ** 2 - 1)], "x long")
    assert [r[0] for r in df.select(X.root(F.col("x"))).collect()] == [math.isqrt(v) for v in (0, 1, 3, 4, 10**18 - 1, 10**18, (3 * 10**9 + 7) ** 2 - 1)]
    swap = spark.createDataFrame([(1000, 100_000, 5, "sell", 95, 105, 30), (1000, 100_000, 200, "sell", 95, 105, 30), (1000, 100_000, 0, "buy", 95, 105, 30), (1000, 100_000, 5, "buy", 105, 95, 30)], "reserves_base long, reserves_quote long, amount long, side string, lower long, upper long, fee long")
    got = X.quoted(swap, 0, 0, 0, 100, 300).collect()
    net = 5 * 9970 // 10_000
    assert (got[0]["out"], got[0]["in_band"], got[0]["fee_bps"]) == (net * 100_000 // (1000 + net), True, 30)
    first = 200 * 9970 // 10_000 * 100_000 // (1000 + 200 * 9970 // 10_000)
    extra = min((95 - (100_000 - first) // 1200) * 100 // 10, 300)
    net = 200 * (10_000 - 30 - extra) // 10_000
    assert (got[1]["out"], got[1]["in_band"], got[1]["fee_bps"], got[1]["fee_paid"]) == (net * 100_000 // (1000 + net), False, 30 + extra, 200 - net)
    assert [r["error"] for r in got[2:]] == ["ZeroAmountIn", "InvertedBand"]


def test_reports_payloads_and_fixed_point(spark):
    word = lambda v: (v % (1 << 256)).to_bytes(32, "big")
    values = [12345, 1700000000, 1700000001, 0, 0, 1700003600, 1700000000123456789, -5 * 10**17, 2, 10**18, 10**18, 0, 1234567 * 10**15]
    raw = b"".join(map(word, values))
    df = spark.createDataFrame([(bytearray(raw),), (bytearray(raw[:-1]),)], "raw binary")
    a, b = B.report(df, "raw", B.V10).collect()
    assert (a["price"], a["tokenized_price"], a["last_update_ns"], a["market_status"]) == (-0.5, 1234.567, 1700000000123456789, 2) and b["price"] is None
    row = spark.createDataFrame([("SPY", "high_vol", "lwc", "amm", 0.95, 0.95, 0.02, 500.25, 490.5, 510.125, 501.0, dt.date(2024, 5, 3))], "symbol string, regime string, forecaster string, profile string, target double, served double, buffer double, point double, lower double, upper double, fri_close double, fri_ts date")
    sent = B.payload(row)
    raw = bytes(sent.first()["payload"])
    assert len(raw) == 67 and raw[:11] == bytes([1, 2, 3, 248, 2]) + (9500).to_bytes(2, "little") * 2 + (200).to_bytes(2, "little") and raw[11:27] == b"SPY" + bytes(13)
    assert int.from_bytes(raw[27:35], "little") == 50_025_000_000 and int.from_bytes(raw[59:], "little") == 1714766400
    got = B.payload_read(sent).first()
    assert (got["symbol_read"], got["regime"], got["forecaster"], got["upper"], got["error"]) == ("SPY", "high_vol", "lwc", 510.125, None)
    assert B.payload(row.withColumn("symbol", F.lit("a-symbol-that-is-long"))).first()["payload"] is None
    assert B.payload_read(B.payload(row.withColumn("lower", F.lit(600.0)))).first()["error"] == "band"
    n = spark.createDataFrame([(v,) for v in (-1999, 1999, 10**12)], "v long")
    assert [r[0] for r in n.select(B.rescaled(F.col("v"), -3, 0)).collect()] == [-1, 1, 10**9]
    assert [r[0] for r in n.select(B.rescaled(F.col("v"), 0, -8)).collect()] == [-199_900_000_000, 199_900_000_000, None]


def test_publishing_cadence_against_a_loop(spark):
    rng = np.random.default_rng(9)
    rows = [(s, int(t), "band" if rng.random() < 0.2 else None) for s in "AB" for t in np.unique(np.cumsum(rng.integers(1, 9, 80)))]
    df = spark.createDataFrame(rows, "symbol string, t long, error string").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r["symbol"], r["t"]): r["error"] for r in B.published(df, "symbol", "ts", 10).collect()}
    for s in "AB":
        last = None
        for _, t, error in sorted(r for r in rows if r[0] == s):
            if error is None and last is not None and t - last < 10:
                error = "cadence"
            elif error is None:
                last = t
            assert got[s, t] == error


def test_sessions_as_of_falls_back(spark):
    at = lambda m: dt.datetime(2024, 1, 2) + dt.timedelta(minutes=m)
    left = spark.createDataFrame([("A", at(100), 1), ("A", at(500), 2), ("B", at(100), 3)], "k string, ts timestamp, i int")
    right = spark.createDataFrame([("A", at(50), 10, "rth"), ("A", at(90), 11, "late"), ("A", at(480), 12, "late")], "k string, ts timestamp, o long, s string")
    got = {r["i"]: r["o"] for r in J.session_as_of(left, right, "k", "ts", ["o"], "o", "s", "rth", 3600).collect()}
    assert got == {1: 10, 2: 12, 3: None}


def test_tapes_sidecars_and_archives(spark, tmp_path):
    root = f"file://{tmp_path}"
    for kind, tape in T.TAPES.items():
        empty = T.scanned(spark, kind, root, "2024-01-01", "2024-01-03", "X" if tape.key else None)
        assert empty.count() == 0 and len(empty.columns) == len(spark.createDataFrame([], tape.schema).columns)
    assert T.as_date("2024-05-01T23:30:00-05:00") == dt.date(2024, 5, 2) and T.as_date(dt.datetime(2024, 5, 1, 23)) == dt.date(2024, 5, 1)
    assert T.latest(["a_frozen_20240101.json", "x/a_frozen_20240301.json", "b_frozen_20250101.json"], "a") == "x/a_frozen_20240301.json" and T.latest([], "a") is None
    tables = T.sidecar_tables(spark, '{"quantile_table": {"normal": {"0.95": 2.5}}, "c_bump_schedule": {"0.68": 1.1}}')
    assert [tuple(r) for r in tables["quantile_table"].collect()] == [("normal", 9500, 2.5)] and tables["delta_shift_schedule"].count() == 0
    assert all(t.count() == 0 for t in T.sidecar_tables(spark, None).values())
    (tmp_path / "bands.csv").write_text("weekend_date,mon_date,symbol,tau,lower,upper,point,half_width_bps,regime_code,forecaster_code,profile_code,artefact_sha256,provenance,computed_ts\n2024-05-03,2024-05-06,SPY,0.95,490.5,510.25,500.0,200.0,normal,3,2,ab,x,2024-05-03 21:00:00\n")
    got = T.archive(spark, "bands", f"{root}/bands.csv").first()
    assert (got["weekend_date"], got["tau"], got["upper"], got["profile_code"]) == (dt.date(2024, 5, 3), 0.95, 510.25, 2)
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    path = f"{root}/archive"
    assert [T.archived(spark, rows, ["k"], path), T.archived(spark, rows, ["k"], path), T.archived(spark, rows.unionByName(spark.createDataFrame([("c", "3")], rows.schema)), ["k"], path)] == [(2, 2), (0, 2), (1, 3)]


def test_truths_and_freshness(spark):
    bands = spark.createDataFrame([("A", day(0), day(3)), ("A", day(7), day(10)), ("A", day(14), day(17))], "symbol string, fri_ts date, mon_ts date")
    truth = spark.createDataFrame([("A", day(0), 1.0)], "symbol string, fri_ts date, truth double")
    assert [r["status"] for r in A.with_truth(bands, truth, str(day(12))).orderBy("fri_ts").collect()] == ["known", "missing", "pending"]
    side = A.frozen('{"quantile_table": {}}', "rows")
    assert A.artefact_intact(side, "rows") and not A.artefact_intact(side, "others") and not A.artefact_intact(side.replace("{}", "1"), "rows")


def test_streams_keep_state_over_batches(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    base = dt.datetime(2024, 1, 1)
    files = [[(1, 0, 5.0), (2, 30, 7.0)], [(2, 30, 7.0), (3, 10, 1.0), (4, 60 * 30, 9.0)], [(5, 60 * 60, 2.0)], [(6, 5, 100.0), (7, 60 * 60 + 1, 3.0)]]
    for i, rows in enumerate(files):
        p = pd.DataFrame([("A", base + dt.timedelta(minutes=m), v, e) for e, m, v in rows], columns=["symbol", "ts", "value", "event_id"])
        p["ts"] = p["ts"].astype("datetime64[us]")
        p.to_parquet(src / f"{i}.parquet")
    ticks = spark.readStream.schema("symbol string, ts timestamp_ntz, value double, event_id long").option("maxFilesPerTrigger", 1).parquet(str(src)).withColumn("ts", F.col("ts").cast("timestamp"))
    live.drain(live.live_bars(ticks, late="1 hour"), f"{out}/bars", f"{out}/bars-state", "update")
    got = spark.read.parquet(f"{out}/bars").groupBy("bar").agg(F.max_by(F.struct("open", "high", "low", "close", "n"), "batch").alias("v")).orderBy("bar").collect()
    assert tuple(got[0]["v"]) == (5.0, 7.0, 1.0, 7.0, 3)  # the repeat counts once, the tick of the first day that came days late not at all
    live.drain(ticks.select("event_id", "value"), f"{out}/once", f"{out}/once-state", key=["event_id"])
    once = spark.read.parquet(f"{out}/once")
    assert once.count() == 7 and once.select("event_id").distinct().count() == 7
