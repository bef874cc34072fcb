"""As-of by days, anchored windows, sliding regressions, bundles and SQL functions against plain loops."""

import datetime as dt

import numpy as np
import pytest

from lacuna.functions import sql_functions
from lacuna.operators import density, factors, joins, variants

T0 = dt.datetime(2024, 3, 1)


def at(minutes: int) -> dt.datetime:
    return T0 + dt.timedelta(minutes=int(minutes))


def ticks_of(rng, n, span, keys=2):
    return [(f"k{i % keys}", at(rng.integers(span)), float(round(rng.normal(100, 5), 3)), int(i)) for i in range(n)]


def test_as_of_by_day_is_as_of(spark):
    rng = np.random.default_rng(3)
    right = ticks_of(rng, 300, 60 * 24 * 9)
    right += [(right[0][0], right[0][1], 1.0, 999), ("k0", None, 5.0, 7), (None, at(5), 5.0, 8)]  # a tie in time, no time, no key
    left = [(f"k{i % 3}", at(m), i) for i, m in enumerate(rng.integers(-3000, 60 * 24 * 14, 200))] + [("k0", None, 900), (None, at(50), 901)]
    r = spark.createDataFrame(right, "key string, ts timestamp, x double, o long")
    le = spark.createDataFrame(left, "key string, ts timestamp, id long")
    for within in (None, 7200):
        got = {row["id"]: (row["x"], row["as_of"]) for row in joins.as_of_by_day(le, r, "key", "ts", ["x"], "o", within).collect()}
        assert len(got) == len(left)
        for key, ts, i in left:
            seen = [q for q in right if key is not None and ts is not None and q[0] == key and q[1] is not None and q[1] <= ts]
            best = max(seen, key=lambda q: (q[1], q[3]), default=None)
            if best and within is not None and (ts - best[1]).total_seconds() > within:
                best = None
            assert got[i] == ((best[2], best[1]) if best else (None, None))
    assert joins.as_of_by_day(le.limit(0), r, "key", "ts", ["x"], "o").count() == 0
    assert joins.as_of_by_day(le, r.limit(0), "key", "ts", ["x"], "o").where("x IS NULL").count() == len(left)


def test_anchored_windows_against_a_loop(spark):
    rng = np.random.default_rng(5)
    ticks = [(f"k{i % 2}", at(m), float(p), float(p + rng.random()), float(p + 0.3)) for i, (m, p) in enumerate(zip(rng.integers(0, 60 * 24 * 8, 400), rng.normal(100, 3, 400), strict=True))]
    ticks += [("k2", at(2000), 5.0, 6.0, 5.5), ("k2", at(2000), 4.0, 6.5, 5.7), ("k2", at(2100), 7.0, 8.0, 7.5)]  # no tick before; two at one time
    windows = [(f"k{i % 2}", at(m), at(m + w), i) for i, (m, w) in enumerate(zip(rng.integers(-500, 60 * 24 * 7, 60), rng.integers(1, 5000, 60), strict=True))]
    windows += [("k2", at(1900), at(2200), 100), ("k2", at(1900), at(2200), 101), ("k2", at(1999), at(2200), 102), ("k9", at(0), at(9000), 103)]  # shared, first inside, in grace, no ticks
    t = spark.createDataFrame(ticks, "key string, ts timestamp, low double, high double, close double")
    w = spark.createDataFrame(windows, "key string, a timestamp, b timestamp, id long")
    got = {r["id"]: (r["n"], r["low"], r["high"], r["anchor"]) for r in joins.anchored_extrema(w, t, "key", "a", "b").collect()}
    want = {}
    for key, a, b, i in windows:
        own = [x for x in ticks if x[0] == key]
        inside = [x for x in own if a <= x[1] <= b]
        if inside:
            pre = max((x for x in own if x[1] <= a + dt.timedelta(seconds=60)), key=lambda x: (x[1], x[4]), default=None)
            first = min(inside, key=lambda x: (x[1], -x[4]))
            want[i] = (len(inside), min(x[2] for x in inside), max(x[3] for x in inside), (pre or first)[4])
    assert got == want and got[101][3] == 5.7 and got[102][3] == 5.7 and 103 not in got and got[100] == got[101]


def test_anchored_paths_scale_by_the_close_and_drop_the_pivot(spark):
    gap = lambda s, f, m: (s, dt.date.fromisoformat(f), dt.date.fromisoformat(m), 200.0)
    panel = spark.createDataFrame([gap("A", "2024-01-05", "2024-01-08"), gap("A", "2024-07-05", "2024-07-08"), gap("P", "2023-06-02", "2023-06-05"), gap("P", "2024-01-05", "2024-01-08")], "symbol string, fri_ts date, mon_ts date, fri_close double")
    bar = lambda s, lo, hi, c: (factors.DEFAULT, dt.datetime.fromisoformat(s), lo, hi, c)
    bars = spark.createDataFrame(
        [bar("2024-01-05 20:59:00", 1.0, 900.0, 50.0), bar("2024-01-05 21:01:00", 40.0, 60.0, 100.0), bar("2024-01-08 14:30:00", 90.0, 120.0, 110.0), bar("2024-01-08 14:31:00", 1.0, 999.0, 1.0),
         bar("2024-07-05 19:59:00", 2.0, 800.0, 80.0), bar("2024-07-08 13:30:00", 70.0, 88.0, 75.0), bar("2024-07-08 14:00:00", 3.0, 777.0, 7.0), bar("2023-06-03 00:00:00", 9.0, 11.0, 10.0)],
        "symbol string, ts timestamp, low double, high double, close double",
    )
    out = factors.anchored_paths(panel, bars, pivot=("P", "2024-01-01", "other"))
    got = {(r["symbol"], str(r["fri_ts"])): (r["n_bars"], r["anchor"], r["path_lo"], r["path_hi"]) for r in out.collect()}
    assert got[("A", "2024-01-05")] == (2, 100.0, 80.0, 240.0)  # winter: 21:00 to 14:30; a minute after the start still anchors
    assert got[("A", "2024-07-05")] == (1, 80.0, 175.0, 220.0)  # summer: 20:00 to 13:30
    assert ("P", "2024-01-05") not in got and got[("P", "2023-06-02")][0] == 1


def reference_fits(x, y, fine, window, least):
    out = np.full(x.shape, np.nan)
    for i in range(len(x)):
        use = [j for j in range(max(0, i - window), i) if fine[j]]
        if len(use) >= least:
            kept = [0, 1] + [c for c in range(2, x.shape[1]) if len(set(x[use, c])) > 1]
            out[i] = 0
            out[i, kept] = np.linalg.lstsq(x[np.ix_(use, kept)], y[use], rcond=None)[0]
    return out


def test_sliding_fits_with_constant_and_dependent_columns():
    rng = np.random.default_rng(8)
    n = 700
    rare = (rng.random(n) < 0.01).astype(float)  # often constant in a window
    flag = (rng.random(n) < 0.4).astype(float)
    x = np.column_stack([np.ones(n), rng.normal(3, 0.3, n), rare, flag, 1 - flag])  # the last two add up to the first
    y = 0.5 + 0.8 * x[:, 1] + 0.3 * flag + rng.normal(0, 0.2, n)
    fine = rng.random(n) < 0.9
    got, want = density._sliding_fits(x, y, fine, 60, 20, 2), reference_fits(x, y, fine, 60, 20)
    assert (np.isnan(got) == np.isnan(want)).all()
    there = np.isfinite(want[:, 0])
    assert np.allclose(got[there], want[there], atol=1e-7) and (want[there][:, 2] == 0).any() and (want[there][:, 2] != 0).any()
    none = np.zeros(n, bool)
    assert np.isnan(density._sliding_fits(x, y, none, 60, 20, 2)).all() and density._sliding_fits(x[:0], y[:0], none[:0], 60, 20, 2).shape == (0, 5)


def test_loglog_fits_against_a_loop(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s in ("a", "b"):
        for i in range(130):
            vix = None if i == 40 else float(np.exp(rng.normal(3, 0.3)))
            point = 100.0 + i
            rows.append((s, dt.date(2020, 1, 3) + dt.timedelta(7 * i), point if i == 50 else point * float(np.exp(rng.normal(0, 0.02))), point, vix, i % 5 == 0, None if i == 60 else float(i % 7 == 0)))
    df = spark.createDataFrame(rows, "symbol string, fri_ts date, mon_open double, point double, vix double, event boolean, other double")
    out = density.loglog_fits(df.repartition(3), (0.68, 0.95), window=52, least=20, extras=("event", "other"))
    got = {(r["symbol"], r["fri_ts"]): r for r in out.collect()}
    n_want = 0
    for s in ("a", "b"):
        own = [r for r in rows if r[0] == s]
        r_ = np.array([np.log(q[2] / q[3]) for q in own])
        x = np.array([[1, np.log(q[4]) if q[4] else np.nan, float(q[5]), np.nan if q[6] is None else q[6]] for q in own])
        whole = np.isfinite(x).all(axis=1)
        fine = whole & (np.abs(r_) > 1e-10)
        y = np.where(fine, np.log(np.where(fine, np.abs(r_), 1)), 0)
        beta = reference_fits(np.where(fine[:, None], x, 0), y, fine, 52, 20)
        for i in range(len(own)):
            if not (whole[i] and np.isfinite(beta[i, 0])):
                assert (s, own[i][1]) not in got
                continue
            n_want += 1
            use = [j for j in range(max(0, i - 52), i) if fine[j]]
            z, now, row = r_[use] / np.exp(x[use] @ beta[i]), np.exp(x[i] @ beta[i]), got[s, own[i][1]]
            assert row["n_fit"] == len(use) and np.allclose(row["coefs"], beta[i], atol=1e-7) and np.isclose(row["sigma_now"], now)
            assert np.allclose(row["lower"], [own[i][3] * np.exp(np.quantile(z, (1 - t) / 2) * now) for t in (0.68, 0.95)])
            assert np.allclose(row["upper"], [own[i][3] * np.exp(np.quantile(z, (1 + t) / 2) * now) for t in (0.68, 0.95)])
    assert n_want == len(got) > 150


def gaps(spark, n=60):
    rng = np.random.default_rng(2)
    rows = []
    for s in ("a", "b", "c"):
        for i in range(n):
            close, move = 100.0, float(rng.normal(0, 0.02))
            rows.append((s, dt.date(2020, 1, 3) + dt.timedelta(7 * i), "r1" if i % 3 else "r2", close, close, close * (1 + move), move, abs(move)))
    return spark.createDataFrame(rows, "symbol string, fri_ts date, regime_pub string, fri_close double, point double, mon_open double, rel_resid double, score_raw double")


RULES = "variant string, method string, half_life double, window int, alpha double, cell string"


def test_bundle_takes_the_least_shift_that_holds(spark):
    rules = spark.createDataFrame([("one", "ewma", 6.0, None, None, None), ("two", "blend", 8.0, 12, 0.25, "regime_pub")], RULES)
    rows = variants.scaled(gaps(spark), rules)
    got = rows.collect()
    train, tune = [r for r in got if r["fri_ts"] < dt.date(2020, 9, 1)], [r for r in got if r["fri_ts"] >= dt.date(2020, 9, 1)]
    taus, shifts = (0.68, 0.95), (0.0, 0.02, 0.05)
    made = variants.fitted(rows.where("fri_ts < '2020-09-01'"), rows.where("fri_ts >= '2020-09-01'"), taus, shifts)
    seen = {(r["variant"], r["cell"], r["tau_bps"]): (r["shift"], r["n"], r["q"]) for r in made.collect()}
    want = {}
    for v in ("one", "two"):
        cells = {r["cell"] for r in train if r["variant"] == v}
        for t in taus:
            for d in shifts:
                q = {}
                for c in cells:
                    line = sorted(r["score"] for r in train if (r["variant"], r["cell"]) == (v, c))
                    q[c] = (len(line), line[int(min(max(np.ceil(min(t + d, 0.999) * (len(line) + 1)), 1), len(line))) - 1])
                hits = [r["score"] <= q[r["cell"]][1] for r in tune if r["variant"] == v and r["cell"] in q]
                if d == shifts[-1] or np.mean(hits) >= t:
                    want |= {(v, c, int(round(t * 10_000))): (d, *q[c]) for c in cells}
                    break
    assert seen == want and {k[1] for k in seen if k[0] == "one"} == {"all"}
    side = variants.side_by_side(variants.served(rows.where("fri_ts >= '2020-09-01'"), made), "one").collect()
    assert len(side) == 4 and all(r["width_ratio"] == 1 for r in side if r["variant"] == "one") and len({r["n"] for r in side}) == 1
    empty = variants.fitted(rows.where("fri_ts < '2020-09-01'"), rows.limit(0), taus, shifts)
    assert {r["shift"] for r in empty.collect()} == {0.05}


def test_bundles_that_are_wrong_stop(spark):
    bad = spark.createDataFrame([("one", "guess", 6.0, None, None, None)], RULES)
    with pytest.raises(ValueError, match="no method"):
        variants.scaled(gaps(spark), bad)
    twice = spark.createDataFrame([("one", "ewma", 6.0, None, None, None), ("one", "ewma", 8.0, None, None, None)], RULES)
    with pytest.raises(ValueError, match="one name"):
        variants.scaled(gaps(spark), twice)


def test_sql_functions(spark):
    names = sql_functions.register(spark)
    assert sql_functions.register(spark) == names and len(names) == 4
    ask = lambda x: spark.sql(f"SELECT {x} AS x").first()["x"]
    for x in (0.1, 0.68, 0.7, 0.9, 0.95, 0.97, 0.999):
        assert np.isclose(ask(f"lacuna_line_at({x}D, array(0.68D, 0.85D, 0.95D), array(1D, 2D, 5D))"), np.interp(x, [0.68, 0.85, 0.95], [1, 2, 5]))
    assert ask("lacuna_line_at(CAST(NULL AS DOUBLE), array(0D, 1D), array(1D, 2D))") is None
    assert np.isclose(ask("lacuna_winkler(1D, 2D, 2.5D, 0.9D)"), 1 + 20 * 0.5) and np.isclose(ask("lacuna_kupiec_lr(0L, 10L, 0.9D)"), -20 * np.log(0.9))
    assert ask("lacuna_kupiec_lr(0L, 0L, 0.9D)") is None
    rows = spark.sql("SELECT k, b.* FROM VALUES (1, 100D), (2, CAST(NULL AS DOUBLE)) AS p(k, point), LATERAL lacuna_bands_at(point, 2D, array(0.5D, 0.9D), array(1D, 3D), array(0.5D, 0.7D)) b ORDER BY k, tau").collect()
    assert [(r["k"], r["tau"], r["lower"], r["upper"]) for r in rows][:2] == [(1, 0.5, 98.0, 102.0), (1, 0.7, 96.0, 104.0)] and rows[2]["lower"] is None and len(rows) == 4
    assert spark.sql("SELECT b.* FROM VALUES (1D) AS p(x), LATERAL lacuna_bands_at(x, 2D, array(0.5D), array(1D), CAST(NULL AS ARRAY<DOUBLE>)) b").count() == 0


def independence(lines):
    """The likelihood ratio of following misses, summed over lines that have one, and how many do."""
    total, k = 0.0, 0
    log = lambda n, p: n * np.log(max(p, 1e-12)) if n else 0.0
    for line in lines:
        n = {(a, b): sum((p, q) == (a, b) for p, q in zip(line[:-1], line[1:], strict=True)) for a in (0, 1) for b in (0, 1)}
        if n[0, 0] + n[0, 1] and n[1, 0] + n[1, 1]:
            p0, p1, p = n[0, 1] / (n[0, 0] + n[0, 1]), n[1, 1] / (n[1, 0] + n[1, 1]), (n[0, 1] + n[1, 1]) / sum(n.values())
            own = log(n[0, 0], 1 - p0) + log(n[0, 1], p0) + log(n[1, 0], 1 - p1) + log(n[1, 1], p1)
            total, k = total + max(2 * (own - log(n[0, 0] + n[1, 0], 1 - p) - log(n[0, 1] + n[1, 1], p)), 0), k + 1
    return total, k


def test_walk_forward_buffers_against_a_loop(spark):
    from lacuna.functions.special import chi2_tail
    from lacuna.operators import audit

    rng = np.random.default_rng(12)
    rows = []
    for s in ("a", "b", "c"):
        day = dt.date(2018, 1, 5)
        while day < dt.date(2022, 1, 1):
            if s != "c" or day.year != 2019:  # c has a year without rows, which a pair of its line spans
                rows.append((s, day, None if rng.random() < 0.03 else float(rng.choice([0.5, 1.0, 1.5, 2.0, 3.0]) * (1 + (day.year == 2021)))))
            day += dt.timedelta(int(rng.choice([3, 7, 14])))
    grid, tau = (0.5, 1.0, 1.5, 2.0, 2.5, 4.0), 0.85
    out = audit.walk_forward_buffers(spark.createDataFrame(rows, "symbol string, fri_ts date, score double").repartition(3), "score", grid, tau)
    got = {r["cutoff"]: r for r in out.collect()}
    own = [(s, d, x, d.year * 4 + (d.month - 1) // 3) for s, d, x in rows if x is not None]
    low, high = min(r[3] for r in own), max(r[3] for r in own)

    def told(a, b, buffer):  # noqa: ANN001, ANN202
        use = [r for r in own if a <= r[3] < b]
        x = sum(r[2] > buffer for r in use)
        n, hit = len(use), 1 - x / len(use)
        lr = 2 * ((n - x) * np.log(hit) + (x * np.log(x / n) if x else 0) - (n - x) * np.log(tau) - x * np.log(1 - tau)) if hit else np.inf
        ind, k = independence([[int(r[2] > buffer) for r in sorted(use) if r[0] == s] for s in "abc"])
        return n, hit, chi2_tail(max(lr, 0.0), 1) if np.isfinite(lr) else 0.0, chi2_tail(ind, k) if k else None

    assert len(got) == high - low - 3
    for cut in range(low + 4, high + 1):
        ranked = []
        for b in grid:
            _, hit, p_uc, p_ind = told(cut - 4, cut, b)
            rank = 0 if hit >= tau - 0.005 and p_uc > 0.1 and (p_ind or 0) > 0.05 else 1 if hit >= tau - 0.005 and p_uc > 0.05 else 2 if hit >= tau else 3
            ranked.append((rank, b if rank < 3 else -b, b))
        rank, _, b = min(ranked)
        row, (n, hit, p_uc, p_ind) = got[dt.date(cut // 4, cut % 4 * 3 + 1, 1)], told(cut, cut + 4, b)
        assert (row["buffer"], row["status"], row["n"]) == (b, ("PASS", "MARGINAL", "CEILING", "CEILING")[rank], n)
        assert np.isclose(row["realised"], hit) and np.isclose(row["p_uc"], p_uc, atol=1e-6)
        assert (row["p_ind"] is None) == (p_ind is None) and (p_ind is None or np.isclose(row["p_ind"], p_ind, atol=1e-6))
    assert audit.walk_forward_buffers(spark.createDataFrame([], "symbol string, fri_ts date, score double"), "score", grid, tau).count() == 0


def test_latest_pairs_and_their_missing_edges(spark):
    from lacuna.operators import audit

    day = lambda x: dt.date(2024, 1, x)
    lead = spark.createDataFrame([(day(x),) for x in (1, 2, 5, 8, 9, 12, 15, 15)], "ts date")
    asked = spark.createDataFrame([(day(x),) for x in (1, 7, 8, 14, 15, 31)], "today date")
    got = {r["today"].day: r["fri_ts"] and (r["fri_ts"].day, r["mon_ts"].day) for r in audit.latest_pairs(lead, asked, "2024-01-04").collect()}
    assert got == {1: None, 7: None, 8: (5, 8), 14: (9, 12), 15: (12, 15), 31: (12, 15)}
    there = spark.createDataFrame([("a", day(12)), ("a", day(15)), ("b", day(15)), ("b", day(15))], "symbol string, day date")
    symbols = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "symbol string, hard boolean")
    pairs = audit.latest_pairs(lead, asked.where("today IN ('2024-01-01', '2024-01-31')"), "2024-01-04")
    seen = sorted((r["symbol"], r["edge"], r["day"].day, r["kind"]) for r in audit.missing_edges(pairs, there, symbols).collect())
    assert seen == [("b", "fri", 12, "hard"), ("c", "fri", 12, "soft"), ("c", "mon", 15, "soft")]
    assert audit.latest_pairs(lead.limit(0), asked, "2024-01-04").where("fri_ts IS NOT NULL").count() == 0
