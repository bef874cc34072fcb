"""Recursions along time: adaptive multipliers and their sealed state, online conformal radii, drift alarms, late data."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import running, sized, written

# The rule of the adaptive multipliers, and the name of its state.
RATE, LOWEST, HIGHEST = 0.05, 0.25, 4.0
STATE = "adaptive_state.v1"
# The step sizes of online methods' experts, and their horizon in periods.
STEPS, HORIZON = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1), 100


def _periods(batches: Iterator[pa.RecordBatch], key: Sequence[str], period: str) -> Iterator[tuple[tuple, object, pd.DataFrame]]:
    """Rows sorted by key and period as whole periods, as they come: no more than one period is held."""
    held: list[pd.DataFrame] = []
    at = None
    for b in batches:
        p = b.to_pandas()
        for where, own in p.groupby([*key, period], sort=False, dropna=False):
            if at is not None and where != at:
                yield at[:-1], at[-1], pd.concat(held) if len(held) > 1 else held[0]
                held = []
            at = where
            held.append(own)
    if at is not None:
        yield at[:-1], at[-1], pd.concat(held) if len(held) > 1 else held[0]


def adaptive_replay(scores: DataFrame, table: DataFrame, cell: str, period: str, score: str, rate: float = RATE, start: Mapping[tuple[str, int], float] | None = None) -> DataFrame:
    """The adaptive multipliers of every cell and tau over the periods in order, whatever the order of the rows: cell,
    tau_bps, period, n, m_served and m_next.

    m begins at 1, or where start has it; a period is served with the m from before it, then m grows by exp(rate (miss
    share - (1 - tau))), within its bounds. Rows without a score take no part; a caller's score of a row whose half-width
    is nothing, such as one with a scale of 0, is infinite, a sure miss, if it moved at all. A cell and tau is one recursion; its rows are sorted and streamed, and a task holds one period of them.
    """
    begin = dict(start or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, m, out = None, 1.0, []
        for key, when, rows in _periods(batches, ["cell", "tau_bps"], "period"):
            if key != now:
                now, m = key, begin.get((key[0], int(key[1])), 1.0)
            s, served = rows["s"].to_numpy(float), m
            miss = float((s > m * float(rows["q"].iloc[0])).mean())
            m = min(max(m * math.exp(rate * (miss - (1 - float(rows["tau"].iloc[0])))), LOWEST), HIGHEST)
            out.append((key[0], int(key[1]), when, len(s), served, m))
            if len(out) >= 5000:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(rows: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.date32(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["cell", "tau_bps", "period", "n", "m_served", "m_next"])

    known = scores.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(period).isNotNull())
    rows = known.join(sized(table.where("q IS NOT NULL")), cell).select(F.col(cell).alias("cell"), "tau_bps", "tau", "q", F.col(period).cast("date").alias("period"), F.col(score).alias("s"))
    dealt = rows.repartition("cell", "tau_bps").sortWithinPartitions("cell", "tau_bps", "period")
    return dealt.mapInArrow(run, "cell string, tau_bps int, period date, n long, m_served double, m_next double")


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks, whose hash stands for the value."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def sealed(replayed: DataFrame, profile: str, artefact: str) -> dict:
    """A checkpoint of the multipliers after the last replayed period: one number a cell and tau, numbers as text of fixed
    places, and the hash of it all."""
    last = replayed.groupBy("cell", "tau_bps").agg(F.max_by("m_next", "period").alias("m")).collect()
    whole = replayed.agg(F.max("period"), F.countDistinct("period")).first()
    m: dict[str, dict[str, str]] = {}
    for r in sorted(last, key=lambda r: (r["tau_bps"], r["cell"])):
        m.setdefault(f"{r['tau_bps'] / 10_000:.4f}", {})[r["cell"]] = f"{r['m']:.10f}"
    body = {"schema": STATE, "profile": profile, "artefact_sha256": artefact, "through_period": str(whole[0]), "gamma": f"{RATE:.10f}", "m_floor": f"{LOWEST:.10f}", "m_ceil": f"{HIGHEST:.10f}", "n_periods_replayed": whole[1], "m": m}
    return body | {"checkpoint_sha256": hashlib.sha256(canonical(body).encode()).hexdigest()}


def intact(checkpoint: Mapping) -> bool:
    """Whether a checkpoint's hash is that of what it says."""
    body = {k: v for k, v in checkpoint.items() if k != "checkpoint_sha256"}
    return checkpoint.get("checkpoint_sha256") == hashlib.sha256(canonical(body).encode()).hexdigest()


def resumed(checkpoint: Mapping) -> dict[tuple[str, int], float]:
    """Where a replay of later periods begins."""
    if not intact(checkpoint):
        raise ValueError("the checkpoint is not what its hash says")
    return {(cell, int(round(float(t) * 10_000))): float(v) for t, row in checkpoint["m"].items() for cell, v in row.items()}


def multipliers(rows: DataFrame, checkpoint: Mapping) -> DataFrame:
    """rows (cell, tau_bps) with m: that of a known cell, 1 for an unknown one; a tau that the checkpoint lacks is an
    error."""
    start, spark = resumed(checkpoint), rows.sparkSession
    table = spark.createDataFrame([(c, t, v) for (c, t), v in start.items()], "cell string, tau_bps int, m double")
    known = F.col("tau_bps").isin(sorted({t for _, t in start}))
    return rows.join(F.broadcast(table), ["cell", "tau_bps"], "left").withColumn("m", F.when(known, F.coalesce("m", F.lit(1.0))).otherwise(F.raise_error(F.concat(F.lit("no state for tau "), F.col("tau_bps").cast("string")))))


class _Line:
    """Scores seen so far, by their rank among all that a key will have: a value and a count a rank, twelve bytes a score.
    Counts stand in a tree of partial sums, so adding and finding the k-th take as many steps as ranks have bits."""

    def __init__(self, n: int):
        self.n, self.values, self.tree = 0, np.zeros(n), np.zeros(n + 1, np.int32)
        self.top = 1 << n.bit_length() - 1 if n else 0

    def add(self, ranks: np.ndarray, scores: np.ndarray) -> None:
        self.values[ranks] = scores
        at = ranks.astype(np.int64) + 1
        while len(at):
            np.add.at(self.tree, at, 1)
            at = at + (at & -at)
            at = at[at < len(self.tree)]
        self.n += len(ranks)

    def kth(self, k: int) -> float:
        """The k-th smallest, from 0."""
        at, step, left = 0, self.top, k
        while step:
            if at + step < len(self.tree) and self.tree[at + step] <= left:
                at += step
                left -= int(self.tree[at])
            step >>= 1
        return float(self.values[at])

    def quantile(self, a: float) -> float:
        """The 1 - a quantile, between neighbours; a <= 0, or no values, gives infinity, a >= 1 nothing."""
        if a <= 0 or (a < 1 and not self.n):
            return math.inf
        if a >= 1:
            return 0.0
        at = (self.n - 1) * (1 - a)
        lo = int(at)
        first = self.kth(lo)
        return first + (self.kth(min(lo + 1, self.n - 1)) - first) * (at - lo) if at > lo else first


class _Radii:
    """Three online methods over the periods of one key: one adapted level (aci), a bank of levels weighed by the loss of
    their radii (dtaci), and a tracked quantile with a saturated sum of errors (pi)."""

    def __init__(self, alpha: float, rate: float, warm: int, n: int):
        self.alpha, self.rate, self.warm = alpha, rate, warm
        k = len(STEPS)
        self.level, self.bank, self.weight = alpha, np.full(k, alpha), np.full(k, 1 / k)
        self.eta, self.mix = math.sqrt(3 / HORIZON * (math.log(k * HORIZON) + 2)), 1 / (2 * HORIZON)
        self.past = _Line(n)
        self.first: list[np.ndarray] = []
        self.t, self.q, self.debt, self.step = 0, 0.0, 0.0, 0.01

    def served(self) -> tuple[float, float, float]:
        return self.past.quantile(self.level), self.past.quantile(float(self.weight @ self.bank)), max(self.q, 0.0)

    def learn(self, s: np.ndarray, ranks: np.ndarray) -> None:
        a, bank = self.alpha, self.bank
        own = self.past.quantile(self.level)
        radii = np.array([self.past.quantile(x) for x in bank])
        over = s[:, None] - radii[None, :]
        loss = np.where(np.isfinite(radii), np.where(over > 0, a * over, (a - 1) * over).mean(axis=0), s.max() * a)
        weight = self.weight * np.exp(-self.eta * loss)
        total = weight.sum()
        weight = weight / total if np.isfinite(total) and total > 0 else np.full(len(bank), 1 / len(bank))
        self.weight = (1 - self.mix) * weight + self.mix / len(bank)
        self.level = min(max(self.level + self.rate * (a - float((s > own).mean())), -1.0), 2.0)
        self.bank = np.clip(bank + np.array(STEPS) * (a - (s[:, None] > radii[None, :]).mean(axis=0)), -1.0, 2.0)
        if self.t < self.warm:  # the tracker begins at the warm-up's quantile, with steps of its scale
            self.first.append(s)
            if self.t == self.warm - 1:
                self.replay()
        else:
            self.track(s, self.t)
        self.past.add(ranks, s)
        self.t += 1

    def replay(self) -> None:
        start = np.concatenate(self.first)
        self.q, self.step = float(np.quantile(start, 1 - self.alpha)), float(np.quantile(start, 0.95)) * 0.05
        for t, s in enumerate(self.first):
            self.track(s, t)
        self.first = []

    def track(self, s: np.ndarray, t: int) -> None:
        off = float((s > self.q).mean()) - self.alpha
        self.debt += off
        n = max(t + 1, 2)
        self.q += self.step * off + self.step * math.tan(min(max(self.debt * math.log(n) / (n * 5), -1.5), 1.5))


def conformal_radii(scores: DataFrame, key: str, period: str, score: str, tau: float = 0.9, rate: float = 0.01, warm: int = 20) -> DataFrame:
    """Radii of three online methods along the periods of each key: key, period, s, aci, dtaci and pi, a row a score from
    after `warm` periods. A period is served by what was known before it, and moves the methods by its share of misses.

    One distributed sort ranks each key's scores. A key's rows then come by period, and a task keeps a value and a count a
    rank of one key, as the methods' quantiles need all scores so far: 120 MB for a key of ten million.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for k, when, rows in _periods(batches, ["key"], "period"):
            if state is None or k != now:
                now, state = k, _Radii(round(1 - tau, 12), rate, warm, int(rows["n"].iloc[0]))
            s = rows["s"].to_numpy(float)
            if state.t >= warm:
                aci, dtaci, pi = state.served()
                n = len(s)
                yield pa.RecordBatch.from_arrays([pa.array([k[0]] * n, pa.string()), pa.array([when] * n, pa.date32()), pa.array(s), *[pa.array(np.full(n, v)) for v in (aci, dtaci, pi)]], ["key", "period", "s", "aci", "dtaci", "pi"])
            state.learn(s, rows["rank"].to_numpy(np.int64))

    rows = scores.select(F.col(key).cast("string").alias("key"), F.col(period).cast("date").alias("period"), F.col(score).alias("s")).where("s IS NOT NULL AND key IS NOT NULL")
    ranked = written(running(rows, ["key", "s", "period"], {"rank": "1"}, ["key"]), "ranked-scores")
    sizes = ranked.groupBy("key").agg(F.count("*").alias("n"))
    dealt = ranked.join(sized(sizes), "key").repartition("key").sortWithinPartitions("key", "period", "s", "rank")
    return dealt.mapInArrow(run, "key string, period date, s double, aci double, dtaci double, pi double")


def cusum(rows: DataFrame, key: str, order: str, value: str, slack: float, alarm: float) -> DataFrame:
    """Both one-sided sums and whether one is over the alarm. A sum reflected at zero is the walk less its lowest point so
    far, so running windows do."""
    line = Window.partitionBy(key).orderBy(order)
    to_now = line.rowsBetween(Window.unboundedPreceding, 0)
    up = rows.withColumns({"_u": F.sum(F.col(value) - slack).over(to_now), "_d": F.sum(-F.col(value) - slack).over(to_now)})
    low = up.withColumns({"_mu": F.least(F.lit(0.0), F.min("_u").over(to_now)), "_md": F.least(F.lit(0.0), F.min("_d").over(to_now))})
    return low.withColumns({"s_up": F.col("_u") - F.col("_mu"), "s_down": F.col("_d") - F.col("_md")}).withColumn("alarm", (F.col("s_up") >= alarm) | (F.col("s_down") >= alarm)).drop("_u", "_d", "_mu", "_md")


def monotone(updates: DataFrame, key: str, arrival: list[str], ts: str) -> DataFrame:
    """Updates in order of arrival with whether a store that only moves forward in event time takes them."""
    before = F.max(ts).over(Window.partitionBy(key).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1))
    return updates.withColumn("accepted", before.isNull() | (F.col(ts) >= before))


def garch_path(e: np.ndarray, omega: float, alpha: float, beta: float, start: float) -> np.ndarray:
    """Variances of a GARCH(1,1), each from the residual and variance before it; one more than residuals, the next."""
    out = np.empty(len(e) + 1)
    out[0] = start
    for i, x in enumerate(e * e):
        out[i + 1] = omega + alpha * x + beta * out[i]
    return out


def _likelihood(e: np.ndarray, s: np.ndarray, nu: float | None) -> float:
    if nu is None:
        return float(-0.5 * (np.log(2 * np.pi * s) + e * e / s).sum())
    c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(np.pi * (nu - 2))
    return float((c - 0.5 * np.log(s) - (nu + 1) / 2 * np.log1p(e * e / (s * (nu - 2)))).sum())


def simplex(f, start: Sequence[float], steps: int = 400, size: float = 0.3) -> np.ndarray:  # noqa: ANN001
    """A minimum of f by a moving simplex: reflect, stretch, pull in, shrink."""
    pts = [np.array(start, float), *[np.array(start, float) + size * row for row in np.eye(len(start))]]
    val = [f(p) for p in pts]
    for _ in range(steps):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if val[-1] - val[0] < 1e-9 * (abs(val[0]) + 1e-9):
            break
        middle = np.mean(pts[:-1], axis=0)
        far = middle + (middle - pts[-1])
        v = f(far)
        if v < val[0]:
            beyond = middle + 2 * (middle - pts[-1])
            w = f(beyond)
            pts[-1], val[-1] = (beyond, w) if w < v else (far, v)
        elif v < val[-2]:
            pts[-1], val[-1] = far, v
        else:
            near = middle + 0.5 * (pts[-1] - middle)
            w = f(near)
            if w < val[-1]:
                pts[-1], val[-1] = near, w
            else:
                pts = [pts[0], *[pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]]
                val = [val[0], *[f(p) for p in pts[1:]]]
    return pts[int(np.argmin(val))]


def garch_fit(e: np.ndarray, student: bool) -> tuple[float, float, float, float]:
    """omega, alpha, beta and degrees of freedom (infinite for normal errors) of most likelihood."""
    var = float(np.mean(e * e)) or 1e-12

    def told(x: np.ndarray) -> tuple[float, float, float, float]:
        share = 0.999 / (1 + math.exp(-min(max(x[1], -30.0), 30.0)))  # alpha + beta
        alpha = share / (1 + math.exp(-min(max(x[2], -30.0), 30.0)))
        return var * math.exp(min(max(x[0], -20.0), 5.0)), alpha, share - alpha, 2.05 + math.exp(min(max(x[3], -5.0), 5.0)) if student else math.inf

    def loss(x: np.ndarray) -> float:
        omega, alpha, beta, nu = told(x)
        return -_likelihood(e, np.maximum(garch_path(e, omega, alpha, beta, var)[:-1], 1e-18), nu if student else None)

    return told(simplex(loss, [-1.5, 1.5, -1.5, 1.5] if student else [-1.5, 1.5, -1.5]))


def garch_bands(panel: DataFrame, split: str, taus: Mapping[float, float], student: bool = False, least: int = 60) -> DataFrame:
    """GARCH bands of log moves against the point: fitted to a symbol's gaps before split, run on through all of them, and
    served after it: symbol, fri_ts, tau_bps, sigma, lower, upper, mon_open. taus maps a coverage to its unit quantile;
    with t errors those of the fitted degrees are taken. Symbols with under `least` gaps to fit have no bands.
    """
    from ..functions.special import student_quantile

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = ["symbol", "fri_ts", "tau_bps", "sigma", "lower", "upper", "mon_open"]
        p = pdf.sort_values("fri_ts").reset_index(drop=True)
        e = np.log(p["mon_open"].to_numpy(float) / p["point"].to_numpy(float))
        train = (p["fri_ts"].astype(str) < split).to_numpy()
        if train.sum() < least:
            return pd.DataFrame(columns=names)
        e = e - e[train].mean()
        omega, alpha, beta, nu = garch_fit(e[train], student)
        s = np.sqrt(garch_path(e, omega, alpha, beta, float(np.mean(e[train] ** 2)))[:-1])[~train]
        late, out = p[~train], []
        for t, z in taus.items():
            z = student_quantile((1 + t) / 2, nu) * math.sqrt((nu - 2) / nu) if student else z
            own = late[["fri_ts", "mon_open"]].assign(symbol=key[0], tau_bps=int(round(t * 10_000)), sigma=s)
            out.append(own.assign(lower=late["point"] * np.exp(-z * s), upper=late["point"] * np.exp(z * s)))
        return pd.concat(out)[names]

    rows = panel.select("symbol", "fri_ts", "mon_open", "point")
    return rows.groupBy("symbol").applyInPandas(one, "symbol string, fri_ts date, tau_bps int, sigma double, lower double, upper double, mon_open double")
