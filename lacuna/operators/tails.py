"""Tail models of one symbol's losses, fitted by likelihood in grouped functions: peaks over thresholds, quantile
recursions and self-exciting exceedances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .online import simplex


def pareto_fit(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto distribution of excesses (location 0), of most likelihood."""
    mean = float(excess.mean())

    def loss(x: np.ndarray) -> float:
        shape, scale = float(np.clip(x[0], -0.9, 2.0)), math.exp(float(np.clip(x[1], -40, 40)))
        z = excess / scale
        if abs(shape) < 1e-8:
            return float(len(z) * math.log(scale) + z.sum())
        inner = 1 + shape * z
        return math.inf if (inner <= 0).any() else float(len(z) * math.log(scale) + (1 + 1 / shape) * np.log(inner).sum())

    x = simplex(loss, [0.1, math.log(max(mean, 1e-12))])
    return float(np.clip(x[0], -0.9, 2.0)), math.exp(float(np.clip(x[1], -40, 40)))


def pareto_quantile(threshold: float, shape: float, scale: float, p: float) -> float:
    """Where the tail over a threshold has the share p left (of the exceedances); exponential near shape 0."""
    return threshold - scale * math.log(p) if abs(shape) < 1e-8 else threshold + scale / shape * (p**-shape - 1)


def peaks(x: np.ndarray, tau: float, level: float = 0.9, least: int = 15) -> tuple[int, float, float, float, float]:
    """Exceedances over the level's quantile, shape, scale, threshold and the tau quantile of x; NaN with too few."""
    u = float(np.quantile(x, level))
    over = x[x > u] - u
    if len(over) < least:
        return len(over), math.nan, math.nan, u, math.nan
    shape, scale = pareto_fit(over)
    p = (1 - tau) / (len(over) / len(x))
    return len(over), shape, scale, u, pareto_quantile(u, shape, scale, min(p, 1.0))


def recursion(x: np.ndarray, beta: np.ndarray, start: float, signed: bool) -> np.ndarray:
    """q_t = b0 + b1 q_{t-1} + b2 |x_{t-1}|, or with a weight for either sign; one more than x, the next."""
    q = np.empty(len(x) + 1)
    q[0] = start
    for t, v in enumerate(x):
        q[t + 1] = beta[0] + beta[1] * q[t] + (beta[2] * max(v, 0.0) + beta[3] * max(-v, 0.0) if signed else beta[2] * abs(v))
    return q


def caviar(x: np.ndarray, tau: float, signed: bool = False, least: int = 30) -> tuple[np.ndarray, float]:
    """Weights of a quantile recursion that lose least by the pinball loss, and the next step's quantile."""
    k = 4 if signed else 3
    if len(x) < least:
        return np.full(k, math.nan), math.nan
    start = float(np.quantile(x[: max(10, len(x) // 10)], tau))

    def loss(beta: np.ndarray) -> float:
        if abs(beta[1]) > 0.999:
            return math.inf
        d = x - recursion(x, beta, start, signed)[:-1]
        return float(np.where(d >= 0, tau * d, (tau - 1) * d).mean())

    beta = simplex(loss, [0.1 * start, 0.8, *([0.1] * (k - 2))], 800 if signed else 500)
    return beta, float(recursion(x, beta, start, signed)[-1])


def hawkes(times: np.ndarray, end: float) -> tuple[float, float, float]:
    """Base rate, jump and decay of a self-exciting process with an exponential kernel, of most likelihood; the jump is
    under 0.999 of the decay."""

    def told(x: np.ndarray) -> tuple[float, float, float]:
        mu, decay = math.exp(float(np.clip(x[0], -20, 5))), math.exp(float(np.clip(x[1], -10, 5)))
        return mu, 0.999 * decay / (1 + math.exp(float(np.clip(-x[2], -30, 30)))), decay

    def loss(x: np.ndarray) -> float:
        mu, jump, decay = told(x)
        a, like = 0.0, 0.0
        for i, t in enumerate(times):
            if i:
                a = math.exp(-decay * (t - times[i - 1])) * (1 + a)
            like += math.log(mu + jump * a)
        return -(like - mu * end - jump / decay * float((1 - np.exp(-decay * (end - times))).sum()))

    return told(simplex(loss, [math.log(max(len(times), 1) / max(end, 1e-9)), 0.0, 0.0], 600))


def tail_quantiles(panel: DataFrame, tau: float, value: str = "score") -> DataFrame:
    """Per symbol, the tau quantile of the next value by four models: peaks over a threshold, two quantile recursions, and
    self-exciting exceedances (whose rate at the end weighs the Pareto tail): one group a symbol, its own values only."""
    names = ["symbol", "n", "exceedances", "shape", "scale", "pot", "sav", "signed", "hawkes_rate", "hawkes"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("fri_ts")[value].to_numpy(float)
        n_over, shape, scale, u, pot = peaks(x, tau)
        _, sav = caviar(x, tau)
        _, both = caviar(x, tau, True)
        rate = q = math.nan
        if not math.isnan(shape):
            t = np.flatnonzero(x > u).astype(float)
            mu, jump, decay = hawkes(t, float(len(x)))
            rate = mu + jump * float(np.exp(-decay * (len(x) - t)).sum())
            q = pareto_quantile(u, shape, scale, min((1 - tau) / min(max(rate, 1e-9), 1.0), 1.0))
        return pd.DataFrame([(key[0], len(x), n_over, shape, scale, pot, sav, both, rate, q)], columns=names)

    rows = panel.where(F.col(value).isNotNull()).select("symbol", "fri_ts", value)
    return rows.groupBy("symbol").applyInPandas(one, "symbol string, n long, exceedances long, shape double, scale double, pot double, sav double, signed double, hawkes_rate double, hawkes double")
