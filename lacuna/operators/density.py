"""Densities and forecasters: probability integral transforms, their tests, Gaussian bands and causal regressions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_tail, normal_quantile

EQUITY_DAYS = 252.0


def pit_from_grid(miss: Column, halves: Sequence[Column], taus: Sequence[float]) -> Column:
    """0.5 and half the coverage at which a symmetric band's half-width is |miss|, on the side of its sign: linear between
    the grid's half-widths (and 0 at 0), at most the last tau. Null if miss or a half-width is."""
    size, tau = F.abs(miss), F.lit(float(taus[-1]))
    points = [(F.lit(0.0), 0.0), *zip(halves, taus, strict=True)]
    for (a, u), (b, v) in reversed(list(zip(points[:-1], points[1:], strict=True))):
        tau = F.when(size < b, F.lit(u) + F.try_divide(size - a, b - a) * F.lit(v - u)).otherwise(tau)
    whole = miss.isNotNull()
    for h in halves:
        whole = whole & h.isNotNull()
    return F.when(whole, 0.5 + 0.5 * tau * F.when(miss >= 0, 1).otherwise(-1))


def pit_from_quantiles(value: Column, levels: Sequence[float], quantiles: Sequence[Column]) -> Column:
    """The level of a value between quantiles, which are sorted first; the outermost levels beyond them. Null quantiles
    take no part; fewer than two give null."""
    pairs = F.array(*[F.struct(q.alias("q"), F.lit(float(a)).alias("a")) for a, q in zip(levels, quantiles, strict=True)])
    line = F.array_sort(F.filter(pairs, lambda x: x["q"].isNotNull()))
    under = F.filter(line, lambda x: x["q"] < value)
    over = F.filter(line, lambda x: x["q"] >= value)
    lo, hi = F.try_element_at(under, F.lit(-1)), F.try_element_at(over, F.lit(1))
    inner = lo["a"] + F.try_divide(value - lo["q"], hi["q"] - lo["q"]) * (hi["a"] - lo["a"])
    return F.when((F.size(line) >= 2) & value.isNotNull(), F.when(lo.isNull(), hi["a"]).when(hi.isNull(), lo["a"]).otherwise(inner))


def normal_scores(rows: DataFrame, pit: str, name: str = "z") -> DataFrame:
    """Adds the normal quantile of a PIT; those at 0, 1 or null give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = b.column(b.schema.get_field_index(pit)).to_pylist()
            z = [normal_quantile(v) if v is not None and 0 < v < 1 else None for v in u]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(z, pa.float64())], [*b.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, {name} double")


def score_sums(rows: DataFrame, by: Sequence[str], order: Sequence[str], z: str = "z") -> DataFrame:
    """What Berkowitz' tests need of each series of normal scores: sums over neighbouring pairs. A series of any length
    is a window and an aggregation."""
    some = rows.where(F.col(z).isNotNull())
    line = some.withColumn("_l", F.lag(z).over(Window.partitionBy(*by).orderBy(*order)))
    x, y = F.col("_l"), F.col(z)
    pair = x.isNotNull()
    return line.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(pair).alias("m"), F.avg(F.when(pair, y)).alias("my"), F.avg(x).alias("mx"), F.var_pop(F.when(pair, y)).alias("vy"), F.var_pop(x).alias("vx"),
        F.covar_pop(y, x).alias("cxy"), F.sum(F.when(pair, y * y)).alias("syy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"),
    )


def berkowitz(sums: DataFrame, least: int = 30) -> DataFrame:
    """Berkowitz' joint likelihood ratio (level, spread and lag of normal scores), and the ratios of each alone with their
    shares; null under `least` scores or without spread."""
    m, pi = F.col("m"), 2 * math.pi
    ok = (F.col("n") >= least) & (F.col("vx") > 0)
    rho = F.col("cxy") / F.col("vx")
    var = F.col("vy") - rho * F.col("cxy")
    base = -0.5 * F.col("syy") - 0.5 * m * math.log(pi)
    full = 2 * (-0.5 * m * (F.log(pi * var) + 1) - base)
    ar = F.greatest(F.least(F.col("sxy") / F.col("sxx"), F.lit(0.999)), F.lit(-0.999))
    each = {
        "lr_mean": F.col("syy") - (F.col("vy") * m), "lr_var": 2 * (-0.5 * m * (F.log(pi * F.col("syy") / m) + 1) - base),
        "lr_ar1": F.col("syy") - (F.col("syy") - 2 * ar * F.col("sxy") + ar * ar * F.col("sxx")),
    }
    out = sums.withColumns({"lr": F.when(ok & (var > 0), full), "rho": F.when(ok, rho), **{k: F.when(ok, v) for k, v in each.items()}})
    total = sum((F.greatest(F.col(k), F.lit(0.0)) for k in each), F.lit(0.0))
    return out.withColumns({k.replace("lr_", "share_"): F.when(total > 0, F.greatest(F.col(k), F.lit(0.0)) / total) for k in each})


def dynamic_quantile(rows: DataFrame, by: Sequence[str], order: Sequence[str], miss: str, claimed: str, lags: int = 4, covariate: str | None = None) -> DataFrame:
    """Whether centred misses can be told from a constant, the misses before and a covariate: h'X (X'X)^-1 X'h over
    claimed (1 - claimed), and its tail on as many degrees as X has columns. Null under lags + 5 rows or for columns that
    depend on each other.

    Lags come from a window, the normal equations' sums from an aggregation; only each group's small matrix is solved.
    """
    line = Window.partitionBy(*by).orderBy(*order)
    own = rows.withColumns({"_y": F.col(miss).cast("double"), **{f"_x{k}": F.lag(F.col(miss).cast("double"), k).over(line) for k in range(1, lags + 1)}})
    names = ["_x0", *[f"_x{k}" for k in range(1, lags + 1)], *(["_xc"] if covariate else [])]
    own = own.withColumn("_x0", F.lit(1.0)).withColumn("_h", F.col("_y") - (1 - F.col(claimed)))
    if covariate:
        own = own.withColumn("_xc", F.col(covariate).cast("double"))
    some = own.where(F.col(f"_x{lags}").isNotNull()) if lags else own
    sums = {f"g{i}_{j}": F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j}
    sums |= {f"h{i}": F.sum(F.col(a) * F.col("_h")) for i, a in enumerate(names)}
    g = some.groupBy(*by).agg(F.count("*").alias("n"), F.first(claimed).alias("_t"), *[v.alias(k) for k, v in sums.items()])
    kinds = dict(rows.dtypes)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(names)
        for p in batches:
            dq, tail = [], []
            for r in p.to_dict("records"):
                gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                h = np.array([r[f"h{i}"] for i in range(k)], float)
                if r["n"] + lags < lags + 5 or not np.isfinite(gram).all() or np.linalg.matrix_rank(gram) < k:
                    dq.append(None)
                    tail.append(None)
                    continue
                a = 1 - r["_t"]
                dq.append(float(h @ np.linalg.solve(gram, h) / max(a * (1 - a), 1e-12)))
                tail.append(chi2_tail(dq[-1], k))
            yield p[[*by, "n"]].assign(dq=pd.Series(dq, dtype="float64", index=p.index), df=k, p=pd.Series(tail, dtype="float64", index=p.index))

    return g.mapInPandas(solve, ", ".join([*[f"{c} {kinds[c]}" for c in by], "n long", "dq double", "df int", "p double"]))


def gaussian_sigma(panel: DataFrame, equities: Sequence[str] | None = None) -> DataFrame:
    """sigma_f0, from the left edge's volatility and the gap's length, and sigma_vix, from the index, both in price units;
    sigma_vix is null for symbols that aren't among equities (none named: all are)."""
    days = F.greatest(F.col("gap_days") - 3, F.lit(0)) + 1
    f0 = F.col("fri_vol_20d") * F.sqrt(days.cast("double")) * F.col("fri_close")
    vix = F.col("vix") / 100 * F.sqrt(days / F.lit(EQUITY_DAYS)) * F.col("fri_close")
    return panel.withColumns({"sigma_f0": f0, "sigma_vix": vix if equities is None else F.when(F.col("symbol").isin(list(equities)), vix)})


def rolling_sigma(panel: DataFrame, window: int = 52) -> DataFrame:
    """sigma_f1: the spread of a symbol's last log residuals, strictly earlier, in price units; null before 8 of them, or
    a quarter of the window."""
    past = Window.partitionBy("symbol").orderBy("fri_ts").rowsBetween(-window, -1)
    r = F.log(F.col("mon_open") / F.col("point"))
    return panel.withColumn("_r", r).withColumn("sigma_f1", F.when(F.count("_r").over(past) >= max(8, window // 4), F.stddev_samp("_r").over(past) * F.col("point"))).drop("_r")


def gaussian_bands(panel: DataFrame, sigma: str, taus: Sequence[float], point: str = "point") -> DataFrame:
    """A row a valid row and tau: point -+ z sigma. Valid: point, sigma and open there, sigma over 0."""
    rows = panel.where(F.col(point).isNotNull() & F.col("mon_open").isNotNull() & (F.col(sigma) > 0))
    asked = F.explode(F.array(*[F.struct(F.lit(int(round(t * 10_000))).alias("tau_bps"), F.lit(float(t)).alias("tau"), F.lit(normal_quantile((1 + t) / 2)).alias("z")) for t in taus]))
    each = rows.withColumn("_t", asked).select(*[c for c in rows.columns if c not in ("tau_bps", "tau", "z")], "_t.*")
    half = F.col("z") * F.col(sigma)
    return each.withColumns({"lower": F.col(point) - half, "upper": F.col(point) + half})


def _rolling_fit(window: int | None, least: int, names: list[str], floor: float | None):  # noqa: ANN202
    """For each row of a group, a regression on rows before it: coefficients by normal equations, slid along."""

    def run(pdf: pd.DataFrame, y: np.ndarray, x: np.ndarray, now: np.ndarray) -> np.ndarray:
        n, k = x.shape
        fine = np.isfinite(x).all(axis=1) & np.isfinite(y)
        gram, rhs, count, total = np.zeros((k, k)), np.zeros(k), 0, 0.0
        out = np.full((n, k + 2), np.nan)
        for i in range(n):
            out[i, k], out[i, k + 1] = count, total / count if count else np.nan
            if count >= least:
                out[i, :k] = np.linalg.lstsq(gram + (1e-10 * np.eye(k) if floor is not None else 0), rhs, rcond=None)[0]
            for j, sign in ((i, 1.0), (i - window if window is not None else -1, -1.0)):
                if j >= 0 and fine[j]:
                    gram += sign * np.outer(x[j], x[j])
                    rhs += sign * x[j] * y[j]
                    count, total = count + int(sign), total + sign * y[j]
        return out

    return run


def _sliding_fits(x: np.ndarray, y: np.ndarray, fine: np.ndarray, window: int, least: int, fixed: int) -> np.ndarray:
    """For each row, the least-squares coefficients of y on x over the fine ones of the `window` rows before it; NaN under
    `least` of them. Columns from `fixed` on that don't vary in a window take no part (coefficient 0); among columns that
    depend on each other the shortest solution is taken.

    The normal equations gain a row and lose one at each step, and are made anew every `window` steps, so rounding doesn't
    add up; eigenvalues under 1e-12 of the largest count as 0.
    """
    n, k = x.shape
    out = np.full((n, k), np.nan)
    at = np.flatnonzero(fine)
    turns = np.zeros((len(at) + 1, k), int)  # turns[j]: how often a column changed up to the j-th fine row
    if len(at) > 1:
        turns[2:] = np.cumsum(x[at[1:]] != x[at[:-1]], axis=0)
    gram, rhs = np.zeros((k, k)), np.zeros(k)
    for i in range(n):
        lo = max(0, i - window)
        first, end = np.searchsorted(at, (lo, i))
        if i % window == 0:
            rows = at[first:end]
            gram, rhs = x[rows].T @ x[rows], x[rows].T @ y[rows]
        if end - first >= least:
            kept = np.flatnonzero((np.arange(k) < fixed) | (turns[end] > turns[first + 1]))
            out[i] = 0.0
            out[i, kept] = np.linalg.pinv(gram[np.ix_(kept, kept)], rcond=1e-12, hermitian=True) @ rhs[kept]
        for j, sign in ((i, 1.0), (i - window, -1.0)):
            if j >= 0 and fine[j]:
                gram += sign * np.outer(x[j], x[j])
                rhs += sign * x[j] * y[j]
    return out


def loglog_fits(panel: DataFrame, taus: Sequence[float], window: int = 156, least: int = 50, vol: str = "vix", extras: Sequence[str] = ()) -> DataFrame:
    """Widths that follow an index: a symbol's log |residual| on the log index and further columns, over its last `window`
    gaps, strictly earlier. A row a gap: n_fit, coefs (intercept, index, then extras; 0 for one that doesn't vary in the
    window), sigma_now, and lower and upper, arrays by tau: quantiles of the window's residuals in units of the fit, put on
    today's. Gaps with a null in what they need, or under `least` fine ones before, have no row.

    One group a symbol (its gaps only); what a gap needs of the past is slid along.
    """
    names = list(extras)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("fri_ts").reset_index(drop=True)
        point, v, more = p["point"].to_numpy(float), p["_vol"].to_numpy(float), p[[f"_x{i}" for i in range(len(names))]].to_numpy(float)
        with np.errstate(all="ignore"):
            r = np.log(p["mon_open"].to_numpy(float) / point)
            x = np.column_stack([np.ones(len(p)), np.log(np.where(v > 0, v, np.nan)), more])
            y = np.log(np.where(np.abs(r) > 1e-10, np.abs(r), np.nan))
        whole = np.isfinite(x).all(axis=1)
        fine = whole & np.isfinite(y)
        beta = _sliding_fits(np.where(fine[:, None], x, 0.0), np.where(fine, y, 0.0), fine, window, least, 2)
        out = []
        for i in np.flatnonzero(np.isfinite(beta[:, 0]) & whole & np.isfinite(point)):
            lo = max(0, i - window)
            use = np.flatnonzero(fine[lo:i]) + lo
            z, now = r[use] / np.exp(x[use] @ beta[i]), float(np.exp(x[i] @ beta[i]))
            if not 0 < now < math.inf:
                continue
            edges = np.quantile(z, [[(1 - t) / 2 for t in taus], [(1 + t) / 2 for t in taus]])
            out.append((key[0], p["fri_ts"][i], len(use), list(beta[i]), now, *(list(point[i] * np.exp(e * now)) for e in edges)))
        return pd.DataFrame(out, columns=["symbol", "fri_ts", "n_fit", "coefs", "sigma_now", "lower", "upper"])

    rows = panel.select("symbol", "fri_ts", "mon_open", "point", F.col(vol).alias("_vol"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)])
    return rows.groupBy("symbol").applyInPandas(one, "symbol string, fri_ts date, n_fit int, coefs array<double>, sigma_now double, lower array<double>, upper array<double>")


def loglog_bounds(panel: DataFrame, taus: Sequence[float], window: int = 156, least: int = 50, vol: str = "vix", extras: Sequence[str] = ()) -> DataFrame:
    """The bounds of loglog_fits, a row a gap and tau."""
    fits = loglog_fits(panel, taus, window, least, vol, extras)
    each = F.explode(F.array(*[F.struct(F.lit(int(round(t * 10_000))).alias("tau_bps"), F.col("lower")[i].alias("lower"), F.col("upper")[i].alias("upper")) for i, t in enumerate(taus)]))
    return fits.select("symbol", "fri_ts", each.alias("_b")).select("symbol", "fri_ts", "_b.*").join(panel.select("symbol", "fri_ts", "mon_open"), ["symbol", "fri_ts"])


def daily_har(bars: DataFrame) -> DataFrame:
    """symbol, ts, rv_d, rv_w, rv_m: squared daily log returns and their means over 5 and 22 days, whole windows only."""
    line = Window.partitionBy("symbol").orderBy("ts")
    r = bars.withColumn("_r", F.log(F.col("close") / F.lag("close").over(line))).withColumn("rv_d", F.col("_r") * F.col("_r"))
    mean = lambda n: F.when(F.count("rv_d").over(line.rowsBetween(1 - n, 0)) == n, F.avg("rv_d").over(line.rowsBetween(1 - n, 0)))
    return r.select("symbol", "ts", "rv_d", mean(5).alias("rv_w"), mean(22).alias("rv_m"))


def har_sigma(panel: DataFrame, bars: DataFrame, least: int = 40) -> DataFrame:
    """panel with sigma_har: a walk-forward regression of the gap's squared log return on the daily features of its left
    edge, on strictly earlier gaps; under `least` of them, or without features, their mean; at least 1e-8; in price units."""
    there = panel.join(daily_har(bars).withColumnRenamed("ts", "fri_ts"), ["symbol", "fri_ts"], "left")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("fri_ts").reset_index(drop=True)
        x = np.column_stack([np.ones(len(p)), p[["rv_d", "rv_w", "rv_m"]].to_numpy(float)])
        y = np.log(p["mon_open"].to_numpy(float) / p["fri_close"].to_numpy(float)) ** 2
        fit = _rolling_fit(None, least, [], 1e-8)(p, y, x, x)
        var = np.maximum((np.nan_to_num(x) * fit[:, :4]).sum(axis=1), 1e-8)
        whole = np.isfinite(x).all(axis=1) & (fit[:, 4] >= least)
        var = np.where(whole, var, fit[:, 5])
        return pd.DataFrame({"symbol": key[0], "fri_ts": p["fri_ts"], "sigma_har": np.where(np.isfinite(var), p["point"].to_numpy(float) * np.sqrt(np.where(np.isfinite(var), var, 0.0)), np.nan)})

    rows = there.select("symbol", "fri_ts", "mon_open", "fri_close", "point", "rv_d", "rv_w", "rv_m")
    own = rows.groupBy("symbol").applyInPandas(one, "symbol string, fri_ts date, sigma_har double")
    return panel.join(own.withColumn("sigma_har", F.when(~F.isnan("sigma_har"), F.col("sigma_har"))), ["symbol", "fri_ts"], "left")
