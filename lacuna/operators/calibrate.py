"""Split-conformal calibration per cell, serving of bands, and their coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import interpolated
from .shared import order_statistics, sized, written

TAUS = (0.68, 0.85, 0.95, 0.99)


def tau_table(spark: SparkSession, taus: Sequence[float] = TAUS) -> DataFrame:
    """tau_bps, an integer to join by, and tau."""
    rows = ", ".join(f"({int(round(t * 10_000))}, CAST({t!r} AS DOUBLE))" for t in taus)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(tau_bps, tau)")


def quantile_table(scores: DataFrame, taus: DataFrame, cell: Sequence[str], score: str) -> DataFrame:
    """cell, tau_bps, tau, n and q: the score at rank ceil(tau (n + 1)), within [1, n], of each cell.

    taus is a short table (tau_bps, tau). A cell may be as large as the table; see order_statistics."""
    levels = [(r["tau_bps"], r["tau"]) for r in taus.orderBy("tau_bps").collect()]
    rank = lambda t: lambda n: F.least(F.greatest(F.ceil(F.lit(t) * (n + 1)), F.lit(1)), n)
    found = order_statistics(scores, cell, score, [(t, rank(t)) for _, t in levels])
    told = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in levels]), F.col("ask") + 1)
    return found.select(*cell, told(0).cast("int").alias("tau_bps"), told(1).alias("tau"), "n", "q")


def tail_quantiles(residuals: DataFrame, taus: DataFrame, cell: Sequence[str], value: str, least: int = 5) -> DataFrame:
    """Equal-tail and one-sided residual quantiles of each cell; null under `least` rows. Lower ranks are floored, upper
    ones ceiled, all within [1, n]."""
    asks, names = [], []
    for r in taus.orderBy("tau_bps").collect():
        t = r["tau"]
        a = (1 - t) / 2
        within = lambda k: lambda n: F.least(F.greatest(k(n), F.lit(1)), n)
        for kind, share, k in (
            ("lower", a, lambda n, a=a: F.floor(F.lit(a) * (n + 1))), ("upper", 1 - a, lambda n, a=a: F.ceil(F.lit(1 - a) * (n + 1))),
            ("one_lower", 1 - t, lambda n, t=t: F.floor(F.lit(1 - t) * (n + 1))), ("one_upper", t, lambda n, t=t: F.ceil(F.lit(t) * (n + 1))),
        ):
            asks.append((share, within(k)))
            names.append((r["tau_bps"], kind))
    found = order_statistics(residuals, cell, value, asks)
    told = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in names]), F.col("ask") + 1)
    return found.select(*cell, told(0).cast("int").alias("tau_bps"), "n", told(1).alias("kind"), F.when(F.col("n") >= least, F.col("q")).alias("q"))


def fit_bump(scores: DataFrame, table: DataFrame, cell: Sequence[str], score: str, most: float = 5.0) -> DataFrame:
    """tau_bps, tau and c: the smallest factor of a thousandth grid from 1 to most at which q c holds at least tau of the
    scores.

    The share is reached at one order statistic of score / q; its neighbours on the grid are tried with the very test.
    """
    table = sized(table.select(*cell, "tau_bps", "tau", "q"))
    ratio = scores.where(F.col(score).isNotNull()).join(table, list(cell)).select("tau_bps", "tau", F.col(score).alias("_s"), "q").withColumn("_x", F.col("_s") / F.col("q"))
    levels = sorted({(r["tau_bps"], r["tau"]) for r in table.select("tau_bps", "tau").distinct().collect()})
    at = order_statistics(ratio, ["tau_bps"], "_x", [(t, lambda n, t=t: F.greatest(F.ceil(F.lit(t) * n), F.lit(1))) for _, t in levels])
    own = at.where(F.element_at(F.array(*[F.lit(b) for b, _ in levels]), F.col("ask") + 1) == F.col("tau_bps"))
    step = F.ceil((F.col("q") - 1) * 1000)
    near = own.select("tau_bps", F.explode(F.array(F.lit(0).cast("long"), step - 1, step, step + 1)).alias("_g")).where("_g >= 0").distinct()
    near = near.withColumn("c", 1.0 + F.col("_g") * F.lit(0.001)).where(F.col("c") <= most)
    tested = ratio.join(sized(near), "tau_bps").groupBy("tau_bps", "tau", "c").agg(F.avg((F.col("_s") <= F.col("q") * F.col("c")).cast("double")).alias("held"))
    return tested.groupBy("tau_bps", "tau").agg(F.coalesce(F.min(F.when(F.col("held") >= F.col("tau"), F.col("c"))), F.lit(most)).alias("c"))


def serve(panel: DataFrame, table: DataFrame, bumps: DataFrame | None, cell: Sequence[str], scaled: bool = True) -> DataFrame:
    """A band a row and tau: point -+ c q, times sigma and the close if scaled, or the point."""
    c = table.join(bumps.select("tau_bps", "c"), "tau_bps", "left") if bumps is not None else table.withColumn("c", F.lit(1.0))
    both = panel.join(sized(c.select(*cell, "tau_bps", "tau", "q", F.coalesce("c", F.lit(1.0)).alias("c"))), list(cell))
    half = F.col("c") * F.col("q") * (F.col("sigma") * F.col("fri_close") if scaled else F.col("point"))
    return both.withColumns({"half": half, "lower": F.col("point") - half, "upper": F.col("point") + half}).where("half IS NOT NULL")


def one_shot(panel: DataFrame, taus: DataFrame, split: str, kind: str = "score", cell: Sequence[str] = ("regime_pub",)) -> DataFrame:
    """Bands of the gaps from split on: quantiles of the scores before it, c of those after it. kind: score (scaled by
    sigma), score_raw (share of the point) or score_path; rows without that score teach nothing."""
    table = written(quantile_table(panel.where(F.col("fri_ts") < split), taus, list(cell), kind), "quantiles")
    late = panel.where(F.col("fri_ts") >= split)
    return serve(late, table, fit_bump(late, table, list(cell), kind), list(cell), scaled=kind != "score_raw")


def melted(wide: DataFrame, taus: Sequence[int]) -> DataFrame:
    """A row a gap and tau from columns <tau>_lo and <tau>_hi."""
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("tau_bps"), F.col(f"{t}_lo").alias("lower"), F.col(f"{t}_hi").alias("upper")) for t in taus]))
    keep = [c for c in wide.columns if c not in {f"{t}_{x}" for t in taus for x in ("lo", "hi")}]
    return wide.withColumn("_b", rows).select(*keep, "_b.*").where("lower IS NOT NULL OR upper IS NOT NULL")


def serve_downside(panel: DataFrame, table: DataFrame, bumps: DataFrame, cell: Sequence[str]) -> DataFrame:
    """One-sided bands: point - c q sigma close, no upper edge, and no shift of tau. A tau without c takes 1; a cell
    without q, or no sigma, gives a null edge."""
    taus = sized(table.select("tau_bps", "tau").distinct())
    rows = panel.crossJoin(taus).join(sized(table.select(*cell, "tau_bps", "q")), [*cell, "tau_bps"], "left").join(sized(bumps.select("tau_bps", "c")), "tau_bps", "left")
    return rows.withColumn("lower", F.col("point") - F.coalesce("c", F.lit(1.0)) * F.col("q") * F.col("sigma") * F.col("fri_close"))


def between(x: Column, anchors: Sequence[float], values: Sequence[Column]) -> Column:
    """Linear between anchors, whose values are columns; flat beyond both ends."""
    out = F.when(x <= anchors[0], values[0])
    for a, b, u, v in zip(anchors[:-1], anchors[1:], values[:-1], values[1:], strict=True):
        out = out.when(x <= b, u + (x - F.lit(a)) / F.lit(b - a) * (v - u))
    return out.otherwise(values[-1])


def serve_shifted(panel: DataFrame, table: DataFrame, asked: DataFrame, shift: Mapping[float, float], bump: Mapping[float, float], cell: str = "regime_pub", taus: Sequence[float] = TAUS) -> DataFrame:
    """Bands of unscaled scores: tau plus its shift (none for a tau not in the schedule), at most the last anchor, c and q
    there by interpolation, and point (1 -+ c q). asked has tau; a cell without a table has null edges."""
    names = [str(int(round(t * 10_000))) for t in taus]
    wide = table.groupBy(cell).pivot("tau_bps", [int(n) for n in names]).agg(F.first("q"))
    moved = F.lit(0.0)
    for t, d in shift.items():
        moved = F.when(F.abs(F.col("tau") - t) < 1e-9, F.lit(float(d))).otherwise(moved)
    rows = panel.crossJoin(sized(asked)).join(sized(wide), cell, "left").withColumn("served", F.least(F.col("tau") + moved, F.lit(float(taus[-1]))))
    q = between(F.col("served"), taus, [F.col(n) for n in names])
    rows = rows.withColumn("q_eff", interpolated(F.col("served"), bump) * q)
    return rows.withColumns({"lower": F.col("point") * (1 - F.col("q_eff")), "upper": F.col("point") * (1 + F.col("q_eff"))}).drop(*names)


def looked_up(requests: DataFrame, artefact: DataFrame, table: DataFrame, shift: Mapping[float, float], bump: Mapping[float, float], kind: str = "scaled", fallback: str = "high_vol", taus: Sequence[float] = TAUS) -> DataFrame:
    """Bands for requests (symbol, fri_ts, target), a row each, with the reason where there is none.

    artefact has a row a symbol and date: regime_pub, fri_close, point, sigma. The target is clipped to the fitted range
    and shifted; an unknown regime takes the fallback's quantiles. kind: scaled (sigma times the close), raw (share of the point), lending
    (share of the close) or downside (scaled, lower edge only, the clipped target itself is claimed, no shift).
    """
    names = [str(int(round(t * 10_000))) for t in taus]
    wide = table.groupBy("regime_pub").pivot("tau_bps", [int(n) for n in names]).agg(F.first("q"))
    back = wide.where(F.col("regime_pub") == fallback).select(*[F.col(n).alias(f"f{n}") for n in names])
    rows = requests.join(artefact, ["symbol", "fri_ts"], "left").join(sized(wide), "regime_pub", "left").crossJoin(sized(back))
    target = F.least(F.greatest(F.col("target"), F.lit(taus[0])), F.lit(taus[-1]))
    served = target if kind == "downside" else F.least(target + interpolated(target, shift), F.lit(taus[-1]))
    rows = rows.withColumns({"claimed": target, "served": served})
    q = F.col("c") * between(F.col("served"), taus, [F.coalesce(F.col(n), F.col(f"f{n}")) for n in names])
    rows = rows.withColumn("c", interpolated(F.col("served"), bump)).withColumn("q_eff", q)
    unit = {"raw": F.col("point"), "lending": F.col("fri_close")}.get(kind, F.col("sigma") * F.col("fri_close"))
    error = F.when(F.col("fri_close").isNull(), "absent")
    if kind in ("scaled", "downside"):
        error = error.when(F.coalesce(F.col("sigma"), F.lit(0.0)) <= 0, "no scale")
    rows = rows.withColumn("error", error).withColumn("half", F.when(F.col("error").isNull(), F.col("q_eff") * unit))
    upper = F.lit(None).cast("double") if kind == "downside" else F.col("point") + F.col("half")
    rows = rows.withColumns({"lower": F.col("point") - F.col("half"), "upper": upper})
    # two readings of a width: relative to the close (sharpness) and to the point (half width)
    rows = rows.withColumns({"sharpness_bps": F.col("half") / F.col("fri_close") * 10_000, "half_width_bps": F.when(F.col("point") != 0, F.col("half") / F.col("point") * 10_000).when(F.col("half").isNotNull(), 0.0)})
    return rows.drop(*names, *[f"f{n}" for n in names])


def available(artefact: DataFrame) -> DataFrame:
    """What can be asked for: each symbol, date and regime once."""
    return artefact.select("symbol", "fri_ts", "regime_pub").distinct()


def serve_requests(panel: DataFrame, table: DataFrame, asked: DataFrame, shift: Mapping[float, float], bump: Mapping[float, float], cell: str = "regime_pub", fallback: str = "high_vol") -> DataFrame:
    """Bands at any asked coverage: asked has tau; it is clipped to the fitted range, shifted, and c and q are interpolated
    between anchors. A cell without a table takes the fallback's."""
    names = [str(int(round(t * 10_000))) for t in TAUS]
    wide = table.groupBy(cell).pivot("tau_bps", [int(n) for n in names]).agg(F.first("q"))
    back = wide.where(F.col(cell) == fallback).select(*[F.col(n).alias(f"f{n}") for n in names])
    rows = panel.crossJoin(sized(asked)).join(sized(wide), cell, "left").crossJoin(sized(back))
    tau = F.least(F.greatest(F.col("tau"), F.lit(TAUS[0])), F.lit(TAUS[-1]))
    rows = rows.withColumn("served", F.least(tau + interpolated(tau, shift), F.lit(TAUS[-1])))
    q = between(F.col("served"), TAUS, [F.coalesce(F.col(n), F.col(f"f{n}")) for n in names])
    rows = rows.withColumns({"c": interpolated(F.col("served"), bump), "q": q})
    half = F.col("c") * F.col("q") * F.col("sigma") * F.col("fri_close")
    return rows.withColumns({"lower": F.col("point") - half, "upper": F.col("point") + half}).drop(*names, *[f"f{n}" for n in names])


def with_hits(bands: DataFrame) -> DataFrame:
    inside = (F.col("mon_open") >= F.col("lower")) & (F.col("mon_open") <= F.col("upper"))
    return bands.withColumns({"inside": inside.cast("int"), "hw_bps": (F.col("upper") - F.col("lower")) / 2 / F.col("fri_close") * 10_000})


def coverage_by(bands: DataFrame, *by: str) -> DataFrame:
    """n, realised coverage and mean half-width of bands, by any columns."""
    return with_hits(bands).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("inside").cast("double")).alias("realised"), F.avg("hw_bps").alias("mean_hw_bps"))


def path_coverage(bands: DataFrame, *by: str) -> DataFrame:
    """Coverage of the gap's end and of its whole path (path_lo, path_hi), and the difference in points."""
    end = ((F.col("mon_open") >= F.col("lower")) & (F.col("mon_open") <= F.col("upper"))).cast("double")
    path = ((F.col("path_lo") >= F.col("lower")) & (F.col("path_hi") <= F.col("upper"))).cast("double")
    g = bands.groupBy(*by).agg(F.count("*").alias("n"), F.avg(end).alias("endpoint_cov"), F.avg(path).alias("path_cov"))
    return g.withColumn("gap_pp", (F.col("endpoint_cov") - F.col("path_cov")) * 100)


def shrunk_table(table: DataFrame, cell: Sequence[str], k: float = 30.0) -> DataFrame:
    """Thin cells pulled to the pool: w q + (1 - w) m q_pool, w = n / (n + k), m the cell's median ratio to the pool.

    table has rows of the cells and rows whose cells are all null, the pool."""
    pool = table.where(F.col(cell[0]).isNull()).select("tau_bps", F.col("q").alias("q_pool"))
    own = table.where(F.col(cell[0]).isNotNull()).join(F.broadcast(pool), "tau_bps")
    ratio = F.percentile(F.try_divide(F.col("q"), F.col("q_pool")), F.lit(0.5)).over(Window.partitionBy(*cell))
    w = F.col("n") / (F.col("n") + k)
    return own.withColumn("_m", ratio).withColumn("q_shrunk", w * F.col("q") + (1 - w) * F.col("_m") * F.col("q_pool")).drop("_m")
