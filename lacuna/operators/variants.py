"""Variants of the forecaster as rows of a bundle: how each makes its scale and its cells, what it was fitted to, and how all
of them do on the same gaps, in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import panel as P
from .shared import order_statistics, sized
from .stats import conditional, transitions

MOST = 200


def scaled(panel: DataFrame, rules: DataFrame) -> DataFrame:
    """A row a gap and variant: variant, cell, scale and score (score_raw over the scale), for the gaps at which every
    variant has a positive scale, so that all stand on the same rows.

    rules has variant, method (ewma: half_life; window: window; blend: alpha of the ewma and the rest of the window), half_life,
    window, alpha and cell (a column of panel, or null for one cell for all). A bundle has at most 200 rules, each its own
    name; a method that isn't known is an error.
    """
    told = rules.limit(MOST + 1).collect()
    if len(told) > MOST or len({r["variant"] for r in told}) < len(told):
        raise ValueError(f"more than {MOST} rules, or two of one name")
    made: dict[tuple, str] = {}

    def scale(kind: str, size: float):  # noqa: ANN202
        nonlocal panel
        if (kind, size) not in made:
            made[kind, size] = name = f"_scale{len(made)}"
            panel = P.ewma_scale(panel, float(size), name=name) if kind == "ewma" else P.window_scale(panel, int(size), name=name)
        return F.col(made[kind, size])

    each = []
    for r in told:
        if r["method"] == "blend":
            own = F.lit(r["alpha"]) * scale("ewma", r["half_life"]) + (1 - F.lit(r["alpha"])) * scale("window", r["window"])
        elif r["method"] in ("ewma", "window"):
            own = scale(r["method"], r["half_life"] if r["method"] == "ewma" else r["window"])
        else:
            raise ValueError(f"{r['variant']}: no method {r['method']}")
        cell = F.lit("all") if r["cell"] is None else F.col(r["cell"]).cast("string")
        each.append(F.struct(F.lit(r["variant"]).alias("variant"), cell.alias("cell"), own.alias("scale")))
    rows = panel.withColumn("_v", F.array(*each)).where(F.forall("_v", lambda v: v["scale"] > 0) & F.col("score_raw").isNotNull())
    out = rows.select("symbol", "fri_ts", "point", "fri_close", "mon_open", "score_raw", F.explode("_v").alias("_v")).select("*", "_v.*").drop("_v")
    return out.withColumn("score", F.col("score_raw") / F.col("scale"))


def fitted(train: DataFrame, tune: DataFrame, taus: Sequence[float], shifts: Sequence[float], top: float = 0.999) -> DataFrame:
    """A bundle's tables: variant, cell, tau_bps, tau, shift, n and q. q is the score of training at rank
    ceil((tau + shift) (n + 1)), in [1, n], and shift the least at which the variant's cells together hold tau on the rows of tuning;
    the greatest if none does, or there are none. tau + shift is at most `top`.

    One pass over training finds all ranks, one over tuning tests all shifts: rows aren't multiplied by the grid.
    """
    grid = [(t, d, min(t + d, top)) for t in taus for d in sorted(shifts)]
    rank = lambda at: lambda n: F.least(F.greatest(F.ceil(F.lit(at) * (n + 1)), F.lit(1)), n)
    found = order_statistics(train, ["variant", "cell"], "score", [(at, rank(at)) for _, _, at in grid])
    wide = found.groupBy("variant", "cell", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("ask", "q"))), lambda x: x["q"]).alias("qs"))
    wide = sized(wide)
    held = tune.join(wide, ["variant", "cell"]).groupBy("variant").agg(*[F.avg((F.col("score") <= F.col("qs")[i]).cast("double")).alias(f"h{i}") for i in range(len(grid))])
    picks = []
    for t in taus:
        at = [i for i, (u, _, _) in enumerate(grid) if u == t]
        pick = F.coalesce(*[F.when(F.col(f"h{i}") >= t, F.lit(i)) for i in at], F.lit(at[-1]))
        picks.append(F.struct(F.lit(int(round(t * 10_000))).alias("tau_bps"), F.lit(float(t)).alias("tau"), pick.alias("pick")))
    all_of = wide.select("variant").distinct().join(held, "variant", "left").select("variant", F.explode(F.array(*picks)).alias("_p")).select("variant", "_p.*")
    shift = F.element_at(F.array(*[F.lit(float(d)) for _, d, _ in grid]), F.col("pick") + 1)
    return wide.join(sized(all_of), "variant").select("variant", "cell", "tau_bps", "tau", shift.alias("shift"), "n", F.element_at("qs", F.col("pick") + 1).alias("q"))


def served(rows: DataFrame, bundle: DataFrame) -> DataFrame:
    """Bands of every variant: point -+ q scale close. Cells without a table have none."""
    both = rows.join(sized(bundle.select("variant", "cell", "tau_bps", "tau", "shift", "q")), ["variant", "cell"])
    half = F.col("q") * F.col("scale") * F.col("fri_close")
    return both.withColumns({"lower": F.col("point") - half, "upper": F.col("point") + half})


def side_by_side(bands: DataFrame, against: str) -> DataFrame:
    """A row a variant and tau: n, realised, mean half-width in points of the close, coverage and independence ratios (the
    latter summed over symbols, k of them), and width_ratio, to the variant named `against`."""
    inside = (F.col("mon_open") >= F.col("lower")) & (F.col("mon_open") <= F.col("upper"))
    rows = bands.withColumns({"miss": F.when(inside, 0).otherwise(1), "hw": (F.col("upper") - F.col("lower")) / 2 / F.col("fri_close") * 10_000})
    uc = rows.groupBy("variant", "tau_bps", "tau").agg(F.count("*").alias("n"), F.sum("miss").alias("x"), F.avg("hw").alias("mean_hw_bps"), F.max("shift").alias("shift"))
    out = conditional(uc, transitions(rows, ["variant", "symbol", "tau_bps"], ["fri_ts"], "miss"), ["variant", "tau_bps"])
    base = F.max(F.when(F.col("variant") == against, F.col("mean_hw_bps"))).over(Window.partitionBy("tau_bps"))
    return out.withColumns({"realised": 1 - F.col("x") / F.col("n"), "width_ratio": F.col("mean_hw_bps") / base}).select("variant", "tau_bps", "shift", "n", "realised", "mean_hw_bps", "width_ratio", "lr_uc", "lr_ind", "k")
