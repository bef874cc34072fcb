"""Audits of what was served: truth joins, seals, commitments, forward tapes, freshness and buffers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats as S
from .online import canonical
from .shared import sized


def with_truth(bands: DataFrame, truth: DataFrame, today: str) -> DataFrame:
    """Bands with the truth of their gap and its status: known, pending (the right edge isn't before today) or missing."""
    both = bands.join(truth, ["symbol", "fri_ts"], "left")
    status = F.when(F.col("truth").isNotNull(), "known").when(F.col("mon_ts") >= F.lit(today).cast("date"), "pending").otherwise("missing")
    return both.withColumn("status", status)


def coverage_audit(rows: DataFrame) -> DataFrame:
    """Of bands with truth, by tau: coverage, Kupiec's ratio, the grouped conditional ratios and their tails."""
    seen = rows.withColumn("miss", (~F.col("truth").between(F.col("lower"), F.col("upper"))).cast("int"))
    uc = seen.groupBy("tau_bps", "tau").agg(F.count("*").alias("n"), F.sum("miss").alias("x"))
    t = S.transitions(seen, ["symbol", "tau_bps"], ["fri_ts"], "miss")
    out = S.conditional(uc, t, ["tau_bps"]).withColumn("realised", 1 - F.col("x") / F.col("n"))
    return out.select("tau_bps", "n", "x", "realised", "k", "lr_uc", "lr_ind", "lr_cc", "p_uc", "p_ind", "p_cc")


def content_hash(rows: DataFrame, columns: Sequence[str]) -> str:
    """A hash of a table's rows, whatever their order and files: the sum of the rows' own hashes."""
    one = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    got = rows.agg(F.sum(one), F.count("*")).first()
    return hashlib.sha256(f"{got[0]}:{got[1]}".encode()).hexdigest()


def frozen(sidecar: str, rows_sha256: str) -> str:
    """A sidecar with the hash of its rows and, last, its own."""
    body = json.loads(sidecar) | {"rows_sha256": rows_sha256}
    return canonical(body | {"artefact_sha256": hashlib.sha256(canonical(body).encode()).hexdigest()})


def artefact_intact(sidecar: str, rows_sha256: str) -> bool:
    """Whether a frozen sidecar is what its hash says, and its rows are those it was frozen with."""
    body = json.loads(sidecar)
    told = body.pop("artefact_sha256", None)
    return told == hashlib.sha256(canonical(body).encode()).hexdigest() and body.get("rows_sha256") == rows_sha256


def frozen_serve(panel: DataFrame, table: DataFrame, bumps: DataFrame, fallback: str = "high_vol") -> DataFrame:
    """Bands by a frozen table (regime_pub, tau_bps, q) and bumps (tau_bps, c): unknown regimes take the fallback's
    quantiles, taus without a c take 1; rows without a scale have no band."""
    back = table.where(F.col("regime_pub") == fallback).select("tau_bps", F.col("q").alias("_q"))
    rows = panel.where("sigma IS NOT NULL").crossJoin(sized(back)).join(sized(table.select("regime_pub", "tau_bps", "q")), ["regime_pub", "tau_bps"], "left")
    rows = rows.join(sized(bumps), "tau_bps", "left")
    half = F.coalesce("c", F.lit(1.0)) * F.coalesce("q", "_q") * F.col("sigma") * F.col("fri_close")
    return rows.withColumns({"lower": F.col("point") - half, "upper": F.col("point") + half})


def commitments(panel: DataFrame, table: DataFrame, zone: str, computed: Column | None = None) -> DataFrame:
    """What is committed before the open is known: half-widths of all taus, with whether it was in time, before 17:45 of
    the day before the right edge in a zone; computed is when, else the evening of the left edge."""
    rows = panel.where("sigma > 0").join(sized(table.select("regime_pub", "tau_bps", "q")), "regime_pub")
    deadline = F.to_utc_timestamp(F.date_sub("mon_ts", 1).cast("timestamp") + F.expr("INTERVAL 1065 MINUTES"), zone)
    at = computed if computed is not None else F.to_utc_timestamp(F.col("fri_ts").cast("timestamp") + F.expr("INTERVAL 17 HOURS"), zone)
    half = F.col("q") * F.col("sigma") * F.col("fri_close")
    return rows.select("symbol", "fri_ts", "mon_ts", "tau_bps", "fri_close", half.alias("half"), (at <= deadline).alias("accepted"))


def publications(committed: DataFrame, factor: DataFrame, now: Column | None = None, zone: str = "America/New_York") -> DataFrame:
    """Committed widths about a new centre, the close moved with its factor; symbols whose factor is missing are skipped.
    With now, an instant, rows say whether they are refused: from 09:25 of the right edge in the zone on."""
    both = committed.join(factor.where("factor_ret IS NOT NULL"), ["symbol", "fri_ts"])
    if now is not None:
        both = both.withColumn("refused", now >= F.to_utc_timestamp(F.col("mon_ts").cast("timestamp") + F.expr("INTERVAL 565 MINUTES"), zone))
    centre = F.col("fri_close") * (1 + F.col("factor_ret"))
    return both.withColumns({"lower": centre - F.col("half"), "upper": centre + F.col("half")})


def forward_tape(panel: DataFrame, cutoff: str, context: int) -> DataFrame:
    """Gaps from the cutoff on, marked is_forward, and so many of each symbol before it."""
    flag = F.col("fri_ts") >= F.lit(cutoff).cast("date")
    back = Window.partitionBy("symbol", "is_forward").orderBy(F.desc("fri_ts"))
    rows = panel.withColumn("is_forward", flag).withColumn("_k", F.row_number().over(back))
    return rows.where(F.col("is_forward") | (F.col("_k") <= context)).drop("_k")


def missing_partitions(there: DataFrame, days: DataFrame, symbols: DataFrame) -> DataFrame:
    """Expected days of symbols (a flag hard) that a tape lacks: symbol, day, kind."""
    want = symbols.crossJoin(sized(days))
    out = want.join(there.select("symbol", "day").distinct(), ["symbol", "day"], "left_anti")
    return out.select("symbol", "day", F.when(F.col("hard"), "hard").otherwise("soft").alias("kind"))


def latest_pairs(days: DataFrame, asked: DataFrame, cutoff: str, least_gap: int = 3) -> DataFrame:
    """For each asked day (column today) the latest gap of a leading series (column ts, its days) that is closed by then and begins
    after the cutoff: today, fri_ts, mon_ts; both null if there is none. One line of days, a row each."""
    line = Window.partitionBy(F.lit(0)).orderBy("ts")
    gaps = days.select("ts").distinct().withColumn("_l", F.lag("ts").over(line)).where((F.datediff("ts", "_l") >= least_gap) & (F.col("_l") > F.lit(cutoff).cast("date")))
    both = gaps.select(F.col("ts").alias("today"), F.lit(0).alias("_side"), F.struct(F.col("_l").alias("fri_ts"), F.col("ts").alias("mon_ts")).alias("_g"))
    both = both.unionByName(asked.select("today").distinct().withColumn("_side", F.lit(1)), allowMissingColumns=True)
    seen = F.last("_g", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("today", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_g", seen).where("_side = 1").select("today", "_g.fri_ts", "_g.mon_ts")


def missing_edges(pairs: DataFrame, there: DataFrame, symbols: DataFrame) -> DataFrame:
    """What a pair lacks: today, symbol, edge (fri or mon), day and kind. symbols says of each whether it is hard; those
    stop a run. Pairs are few, a row an asked day; there has symbol and day."""
    edge = F.explode(F.array(F.struct(F.lit("fri").alias("edge"), F.col("fri_ts").alias("day")), F.struct(F.lit("mon").alias("edge"), F.col("mon_ts").alias("day"))))
    want = symbols.crossJoin(sized(pairs.where("fri_ts IS NOT NULL").select("today", edge.alias("_e")).select("today", "_e.*")))
    out = want.join(there.select("symbol", "day").distinct(), ["symbol", "day"], "left_anti")
    return out.select("today", "symbol", "edge", "day", F.when(F.col("hard"), "hard").otherwise("soft").alias("kind"))


def freshness(runs: DataFrame, by: str, now: Column, hours: float) -> DataFrame:
    """Each manifest's last success, and whether it is within so many hours of now; none is not fresh."""
    g = runs.groupBy(by).agg(F.max(F.when(F.col("status") == "succeeded", F.col("ts"))).alias("last_success"), F.max(now).alias("_now"))
    age = F.unix_micros("_now") - F.unix_micros("last_success")
    return g.withColumn("fresh", F.coalesce(age <= int(hours * 3_600_000_000), F.lit(False))).drop("_now")


def differing(a: DataFrame, b: DataFrame, key: Sequence[str], fields: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Two answers to the same questions, field by field: rows of both, of one side only, and those that differ by more
    than a relative tolerance."""
    both = a.select(*key, F.lit(1).alias("_a"), *[F.col(f).alias(f"a_{f}") for f in fields]).join(b.select(*key, F.lit(1).alias("_b"), *[F.col(f).alias(f"b_{f}") for f in fields]), list(key), "full")
    alone = F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("one_side")
    off = lambda f: F.abs(F.col(f"a_{f}") - F.col(f"b_{f}")) > tolerance * F.greatest(F.abs(f"a_{f}"), F.abs(f"b_{f}"), F.lit(1.0))
    one = both.agg(F.count("*").alias("n"), alone, *[F.count_if(off(f)).alias(f) for f in fields])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("differing")) for f in fields]))
    return one.withColumn("_f", rows).select("_f.field", "n", "one_side", "_f.differing")


def buffer_pick(rows: DataFrame, score: str, grid: Sequence[float], tau: float) -> DataFrame:
    """For each year the smallest buffer of a grid whose band covers tau less half a point of the year's scores and passes
    its tests (Kupiec's p over 0.10, independence over 0.05), else covers with p over 0.05, else covers, else the
    largest: year, buffer, realised, status."""
    from ..functions.special import chi2_column

    each = rows.withColumn("year", F.year("fri_ts")).withColumn("buffer", F.explode(F.array(*[F.lit(float(b)) for b in grid])))
    each = each.withColumns({"miss": (F.col(score) > F.col("buffer")).cast("int"), "tau": F.lit(tau)})
    uc = each.groupBy("year", "buffer", "tau").agg(F.count("*").alias("n"), F.sum("miss").alias("x")).withColumn("lr_uc", S.kupiec_lr(F.col("x"), F.col("n"), 1 - F.col("tau")))
    t = S.transitions(each, ["year", "buffer", "symbol"], ["fri_ts"], "miss")
    ind = t.withColumn("_lr", S.independence_lr(t)).groupBy("year", "buffer").agg(F.sum("_lr").alias("lr_ind"), F.count("_lr").cast("int").alias("k"))
    both = uc.join(ind, ["year", "buffer"], "left").withColumn("realised", 1 - F.col("x") / F.col("n"))
    both = both.withColumns({"p_uc": chi2_column(F.col("lr_uc"), F.lit(1)), "p_ind": F.when(F.coalesce("k", F.lit(0)) > 0, chi2_column(F.col("lr_ind"), F.col("k"))).otherwise(1.0)})
    near = F.col("realised") >= tau - 0.005
    rank = F.when(near & (F.col("p_uc") > 0.10) & (F.col("p_ind") > 0.05), 0).when(near & (F.col("p_uc") > 0.05), 1).when(F.col("realised") >= tau, 2).otherwise(3)
    key = F.struct(rank.alias("rank"), F.when(rank < 3, F.col("buffer")).otherwise(-F.col("buffer")).alias("_b"), "buffer", "realised")
    best = both.groupBy("year").agg(F.min(key).alias("b"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("PASS", "MARGINAL", "CEILING", "CEILING")]), F.col("b.rank") + 1)
    return best.select("year", F.col("b.buffer").alias("buffer"), F.round("b.realised", 5).alias("realised"), status.alias("status"))


def walk_forward_buffers(rows: DataFrame, score: str, grid: Sequence[float], tau: float, tune: int = 4, test: int = 4) -> DataFrame:
    """A buffer chosen on the `tune` quarters before each quarter, and how it did on the `test` quarters from it on: cutoff,
    buffer, status, n_tune, realised_tune, n, realised, p_uc, p_ind.

    Chosen is the smallest buffer that covers tau less half a point with Kupiec's p over 0.10 and independence over 0.05 (PASS),
    else covers so with p over 0.05 (MARGINAL), else the smallest that covers tau, else the largest (CEILING). Symbols are
    one line each; pairs across a window's start don't count. A p of independence without a pair to tell it by is null and
    doesn't pass. Cutoffs have `tune` quarters of history, rows to choose on and rows to test on; rows without a score take no part.

    A row meets neither the grid nor the windows: rows are counted by quarter and by the number of buffers that they exceed,
    theirs and that of the row before, and the counts go to the windows.
    """
    from ..functions.special import chi2_column

    steps = sorted(float(b) for b in grid)
    level = F.array_size(F.filter(F.array(*[F.lit(b) for b in steps]), lambda b: b < F.col(score)))
    line = Window.partitionBy("symbol").orderBy("fri_ts")
    own = rows.where(F.col(score).isNotNull()).select("symbol", "fri_ts", (F.year("fri_ts") * 4 + F.quarter("fri_ts") - 1).alias("p"), level.alias("g"))
    own = own.withColumns({"p0": F.lag("p").over(line), "g0": F.lag("g").over(line)})
    counts = own.groupBy("symbol", "p", "g", "p0", "g0").agg(F.count("*").alias("c"))
    at = lambda kind, low, high, back: F.transform(F.sequence(low, high), lambda c: F.struct(c.alias("cut"), F.lit(kind).alias("kind"), (c - back).alias("start")))
    spans = F.concat(at("tune", F.col("p") + 1, F.col("p") + tune, tune), at("test", F.col("p") - test + 1, F.col("p"), 0))
    spread = counts.withColumn("_w", F.explode(spans)).select("symbol", "g", F.when(F.col("p0") >= F.col("_w.start"), F.col("g0")).alias("g0"), "c", "_w.cut", "_w.kind")
    spread = spread.groupBy("cut", "kind", "symbol", "g", "g0").agg(F.sum("c").alias("c")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    now, before = (F.col("g") > F.col("j")).cast("int"), (F.col("g0") > F.col("j")).cast("int")
    pairs = [F.sum(F.when((before == a) & (now == b), F.col("c")).otherwise(0)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]
    t = spread.groupBy("cut", "kind", "j", "symbol").agg(F.sum("c").alias("n"), F.sum(F.col("c") * now).alias("x"), *pairs)
    g = t.withColumn("_lr", S.independence_lr(t)).groupBy("cut", "kind", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("_lr").alias("lr_ind"), F.count("_lr").cast("int").alias("k"))
    g = g.withColumns({"realised": 1 - F.col("x") / F.col("n"), "p_uc": chi2_column(S.kupiec_lr(F.col("x"), F.col("n"), F.lit(1 - tau)), F.lit(1)), "p_ind": F.when(F.col("k") > 0, chi2_column(F.col("lr_ind"), F.col("k")))})
    near = F.col("realised") >= tau - 0.005
    rank = F.when(near & (F.col("p_uc") > 0.10) & F.coalesce(F.col("p_ind") > 0.05, F.lit(False)), 0).when(near & (F.col("p_uc") > 0.05), 1).when(F.col("realised") >= tau, 2).otherwise(3)
    key = F.struct(rank.alias("rank"), F.when(rank < 3, F.col("j")).otherwise(-F.col("j")).alias("_j"), "j", "n", "realised")
    best = g.where("kind = 'tune'").groupBy("cut").agg(F.min(key).alias("b")).select("cut", F.col("b.rank").alias("rank"), F.col("b.j").alias("j"), F.col("b.n").alias("n_tune"), F.col("b.realised").alias("realised_tune"))
    first = counts.agg((F.min("p") + tune).alias("_first"))
    both = best.join(g.where("kind = 'test'"), ["cut", "j"]).crossJoin(F.broadcast(first)).where("cut >= _first")
    status = F.element_at(F.array(*[F.lit(x) for x in ("PASS", "MARGINAL", "CEILING", "CEILING")]), F.col("rank") + 1)
    buffer = F.element_at(F.array(*[F.lit(b) for b in steps]), F.col("j") + 1)
    cutoff = F.make_date(F.floor(F.col("cut") / 4).cast("int"), (F.col("cut") % 4 * 3 + 1).cast("int"), F.lit(1))
    return both.select(cutoff.alias("cutoff"), buffer.alias("buffer"), status.alias("status"), "n_tune", "realised_tune", "n", "realised", "p_uc", "p_ind")
