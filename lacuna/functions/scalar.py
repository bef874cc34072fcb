"""Column expressions: schedules, scores, fixed-point prices, session windows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def interpolated(x: Column, anchors: Mapping[float, float]) -> Column:
    """Piecewise-linear schedule through the anchors, flat beyond both ends."""
    points = sorted(anchors.items())
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (a, va), (b, vb) in zip(points[:-1], points[1:], strict=True):
        out = out.when(x <= b, F.lit(float(va)) + (x - a) / F.lit(float(b - a)) * F.lit(float(vb - va)))
    return out.otherwise(F.lit(float(points[-1][1])))


def winkler(lower: Column, upper: Column, truth: Column, tau: Column) -> Column:
    """Interval score: the width, and 2 / (1 - tau) times what the truth is outside by."""
    alpha = 1 - tau
    return (upper - lower) + F.when(truth < lower, (lower - truth) * 2 / alpha).when(truth > upper, (truth - upper) * 2 / alpha).otherwise(0.0)


def realised_z(after: Column, before: Column, vol: Column) -> Column:
    """The size of a log move in units of the volatility before it; none, or 0, gives null."""
    return F.try_divide(F.abs(F.log(after / before)), F.when(vol != 0, vol))


def gap_scale(gap_days: Column) -> Column:
    return F.sqrt(F.greatest(gap_days - 3, F.lit(0)) + F.lit(1.0))


def cut(num: Column, den: Column) -> Column:
    """num / den, cut toward zero, of whole numbers as decimals. What is left over goes first: a plain quotient is rounded
    at its sixth digit, which lifts 0.9999999 to one."""
    return ((num - num % den) / den).cast("decimal(38,0)")


def deviation_bps(price: Column, middle: Column) -> Column:
    """Whole basis points from the middle, toward zero; no middle, or 0, gives null."""
    return F.when(middle != 0, cut((price - middle).cast("decimal(30,0)") * 10_000, middle.cast("decimal(20,0)")).cast("long"))


def fixed_point(value: Column, exponent: int) -> Column:
    """A price as an integer of 10^exponent units, halves away from zero."""
    return F.round(value * F.lit(float(10**-exponent))).cast("long")


def session_of(ts: Column, zone: str = "America/New_York") -> Column:
    """weekend, rth, premarket, afterhours or overnight of the local time; windows are half-open."""
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return (
        F.when(F.dayofweek(local).isin(1, 7), "weekend").when((minute >= 570) & (minute < 960), "rth").when((minute >= 240) & (minute < 570), "premarket")
        .when((minute >= 960) & (minute < 1200), "afterhours").otherwise("overnight")
    )


def triple_witching(day: Column) -> Column:
    """The third Friday of a quarter's last month."""
    return F.month(day).isin(3, 6, 9, 12) & (F.dayofweek(day) == 6) & F.dayofmonth(day).between(15, 21)


def epoch_to_utc(x: Column) -> Column:
    """A timestamp of an epoch number whose unit (ns, us, ms or s) its size tells."""
    size = F.abs(x)
    micros = F.when(size > 10**17, x / 1000).when(size > 10**14, x).when(size > 10**11, x * 1000).otherwise(x * 1_000_000)
    return F.timestamp_micros(micros.cast("long"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share, within [0, 1]; null without trials."""
    p, nn = hits / n, n.cast("double")
    middle = (p + z * z / (2 * nn)) / (1 + z * z / nn)
    half = z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)) / (1 + z * z / nn)
    return F.when(n > 0, F.greatest(middle - half, F.lit(0.0))), F.when(n > 0, F.least(middle + half, F.lit(1.0)))
