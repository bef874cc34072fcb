"""The adaptive multipliers as keyed state of a stream: sealed numbers a cell, timers that close periods, late rows refused."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.online import HIGHEST, LOWEST, RATE, resumed

#: What spark.sql.streaming.stateStore.providerClass must be.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
OUT = "cell string, tau_bps int, period date, n long, m_served double, m_next double"


def _day_ms(period: dt.date) -> int:
    return (period - dt.date(1970, 1, 1)).days * DAY_MS


class _Multipliers(StatefulProcessor):
    """One cell: its multipliers by tau, the scores of periods that are still open, and the last period that was closed."""

    def __init__(self, table: Mapping[str, list[tuple[int, float, float]]], start: Mapping[tuple[str, int], float], rate: float):
        self.table, self.start, self.rate = dict(table), dict(start), rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.m = handle.getMapState("m", "tau_bps int", "m double")
        self.open = handle.getMapState("open", "period date", "scores array<double>")
        self.closed = handle.getValueState("closed", "period date")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        closed = self.closed.get()[0] if self.closed.exists() else None
        for p in rows:
            for period, own in p.groupby("period"):
                if closed is not None and period <= closed:  # no closed period is opened again
                    continue
                old = list(self.open.getValue((period,))[0]) if self.open.containsKey((period,)) else []
                if not old:
                    self.handle.registerTimer(_day_ms(period) + DAY_MS)
                self.open.updateValue((period,), (old + own["s"].astype(float).tolist(),))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        """Periods that the watermark has passed, in order, each with the multiplier from before it."""
        until = expiredTimerInfo.getExpiryTimeInMs()
        out, cell = [], key[0]
        for period in sorted(k[0] for k in self.open.keys() if _day_ms(k[0]) + DAY_MS <= until):
            s = np.array(list(self.open.getValue((period,))[0]), float)
            for bps, tau, q in self.table.get(cell, []):
                m = self.m.getValue((bps,))[0] if self.m.containsKey((bps,)) else self.start.get((cell, bps), 1.0)
                miss = float((s > m * q).mean())
                then = min(max(m * math.exp(self.rate * (miss - (1 - tau))), LOWEST), HIGHEST)
                self.m.updateValue((bps,), (then,))
                out.append((cell, bps, period, len(s), m, then))
            self.open.removeKey((period,))
            self.closed.update((period,))
        return iter([pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])] if out else [])

    def close(self) -> None:
        pass


def adaptive_stream(scores: DataFrame, table: DataFrame, cell: str, period: str, score: str, late: str = "0 seconds", rate: float = RATE, checkpoint: Mapping | None = None) -> DataFrame:
    """adaptive_replay on a stream: the same rows, but that rows which come after their period was closed are refused.

    scores has cell, period (a date) and score; a period closes once the watermark, `late` behind the newest period,
    has passed its day. checkpoint, a sealed one, says where to begin and must be what its hash says; the stream's own
    checkpoint keeps the state after that. A cell holds its open periods' scores and a number a tau; cells and taus of
    table are few and go along with the code. Sessions must name STORE as their state store, which keeps several states a key.
    """
    levels: dict[str, list[tuple[int, float, float]]] = {}
    for r in table.where("q IS NOT NULL").select(F.col(cell).alias("cell"), "tau_bps", "tau", "q").orderBy("tau_bps").collect():
        levels.setdefault(r["cell"], []).append((int(r["tau_bps"]), float(r["tau"]), float(r["q"])))
    start = resumed(checkpoint) if checkpoint is not None else {}
    known = scores.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(cell).isNotNull() & F.col(period).isNotNull())
    rows = known.select(F.col(cell).alias("cell"), F.col(period).cast("date").alias("period"), F.col(score).cast("double").alias("s"))
    timed = rows.withColumn("at", F.col("period").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("cell").transformWithStateInPandas(_Multipliers(levels, start, rate), OUT, "Append", "EventTime")
