"""Shards of near equal bytes: a minimax contiguous partition over ordered atomic groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordkit as W
from .store import running, with_row_of, written


class _Line:
    """What the driver knows of the groups laid end to end: cells of neighbouring groups, each with the starts of its
    first and last group and their number. A few ten thousand numbers at most, whatever the input."""

    def __init__(self, total: int, first: np.ndarray, last: np.ndarray, n: np.ndarray):
        self.total, self.first, self.last, self.n = total, first, last, n
        self.borders = np.unique(np.concatenate([first, last, [total]]))

    def split(self, cells: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> _Line:
        """The line with finer cells in the place of some."""
        keep = np.ones(len(self.first), bool)
        keep[cells] = False
        order = np.argsort(np.concatenate([self.first[keep], first]), kind="stable")
        parts = ((self.first, first), (self.last, last), (self.n, n))
        return _Line(self.total, *[np.concatenate([a[keep], b])[order] for a, b in parts])

    def cuts(self, capacity: int, k: int, hopeful: bool) -> list[int]:
        """Where greedy filling ends each shard; hopeful: as far as it could, where borders aren't known."""
        at, out = 0, []
        for _ in range(k):
            to = min(at + capacity, self.total)
            end = int(self.borders[np.searchsorted(self.borders, to, "right") - 1])
            if hopeful:
                i = int(np.searchsorted(self.first, to, "right")) - 1
                if self.n[i] > 2 and to < self.last[i]:
                    end = to
            at = max(at, end)
            out.append(at)
        return out

    def least(self, k: int, hopeful: bool) -> int:
        lo, hi = -(-self.total // k), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.cuts(mid, k, hopeful)[-1] >= self.total else (mid + 1, hi)
        return lo

    def doubtful(self, low: list[int], high: list[int]) -> np.ndarray:
        """Cells with unknown borders between where a cut may be at the earliest and at the latest."""
        reached = np.zeros(len(self.first), bool)
        for a, b in zip(low, high, strict=True):
            reached |= (self.first <= b) & (self.last >= a)
        return np.flatnonzero(reached & (self.n > 2))


def _cells(first: np.ndarray, last: np.ndarray, bins: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Groups that start in some stretches, counted in bins of each stretch from its first start to its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(0))
            i = np.maximum(np.searchsorted(first, x, "right") - 1, 0)
            x, i = (v[(x >= first[i]) & (x <= last[i])] for v in (x, i))
            spot = i * bins + np.minimum((x - first[i]) * bins // np.maximum(last[i] - first[i], 1), bins - 1) if len(x) else x
            order = np.lexsort((x, spot))
            x, spot = x[order], spot[order]
            at = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]])) if len(x) else np.zeros(0, np.int64)
            end = np.append(at[1:], len(x)) - 1 if len(x) else at
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (spot[at], x[at], x[end], end - at + 1)], ["spot", "first", "last", "n"])

    return W.tidy(run)


def minimax_cuts(groups: DataFrame, shards: int, start: str = "start", size: str = "size", fineness: int = 2048) -> tuple[int, list[int]]:
    """The smallest capacity with which all groups, in order, fill at most so many shards, and where to cut.

    groups has each group's exclusive prefix sum and its size (1 at least). The driver binary-searches the capacity and
    checks it greedily over known borders; where the answer hangs on unknown ones, one Spark job looks into just those
    cells, until it is exact. A cell is cut in bins from its first start to its last, so its two ends part in every job
    and the search ends however large a group is; a bin is at most a fineness-th of its cell, so jobs are few.
    """
    ends = groups.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(start), F.lit(0)), F.count("*")).first()
    total = int(ends[0])
    if total == 0:
        return 0, [0] * shards
    line = _Line(total, np.array([0], np.int64), np.array([int(ends[1])], np.int64), np.array([int(ends[2])], np.int64))
    while True:
        lo, hi = line.least(shards, True), line.least(shards, False)
        cells = line.doubtful(line.cuts(lo, shards, False), line.cuts(hi, shards, True)) if lo < hi else np.zeros(0, np.int64)
        if not len(cells):
            return hi, line.cuts(hi, shards, False)
        bins = max(2, fineness // max(1, len(cells) // 16))
        look = _cells(line.first[cells], line.last[cells], bins)
        seen = groups.select(F.col(start).cast("long")).mapInArrow(look, "spot long, first long, last long, n long")
        seen = seen.groupBy("spot").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).toPandas()
        line = line.split(cells, *[seen[c].to_numpy(np.int64) for c in ("first", "last", "n")])


def shard_by_bytes(rows: DataFrame, shards: int, group: Column, id_col: str = "doc_id", size_col: str = "size") -> DataFrame:
    """Adds shard and slot to narrow rows (columns so named are replaced): groups stay whole, in the order of their
    smallest id; the largest shard is as small as contiguous cuts allow.

    Ties in id are told apart by the group; wholly equal rows take neighbouring slots. Null ids come first. A group
    larger than a fair share makes the largest shard, as nothing may split it; its rows are still dealt over many tasks.
    No rows: no rows. Other columns may have any names.
    """
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    keyed = rows.select(group.alias("group"), F.col(id_col).alias("id"), F.col(size_col).alias("size"), F.struct(*kept).alias("row"))
    keyed = written(keyed.withColumn("place", F.monotonically_increasing_id()), "shard-rows")
    groups = keyed.groupBy("group").agg(F.min("id").alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("n"))
    placed = written(running(groups, ["first", "group"], {"start": "bytes", "row0": "n"}, "shard-groups"), "shard-starts")
    _, cuts = minimax_cuts(placed, shards, "start", "bytes")
    shard = F.lit(0)
    for c in cuts[:-1]:
        shard = shard + F.when(F.col("start") >= c, 1).otherwise(0)
    placed = placed.withColumn("shard", shard.cast("int"))
    base = {int(r["shard"]): int(r["r"]) for r in placed.groupBy("shard").agg(F.min("row0").alias("r")).collect()}
    whole = with_row_of(keyed, placed.select("group", "start", "shard", "n"), "group", "n")
    counted = running(whole.select("start", "id", "place", "shard", "row"), ["start", "id", "place"], {"at": "1"}, "shard-slots")
    first = F.lit(0).cast("long")
    for s, r in base.items():
        first = F.when(F.col("shard") == s, F.lit(r).cast("long")).otherwise(first)
    return counted.select(*[F.col("row").getField(c).alias(c) for c in kept], "shard", (F.col("at") - first).alias("slot"))
