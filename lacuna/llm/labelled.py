"""What the learned operators share: who teaches, bounded samples of them, and scores made probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def taught(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, few: int = 1_000_000) -> DataFrame:
    """doc_id, text and y of labelled rows outside the held-out fold.

    Of several labels of a document the largest counts; null labels and ids teach nothing. At most `few` labels go to all
    tasks (some 25 MB); more are joined by shuffle.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held))
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    own = F.broadcast(own) if own.limit(few + 1).count() <= few else own
    return docs.select("doc_id", "text").join(own, "doc_id")


def sampled(rows: DataFrame, most: int, salt: int) -> DataFrame:
    """rows of at most so many different texts, one each, picked by a hash of the text: the same in every run. h is that
    hash, for a caller that wants them in order. Few texts: all of them."""
    h = F.xxhash64("text")
    ids = rows.groupBy(h.alias("h")).agg(F.min("doc_id").alias("doc_id")).orderBy(F.xxhash64("h", F.lit(salt)), "h").limit(most)
    ids = ids.select("h", F.col("doc_id").alias("_doc"))
    some = rows.withColumn("h", h).join(F.broadcast(ids), ["h"]).where(F.col("doc_id") == F.col("_doc")).drop("_doc")
    return some.dropDuplicates(["h"])


def calibrate(margins: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """a, b of the logistic curve 1 / (1 + exp(-(a m + b))) that fits labels best, by Newton steps, slightly ridged.

    One kind of label, or none, gives a flat or nearly flat curve at its smoothed share.
    """
    a, b = 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(y) == 0 or y.min() == y.max():
        return 1.0 if len(y) == 0 else 0.0, b
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g = np.array([np.dot(p - t, margins) + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[np.dot(v * margins, margins) + 1e-3, np.dot(v, margins)], [np.dot(v, margins), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def chance(margins: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] * margins + curve[1], -35, 35)))
