"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordkit as W
from .labelled import calibrate, chance, sampled, taught

_PUNCT = ~(W.ALNUM_WORDS | W._SPACE)
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)


def _shapes(w: W.Words, h: np.ndarray) -> np.ndarray:
    """How each word looks: capitals, digits, its last marks, and whether it repeats the word before."""
    d, s, e = w.data, w.start, w.end
    code = np.zeros(len(s), np.uint64)
    size = e - s
    second = d[np.minimum(s + 1, e - 1)]
    for x in (_UPPER[d[s]], _UPPER[second], _DIGIT[d[s]], _PUNCT[d[s]]):
        code = code * np.uint64(2) + x.astype(np.uint64)
    for back in (1, 2, 3):
        last = d[np.maximum(e - back, s)]
        code = code * np.uint64(256) + np.where((size >= back) & _PUNCT[last], last, 0).astype(np.uint64)
    code = code * np.uint64(4) + np.minimum(size // 4, 3).astype(np.uint64)
    again = np.zeros(len(s), bool)
    again[1:] = h[1:] == h[:-1]
    again[w.first[:-1][np.diff(w.first) > 0]] = False
    return W.mixed(code * np.uint64(2) + again.astype(np.uint64))


def features(texts: pa.Array, lo: int, hi: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each distinct feature, hashed into 2^bits buckets: words, pairs of words, and runs of one to
    three word shapes."""
    w = W.words(texts, lo, hi, W.BLANK_WORDS)
    h = w.hashes()
    shape = _shapes(w, h) if len(h) else h
    owner = w.owner().astype(np.int64)
    parts = []
    for salt, v, k in ((0, h, 1), (4, h, 2), (1, shape, 1), (2, shape, 2), (3, shape, 3)):
        g, ok = W.grams(v, w.first, k)
        bucket = (W.mixed(g + np.uint64(salt << 40)) >> np.uint64(64 - bits)).astype(np.int64)
        parts.append((owner[ok] << bits) | bucket[ok])
    both = np.unique(np.concatenate(parts))
    return both >> bits, both & ((1 << bits) - 1)


@dataclass
class Model:
    """Weights of the buckets (their log-count ratios times the hinge-loss weights), and the curve to a chance."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    curve: tuple[float, float]

    @property
    def bits(self) -> int:
        return len(self.weight).bit_length() - 1

    def margins(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        norm = np.sqrt(np.bincount(doc, self.ratio[bucket] ** 2, n))
        return np.bincount(doc, self.weight[bucket] * self.ratio[bucket], n) / np.maximum(norm, 1e-9) + self.bias


def _counts(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        for b in batches:
            texts, y = W.column(b, "text"), np.asarray(b.column(b.schema.get_field_index("y")))
            for lo, hi in W.slices(texts):
                doc, bucket = features(texts, lo, hi, bits)
                for v in (0, 1):
                    total[v] += np.bincount(bucket[y[lo:hi][doc] == v], minlength=1 << bits)
        k = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[0, k]), pa.array(total[1, k])], ["bucket", "bad", "good"])

    return W.tidy(run)


def _indicators(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = W.column(b, "text")
            for lo, hi in W.slices(texts):
                doc, bucket = features(texts, lo, hi, bits)
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                own = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)).slice(lo, hi - lo) for c in ("h", "y")], own], ["h", "y", "buckets"])

    return W.tidy(run)


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 4.0, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear hinge loss: one multiplier a row, each in turn set to its best value in
    [0, cost]. Rows are their buckets' ratios at unit length, with a constant for the bias; the rarer label costs more."""
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    sign = np.where(y == 1, 1.0, -1.0)
    share = max(float((y == 1).mean()), 1e-3) if len(y) else 0.5
    top = cost * np.where(y == 1, 1.0, min(share / max(1 - share, 1e-3), 10.0))
    unit = [1 / max(float(np.sqrt(ratio[r] @ ratio[r])), 1e-9) for r in rows]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = ratio[r] * unit[i]
            gradient = sign[i] * (float(w[r] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / (float(v @ v) + 1.0), 0.0), top[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[r] += step * v
                bias += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-3:
            break
    return w, bias


def log_ratios(count: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the smoothed share of each feature among good documents over that among bad ones; count is [bad, good]."""
    share = (count + smooth) / (count + smooth).sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, most_rows: int = 4500, smooth: float = 1.0, bits: int = 18) -> Model:
    """A model from the labelled rows outside the held-out fold.

    The class log-count ratios are sums over all of them, made by Spark, in 2^bits buckets of hashed features (a larger
    corpus may want more). The hinge loss is fitted to a sample of at most most_rows different texts (a documented
    bound), and the curve to another third as large; both go by a hash of the text, so reruns agree. No labels: a flat model.
    """
    rows = taught(docs, labels, "quality", folds, held)
    seen = rows.select("text", "y").mapInArrow(_counts(bits), "bucket int, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    count = np.zeros((2, 1 << bits))
    at = seen["bucket"].to_numpy(np.int64)
    count[0, at], count[1, at] = seen["bad"], seen["good"]
    ratio = log_ratios(count, smooth)
    picked = sampled(rows, most_rows + most_rows // 3, 11).select("h", "y", "text").mapInArrow(_indicators(bits), "h long, y int, buckets array<int>").toArrow()
    if not picked.num_rows:
        return Model(np.zeros(1 << bits), ratio, 0.0, (0.0, 0.0))
    order = np.argsort(np.asarray(picked["h"]), kind="stable")
    y, buckets = np.asarray(picked["y"]).astype(np.int64)[order], []
    for part in picked["buckets"].chunks:
        value, off = np.asarray(part.values), np.asarray(part.offsets)
        buckets += [value[i:j] for i, j in zip(off[:-1], off[1:], strict=True)]
    buckets = [buckets[i] for i in order]
    test = np.arange(len(y)) % 4 == 3
    weight, bias = descend([x for x, t in zip(buckets, test, strict=True) if not t], y[~test], ratio)
    model = Model(weight, ratio, bias, (1.0, 0.0))
    tried = [x for x, t in zip(buckets, test, strict=True) if t]
    doc = np.repeat(np.arange(len(tried)), [len(x) for x in tried])
    m = model.margins(doc, np.concatenate([np.zeros(0, np.int64), *tried]).astype(np.int64), len(tried))
    model.curve = calibrate(m, y[test])
    del picked, buckets, tried, doc
    W.give_back()  # the driver goes on to other work
    return model


def _score(sent, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for b in batches:
            texts, out = W.column(b, "text"), [np.zeros(0)]
            for lo, hi in W.slices(texts):
                doc, bucket = features(texts, lo, hi, model.bits)
                out.append(chance(model.margins(doc, bucket, hi - lo), model.curve))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out), pa.float64())], [*b.schema.names, name])

    return W.tidy(run)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """Adds the chance that a document is good (a column of that name is replaced; others may have any names). Only text
    is looked at; null and empty texts have no features and get the score of the bare curve; equal texts get equal
    scores; no rows, no rows."""
    rows = docs.drop(column)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(sent, column), T.StructType([*rows.schema.fields, T.StructField(column, T.DoubleType())]))
