"""Language-model scores: subword lattices over an existing piece vocabulary, and a smoothed word model as base."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordkit as W
from .store import whole_ids, written

END = "</s>"


def read_pieces(model_file: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces of a sentencepiece file as byte strings, a word's first blank as b" ", and start weights.

    Such files of BPE kind give ranks as scores, so a piece starts with 1 / (rank + 3); training does the rest. Each
    single byte is a piece, so any text has segmentations. Pieces with a blank inside never match a word and are left.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    weight: dict[bytes, float] = {bytes([b]): 1e-6 for b in range(256)}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        raw = sp.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in raw[1:]:
            weight[raw] = weight.get(raw, 0.0) + 1.0 / (max(-sp.get_score(i), 0.0) + 3.0)
    return list(weight), np.array(list(weight.values()))


class Lattice:
    """All segmentations of words into pieces, each weighing the product of its pieces' probabilities."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.longest = max(map(len, pieces), default=1)
        self.lengths = sorted({len(p) for p in pieces})
        texts = pa.array(pieces, pa.binary())
        data, off = W.raw(texts)
        n = len(data)
        up, down = W._power(n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W._CODE[data] * up[:n])])
        h = W.mixed((sums[off[1:]] - sums[off[:-1]]) * down[off[:-1]] + np.uint64(7919) * (off[1:] - off[:-1]).astype(np.uint64))
        self.found = W.Found(h, 20)
        self.piece = np.empty(len(pieces), np.int64)
        self.piece[np.searchsorted(self.found.keys, h)] = np.arange(len(pieces))
        self.log_p = log_p

    def _arcs(self, rows: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """For each piece length l, the piece that covers bytes [i, i + l) of each row, or -1."""
        n, m = rows.shape
        up, down = W._power(m + 1)
        sums = np.zeros((n, m + 1), np.uint64)
        np.cumsum(W._CODE[rows] * up[:m], axis=1, out=sums[:, 1:])
        arcs = {}
        for size in self.lengths:
            if size > m:
                break
            h = W.mixed((sums[:, size:] - sums[:, :-size]) * down[: m - size + 1] + np.uint64(7919 * size))
            at, k = self.found.where(h.ravel())
            if len(at):
                own = np.full(h.size, -1, np.int32)
                own[at] = self.piece[k]
                arcs[size] = own.reshape(h.shape)
        return rows, arcs

    def _forward(self, m: int, n: int, weights: dict[int, np.ndarray]) -> np.ndarray:
        alpha = np.full((m + 1, n), -np.inf)
        alpha[0] = 0
        for j in range(1, m + 1):
            alpha[j] = np.logaddexp.reduce([alpha[j - s] + w[:, j - s] for s, w in weights.items() if s <= j], axis=0)
        return alpha

    def _backward(self, m: int, n: int, weights: dict[int, np.ndarray]) -> np.ndarray:
        beta = np.full((m + 1, n), -np.inf)
        beta[m] = 0
        for i in range(m - 1, -1, -1):
            beta[i] = np.logaddexp.reduce([beta[i + s] + w[:, i] for s, w in weights.items() if i + s <= m], axis=0)
        return beta

    def _stretches(self, word: np.ndarray, size: int, back: bool) -> Iterator[tuple[int, int, int, dict[int, np.ndarray]]]:
        """A long word in stretches: their positions [lo, hi), where their bytes begin, and the arcs that end (or, going
        back, begin) in them."""
        m = len(word)
        for lo in range(0, m, size) if not back else range((m - 1) // size * size, -1, -size):
            hi = min(lo + size, m)
            a, b = (lo, min(hi + self.longest, m)) if back else (max(lo - self.longest, 0), hi)
            yield lo, hi, a, self._arcs(word[None, a:b])[1]

    def _long(self, word: np.ndarray, lp: np.ndarray, count: float | None, used: np.ndarray, size: int) -> float:
        """run for one word of any length: arcs are held for a stretch at a time, and of the recursions a number a
        position (forward), or as many as the longest piece has (backward)."""
        m = len(word)
        alpha = np.full(m + 1, -np.inf)
        alpha[0] = 0.0
        for lo, hi, a, arcs in self._stretches(word, size, False):
            weights = {s: lp[k[0]] for s, k in arcs.items()}
            for j in range(lo + 1, hi + 1):
                alpha[j] = np.logaddexp.reduce([alpha[j - s] + w[j - s - a] for s, w in weights.items() if s <= j - a])
        if count is None:
            return float(alpha[m])
        beta = {m: 0.0}
        for lo, hi, a, arcs in self._stretches(word, size, True):
            weights = {s: lp[k[0]] for s, k in arcs.items()}
            for i in range(hi - 1, lo - 1, -1):
                on = [(s, w[i - a] + beta[i + s]) for s, w in weights.items() if i - a < len(w) and np.isfinite(w[i - a])]
                beta[i] = float(np.logaddexp.reduce([v for _, v in on]))
                for s, v in on:
                    used[arcs[s][0][i - a]] += count * math.exp(alpha[i] + v - alpha[m])
                beta.pop(i + self.longest + 1, None)
        return float(alpha[m])

    def run(self, words: list[bytes], counts: np.ndarray | None = None, cells: int = 200_000, long: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of each word's marginal probability; with counts, also the pieces' expected counts.

        Words of one length go together; one of `long` bytes or more goes alone, a stretch at a time. Recursions are in
        log space, so long words don't underflow.
        """
        size = np.array([len(w) for w in words], np.int64)
        out, used = np.zeros(len(words)), np.zeros(len(self.log_p))
        order = np.argsort(size, kind="stable")
        lp = np.append(self.log_p, -np.inf)
        at = 0
        while at < len(order):
            m = int(size[order[at]])
            if m >= long:
                i = order[at]
                out[i] = self._long(np.frombuffer(b" " + words[i], np.uint8), lp, None if counts is None else float(counts[i]), used, long)
                at += 1
                continue
            to = min(int(np.searchsorted(size[order], m, "right")), at + max(1, cells // (m + 1)))
            pick = order[at:to]
            at = to
            rows = np.frombuffer(b"".join(b" " + words[i] for i in pick), np.uint8).reshape(len(pick), m + 1)
            _, arcs = self._arcs(rows)
            weights = {s: lp[a] for s, a in arcs.items()}
            alpha = self._forward(m + 1, len(pick), weights)
            out[pick] = alpha[m + 1]
            if counts is not None:
                beta = self._backward(m + 1, len(pick), weights)
                for s, a in arcs.items():
                    post = np.exp(alpha[: m + 2 - s].T + weights[s] + beta[s:].T - alpha[m + 1][:, None]) * counts[pick][:, None]
                    on = a >= 0
                    used += np.bincount(a[on], post[on], len(used))
        return out, used


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a run of texts with how often all texts, and those to learn from, have them."""
    for b in batches:
        texts, learn = W.column(b, "text"), np.asarray(b.column(b.schema.get_field_index("learn")).cast(pa.int8()))
        for lo, hi in W.slices(texts, 24 << 20):
            split = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(lo, hi - lo)))
            coded = split.flatten().dictionary_encode()
            index = np.asarray(coded.indices)
            per = np.diff(np.asarray(split.offsets))
            n = np.bincount(index, minlength=len(coded.dictionary))
            c = np.bincount(index, np.repeat(learn[lo:hi], per), len(n)).astype(np.int64)
            made = pa.RecordBatch.from_arrays([coded.dictionary, pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["word", "c", "n"])
            yield made.filter(pc.not_equal(made.column(0), ""))


def _expect(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(*sent.value), np.zeros(len(sent.value[0]))
        for b in batches:
            words = [w.encode() for w in b.column(0).to_pylist()]
            total += lattice.run(words, np.asarray(b.column(1)).astype(float))[1]
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k], pa.float64())], ["piece", "used"])

    return W.tidy(run)


def _marginal(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*sent.value)
        for b in batches:
            texts = b.column(0)
            n = len(texts)
            data, off = W.raw(texts)
            w = W.Words(data[off[0] : off[-1]], off[:-1] - off[0], off[1:] - off[0], np.arange(n + 1), off - off[0])
            log, _ = lattice.run([x.encode() for x in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(w.hashes()), pa.int64()), b.column(1), b.column(2), pa.array(log / np.log(10), pa.float64())], ["word", "c", "n", "log"])

    return W.tidy(run)


def _score(common, end: tuple[float, float, bool]) -> Callable:
    """Each document's sums over the common words, and one row for each of its other words.

    Both carry a number that the task gives the document, so rows that look alike stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, base, log, known = common.value
        found = W.Found(keys)
        number = TaskContext.get().partitionId() << 36
        for b in batches:
            texts, ids, held = W.column(b, "text"), b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("held_out"))
            for lo, hi in W.slices(texts):
                w = W.words(texts, lo, hi, W.BLANK_WORDS)
                h = w.hashes()
                at, k = found.where(h)
                n = hi - lo
                own = np.arange(number, number + n)
                number += n
                doc = np.searchsorted(w.first, at, "right") - 1
                total = lambda v, to=end: np.bincount(doc, v[k], n)  # noqa: B023, E731
                yield _rows(own, W.signed(W.mixed(own.astype(np.uint64))), np.ones(n), np.ones(n), ids.slice(lo, n), held.slice(lo, n), np.diff(w.first) + 1, total(known) + end[2], total(base) + end[0], total(log) + end[1])
                rest = np.ones(len(h), bool)
                rest[at] = False
                at = np.flatnonzero(rest)
                doc = np.searchsorted(w.first, at, "right") - 1
                order = np.lexsort((h[at], doc))
                d, x = doc[order], h[at][order]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])) if len(d) else np.zeros(0, np.int64)
                many = np.diff(np.append(new, len(d)))
                yield _rows(own[d[new]], W.signed(x[new]), np.zeros(len(new)), many)

    return W.tidy(run)


def _rows(own, word, kind, tf, ids=None, held=None, n=None, known=None, base=None, log=None) -> pa.RecordBatch:  # noqa: ANN001
    size = len(own)
    full = lambda v, t: pa.nulls(size, t) if v is None else v if isinstance(v, pa.Array) else pa.array(np.asarray(v).astype(t.to_pandas_dtype()), t)
    cols = [("own", own, pa.int64()), ("word", word, pa.int64()), ("kind", kind, pa.int32()), ("tf", tf, pa.int64()), ("doc_id", ids, pa.int64()), ("held_out", held, pa.bool_()), ("n_tokens", n, pa.int64()), ("n_known", known, pa.int64()), ("base", base, pa.float64()), ("log", log, pa.float64())]
    return pa.RecordBatch.from_arrays([full(v, t) for _, v, t in cols], [c for c, _, _ in cols])


_ROWS = "own long, word long, kind int, tf long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, log double"


def train_pieces(vocabulary: DataFrame, ends: int, model_file: str, rounds: int = 3) -> tuple[list[bytes], np.ndarray]:
    """Piece probabilities that fit the training counts of vocabulary (word, c), by expectation maximisation.

    Each round's expected counts are summed over tasks: a row a piece. The end of a text is a token beside the pieces
    and has its own share, which is given last.
    """
    pieces, weight = read_pieces(model_file)
    spark = vocabulary.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, np.log(weight / weight.sum())))
        seen = vocabulary.select("word", "c").where("c > 0").mapInArrow(_expect(sent), "piece int, used double").groupBy("piece").agg(F.sum("used").alias("used")).toPandas()
        weight = np.full(len(pieces), 0.01)
        weight[seen["piece"].to_numpy(np.int64)] += seen["used"].to_numpy()
    total = weight.sum() + ends + 0.5
    return pieces, np.append(np.log(weight / total), np.log((ends + 0.5) / total))


def score_texts(documents: DataFrame, model_file: str, folds: int = 5, held: int = 1, rounds: int = 3, most_common: int = 200_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of documents.

    Tokens are words (runs without blanks, A-Z as a-z), then one end. Rows whose crc32(doc_id as text) mod folds is not
    held teach: word counts for the base, and the probabilities of an existing vocabulary's pieces. score is the log10
    of the summed probability of all segmentations of the text into pieces, a word's blank before it, and the end.

    Null and empty texts are a lone end; a null doc_id counts as the text ''. Equal rows each count and score. Without
    training rows all counts are 0 and the pieces keep their start weights. The most_common words, a bounded table, go to
    all tasks; the others of each document are joined with the vocabulary.
    """
    spark = documents.sparkSession
    whole_ids(documents, "doc_id")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc % folds == held).alias("held_out"))
    words = docs.select("text", (~F.col("held_out")).alias("learn")).mapInArrow(W.tidy(_counts), "word string, c long, n long")
    counted = written(words.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "word-counts")
    ends = docs.where("NOT held_out").count()
    total, kinds = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    total, kinds = int(total) + ends, int(kinds) + (ends > 0)
    pieces, log_p = train_pieces(counted, ends, model_file, rounds)
    sent = spark.sparkContext.broadcast((pieces, log_p[:-1]))
    vocabulary = written(counted.mapInArrow(_marginal(sent), "word long, c long, n long, log double"), "vocabulary")

    under = float(np.log10(total + 0.5 * (kinds + 1)))
    spread = vocabulary.groupBy("n").count().orderBy(F.desc("n")).limit(most_common).toPandas()
    fit = spread[spread["count"].cumsum() <= most_common]
    least = int(fit["n"].min()) if len(fit) else None
    common = vocabulary.where(F.col("n") >= least).toPandas() if least is not None else vocabulary.limit(0).toPandas()
    common = common.assign(key=common["word"].to_numpy(np.int64).view(np.uint64)).sort_values("key").drop_duplicates("key")
    c = common["c"].to_numpy(np.float64)
    table = spark.sparkContext.broadcast((common["key"].to_numpy(np.uint64), np.log10(c + 0.5) - under, common["log"].to_numpy(np.float64), (c > 0).astype(float)))
    end = (float(np.log10(ends + 0.5)) - under, float(log_p[-1] / np.log(10)), ends > 0)

    rows = docs.mapInArrow(_score(table, end), _ROWS)
    rest = vocabulary if least is None else vocabulary.where(F.col("n") < least)
    rest = rest.select("word", F.lit(0).alias("kind"), F.col("c").alias("_c"), F.col("log").alias("_log"))
    joined = rows.join(rest, ["word", "kind"], "left")
    per = joined.select(
        "own", "doc_id", "held_out", "n_tokens", F.when(F.col("kind") == 1, F.col("n_known")).otherwise(F.when(F.col("_c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.when(F.col("kind") == 1, F.col("base")).otherwise(F.col("tf") * (F.log10(F.coalesce("_c", F.lit(0)) + 0.5) - under)).alias("base"),
        F.when(F.col("kind") == 1, F.col("log")).otherwise(F.col("tf") * F.col("_log")).alias("log"),
    )
    out = per.groupBy("own").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("log").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
