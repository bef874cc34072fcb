"""Toxicity: a linear-chain conditional random field over words, whose marginals make document scores and spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordkit as W
from .labelled import calibrate, chance, sampled, taught
from .store import free, written

SHAPES, AFFIXES = 32, 64
LOOKS = 2 * (SHAPES + AFFIXES)  # of words of the lexicon, and of those beside them
RUN = 64  # words of a run that the field is fitted to


@dataclass
class Weights:
    """own: evidence for toxic of each lexicon word; looks: of a word's shape and last letters; shared: of any word, per
    unit of log odds, of standing before a lexicon word, and after one; step[a, b]: of state b after state a."""

    own: np.ndarray
    looks: np.ndarray
    shared: np.ndarray
    step: np.ndarray

    @staticmethod
    def start(words: int) -> Weights:
        return Weights(np.zeros(words), np.zeros(LOOKS), np.array([-3.0, 1.0, 0.0, 0.0]), np.array([[0.0, -1.0], [0.0, -1.0]]))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.own, self.looks, self.shared, self.step

    def evidence(self, odds: np.ndarray, k: np.ndarray, before: np.ndarray, after: np.ndarray, shape: np.ndarray | int, affix: np.ndarray | int) -> np.ndarray:
        """Of words that are in the lexicon (k >= 0) or beside one; any other word has shared[0] alone."""
        at = np.maximum(k, 0)
        lex = np.where(k >= 0, self.own[at] + self.shared[1] * odds[at], 0.0) if len(odds) else 0.0
        return self.shared[0] + lex + self.shared[2] * before + self.shared[3] * after + self.looks[shape] + self.looks[affix]


@dataclass
class Field:
    """Two states, clean and toxic. Words of the lexicon, and those beside them, have their own evidence for toxic; all
    others share one. Texts begin after a clean word."""

    words: W.Found
    odds: np.ndarray
    own: np.ndarray
    shared: np.ndarray
    step: np.ndarray
    curve: tuple[float, float]
    looks: np.ndarray = field(default_factory=lambda: np.zeros(LOOKS))

    def evidence(self, k: np.ndarray, before: np.ndarray, after: np.ndarray, shape: np.ndarray | int = 0, affix: np.ndarray | int = 0) -> np.ndarray:
        return Weights(self.own, self.looks, self.shared, self.step).evidence(self.odds, k, before, after, shape, affix)

    def marginals(self, doc: np.ndarray, place: np.ndarray, evidence: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The chance of toxic at the given places of texts of so many words, by forward and backward recursions.

        All other words have the shared evidence, so runs of them are powers of one matrix, taken from its eigenvalues.
        Texts go side by side, one place of each at a time; vectors are kept at unit sum.
        """
        step = np.exp(self.step)
        plain = step * np.array([1.0, np.exp(self.shared[0])])
        value, right = np.linalg.eig(plain)
        value, right = value.real, right.real
        left = np.linalg.inv(right)
        first = int(np.argmax(value))
        lead, rest = np.outer(right[:, first], left[first]), np.outer(right[:, 1 - first], left[1 - first])
        power = lambda g: lead + (value[1 - first] / value[first]) ** g[:, None, None] * rest
        n = np.bincount(doc, minlength=len(size))
        at = np.concatenate([[0], np.cumsum(n)])
        rank = np.arange(len(doc)) - at[doc]
        gap = place - np.concatenate([[0], place[:-1] + 1]) if len(place) else place
        gap = np.where(rank == 0, place, gap)
        move = power(gap) @ (step[None] * np.stack([np.ones(len(doc)), np.exp(np.minimum(evidence, 50.0))], axis=1)[:, None, :])
        ahead, back = np.zeros((len(doc), 2)), np.zeros((len(doc), 2))
        order = np.argsort(rank, kind="stable")
        edges = np.searchsorted(rank[order], np.arange(int(n.max(initial=0)) + 1))
        rounds = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for r, i in enumerate(rounds):
            start = np.tile([1.0, 0.0], (len(i), 1)) if r == 0 else ahead[i - 1]
            v = np.einsum("nj,njk->nk", start, move[i])
            ahead[i] = v / v.sum(axis=1, keepdims=True)
        last = at[1:][n > 0] - 1
        tail = size[doc[last]] - 1 - place[last] if len(last) else np.zeros(0, np.int64)
        back[last] = power(tail).sum(axis=2)
        for i in reversed(rounds[1:]):
            v = np.einsum("njk,nk->nj", move[i], back[i])
            back[i - 1] = v / v.sum(axis=1, keepdims=True)
        both = np.maximum(ahead * back, 0)
        return both[:, 1] / np.maximum(both.sum(axis=1), 1e-300)


_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)


def _looks(w: W.Words, at: np.ndarray, lexical: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the shape (capitals, digits, length) and of the last two bytes of words, apart for lexicon words."""
    s, e = w.start[at], w.end[at]
    size, last = e - s, np.maximum(e - 1, 0)
    flags = (_UPPER[w.data[s]], _UPPER[w.data[last]], _DIGIT[w.data[last]]) if len(at) else (np.zeros(0, bool),) * 3
    shape = sum(f.astype(np.int64) << i for i, f in enumerate(flags)) * 4 + np.minimum(size // 4, 3)
    two = W._LOWER[w.data[last]].astype(np.int64) * 31 + W._LOWER[w.data[np.maximum(last - 1, s)]] if len(at) else np.zeros(0, np.int64)
    base = np.where(lexical, 0, SHAPES + AFFIXES)
    return base + shape, base + SHAPES + two % AFFIXES


def _places(w: W.Words, h: np.ndarray, words: W.Found) -> tuple[np.ndarray, ...]:
    """Lexicon words and the words beside them: positions, lexicon index or -1, whether one stands after, before, and
    the codes of their looks."""
    k = np.full(len(h), -1, np.int64)
    at, which = words.where(h)
    k[at] = which
    hit = k >= 0
    owner = w.owner()
    nxt, prv = np.zeros(len(h), bool), np.zeros(len(h), bool)
    nxt[:-1] = hit[1:] & (owner[1:] == owner[:-1])
    prv[1:] = hit[:-1] & (owner[1:] == owner[:-1])
    place = np.flatnonzero(hit | nxt | prv)
    return place, k[place], nxt[place], prv[place], *_looks(w, place, hit[place])


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of texts, each with its text's kind: the least hash of its word pairs, which near copies share."""
    for b in batches:
        texts = W.column(b, "text")
        for lo, hi in W.slices(texts):
            w = W.words(texts, lo, hi, W.ALNUM_WORDS)
            h, count = w.hashes(), np.diff(w.first)
            pair, ok = W.grams(h, w.first, 2)
            pair[~ok] = np.uint64(2**64 - 1)
            kind = np.zeros(hi - lo, np.uint64)
            kind[count > 0] = np.minimum.reduceat(pair, w.first[:-1][count > 0]) if len(h) else 0
            one = np.flatnonzero(count == 1)
            kind[one] = h[w.first[one]]
            both = np.unique(np.stack([h, kind[w.owner()]], axis=1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i]).view(np.int64)) for i in (0, 1)], ["word", "kind"])


def _texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a run of texts, and how many of the texts have them; the word 0 counts the texts."""
    for b in batches:
        texts = W.column(b, "text")
        for lo, hi in W.slices(texts):
            w = W.words(texts, lo, hi, W.ALNUM_WORDS)
            once = np.unique(np.stack([w.hashes(), w.owner().astype(np.uint64)], axis=1), axis=0)[:, 0] if len(w.start) else np.zeros(0, np.uint64)
            word, n = np.unique(once, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(W.signed(word), 0)), pa.array(np.append(n, hi - lo).astype(np.int64))], ["word", "n"])


def _lexicon(bad: DataFrame, good: DataFrame, least: int, strength: float) -> tuple[W.Found, np.ndarray]:
    """Words toxic enough, and their log odds. Counts of all words are joined in tasks; only what is kept comes here."""
    kinds = written(bad.select("text").mapInArrow(W.tidy(_kinds), "word long, kind long").distinct(), "toxic-kinds")
    total = kinds.select("kind").distinct().count()
    own = kinds.groupBy("word").agg(F.count("*").alias("t"))
    seen = good.select("text").mapInArrow(W.tidy(_texts_with), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    seen = written(seen, "toxic-clean")
    clean = seen.where("word = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # both counts with a margin for chance: what is toxic for sure, against what is clean at most
    sure, most = F.col("t") - 1.25 * F.sqrt("t"), F.coalesce(F.col("n") + 2 * F.sqrt("n"), F.lit(0.0))
    odds = F.log((sure + 0.5) / (total + 1)) - F.log((most + 0.5) / (clean + 1))
    found = own.where(F.col("t") >= least).join(seen, "word", "left").select("word", odds.alias("odds")).where(F.col("odds") >= strength).toArrow()
    keys = found["word"].to_numpy().view(np.uint64)
    return W.Found(keys), found["odds"].to_numpy()[np.argsort(keys)]


def _runs(sent) -> Callable:
    """Runs of words of texts with what the field sees of them: those with a lexicon word, and each text's first. key
    orders them as if by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: W.Found = sent.value
        for b in batches:
            texts, y = W.column(b, "text"), np.asarray(b.column(b.schema.get_field_index("y")))
            for lo, hi in W.slices(texts):
                w = W.words(texts, lo, hi, W.ALNUM_WORDS)
                h = w.hashes()
                place, *seen = _places(w, h, words)
                see = np.zeros((5, len(h)), np.int32)
                see[0] = -1
                for i, v in enumerate(seen):
                    see[i, place] = v
                n = -(-np.diff(w.first) // RUN)
                owner = np.repeat(np.arange(hi - lo), n)
                start = w.first[owner] + RUN * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
                end = np.minimum(start + RUN, w.first[owner + 1])
                hits = np.concatenate([[0], np.cumsum(see[0] >= 0)])
                keep = (hits[end] > hits[start]) | (start == w.first[owner])
                owner, start, end = owner[keep], start[keep], end[keep]
                key = W.mixed(h[start] ^ W.mixed(h[end - 1] + np.uint64(3)) ^ (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
                cell = np.repeat(start, end - start) + np.arange((end - start).sum()) - np.repeat(np.cumsum(end - start) - (end - start), end - start)
                at = pa.array(np.concatenate([[0], np.cumsum(end - start)]), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(v[cell], pa.int32())) for v in see]
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(key)), pa.array(y[lo + owner], pa.int32()), *lists], ["key", "y", "k", "before", "after", "shape", "affix"])

    return W.tidy(run)


@dataclass
class Runs:
    """Runs of words side by side, padded: what the field sees of each word, which words are there, and their tags."""

    k: np.ndarray
    before: np.ndarray
    after: np.ndarray
    shape: np.ndarray
    affix: np.ndarray
    live: np.ndarray
    tag: np.ndarray

    def some(self, lo: int, hi: int) -> Runs:
        return Runs(*[v[lo:hi] for v in vars(self).values()])

    @staticmethod
    def of(lists: dict[str, list], y: np.ndarray) -> Runs:
        """A word is tagged toxic if it is in the lexicon and its text is labelled toxic."""
        n, m = len(y), max(map(len, lists["k"]), default=0)
        live = np.zeros((n, m), bool)
        out = {c: np.full((n, m), -1 if c == "k" else 0, np.int32) for c in lists}
        for c, rows in lists.items():
            for i, v in enumerate(rows):
                out[c][i, : len(v)] = v
                live[i, : len(v)] = True
        return Runs(**out, live=live, tag=((out["k"] >= 0) & (y[:, None] == 1)).astype(np.int8))


def likelihood(runs: Runs, odds: np.ndarray, w: Weights) -> tuple[float, tuple[np.ndarray, ...]]:
    """The log likelihood of the tags of runs given their words, and its gradient by each part of the weights. Expected
    tags and transitions come from the forward-backward recursions."""
    n, m = runs.k.shape
    seen = (runs.k >= 0) | (runs.before > 0) | (runs.after > 0)
    e = np.clip(np.where(seen, w.evidence(odds, runs.k, runs.before, runs.after, runs.shape, runs.affix), w.shared[0]), -40, 40)
    emit = np.stack([np.ones((n, m)), np.exp(e)], axis=2)
    trans = np.exp(w.step)
    ahead, back = np.zeros((m, n, 2)), np.ones((m, n, 2))
    v, log_z = np.tile([1.0, 0.0], (n, 1)), 0.0
    for j in range(m):
        new = (v @ trans) * emit[:, j]
        total = new.sum(axis=1, keepdims=True)
        log_z += float(np.log(total[runs.live[:, j]]).sum())
        v = np.where(runs.live[:, j, None], new / total, v)
        ahead[j] = v
    u = np.ones((n, 2))
    for j in range(m - 1, -1, -1):
        back[j] = u
        new = (emit[:, j] * u) @ trans.T
        u = np.where(runs.live[:, j, None], new / new.sum(axis=1, keepdims=True), u)
    post = ahead * back
    post /= post.sum(axis=2, keepdims=True)
    p = post[:, :, 1].T * runs.live
    previous = np.concatenate([np.tile([1.0, 0.0], (1, n, 1)), ahead[:-1]])
    pair = previous[:, :, :, None] * trans[None, None] * (emit.transpose(1, 0, 2) * back)[:, :, None, :]
    pair /= np.maximum(pair.sum(axis=(2, 3), keepdims=True), 1e-300)
    expected = (pair * runs.live.T[:, :, None, None]).sum(axis=(0, 1))
    last = np.concatenate([np.zeros((n, 1), np.int8), runs.tag[:, :-1]], axis=1)
    steps = np.array([[((last == a) & (runs.tag == b) & runs.live).sum() for b in (0, 1)] for a in (0, 1)], float)
    d = (runs.tag - p) * runs.live
    hit = runs.k >= 0
    scale = odds[runs.k[hit]] if len(odds) else np.zeros(0)
    looks = np.bincount(runs.shape[seen], d[seen], LOOKS) + np.bincount(runs.affix[seen], d[seen], LOOKS)
    own = np.bincount(runs.k[hit], d[hit], len(odds)) if len(odds) else np.zeros(0)
    shared = np.array([d.sum(), (d[hit] * scale).sum(), (d * runs.before).sum(), (d * runs.after).sum()])
    return float((e * runs.tag * runs.live).sum() + (steps * w.step).sum() - log_z), (own, looks, shared, steps - expected)


def train(runs: Runs, odds: np.ndarray, rounds: int = 80, rate: float = 0.2, ridge: float = 1e-2, together: int = 1000) -> Weights:
    """Fits the field to tagged words by gradient steps on the conditional likelihood, with Adam's step sizes. Gradients
    are sums over blocks of runs, so no more than a block's tables are held."""
    w, n = Weights.start(len(odds)), len(runs.tag)
    if not n or not len(odds):
        return w
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in w.parts()]
    for t in range(1, rounds + 1):
        grads = [np.zeros_like(x) for x in w.parts()]
        for lo in range(0, n, together):
            for total, g in zip(grads, likelihood(runs.some(lo, lo + together), odds, w)[1], strict=True):
                total += g
        for x, g, (a, b) in zip(w.parts(), grads, state, strict=True):
            g = g / n - ridge * x
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            x += rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, least: int = 4, strength: float = 2.5, most_rows: int = 6000, most_runs: int = 8000) -> Field:
    """A field from the labelled rows outside the held-out fold.

    The lexicon comes from all of them: words that at least `least` kinds of toxic texts have (near copies are mostly one
    kind), at a share of kinds e^strength times the share of clean texts that have them; all such words, however rare.
    The field is fitted to at most most_runs runs of words from most_rows texts of either kind, and the curve to the
    document sums of most_rows (documented bounds). No toxic labels: an empty lexicon and a flat curve.
    """
    spark = docs.sparkSession
    rows = written(taught(docs, labels, "toxic", folds, held), "toxic-taught")
    bad, good = rows.where("y = 1"), rows.where("y = 0")
    words, odds = _lexicon(bad, good, least, strength)
    sent = spark.sparkContext.broadcast(words)
    both = sampled(bad, most_rows // 2, 23).unionByName(sampled(good, most_rows // 2, 23))
    kind = "key long, y int, k array<int>, before array<int>, after array<int>, shape array<int>, affix array<int>"
    runs = both.select("text", "y").mapInArrow(_runs(sent), kind).orderBy("key", "y", "k").limit(most_runs).toArrow()
    lists = {c: runs[c].to_pylist() for c in ("k", "before", "after", "shape", "affix")}
    weights = train(Runs.of(lists, np.asarray(runs["y"])), odds)
    del runs, lists
    W.give_back()
    found = Field(words, odds, weights.own, weights.shared, weights.step, (1.0, 0.0), weights.looks)
    tried = spark.sparkContext.broadcast(found)
    sums = sampled(rows, most_rows, 29).mapInArrow(_sums(tried), "h long, y int, margin double").toPandas().sort_values("h")
    for x in (sent, tried):
        x.unpersist()
    return replace(found, curve=calibrate(sums["margin"].to_numpy(float), sums["y"].to_numpy(np.int64)))


def _margins(texts: pa.Array, field: Field, lo: int, hi: int) -> tuple:
    """Document sums of a run of texts, and the words, places and chances they come from."""
    w = W.words(texts, lo, hi, W.ALNUM_WORDS)
    place, *seen = _places(w, w.hashes(), field.words)
    doc = np.searchsorted(w.first, place, "right") - 1
    p = field.marginals(doc, place - w.first[doc], field.evidence(*seen), np.diff(w.first))
    clean = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 0.999)), hi - lo))
    return np.log(1 - clean + 1e-3) - np.log(clean + 1e-3), w, place, doc, p


def _sums(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = W.column(b, "text")
            total = np.concatenate([np.zeros(0), *[_margins(texts, sent.value, lo, hi)[0] for lo, hi in W.slices(texts)]])
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in ("h", "y")], pa.array(total)], ["h", "y", "margin"])

    return W.tidy(run)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))


def _tag(sent, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = sent.value
        for b in batches:
            texts, sums, spans = W.column(b, "text"), [np.zeros(0)], []
            for lo, hi in W.slices(texts):
                margin, w, place, doc, p = _margins(texts, field, lo, hi)
                sums.append(margin)
                chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
                own: list[list[dict]] = [[] for _ in range(hi - lo)]
                for i in np.flatnonzero(p >= 0.5):
                    zero = chars[w.base[doc[i]]]
                    own[doc[i]].append({"start": int(chars[w.start[place[i]]] - zero), "end": int(chars[w.end[place[i]]] - zero), "chance": float(p[i])})
                spans += own
            score = pa.array(chance(np.concatenate(sums), field.curve), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, score, pa.array(spans, _SPANS)], [*b.schema.names, *names])

    return W.tidy(run)


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """Adds score, the chance that a document is toxic, and spans: code point offsets of its toxic words with their
    chances (columns so named are replaced; others may have any names). A score comes from the chance that any word is
    toxic, its marginals taken as independent. Only text is looked at; null and empty texts have no spans and the lowest
    score; equal texts get equal results; a text may have any length; no rows, no rows."""
    rows = docs.drop("score", "spans")
    names = free(rows.columns, "score", "spans")
    sent = docs.sparkSession.sparkContext.broadcast(field)
    new = T.StructType.fromDDL(f"`{names[0]}` double, `{names[1]}` array<struct<start:long,end:long,chance:double>>")
    return rows.mapInArrow(_tag(sent, names), T.StructType([*rows.schema.fields, *new.fields]))
