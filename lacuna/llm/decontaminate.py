"""Benchmark decontamination: an exact containment join of item-sized word windows, by their rarest shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordkit as W
from .store import free, whole_ids, written

SHINGLE = 3


def _windows(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = W.column(b, "text"), b.column(b.schema.get_field_index("item_id")).to_pylist()
            for lo, hi in W.slices(texts):
                w = W.words(texts, lo, hi, W.ALNUM_WORDS)
                low = W._LOWER[w.data].tobytes()
                out_id, out = [], []
                for i in range(hi - lo):
                    own = [low[s:e].decode() for s, e in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
                    for j in range(max(len(own) - size + 1, min(len(own), 1))):
                        out.append(" ".join(own[j : j + size]))
                        out_id.append(ids[lo + i])
                yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out, pa.string())], ["item_id", "norm"])

    return W.tidy(run)


class _Block:
    """Some windows of the benchmark, with the word hashes that find and check them."""

    def __init__(self, norms: list[str], items: list[list[int]]):
        texts = pa.array(norms, pa.string())
        w = W.words(texts, 0, len(norms), W.ALNUM_WORDS)
        h = w.hashes()
        self.norms, self.items = [x.encode() for x in norms], items
        self.size = np.diff(w.first)
        self.words = np.zeros((len(norms), int(self.size.max(initial=1))), np.uint64)
        owner = w.owner()
        self.words[owner, np.arange(len(h)) - w.first[owner]] = h
        self.grams: dict[int, np.ndarray] = {}
        for g in range(1, SHINGLE + 1):  # a window of fewer words is one shingle itself
            rows = np.flatnonzero(self.size >= g) if g == SHINGLE else np.flatnonzero(self.size == g)
            if len(rows):
                v, ok = W.grams(h, w.first, g)
                pick = np.isin(owner, rows) & ok
                self.grams[g] = np.stack([owner[pick], np.flatnonzero(pick) - w.first[owner[pick]], v[pick].view(np.int64)], axis=1)

    def shingles(self) -> dict[int, W.Found]:
        return {g: W.Found(a[:, 2].view(np.uint64)) for g, a in self.grams.items()}

    def keep_rarest(self, sets: dict[int, W.Found], counts: dict[int, np.ndarray]) -> None:
        """Orders the shingles of each window by rarity in the corpus and keeps the necessary prefix: for containment of
        the whole window that is its rarest shingle. A window with a shingle that no document has is dropped."""
        self.anchors: dict[int, tuple[W.Found, np.ndarray, np.ndarray, np.ndarray]] = {}
        for g, a in self.grams.items():
            key = np.searchsorted(sets[g].keys, a[:, 2].view(np.uint64))
            count = counts[g][key]
            order = np.lexsort((a[:, 1], key, count, a[:, 0]))
            first = order[np.unique(a[order, 0], return_index=True)[1]]
            first = first[count[first] > 0]
            first = first[np.argsort(a[first, 2].view(np.uint64), kind="stable")]
            found = W.Found(a[first, 2].view(np.uint64))
            span = np.searchsorted(a[first, 2].view(np.uint64), found.keys)
            self.anchors[g] = (found, np.append(span, len(first)), a[first, 0].astype(np.int64), a[first, 1].astype(np.int64))

    def hits(self, w: W.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions at which windows begin, and which ones."""
        starts, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        owner_end = np.repeat(w.first[1:], np.diff(w.first))
        owner_start = np.repeat(w.first[:-1], np.diff(w.first))
        for g, (found, span, window, offset) in self.anchors.items():
            v, ok = W.grams(h, w.first, g)
            at, k = found.where(v)
            k, at = k[ok[at]], at[ok[at]]
            n = span[k + 1] - span[k]
            row = np.repeat(span[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, win = np.repeat(at, n), window[row]
            begin = at - offset[row]
            near = (begin >= owner_start[at]) & (begin + self.size[win] <= owner_end[at])  # positional and length bounds
            begin, win = begin[near], win[near]
            for j in range(self.words.shape[1]):
                same = (j >= self.size[win]) | (h[np.minimum(begin + j, len(h) - 1)] == self.words[win, j])
                begin, win = begin[same], win[same]
            starts.append(begin)
            which.append(win)
        begin, win = np.concatenate(starts), np.concatenate(which)
        if len(begin):
            low = W._LOWER[w.data].tobytes()
            true = [b" ".join([low[w.start[i] : w.end[i]] for i in range(b, b + self.size[x])]) == self.norms[x] for b, x in zip(begin.tolist(), win.tolist(), strict=True)]
            begin, win = begin[true], win[true]
        return begin, win


def _count(sets) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {g: np.zeros(len(s.keys), np.int64) for g, s in sets.value.items()}
        for b in batches:
            texts = W.column(b, "text")
            for lo, hi in W.slices(texts):
                w = W.words(texts, lo, hi, W.ALNUM_WORDS)
                h = w.hashes()
                for g, s in sets.value.items():
                    v, ok = W.grams(h, w.first, g)
                    at, k = s.where(v)
                    total[g] += np.bincount(k[ok[at]], minlength=len(s.keys))
        for g, n in total.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), g), pa.int32()), pa.array(k, pa.int64()), pa.array(n[k], pa.int64())], ["g", "k", "n"])

    return W.tidy(run)


def _mark(block, names: list[str]) -> Callable:
    hit_, items_, words_, hits_ = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = W.column(b, "text")
            old_hit, old_items = (b.column(b.schema.get_field_index(c)) for c in (hit_, items_))
            n_words, n_hit, hit, items = [], [], [], []
            for lo, hi in W.slices(texts):
                w = W.words(texts, lo, hi, W.ALNUM_WORDS)
                h = w.hashes()
                begin, win = block.value.hits(w, h)
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + block.value.size[win], -1)
                covered = np.cumsum(edge[:-1]) > 0
                n_words.append(np.diff(w.first))
                doc = np.searchsorted(w.first, begin, "right") - 1
                found: dict[int, set[int]] = {}
                for d, x in zip(doc.tolist(), win.tolist(), strict=True):
                    found.setdefault(d, set()).update(block.value.items[x])
                before = {i: np.unpackbits(np.frombuffer(v.as_py(), np.uint8)) for i in range(hi - lo) if (v := old_hit[lo + i]).is_valid}
                for i in sorted(found.keys() | before.keys()):
                    own = covered[w.first[i] : w.first[i + 1]]
                    if i in before:
                        own |= before[i][: len(own)].astype(bool)
                        found.setdefault(i, set()).update(old_items[lo + i].as_py())
                total = np.concatenate([[0], np.cumsum(covered)])
                n_hit.append(total[w.first[1:]] - total[w.first[:-1]])
                hit += [np.packbits(covered[w.first[i] : w.first[i + 1]]).tobytes() if i in found else None for i in range(hi - lo)]
                items += [sorted(found[i]) if i in found else None for i in range(hi - lo)]
            new = {
                hit_: pa.array(hit, pa.binary()), items_: pa.array(items, pa.list_(pa.int64())),
                words_: pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), hits_: pa.array(np.concatenate(n_hit) if n_hit else [], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([new.get(f.name, b.column(i)) for i, f in enumerate(b.schema)], b.schema.names)

    return W.tidy(run)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_windows: int = 200_000) -> DataFrame:
    """Adds n_words, n_hit, n_items, items, items_sha256 and contaminated to docs (columns so named are replaced; others
    may have any names).

    docs has text, benchmark a whole item_id and text. Words are runs of letters, digits and non-ASCII characters, A-Z as
    a-z. A window is `window` consecutive words of an item, or a whole shorter item; items without words have none. A
    document word inside an occurrence of a window is hit; a document is contaminated if share * n_hit >= n_words, n_hit > 0.
    Null and empty texts have no words; a text may have any length; equal rows get equal results; items that share an id
    are one item; no benchmark, no hits; no documents, no rows.

    The windows, a stated set, go to the tasks in blocks of at most block_windows; each block marks words in place, so a
    larger benchmark takes more rounds and no shuffle of the texts.
    """
    spark = docs.sparkSession
    whole_ids(benchmark, "item_id")
    new = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]
    rows = docs.drop(*new)
    names = free([*rows.columns, *new], "hit", "found", "words", "hits")
    hit, found, n_words, n_hit = names
    windows = written(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_windows(window), "item_id long, norm string"), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    state = rows.withColumns({hit: F.lit(None).cast("binary"), found: F.lit(None).cast("array<long>"), n_words: F.lit(0).cast("long"), n_hit: F.lit(0).cast("long")})
    for n in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("norm"), F.lit(blocks)) == n).groupBy("norm").agg(F.sort_array(F.collect_set("item_id")).alias("items")).toArrow()
        block = _Block(own["norm"].to_pylist(), own["items"].to_pylist())
        sets = block.shingles()
        sent = spark.sparkContext.broadcast(sets)
        seen = rows.select("text").mapInArrow(_count(sent), "g int, k long, n long").groupBy("g", "k").agg(F.sum("n").alias("n")).toArrow()
        sent.unpersist()
        g, k, count = (np.asarray(seen[c]) for c in ("g", "k", "n"))
        counts = {x: np.zeros(len(s.keys), np.int64) for x, s in sets.items()}
        for x, c in counts.items():
            c[k[g == x]] = count[g == x]
        block.keep_rarest(sets, counts)
        block.grams = {}
        if n:
            state = written(state, "marked")
        state = state.mapInArrow(_mark(spark.sparkContext.broadcast(block), names), state.schema)
    items = F.coalesce(F.col(found), F.array().cast("array<long>"))
    listed = F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",")
    return state.select(
        *rows.columns, F.col(n_words).alias("n_words"), F.col(n_hit).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
        F.sha2(listed, 256).alias("items_sha256"), ((F.col(n_hit) > 0) & (F.col(n_hit) * share >= F.col(n_words))).alias("contaminated"),
    )
