"""Token files: documents as ids, each shard a wavelet matrix with rank and select over compressed bit-planes."""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordkit as W
from .store import running, tasks_for, whole_ids

BLOCK = 1 << 16  # bits of a plane that are compressed, and counted, together
_MAGIC = b"WVM1"
_POP = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8)


def encode_matrix(tokens: np.ndarray) -> bytes:
    """A wavelet matrix of ids as one blob: a header, the alphabet, then each plane's blocks.

    Ids become ranks by frequency, so the upper planes hold few ones and compress well; plane 0 is the top bit. Each
    block stands alone, raw or compressed, with its place and the ones before it in the header.
    """
    counts = np.bincount(tokens) if len(tokens) else np.zeros(0, np.int64)
    alphabet = np.flatnonzero(counts)
    order = np.argsort(-counts[alphabet], kind="stable")
    wide = np.uint16 if len(order) <= 1 << 16 else np.uint32
    rank = np.zeros(len(counts), wide)
    rank[alphabet[order]] = np.arange(len(order))
    x = rank[tokens]
    planes = max(1, int(len(order) - 1).bit_length()) if len(order) else 0
    squeeze = zstandard.ZstdCompressor(level=1)
    body, zeros, table = [], [], []
    for level in range(planes - 1, -1, -1):
        bit = (x >> wide(level)) & wide(1)
        one = bit.astype(bool)
        packed = np.packbits(one)
        ones = np.add.reduceat(_POP[packed], np.arange(0, len(packed), BLOCK // 8), dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(ones)[:-1]])
        for b, o in enumerate(before):
            part = packed[b * BLOCK // 8 : (b + 1) * BLOCK // 8].tobytes()
            small = squeeze.compress(part)
            small, kind = (small, 1) if len(small) < len(part) else (part, 0)
            body.append(small)
            table.append((int(o), len(small), kind))
        zeros.append(len(one) - int(ones.sum()))
        below = np.empty_like(x)
        below[: zeros[-1]], below[zeros[-1] :] = x[~one], x[one]
        x = below
    head = zstandard.compress(json.dumps({"n": len(tokens), "planes": planes, "zeros": zeros}).encode())
    index = zstandard.compress(np.array(table, np.int64).tobytes())
    letters = zstandard.compress(alphabet[order].astype(np.uint32).tobytes())
    return _MAGIC + struct.pack("<III", len(head), len(index), len(letters)) + head + index + letters + b"".join(body)


class WaveletMatrix:
    """Reads encode_matrix's blob; access, rank and select open only the blocks they touch."""

    def __init__(self, blob: bytes):
        if blob[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        a, b, c = struct.unpack("<III", blob[4:16])
        head = json.loads(zstandard.decompress(blob[16 : 16 + a]))
        self.n, self.planes, self.zeros = head["n"], head["planes"], head["zeros"]
        table = np.frombuffer(zstandard.decompress(blob[16 + a : 16 + a + b]), np.int64).reshape(-1, 3)
        self.alphabet = np.frombuffer(zstandard.decompress(blob[16 + a + b : 16 + a + b + c]), np.uint32)
        self._code: dict[int, int] | None = None
        self.blocks = -(-self.n // BLOCK)
        self.before, self.kind = table[:, 0], table[:, 2]
        self.at = 16 + a + b + c + np.concatenate([[0], np.cumsum(table[:, 1])])
        self.blob, self.open_ = blob, {}

    @property
    def code(self) -> dict[int, int]:
        if self._code is None:
            self._code = {int(t): i for i, t in enumerate(self.alphabet)}
        return self._code

    def _part(self, plane: int, block: int) -> np.ndarray:
        k = plane * self.blocks + block
        part = self.blob[self.at[k] : self.at[k + 1]]
        return np.frombuffer(zstandard.decompress(part, BLOCK) if self.kind[k] else part, np.uint8)

    def _open(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bytes, and how many ones stand before each."""
        k = plane * self.blocks + block
        if k not in self.open_:
            part = self._part(plane, block)
            if len(self.open_) > 256:
                self.open_.clear()
            self.open_[k] = part, np.concatenate([[0], np.cumsum(_POP[part], dtype=np.int32)])
        return self.open_[k]

    def _bits(self, plane: int, block: int) -> np.ndarray:
        return np.unpackbits(self._part(plane, block))[: min(BLOCK, self.n - block * BLOCK)]

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before position i: the block's count, its bytes' and the rest of one byte."""
        if i <= 0:
            return 0
        block, at = divmod(i, BLOCK)
        if at == 0:
            block, at = block - 1, BLOCK
        part, before = self._open(plane, block)
        rest = int(_POP[part[at >> 3] >> (8 - (at & 7))]) if at & 7 else 0
        return int(self.before[plane * self.blocks + block]) + int(before[at >> 3]) + rest

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for p in range(self.planes):
            at = i % BLOCK
            bit = int(self._open(p, i // BLOCK)[0][at >> 3]) >> (7 - (at & 7)) & 1
            ones = self._ones(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            code = code * 2 + bit
        return int(self.alphabet[code])

    def rank(self, token: int, i: int) -> int:
        """How often the token stands before position i."""
        code = self.code.get(token)
        if code is None:
            return 0
        lo, hi = 0, min(max(i, 0), self.n)
        for p in range(self.planes):
            a, b = self._ones(p, lo), self._ones(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if code >> (self.planes - 1 - p) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Where the token stands for the k-th time (from 0); -1 if it doesn't."""
        found = self.locate(token, k, k + 1) if k >= 0 else []
        return int(found[0]) if len(found) else -1

    def locate(self, token: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Where the token stands, from its start-th time up to before its stop-th: down to its run on the lowest level,
        and up again through the planes."""
        n = self.count(token)
        stop = n if stop is None else min(stop, n)
        if start >= stop:
            return np.zeros(0, np.int64)
        code, lo, path = self.code[token], 0, []
        for p in range(self.planes):
            a = self._ones(p, lo)
            path.append(code >> (self.planes - 1 - p) & 1)
            lo = self.zeros[p] + a if path[-1] else lo - a
        at = lo + np.arange(start, stop)
        for p in range(self.planes - 1, -1, -1):
            at = self._find(p, path[p], at - self.zeros[p] if path[p] else at)
        return at

    def _find(self, plane: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th ones, or zeros, of a plane; k ascends."""
        own = self.before[plane * self.blocks : (plane + 1) * self.blocks]
        seen = own if bit else np.arange(self.blocks) * BLOCK - own
        block = np.searchsorted(seen, k, "right") - 1
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        out = np.empty(len(k), np.int64)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            b = int(block[lo])
            out[lo:hi] = b * BLOCK + np.flatnonzero(self._bits(plane, b) == bit)[k[lo:hi] - int(seen[b])]
        return out

    def decode(self) -> np.ndarray:
        """All tokens, from the lowest plane up."""
        wide = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        x = np.zeros(self.n, wide)
        for p in range(self.planes - 1, -1, -1):
            one = np.concatenate([self._bits(p, b) for b in range(self.blocks)]).astype(bool) if self.blocks else np.zeros(0, bool)
            up = np.empty_like(x)
            up[~one] = x[: self.zeros[p]]
            up[one] = x[self.zeros[p] :] | wide(1 << (self.planes - 1 - p))
            x = up
        return self.alphabet[x] if self.n else np.zeros(0, np.uint32)


_kept: dict[str, tuple] = {}
_end_marks: dict[str, np.ndarray] = {}


class _Known:
    """The ids of words met lately, in arrays: two hashes of each word, where its ids lie, when and how often it was met."""

    def __init__(self, most: int = 400_000):
        self.most, self.turn = most, 0
        self.a, self.b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # a ascends
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.last, self.often = np.zeros(0, np.int32), np.zeros(0, bool)
        self.flat = np.zeros(0, np.uint32)

    def ids(self, words: pa.Array, tokenizer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
        """Ids of distinct words of small letters, as runs of one array: that array, starts and sizes. New words are learned."""
        data, off = W.raw(words)
        own = W.Words(data[off[0] : off[-1]], off[:-1] - off[0], off[1:] - off[0], off, off)
        a, b = own.hashes(), own.hashes(other=True)
        self.turn += 1
        at, size = np.empty(len(a), np.int64), np.empty(len(a), np.int32)
        hit = np.zeros(len(a), bool)
        if len(self.a):
            k = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1)
            hit = (self.a[k] == a) & (self.b[k] == b)
            k = k[hit]
            at[hit], size[hit] = self.at[k], self.size[k]
            self.last[k], self.often[k] = self.turn, True
        new = np.flatnonzero(~hit)
        flat, n = _learned(words.take(pa.array(new)), tokenizer)
        at[new], size[new] = len(self.flat) + np.cumsum(n) - n, n
        flat = np.concatenate([self.flat, flat])
        self.keep(flat, a[new], b[new], at[new], n)
        return flat, at, size

    def keep(self, flat: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Words met more than once stay before others, and later ones before earlier."""
        both = [np.concatenate(x) for x in ((self.a, a), (self.b, b), (self.at, at), (self.size, size), (self.last, np.full(len(a), self.turn, np.int32)), (self.often, np.zeros(len(a), bool)))]
        if len(both[0]) > self.most:
            worth = both[4].astype(np.int64) + (both[5].astype(np.int64) << 32)
            stay = np.argpartition(-worth, self.most // 2)[: self.most // 2]
            both = [x[stay] for x in both]
        order = np.argsort(both[0])
        self.a, self.b, at, self.size, self.last, self.often = (x[order] for x in both)
        self.flat = _gathered(flat, at, self.size, np.arange(len(at)))
        self.at = np.cumsum(self.size, dtype=np.int64) - self.size


def _tokenizer(path: str):  # noqa: ANN202
    """The tokenizer of a file and the ids of words met so far, kept by a Python worker."""
    if path not in _kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        _kept[path] = (Tokenizer.from_file(path), _Known())
    return _kept[path]


def _cut(own: pa.Array, tokenizer) -> tuple[pa.DictionaryArray, np.ndarray, pa.DictionaryArray]:  # noqa: ANN001
    """Distinct words without the marks after their last letter; which words had some; and those.

    The split pattern sees words as the normalizer leaves them, and some letters become a letter and a combining mark,
    which goes with the marks after it; so only words that still end in a letter then are cut.
    """
    bare = pc.ascii_rtrim(own, ".,;:!?")
    had = np.flatnonzero(np.asarray(pc.binary_length(bare)) != np.asarray(pc.binary_length(own)))
    ends = bare.take(pa.array(had))
    good = pc.match_substring_regex(ends, "[A-Za-z]$").to_numpy(zero_copy_only=False).copy()
    other = np.flatnonzero(pc.match_substring_regex(ends, r"[^\x00-\x7F]$").to_numpy(zero_copy_only=False))
    form = tokenizer.normalizer.normalize_str if tokenizer.normalizer is not None else str
    good[other] = [unicodedata.category(form(w)[-1:] or " ")[0] == "L" for w in ends.take(pa.array(other)).to_pylist()]
    had = had[good]
    cut = np.zeros(len(own), bool)
    cut[had] = True
    core = pc.if_else(pa.array(cut), bare, own)
    data, off = W.raw(own)
    stop = off[1:][had]
    size = np.asarray(pc.binary_length(own))[had] - np.asarray(pc.binary_length(core))[had]
    tails = _gathered(data, stop - size, size, np.arange(len(had)))
    ends = pa.StringArray.from_buffers(len(had), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(tails)))
    return core.dictionary_encode(), had, ends.dictionary_encode()


def _pool(own: pa.Array, tokenizer, known: _Known, plain: bool) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """The ids of distinct words, end to end, and their offsets. Marks after a letter that the normalizer leaves as
    a letter are pieces of their own, so they and what stands before them are looked up apart: fewer new words."""
    if plain:
        core, had, tails = _cut(own, tokenizer)
        flat, at, size = known.ids(pa.concat_arrays([core.dictionary, tails.dictionary]), tokenizer)
        many = np.ones(len(own), np.int64)
        many[had] = 2
        first = np.cumsum(many) - many
        parts_of = np.empty(int(many.sum()), np.int64)
        parts_of[first] = np.asarray(core.indices)
        parts_of[first[had] + 1] = len(core.dictionary) + np.asarray(tails.indices)
        first = np.append(first, len(parts_of))
    else:
        flat, size = _learned(own, tokenizer)
        at, parts_of, first = np.cumsum(size) - size, np.arange(len(own)), np.arange(len(own) + 1)
    out = _gathered(flat, at, size, parts_of)
    return out, np.concatenate([[0], np.cumsum(size[parts_of], dtype=np.int64)])[first]


def _learned(words: pa.Array, tokenizer, run: int = 500) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Ids of words, end to end, and how many each has. Where the tokenizer marks a word's last piece, words of letters go
    in runs, and those marks tell them apart; a run whose marks don't add up is done word by word."""
    last = _ends(tokenizer)
    size = np.zeros(len(words), np.int32)
    flats: list[np.ndarray] = []
    order: list[np.ndarray] = []
    alone = np.arange(len(words))
    if last is not None and len(words):
        is_word = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        letters, alone = np.flatnonzero(is_word), [np.flatnonzero(~is_word)]
        cuts = np.append(np.arange(0, len(letters), run), len(letters))
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.take(pa.array(letters))), " ") if len(letters) else []
        for line, lo, hi in zip(lines, cuts[:-1], cuts[1:], strict=True):
            ids = np.array(tokenizer.encode(line.as_py(), add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(last[ids]) + 1
            if len(stop) != hi - lo or stop[-1] != len(ids):
                alone.append(letters[lo:hi])
                continue
            size[letters[lo:hi]] = np.diff(stop, prepend=0)
            flats.append(ids)
            order.append(letters[lo:hi])
        alone = np.concatenate(alone)
    for i in range(0, len(alone), 1000):
        some = alone[i : i + 1000]
        for at, e in zip(some.tolist(), tokenizer.encode_batch_fast(words.take(pa.array(some)).to_pylist(), add_special_tokens=False), strict=True):
            size[at] = len(e.ids)
            flats.append(np.array(e.ids, np.uint32))
        order.append(some)
    if not order:
        return np.zeros(0, np.uint32), size
    by, flat = np.concatenate(order), np.concatenate(flats)
    start = np.empty(len(words), np.int64)
    start[by] = np.cumsum(size[by], dtype=np.int64) - size[by]
    return _gathered(flat, start, size, np.arange(len(words))), size


def _ends(tokenizer) -> np.ndarray | None:  # noqa: ANN001
    """Which ids end a word, if the tokenizer's pieces say so."""
    mark = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not mark:
        return None
    if mark not in _end_marks:
        out = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        for piece, i in tokenizer.get_vocab().items():
            out[i] = piece.endswith(mark)
        _end_marks[mark] = out
    return _end_marks[mark]


def _gathered(flat: np.ndarray, at: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
    """flat's runs at[i], of size[i] values, for each i of index, end to end."""
    n = size[index]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    shift = (at[index] - ends + n).astype(np.int32)
    return flat[np.repeat(shift, n) + np.arange(ends[-1], dtype=np.int32)]


def encode_texts(texts: pa.Array, path: str, end_id: int | None, by_word: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, an end after each, and their n + 1 offsets.

    by_word: the tokenizer lower-cases and never joins text across blanks or letters with marks, so each distinct word
    of a column is encoded once, and those met lately not again. Otherwise whole texts are encoded.
    """
    tokenizer, known = _tokenizer(path)
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if not by_word:
        ids = [e.ids for e in tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(n.sum()))
    else:
        plain = not pc.any(pc.match_substring(texts, "<|")).as_py()  # else a text may spell a special token
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if plain else texts)
        words = split.flatten().dictionary_encode()
        pool, at = _pool(words.dictionary, tokenizer, known, plain)
        index, size = np.asarray(words.indices), np.diff(at)
        flat = _gathered(pool, at, size, index)
        total = np.concatenate([[0], np.cumsum(size[index])])
        n = np.diff(total[np.asarray(split.offsets)])
    if end_id is None:
        return flat, np.concatenate([[0], np.cumsum(n)])
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(first[-1], end_id, np.uint32)
    keep = np.ones(first[-1], bool)
    keep[first[1:] - 1] = False
    out[keep] = flat
    return out, first


def _segments(path: str, end_id: int, most: int, by_word: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, held = TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Array] = []
        tokens: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            n, all_ids, flat = np.concatenate(sizes), pa.concat_arrays(ids), np.concatenate(tokens)
            for held_ in (ids, tokens, sizes):
                held_.clear()
            listed = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            own = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64()), listed(all_ids), listed(pa.array(n)), pa.array([encode_matrix(flat)], pa.binary())]
            return pa.RecordBatch.from_arrays(own, ["shard", "segment", "n_docs", "n_tokens", "doc_ids", "doc_sizes", "matrix"])

        for b in batches:
            texts, doc = W.column(b, "text"), b.column(b.schema.get_field_index("doc_id"))
            for lo, hi in W.slices(texts, 4 << 20):
                flat, first = encode_texts(texts.slice(lo, hi - lo), path, end_id, by_word)
                tokens.append(flat)
                sizes.append(np.diff(first))
                ids.append(doc.slice(lo, hi - lo))
                held += len(flat)
                if held >= most:
                    yield made()
                    number, held = number + 1, 0
        if ids:
            yield made()

    return W.tidy(run)


SCHEMA = "shard int, segment int, n_docs long, n_tokens long, doc_ids array<long>, doc_sizes array<long>, matrix binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, segment_tokens: int = 1_000_000, shard_docs: int = 100_000, by_word: bool = True, most_tied: int = 10_000) -> None:
    """Writes documents as token files: range-partitioned by doc_id (whole numbers), one file a shard, a row a segment.

    There are as many shards as shuffle partitions, or more, so that none has much over shard_docs documents. A segment
    holds whole documents in ascending doc_id order (null first; ties by the text's first 64 characters, then its
    hash), at least segment_tokens ids but for a shard's last, as one wavelet matrix with the documents' ids and sizes
    beside it. Null and empty texts are a lone end; a text may have any length; equal rows are written as often as they
    come; no documents, no segments. Other columns are not read. Where more than most_tied rows share an id, or have
    none, they are dealt over shards by text and place, so they don't fill one.
    """
    whole_ids(docs, "doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    often, total = rows.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards, order = max(tasks_for(docs.sparkSession), -(-total // shard_docs)), ["doc_id"]
    if often > 1:
        order += ["start", "hash"]
        rows = rows.withColumns({"start": F.substring("text", 1, 64), "hash": F.xxhash64("text")})
    if often > most_tied:
        order.append("place")
        rows = rows.withColumn("place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(shards, *(order if "place" in order else order[:1])).sortWithinPartitions(*order).select("doc_id", "text")
    spark, name = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(min(int(old), 1000)) if int(old) > 0 else "1000")  # whole texts: a batch need not hold more
    try:
        dealt.mapInArrow(_segments(tokenizer, end_id, segment_tokens, by_word), SCHEMA).write.parquet(path)
    finally:
        spark.conf.set(name, old)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in range(b.num_rows):
            get = lambda c: b.column(b.schema.get_field_index(c))[row]  # noqa: B023, E731
            sizes = np.asarray(get("doc_sizes").values)
            first = np.concatenate([[0], np.cumsum(sizes)])
            flat = WaveletMatrix(get("matrix").as_py()).decode().astype("<u4")
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, get("shard").as_py()), pa.int32()), pa.array(np.full(n, get("segment").as_py()), pa.int32()), get("doc_ids").values, pa.array(first[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                ["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def _starts(files: DataFrame) -> DataFrame:
    """How many ids stand before each segment."""
    return running(files.select("shard", "segment", "n_tokens"), ["shard", "segment"], {"before": "n_tokens"}, "segment-starts").drop("n_tokens")


def _looked_up(tokens: list[int], places: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                shard, segment, blob = (b.column(b.schema.get_field_index(c))[row].as_py() for c in ("shard", "segment", "matrix"))
                matrix = WaveletMatrix(blob)
                found = [matrix.locate(t) if places else np.array([matrix.count(t)]) for t in tokens]
                size = [len(f) for f in found]
                n = sum(size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard), pa.int32()), pa.array(np.full(n, segment), pa.int32()), pa.array(np.repeat(tokens, size), pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64())], ["shard", "segment", "token", "value"])

    return W.tidy(run)


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token and n: how often each of some tokens stands in the token files, by rank in each segment; none is decoded."""
    files = spark.read.schema(SCHEMA).parquet(path).select("shard", "segment", "matrix")
    found = files.mapInArrow(_looked_up(sorted(set(tokens)), False), "shard int, segment int, token long, value long")
    return found.groupBy("token").agg(F.sum("value").alias("n"))


def find_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token and at: each place, among the ids of all files in order, where one of some tokens stands, by select."""
    files = spark.read.schema(SCHEMA).parquet(path)
    found = files.select("shard", "segment", "matrix").mapInArrow(_looked_up(sorted(set(tokens)), True), "shard int, segment int, token long, value long")
    return found.join(_starts(files), ["shard", "segment"]).select("token", (F.col("before") + F.col("value")).alias("at"))


def _accessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in range(b.num_rows):
            at = b.column(b.schema.get_field_index("at"))[row].as_py()
            before, blob = (b.column(b.schema.get_field_index(c))[row].as_py() for c in ("before", "matrix"))
            matrix = WaveletMatrix(blob)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([matrix.access(i - before) for i in at], pa.int64())], ["at", "token"])


def tokens_at(spark: SparkSession, path: str, places: DataFrame, page: int = 4096) -> DataFrame:
    """at and token of each of places (a column at), distinct ones within the files' length, by access: a segment is
    opened only if it is asked for, and only in the blocks that its places touch.

    Segments spread over the pages of ids that they touch and meet places by page; a segment's places come together.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    spans = _starts(files).join(files.select("shard", "segment", "n_tokens"), ["shard", "segment"])
    paged = spans.withColumn("page", F.explode(F.sequence(F.floor(F.col("before") / page), F.floor((F.col("before") + F.col("n_tokens") - 1) / page))))
    asked = places.select(F.col("at").cast("long").alias("at")).where("at >= 0").distinct().withColumn("page", F.floor(F.col("at") / page))
    met = asked.join(paged, "page").where("at >= before AND at < before + n_tokens")
    own = met.groupBy("shard", "segment", "before").agg(F.collect_list("at").alias("at"))  # at most a segment's length
    return own.join(files.select("shard", "segment", "matrix"), ["shard", "segment"]).select("before", "at", "matrix").mapInArrow(W.tidy(_accessed), "at long, token long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each document of token files: shard, segment, doc_id, start (ids of all before it), n_tokens and ids_crc32."""
    files = spark.read.schema(SCHEMA).parquet(path)
    docs = files.select("shard", "segment", "doc_ids", "doc_sizes", "matrix").mapInArrow(W.tidy(_documents), "shard int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(_starts(files), ["shard", "segment"]).select("shard", "segment", "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
