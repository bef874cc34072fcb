"""Words, shingles and their hashes for whole Arrow columns of text, in numpy inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240607)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_OTHER = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.arange(256)
#: Which bytes belong to words, after A-Z became a-z.
BLANK_WORDS = ~_SPACE
ALNUM_WORDS = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90))

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        back = pow(_MULT, -1, 2**64)
        for name, m in (("up", _MULT), ("down", back)):
            a = np.full(size, m, U64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=U64)
    return _powers["up"], _powers["down"]


def give_back() -> None:
    """Returns what this process no longer uses to the machine."""
    for name in _powers:
        _powers[name] = _powers[name][: 1 << 16].copy()
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving its memory back at the end: workers are reused, and what they keep adds up over a job's stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits look random."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Words:
    """Words of a run of texts: bytes [start, end) of data, those of text i at first[i] to first[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    base: np.ndarray

    def hashes(self, other: bool = False) -> np.ndarray:
        """64-bit hash of each word, the same for the same bytes (A-Z as a-z); other: of another kind."""
        n = len(self.data)
        up, down = _power(n + 1)
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum((_OTHER if other else _CODE)[_LOWER[self.data]] * up[:n], out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * down[self.start] + U64(7919) * (self.end - self.start).astype(U64))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about most_bytes; a longer text stands alone."""
    off = np.asarray(raw(texts)[1])
    lo, n = 0, len(texts)
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets of an Arrow string array without nulls."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, off, data = texts.buffers()
    if off is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column, null as empty."""
    c = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(c.type):
        c = c.cast(pa.string())
    return c.fill_null("") if c.null_count else c


def words(texts: pa.Array, lo: int, hi: int, inside: np.ndarray) -> Words:
    data, off = raw(texts)
    off = off[lo : hi + 1]
    data = data[off[0] : off[-1]]
    off = off - off[0]
    n = len(data)
    is_in = inside[data]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = is_in
    before[off] = False
    after = np.empty(n + 1, bool)
    after[:n] = is_in
    after[n] = False
    after[off] = False
    start = np.flatnonzero(is_in & ~before[:n])
    end = np.flatnonzero(is_in & ~after[1:]) + 1
    return Words(data, start, end, np.searchsorted(start, off), off)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside each text; a text of 1 to k - 1 words has its whole run.

    Returns the hashes and their n + 1 offsets by text.
    """
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    out = np.empty(at[-1], U64)
    if not len(out):
        return out, at
    whole = max(len(h) - k + 1, 0)
    run = np.zeros(whole, U64)
    for j in range(k):
        run += h[j : j + whole] * _STEP[j]
    pick = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(first[:-1], n)
    long = np.repeat(count >= k, n)
    out[long] = mixed(run[pick[long]] + U64(k))
    for i in np.flatnonzero((count > 0) & (count < k)):
        v = h[first[i] : first[i + 1]]
        out[at[i]] = mixed(np.array([np.sum(v * _STEP[: len(v)], dtype=U64)]) + U64(len(v)))[0]
    return out, at


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they all lie in one text."""
    n = len(h)
    out, ok = np.zeros(n, U64), np.ones(n, bool)
    whole = max(n - k + 1, 0)
    for j in range(k):
        out[:whole] += h[j : j + whole] * _STEP[j]
    for j in range(1, k):
        at = first[1:] - j
        ok[at[at >= first[:-1]]] = False
    return mixed(out + U64(k)), ok


class Found:
    """Membership in a fixed set of 64-bit hashes: a small table of marks first, then a sorted search."""

    def __init__(self, keys: np.ndarray, bits: int = 22):
        self.keys = np.unique(keys.astype(U64))
        self.mask = U64((1 << bits) - 1)
        self.marks = np.zeros(1 << bits, bool)
        self.marks[self.keys & self.mask] = True

    def where(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of members, and which member stands there."""
        at = np.flatnonzero(self.marks[h & self.mask])
        if not len(self.keys) or not len(at):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[k] == h[at]
        return at[good], k[good]
