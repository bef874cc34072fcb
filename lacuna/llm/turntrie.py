"""Conversation prefix trie: an external mergesort whose runs carry what neighbours share, merged into trie nodes."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordkit as W
from .store import tasks_for, whole_ids, with_row_of, written

WIDE = 16  # bytes of a turn's digest


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (a 16-byte digest of role and text each) and chars (code points of each text), turns in order.

    Order is by turn, null first; turns of one number go by role and digest. A null role or text is empty. Rows without a
    conv_id belong to no conversation. Only digests are shuffled, never texts. A conversation's digests, some 60 bytes a
    turn, must fit in a task; its texts need not.
    """
    whole_ids(conversations, "conv_id")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", role.alias("role"), F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.char_length(text).alias("chars")).alias("t"),
    )
    line = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return line.select("conv_id", F.col("t.digest").alias("turns"), F.col("t.chars").alias("chars"))


def rebuilt(sequences: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """Conversations with borrowed heads: the first h turns come from the conversation at the start of the block of ids,
    h = crc32(decimal id) % heads, as far as there are any; a conversation's own turns follow from its h-th on."""
    some = written(sequences.withColumns({"base": F.col("conv_id") - F.pmod("conv_id", F.lit(block)), "h": (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")}), "sequences")
    head = some.where("conv_id = base").select("base", *[F.slice(c, 1, heads - 1).alias(f"head_{c}") for c in ("turns", "chars")])
    both = some.join(head, "base", "left")

    def put(c: str):  # noqa: ANN202
        none = F.array().cast(sequences.schema[c].dataType)
        first = F.coalesce(F.slice(F.col(f"head_{c}"), F.lit(1), F.col("h")), none)
        rest = F.slice(F.col(c), F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))
        return F.concat(first, rest).alias(c)

    return both.select("conv_id", put("turns"), put("chars"))


def shared_turns(a: bytes, b: bytes, at: int = 0) -> int:
    """How many first turns two sequences of digests have in common, the first `at` known to be alike."""
    i, n = at * WIDE, min(len(a), len(b))
    while i < n and a[i : i + WIDE] == b[i : i + WIDE]:
        i += WIDE
    return i // WIDE


_RUNS = "bucket int, ids array<long>, sizes array<int>, shared array<int>, turns binary, chars array<int>"


def _keys(b: pa.RecordBatch) -> Iterator[tuple[bytes, int, np.ndarray]]:
    """Each row's digests end to end, its id and its texts' lengths."""
    ids = b.column(b.schema.get_field_index("conv_id")).to_pylist()
    turns, chars = (b.column(b.schema.get_field_index(c)) for c in ("turns", "chars"))
    at = np.asarray(turns.offsets).tolist()
    flat = b"".join(turns.values[at[0] : at[-1]].to_pylist())  # whatever the batch's own offsets
    count = np.asarray(chars.values[at[0] : at[-1]])
    for i, c in enumerate(ids):
        lo, hi = at[i] - at[0], at[i + 1] - at[0]
        yield flat[lo * WIDE : hi * WIDE], c, count[lo:hi]


def _runs(cuts, most_turns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted runs of at most about so many turns, cut at the borders of buckets. A sequence is kept from where it leaves
    the one before it in its piece, with how many turns they share; the first of a piece is whole."""

    def piece(bucket: int, rows: list[tuple[bytes, int, np.ndarray]]) -> pa.RecordBatch:
        shared, parts, before = [], [], b""
        for key, _, _ in rows:
            shared.append(shared_turns(before, key))
            parts.append(key[shared[-1] * WIDE :])
            before = key
        listed = lambda v, kind: pa.array([v], pa.list_(kind))
        chars = np.concatenate([r[2][s:] for r, s in zip(rows, shared, strict=True)])
        own = [pa.array([bucket], pa.int32()), listed([r[1] for r in rows], pa.int64()), listed([len(r[0]) // WIDE for r in rows], pa.int32()), listed(shared, pa.int32()), pa.array([b"".join(parts)], pa.binary()), listed(chars.tolist(), pa.int32())]
        return pa.RecordBatch.from_arrays(own, ["bucket", "ids", "sizes", "shared", "turns", "chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders, held = cuts.value, 0
        rows: list[tuple[bytes, int, np.ndarray]] = []

        def sorted_pieces() -> Iterator[pa.RecordBatch]:
            rows.sort(key=lambda r: r[:2])
            lo = 0
            while lo < len(rows):
                bucket = bisect_right(borders, rows[lo][:2])
                hi = bisect_left(rows, borders[bucket], lo, key=lambda r: r[:2]) if bucket < len(borders) else len(rows)
                yield piece(bucket, rows[lo:hi])
                lo = hi

        for b in batches:
            for row in _keys(b):
                rows.append(row)
                held += len(row[2]) + 1
                if held >= most_turns:
                    yield from sorted_pieces()
                    rows, held = [], 0
        if rows:
            yield from sorted_pieces()

    return W.tidy(run)


class Run:
    """A sorted run, read from front to back: the current sequence, its id, and what it shares with the one before."""

    def __init__(self, ids, sizes, shared, turns: bytes, chars: np.ndarray):  # noqa: ANN001
        self.ids, self.sizes, self.shared, self.turns, self.chars = ids, sizes, shared, turns, chars
        self.i, self.at, self.key, self.count = -1, 0, b"", np.zeros(0, np.int64)
        self.next()

    def next(self) -> bool:
        self.i += 1
        if self.i >= len(self.ids):
            return False
        self.id, self.lcp = self.ids[self.i], self.shared[self.i]
        new = self.sizes[self.i] - self.lcp
        self.key = self.key[: self.lcp * WIDE] + self.turns[self.at * WIDE : (self.at + new) * WIDE]
        self.count = np.concatenate([self.count[: self.lcp], self.chars[self.at : self.at + new]])
        self.at += new
        return True


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, np.ndarray, int]]:
    """All sequences of some runs in order, by turns and then id, each with how many turns it shares with the one before.

    A loser tree. Each loser keeps how many turns it shares with the one that beat it; as both are then compared with the
    same winner, the one that shares more comes first, and turns are compared only on a draw, from there on.
    """
    k = len(runs)
    lcp = [0] * k
    ended = [False] * k
    losers = [-1] * k  # losers[1:] are inner nodes, leaf i stands at k + i

    def beats(a: int, b: int) -> bool:
        """Whether run a comes first. The loser's shared turns are then those with the winner."""
        if ended[a] or ended[b]:
            return ended[b] and (not ended[a] or a < b)
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        x, y = runs[a], runs[b]
        n = shared_turns(x.key, y.key, lcp[a])
        rest_x, rest_y = x.key[n * WIDE : (n + 1) * WIDE], y.key[n * WIDE : (n + 1) * WIDE]
        first = (rest_x, x.id) < (rest_y, y.id)
        lcp[b if first else a] = n
        return first

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        win, lose = (a, b) if beats(a, b) else (b, a)
        losers[node] = lose
        return win

    if not k:
        return
    win = build(1)
    while not ended[win]:
        own = runs[win]
        yield own.key, own.id, own.count, lcp[win]
        if own.next():
            lcp[win] = own.lcp
        else:
            ended[win] = True
        node = (k + win) // 2
        while node:
            if not beats(win, losers[node]):
                win, losers[node] = losers[node], win
            node //= 2


class _Open:
    """A node on the path: its subtree so far. edge: other buckets may hold more of it."""

    __slots__ = ("chars", "children", "digest", "edge", "ends", "kids", "leaves", "members", "saved", "smallest")

    def __init__(self, chars: int, edge: bool, digest: bytes | None):
        self.chars, self.edge, self.digest = chars, edge, digest
        self.smallest, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.kids: list[tuple] = []
        self.ends: list[int] = []


_NODES = "kind string, bucket int, place int, digest binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary, chars long"
_NAMES = [x.split()[0] for x in _NODES.split(", ")]
_KIND = pa.schema([(x.split()[0], {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}[x.split()[1]]) for x in _NODES.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KIND.types, strict=True)], schema=_KIND)


def _prefix_digests(key: bytes) -> list[bytes]:
    """A digest of each prefix of a sequence, the root's first."""
    h = hashlib.blake2b(b"root", digest_size=16)
    out = [h.digest()]
    for i in range(0, len(key), WIDE):
        h.update(key[i : i + WIDE])
        out.append(h.copy().digest())
    return out


def trie_nodes(stream: Iterator[tuple[bytes, int, np.ndarray, int]], bucket: int) -> Iterator[tuple]:
    """The nodes of a bucket's sorted stream, as rows of _NODES.

    A stack holds the open path; where a sequence leaves it, nodes below are finished: what they know goes to their
    parents, and a finished parent hands its children out. Nodes on the path of the first or the last sequence may go
    on in other buckets: they come as kind "edge" with what this bucket adds to them, in order of first path and then last;
    the others as "done", or as "child" of an edge whose smallest member is not known yet.
    """
    stack: list[_Open] = []
    first_edges: list[_Open] = []
    shared_first, last = 0, b""

    def close(node: _Open, depth: int, parent: _Open) -> None:
        if node.edge:
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.members - 1) * node.chars
        ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
        for kid in node.kids:
            out.append(("done", None, None, None, None, kid[0], kid[1], node.smallest, *kid[2:], None, None))
        parent.kids.append((node.smallest, depth, node.members, node.children, leaves, saved, ends))
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved

    def up(node: _Open, parent: _Open) -> None:
        parent.members += node.members
        parent.smallest = node.smallest if parent.smallest is None else min(parent.smallest, node.smallest)

    out: list[tuple] = []
    for key, conv, count, lcp in stream:
        if not stack:
            stack = [_Open(int(c), True, d) for c, d in zip([0, *count.tolist()], _prefix_digests(key), strict=True)]
            first_edges, shared_first = list(stack), len(key) // WIDE
        else:
            while len(stack) > lcp + 1:
                node = stack.pop()
                up(node, stack[-1])
                close(node, len(stack), stack[-1])
            shared_first = min(shared_first, lcp)
            for c in count[lcp:].tolist():
                stack.append(_Open(c, False, None))
        node = stack[-1]
        node.members += 1
        node.smallest = conv if node.smallest is None else min(node.smallest, conv)
        node.ends.append(conv)
        last = key
        if len(out) >= 5000:
            yield from out
            out.clear()
    yield from out
    out.clear()
    if not stack:
        return
    for node, d in zip(stack, _prefix_digests(last), strict=True):
        node.edge, node.digest = True, d
    for depth in range(len(stack) - 1, 0, -1):
        up(stack[depth], stack[depth - 1])
    path = first_edges + stack[shared_first + 1 :]
    depths = [*range(len(first_edges)), *range(shared_first + 1, len(stack))]
    for place, (node, depth) in enumerate(zip(path, depths, strict=True)):
        for kid in node.kids:
            yield ("child", None, None, None, node.digest, kid[0], kid[1], None, *kid[2:], None, None)
        yield ("edge", bucket, place, node.digest, None, node.smallest, depth, None, node.members, node.children, node.leaves, node.saved, None, ",".join(map(str, node.ends)).encode(), node.chars)


def _merge(table: pa.Table) -> pa.Table:
    runs, rows, done = [], [], []
    for b in table.to_batches():
        for i in range(b.num_rows):
            ids, sizes, shared, turns, chars = (b.column(b.schema.get_field_index(c))[i] for c in ("ids", "sizes", "shared", "turns", "chars"))
            runs.append(Run(ids.as_py(), sizes.as_py(), shared.as_py(), turns.as_py(), np.asarray(chars.values)))
    for row in trie_nodes(merged(runs), table["bucket"][0].as_py()):
        rows.append(row)
        if len(rows) >= 5000:
            done.append(_batch(rows))
            rows = []
    return pa.Table.from_batches([*done, _batch(rows)] if rows else done, _KIND)


class _Edge:
    __slots__ = ("chars", "children", "digest", "first", "hash", "kids", "leaves", "members", "saved", "smallest")

    def __init__(self, digest: bytes, chars: int):
        self.digest, self.chars, self.hash, self.first = digest, chars, hashlib.sha256(), True
        self.smallest, self.members, self.children, self.leaves, self.saved = 2**63 - 1, 0, 0, 0, 0
        self.kids: list[tuple] = []


def _close_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edge nodes of all buckets in order, a few a bucket: parts of one node meet on the open path and are summed."""
    stack: list[_Edge] = []

    def popped() -> list[tuple]:
        node = stack.pop()
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.members - 1) * node.chars
        rows = [("done", None, None, k[0], None, *k[1:3], node.smallest, *k[3:], None, None) for k in node.kids]
        own = (node.digest, node.smallest, len(stack), node.members, node.children, leaves, saved, node.hash.hexdigest())
        if stack:
            parent = stack[-1]
            parent.kids.append(own)
            parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + leaves, parent.saved + saved
        else:
            rows.append(("done", None, None, own[0], None, *own[1:3], None, *own[3:], None, None))
        return rows

    for b in batches:
        rows: list[tuple] = []
        for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("depth", "digest", "chars", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")), strict=True):
            depth, digest, chars, smallest, members, children, leaves, saved, ends = r
            if len(stack) <= depth or stack[depth].digest != digest:
                while len(stack) > depth:
                    rows += popped()
                stack.append(_Edge(digest, chars))
            node = stack[depth]
            node.smallest = min(node.smallest, smallest)
            node.members, node.children, node.leaves, node.saved = node.members + members, node.children + children, node.leaves + leaves, node.saved + saved
            if ends:
                node.hash.update(ends if node.first else b"," + ends)
                node.first = False
        if rows:
            yield _batch(rows)
    rows = []
    while stack:
        rows += popped()
    if rows:
        yield _batch(rows)


def prefix_trie(sequences: DataFrame, bucket_turns: int = 400_000, run_turns: int = 400_000, sampled: int = 32) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node of the trie
    of sequences (conv_id, turns, chars): a node is a distinct prefix, named by its smallest member and its depth.

    1. Tasks sort their conversations into runs of bounded size and write them, front-coded: each sequence from where it
    leaves the one before. Runs are cut into buckets at borders taken from a hash sample of `sampled` sequences a bucket,
    in order of turns and id, so many copies of one conversation fill several buckets. 2. A task merges the pieces of a
    bucket with a loser tree that never compares shared turns again, and a stack of open nodes emits finished ones.
    3. Nodes on the path of a bucket's first or last sequence, a few a bucket, are closed in one small ordered pass: it
    sees a row for each of them, and the ids that end there, as SHA-256 must take a node's ids in order. 4. Children of such
    nodes get their parent's smallest member.

    Sequences without turns end at the root. No sequences, no nodes. Rows that repeat a conv_id count as so many members.
    """
    spark = sequences.sparkSession
    rows = written(sequences, "trie-sequences")
    size = F.size("turns") + 1
    total, count = rows.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-int(total) // bucket_turns))
    every = max(1, count // (buckets * sampled))
    some = rows.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select("conv_id", "turns", "chars").toArrow() if buckets > 1 else None
    borders: list[tuple[bytes, int]] = []
    if some is not None:
        keys = sorted((key, c) for b in some.to_batches() for key, c, _ in _keys(b))
        weight = np.cumsum([len(k[0]) // WIDE + 1 for k in keys]) if keys else np.zeros(0)
        spots = np.searchsorted(weight, [weight[-1] * i / buckets for i in range(1, buckets)]) if keys else []
        borders = sorted({keys[i] for i in spots})
    cuts = spark.sparkContext.broadcast(borders)
    runs = written(rows.mapInArrow(_runs(cuts, run_turns), _RUNS), "trie-runs")
    dealt = runs.repartition(min(len(borders) + 1, 20 * tasks_for(spark)), "bucket")
    nodes = written(dealt.groupBy("bucket").applyInArrow(_merge, _NODES), "trie-nodes")
    cuts.unpersist()
    edges = nodes.where("kind = 'edge'").repartition(1).sortWithinPartitions("bucket", "place").mapInArrow(W.tidy(_close_edges), _NODES)
    edges = written(edges, "trie-edges")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    many = nodes.where("kind = 'child'").groupBy("parent").agg(F.count("*").alias("many"))
    tops = written(edges.select(F.col("digest").alias("parent"), F.col("conv_id").alias("top")).join(many, "parent"), "trie-parents")
    child = with_row_of(nodes.where("kind = 'child'").select("parent", *columns), tops, "parent", "many").withColumn("parent_conv_id", F.col("top"))
    return nodes.where("kind = 'done'").select(*columns).unionByName(edges.select(*columns)).unionByName(child.select(*columns))
