"""N-gram Jaccard join: prefix-filtered candidates, checked in a trie of ordered n-gram sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import wordkit as W
from .components import components
from .store import tasks_for, whole_ids, with_row_of, written

MARK_BITS = 24


def _sets(texts: pa.Array, lo: int, hi: int, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text."""
    w = W.words(texts, lo, hi, W.BLANK_WORDS)
    s, at = W.shingles(w.hashes(), w.first, k)
    return [np.unique(s[at[i] : at[i + 1]]) for i in range(hi - lo)]


def _signed_sums(u: np.ndarray) -> tuple[int, int]:
    a = int(np.sum(W.mixed(u), dtype=np.uint64))
    b = int(np.bitwise_xor.reduce(W.mixed(u * np.uint64(0x2545F4914F6CDD1D) + np.uint64(len(u)))))
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (a, b))


def _digests(k: int) -> Callable:
    """Of each document, the size of its set and two 64-bit sums that equal sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, s1, s2 = W.column(b, "text"), [], [], []
            for lo, hi in W.slices(texts):
                for u in _sets(texts, lo, hi, k):
                    x, y = _signed_sums(u) if len(u) else (0, 0)
                    n.append(len(u))
                    s1.append(x)
                    s2.append(y)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())], ["doc_id", "n", "s1", "s2"])

    return W.tidy(run)


def _prefix(n, percent: int):  # noqa: ANN001, ANN202
    """How many of a set's first members any similar set must share one of; n is a number or an array."""
    return n - -(-n * percent // 100) + 1


def _reach(n, percent: int):  # noqa: ANN001, ANN202
    """Half as many again: of so many, similar sets share a good part."""
    return np.minimum(n, -(-3 * _prefix(n, percent) // 2))


def _least_shared(n: Column, percent: int) -> Column:
    """How many of a set's first _reach members any similar set must share, whatever its size.

    Of two sets the overlap is at least percent / (100 + percent) of both sizes; what lies beyond the reach of the one whose
    reach ends first can't be more than its rest. That bound is concave in the other size, so its ends are the least.
    """
    up = lambda a, b: F.ceil(a / F.lit(b))
    prefix = lambda m: m - up(m * percent, 100) + 1
    reach = lambda m: F.least(m, up(prefix(m) * 3, 2))
    out = n
    for m in (F.greatest(up(n * percent, 100), F.lit(1)), F.floor(n * 100 / F.lit(percent))):
        overlap = up((n + m) * percent, 100 + percent)
        out = F.least(out, overlap - F.greatest(n - reach(n), m - reach(m)))
    return F.greatest(out - 3, F.lit(1))  # rounding may move each part by one


def _prefixes(k: int, percent: int, marks) -> Callable:
    """Of each set not met lately by a task, its first members in the global order: without marks by hash, as far as
    _reach; with marks as far as _prefix, unmarked members first. (What is met again costs time only: classes are made
    one later.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        common = None if marks is None else marks.value
        low = np.uint64((1 << MARK_BITS) - 1)
        for b in batches:
            texts, ids = W.column(b, "text"), b.column(b.schema.get_field_index("doc_id")).to_pylist()
            for lo, hi in W.slices(texts):
                tokens, doc, size = [], [], []
                for i, u in enumerate(_sets(texts, lo, hi, k)):
                    n = len(u)
                    if not n:
                        continue
                    key = (n, *_signed_sums(u))
                    if key in seen:
                        continue
                    if len(seen) >= 20_000:
                        seen.clear()
                    seen.add(key)
                    if common is None:
                        own = u[: int(_reach(n, percent))]
                    else:
                        often = common[u & low]
                        own = np.concatenate([u[~often], u[often]])[: _prefix(n, percent)]
                    tokens.append(own)
                    doc.append(np.full(len(own), ids[lo + i], np.int64))
                    size.append(np.full(len(own), n, np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(W.signed(np.concatenate(tokens)), pa.int64()), pa.array(np.concatenate(doc)), pa.array(np.concatenate(size))], ["token", "doc", "n"])

    return W.tidy(run)


class SetTrie:
    """Sets of integers in one order, sorted into a compressed trie: a node is a run of sets that share a prefix."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.keys, code, often = np.unique(flat, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.keys), np.int64)
        self.rank[np.lexsort((self.keys, -often))] = np.arange(len(self.keys))  # the most shared first: longer common paths
        at, paths = 0, []
        for s in sets:
            paths.append(np.sort(self.rank[code[at : at + len(s)]]))
            at += len(s)
        self.order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.size = np.array([len(p) for p in self.paths], np.int64)
        self.common = np.zeros(len(self.paths), np.int64)
        for i in range(1, len(self.paths)):
            a, b = self.paths[i - 1], self.paths[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.common[i] = differ[0] if len(differ) else m

    def similar(self, probe: np.ndarray, percent: int, open_: np.ndarray | None = None) -> list[int]:
        """The sets whose Jaccard similarity with the probe is at least percent / 100.

        The walk carries the overlap of the shared path, so what sets have in common is compared once. A subtree goes
        unread if even all that can still match, in it or in the probe, would not do, or if open_ has none of its sets.
        """
        todo = None if open_ is None else np.concatenate([[0], np.cumsum(open_[self.order])])
        k = np.minimum(np.searchsorted(self.keys, probe), max(len(self.keys) - 1, 0))
        own = np.sort(self.rank[k[self.keys[k] == probe]]) if len(self.keys) else np.zeros(0, np.int64)
        flag = np.zeros(len(self.keys), bool)
        flag[own] = True
        n, found = len(probe), []
        stack = [(0, len(self.paths), 0, 0)] if self.paths else []
        while stack:
            lo, hi, depth, overlap = stack.pop()
            if todo is not None and todo[lo] == todo[hi]:
                continue
            path = self.paths[lo]
            to = int(self.size[lo]) if hi - lo == 1 else int(self.common[lo + 1 : hi].min())
            overlap += int(np.count_nonzero(flag[path[depth:to]]))
            if to == self.size[lo] and hi - lo == 1:
                if 100 * overlap >= percent * (n + to - overlap) and overlap:
                    found.append(self.order[lo])
                continue
            left = len(own) - (int(np.searchsorted(own, path[to - 1], "right")) if to else 0)
            sizes = self.size[lo:hi]
            best = overlap + min(int(sizes.max()) - to, left)
            if 100 * best < percent * (n + int(sizes.min()) - best):
                continue
            cuts = [lo, *(lo + 1 + np.flatnonzero(self.common[lo + 1 : hi] == to)).tolist(), hi]
            stack += [(a, b, to, overlap) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return found


def _check(k: int, percent: int) -> Callable:
    """Rows sorted by hub and part, the hub's own first: which documents of a part are similar to the hub."""

    def block(hub: int, own: list[np.ndarray], docs: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        trie = SetTrie(sets)
        return [(hub, docs[i]) for probe in own for i in trie.similar(probe, percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, docs, sets, out = None, [], [], [], []
        for b in batches:
            texts = W.column(b, "text")
            hubs, parts, ids = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("hub", "part", "doc"))
            for lo, hi in W.slices(texts):
                for i, u in enumerate(_sets(texts, lo, hi, k), lo):
                    if (hubs[i], parts[i]) != now:
                        if now is not None:
                            out += block(now[0], own, docs, sets)
                        now, own, docs, sets = (hubs[i], parts[i]), [], [], []
                    if ids[i] == hubs[i]:
                        own.append(u)
                    else:
                        docs.append(ids[i])
                        sets.append(u)
            yield _pairs(out)
            out = []
        if now is not None:
            yield _pairs(block(now[0], own, docs, sets))

    return W.tidy(run)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


class _Joined:
    """Components of a few documents, as links come."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x


def _block(k: int, percent: int) -> Callable:
    """Rows sorted by hub and pair of parts: links between documents of the two parts whose components differ so far.

    The second part (or the only one) stands in a trie; each document of the first walks it, past subtrees that hold
    only documents of its own component, so of a group's links just those that join components are looked for.
    """

    def found(first: list, second: list) -> list[tuple[int, int]]:
        joined, out = _Joined(), []
        trie = SetTrie([x[2] for x in second])
        labels = np.array([x[1] for x in second], np.int64)
        for doc, comp, own in first:
            now = np.array([joined.root(c) for c in labels.tolist()], np.int64) if joined.up else labels
            for i in trie.similar(own, percent, now != joined.root(comp)):
                a, b = joined.root(comp), joined.root(int(labels[i]))
                if a != b:
                    joined.up[max(a, b)] = min(a, b)
                    out.append((doc, second[i][0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, out = None, ([], []), []
        for b in batches:
            texts = W.column(b, "text")
            hub, i, j, side, doc, comp = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("hub", "i", "j", "side", "doc", "comp"))
            for lo, hi in W.slices(texts):
                for r, u in enumerate(_sets(texts, lo, hi, k), lo):
                    key = (hub[r], i[r], j[r])
                    if key != now:
                        if now is not None:
                            out += found(sides[0], sides[1] if now[1] != now[2] else sides[0])
                        now, sides = key, ([], [])
                    sides[side[r]].append((doc[r], comp[r], u))
            yield _pairs(out)
            out = []
        if now is not None:
            yield _pairs(found(sides[0], sides[1] if now[1] != now[2] else sides[0]))

    return W.tidy(run)


def _texts(docs: DataFrame, ids: DataFrame, few: int = 1_000_000) -> DataFrame:
    """The documents of some ids, which go to all tasks if they are few, else are joined by shuffle."""
    ids = written(ids.distinct(), "wanted-ids")
    return written(docs.join(F.broadcast(ids) if ids.count() <= few else ids, "doc_id", "left_semi"), "wanted-texts")


def _similar(pairs: DataFrame, texts: DataFrame, k: int, percent: int, part_size: int = 256) -> DataFrame:
    """Those of pairs (a, b) whose texts are similar: b's text goes to its hub a, at most part_size to a task's block."""
    hubs = written(pairs.groupBy("a").agg(F.count("*").alias("many")), "pair-hubs").withColumn("parts", F.ceil(F.col("many") / part_size).cast("int"))
    there = with_row_of(pairs, hubs, "a", "many").select(F.col("a").alias("hub"), F.col("b").alias("doc"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    ours = hubs.select(F.col("a").alias("hub"), F.col("a").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = there.unionByName(ours).join(texts, F.col("doc") == F.col("doc_id")).select("hub", "part", "doc", "text")
    dealt = rows.repartition(tasks_for(texts.sparkSession), "hub", "part").sortWithinPartitions("hub", "part", (F.col("doc") != F.col("hub")))
    return dealt.mapInArrow(_check(k, percent), "a long, b long")


def _within(members: DataFrame, texts: DataFrame, k: int, percent: int, part_size: int = 1024) -> DataFrame:
    """Links inside hubs' groups (hub, doc, n, comp), between documents whose components differ so far.

    A group is cut by set size into classes, in steps that similar sets can't cross by more than one, and those into parts
    of about part_size, documents of the hub's component apart; each pair of parts of one class or neighbouring ones, but for two of
    that component, makes a block of bounded size, so a large group spreads over many tasks and no pairs are listed.
    """
    step = float(np.log(100 / percent))
    side = members.withColumns({"own": F.col("comp") == F.col("hub_comp"), "size": F.floor(F.log(F.col("n").cast("double")) / step).cast("int")})
    count = side.groupBy("hub", "own", "size").agg(F.ceil(F.count("*") / part_size).cast("int").alias("parts"))
    placed = side.join(count, ["hub", "own", "size"]).withColumn("p", (F.pmod(F.xxhash64("doc"), F.col("parts")) * 2 + F.col("own").cast("int")) * 65536 + F.col("size"))
    placed = placed.select("hub", "doc", "comp", "p", "own", "size")
    parts = written(placed.select("hub", "p", "own", "size").distinct(), "parts")
    x, y = (parts.select("hub", F.col("p").alias(i), F.col("own").alias(f"o{i}"), F.col("size").alias(f"s{i}")) for i in "ij")
    near = y.withColumn("si", F.explode(F.array(F.col("sj") - 1, F.col("sj"))))
    met = x.join(near, ["hub", "si"]).where("(si < sj OR i <= j) AND NOT (oi AND oj)")
    blocks = written(met.select("hub", "i", "j"), "blocks")
    first = blocks.join(placed, (blocks["hub"] == placed["hub"]) & (blocks["i"] == placed["p"])).select(blocks["hub"], "i", "j", F.lit(0).alias("side"), "doc", "comp")
    second = blocks.where("i != j").join(placed, (blocks["hub"] == placed["hub"]) & (blocks["j"] == placed["p"])).select(blocks["hub"], "i", "j", F.lit(1).alias("side"), "doc", "comp")
    rows = first.unionByName(second).join(texts, F.col("doc") == F.col("doc_id")).select("hub", "i", "j", "side", "doc", "comp", "text")
    dealt = rows.repartition(tasks_for(texts.sparkSession), "hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return dealt.mapInArrow(_block(k, percent), "a long, b long")


def _frequent(texts: DataFrame, total: int, k: int, percent: int, sample: int = 20_000, most: int = 5000) -> DataFrame:
    """Tokens that a sample of the documents, picked by hash, has again and again: at most so many. They are only dealt
    otherwise, so which they are changes no result."""
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // sample))) == 0)
    seen = some.mapInArrow(_prefixes(k, percent, None), "token long, doc long, n int").groupBy("token").agg(F.count("*").alias("c"))
    return written(seen.where("c >= 20").orderBy(F.desc("c"), "token").limit(most).select("token"), "frequent-tokens")


def _shared(entries: DataFrame, same: DataFrame, often: DataFrame) -> DataFrame:
    """Entries (token, doc, n) of tokens that two classes or more have, documents as their classes' first, with g, how
    many have the token. Tokens known to be frequent (often, a bounded number) stay out of the sort by token."""
    group = Window.partitionBy("token").orderBy("doc")
    flagged = entries.join(F.broadcast(often.withColumn("often", F.lit(True))), "token", "left")
    seen = flagged.where("often IS NULL").withColumns({"before": F.lag("doc").over(group), "after": F.lead("doc").over(group)})
    found = seen.where("before IS NOT NULL OR after IS NOT NULL").select("token", "doc", "n")
    found = written(found.unionByName(flagged.where("often").select("token", "doc", "n")), "shared-prefixes")
    found = written(found.join(same.select(F.col("doc_id").alias("doc"), "rep"), "doc").select("token", F.col("rep").alias("doc"), "n").distinct(), "shared-reps")
    size = written(found.groupBy("token").agg(F.count("*").alias("g")).where("g > 1"), "shared-sizes")
    return written(with_row_of(found, size, "token", "g"), "shared-classes")


def _marks(shared: DataFrame, often: int) -> np.ndarray:
    """One bit for each shingle that many documents have, at its hash's low bits.

    The table has 2^24 bits whatever the input. A bit that stands for another shingle too changes the order for all
    documents alike, so it costs candidates, never a link.
    """
    spot = f"(token & {(1 << MARK_BITS) - 1})"
    words = shared.where(F.col("g") >= often).groupBy(F.expr(f"shiftright({spot}, 6)").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({spot} & 63 as int))")).alias("bits")).toPandas()
    table = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    table[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def jaccard_groups(documents: DataFrame, shingle: int = 5, percent: int = 80, often: int = 64, light: int = 24) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: groups of documents joined by links.

    Words are runs without blanks, A-Z as a-z; a document's set holds its distinct shingles, or its whole sequence if it
    has fewer words. Two documents link if 100 * |A and B| >= percent * |A or B|. component_id is the smallest doc_id
    reachable. Null, empty and blank texts have empty sets and stand alone; equal sets link; rows that share a doc_id
    count as one document; a null doc_id stands alone and has no component_id. Other columns are not read.

    1. Equal sets become one class. 2. The first members of sets by hash are counted; a document that shares too few of
    its own can have no link and stands alone, as most do. 3. Prefixes of the others in one global order give candidates;
    shingles that many have go last in it. 4. In groups of at most `light` documents at a shingle, pairs whose shared prefix
    parts leave the similarity possible are compared. 5. A larger group goes to its hub, the document that shares most;
    all are compared with it, then, in blocks, those that are in different components. Chains of links settle in at most
    60 rounds of labels, or the job stops with an error.
    """
    spark = documents.sparkSession
    whole_ids(documents, "doc_id")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digests = written(docs.mapInArrow(_digests(shingle), "doc_id long, n long, s1 long, s2 long"), "set-digests")
    some = digests.where("n > 0 AND doc_id IS NOT NULL")
    reps = written(some.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "set-classes")
    one = F.struct("n", "s1", "s2")
    same = with_row_of(some.select("doc_id", one.alias("set")), reps.select(one.alias("set"), "rep", "copies"), "set", "copies")
    same = written(same.select("doc_id", "rep").distinct(), "set-members")

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    frequent = _frequent(texts, digests.count(), shingle, percent)
    counted = _shared(texts.mapInArrow(_prefixes(shingle, percent, None), "token long, doc long, n int"), same, frequent)
    marks = spark.sparkContext.broadcast(_marks(counted, often))
    sizes = counted.groupBy("doc", "n").agg(F.count("*").alias("c"))
    active = written(sizes.where(F.col("c") >= _least_shared(F.col("n").cast("long"), percent)).select(F.col("doc").alias("doc_id")), "active")
    wanted = _texts(docs, active)
    shared = _shared(wanted.mapInArrow(_prefixes(shingle, percent, marks), "token long, doc long, n int"), same, frequent)
    marks.unpersist()

    heavy = shared.where(F.col("g") > light)
    weight = shared.groupBy("doc").agg(F.sum("g").alias("s"))
    hubs = heavy.join(weight, "doc").groupBy("token").agg(F.max(F.struct("s", -F.col("doc"), "n")).alias("h"), F.count("*").alias("many"))
    hubs = written(hubs.select("token", (-F.col("h.col2")).alias("hub"), F.col("h.n").alias("hub_n"), "many"), "hub-tokens")
    starred = written(with_row_of(heavy.drop("g"), hubs, "token", "many").select("hub", "doc", "n", "hub_n").distinct(), "hubs")

    prefix = lambda n: n - F.ceil(n * percent / 100) + 1
    fits = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    left = F.greatest(F.col("na") - prefix(F.col("na")), F.col("nb") - prefix(F.col("nb")))
    possible = (F.col("c") + F.least("ha", "hb") + left) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    extra = heavy.groupBy("doc").agg(F.count("*").alias("h"))
    few = shared.where(F.col("g") <= light).join(extra, "doc", "left").select("token", "doc", "n", F.coalesce("h", F.lit(0)).alias("h"))
    x, y = (few.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("doc", "n", "h")]) for s in "xy")
    pairs = x.join(y, "token").where(f"n_x <= n_y AND n_x * 100 >= n_y * {percent} AND (n_x < n_y OR doc_x < doc_y)")
    pairs = pairs.groupBy(F.col("doc_x").alias("a"), F.col("doc_y").alias("b")).agg(F.count("*").alias("c"), F.min("n_x").alias("na"), F.min("n_y").alias("nb"), F.min("h_x").alias("ha"), F.min("h_y").alias("hb"))
    stars = starred.where("doc != hub").select(F.col("hub").alias("a"), F.col("doc").alias("b"), F.col("hub_n").alias("na"), F.col("n").alias("nb")).where(fits)
    tried = written(pairs.where(possible).select("a", "b").union(stars.select("a", "b")).distinct(), "pairs")
    first = written(_similar(tried, wanted, shingle, percent), "links")
    near = components(first)

    label = near.select(F.col("node").alias("_n"), "component")
    members = starred.join(label, F.col("doc") == F.col("_n"), "left").select("hub", "doc", "n", F.coalesce("component", "doc").alias("comp"))
    of_hub = starred.select("hub", "hub_n").distinct().join(label, F.col("hub") == F.col("_n"), "left").select("hub", "hub_n", F.coalesce("component", "hub").alias("hub_comp"))
    members = members.unionByName(of_hub.select("hub", F.col("hub").alias("doc"), F.col("hub_n").alias("n"), F.col("hub_comp").alias("comp"))).distinct()
    members = members.join(of_hub.select("hub", "hub_comp"), "hub")
    members = written(members, "members")
    apart = members.groupBy("hub").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo != _hi").select("hub")
    second = _within(members.join(apart, "hub", "left_semi"), wanted, shingle, percent)
    links = first.union(second).union(same.where("doc_id != rep").select("doc_id", "rep"))
    last = components(links).withColumnRenamed("node", "_node")
    return digests.join(last, F.col("doc_id") == F.col("_node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
