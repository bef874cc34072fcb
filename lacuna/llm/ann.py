"""Approximate nearest neighbours by inner product: a hash-prefix forest over each segment of the vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordkit as W
from .store import tasks_for, whole_ids, written

BITS = 64


def planes(trees: int, size: int, seed: int) -> np.ndarray:
    """Directions of the hash bits: trees x 64 of them, with one more component than vectors have."""
    return np.random.default_rng(seed).standard_normal((trees, BITS, size + 1)).astype(np.float32)


def _strings(x: np.ndarray, extra: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """The 64-bit hash string of each vector in each tree: which side of the tree's planes it lies on, first plane first."""
    full = np.concatenate([x, extra[:, None]], axis=1).astype(np.float32)
    out = np.empty((len(sides), len(x)), np.uint64)
    for t, side in enumerate(sides):
        on = (full @ side.T) > 0
        out[t] = np.packbits(on, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first bits two strings have in common."""
    x, out = a ^ b, np.full(len(a), BITS, np.int64)
    for shift in (32, 16, 8, 4, 2, 1):  # the place of the highest bit that differs, by halves
        high = x >> np.uint64(shift)
        on = high > 0
        out[on] -= shift
        x = np.where(on, high, x)
    return out - (x > 0)


def usual(squares: np.ndarray) -> float:
    """The squared length that all but a fiftieth of some vectors keep to; those few are compared with every query."""
    return float(np.quantile(squares, 0.98, method="lower")) if len(squares) else 0.0


class Forest:
    """Sorted arrays of hash strings, one a tree, over the same vectors, and whose vectors they are."""

    def __init__(self, keys: np.ndarray, order: np.ndarray):
        self.keys, self.order = keys, order

    @staticmethod
    def over(x: np.ndarray, sides: np.ndarray) -> Forest:
        """Lengthened by sqrt(usual^2 - |x|^2) in one more component, vectors have one length, so the largest inner
        product is the smallest angle, which hash strings keep; but for the few longer than usual."""
        length = (x.astype(np.float64) ** 2).sum(axis=1)
        keys = _strings(x, np.sqrt(np.maximum(usual(length) - length, 0.0)), sides)
        order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        return Forest(np.take_along_axis(keys, order, axis=1), order)

    def _ranges(self, q: np.ndarray, tree: int, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where strings stand that share the first bits, so many, with each query's."""
        rest = np.where(depth >= BITS, np.uint64(0), np.uint64(2**64 - 1) >> np.minimum(depth, 63).astype(np.uint64))
        lo = np.searchsorted(self.keys[tree], q & ~rest, "left")
        return lo, np.searchsorted(self.keys[tree], q | rest, "right")

    def descend(self, q: np.ndarray) -> np.ndarray:
        """How long the longest prefix is that each query shares with any string of each tree: it ends at the query's
        place in the sorted array, beside the string before or after."""
        out = np.zeros(q.shape, np.int64)
        for t, own in enumerate(self.keys):
            at = np.searchsorted(own, q[t])
            out[t] = np.maximum(_shared_bits(q[t], own[np.maximum(at - 1, 0)]), _shared_bits(q[t], own[np.minimum(at, len(own) - 1)]))
        return out

    def votes(self, q: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query's strings (trees x queries), in how many trees each row was met.

        Every tree is descended to its longest match; from the deepest of them all trees are ascended together, bit by
        bit, until their ranges hold at least so many. What they hold only grows on the way up, so the level is found by
        halving. A tree whose own match is shorter joins in at its own level.
        """
        trees, n = q.shape
        low, high = np.zeros(n, np.int64), self.descend(q).max(axis=0)
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo] + 1) // 2
            held = np.zeros(len(todo), np.int64)
            for t in range(trees):
                lo, hi = self._ranges(q[t][todo], t, mid)
                held += hi - lo
            enough = held >= least
            low[todo[enough]], high[todo[~enough]] = mid[enough], mid[~enough] - 1
        spans = [self._ranges(q[t], t, low) for t in range(trees)]
        for i in range(n):
            met = np.concatenate([self.order[t, spans[t][0][i] : spans[t][1][i]] for t in range(trees)])
            yield np.bincount(met, minlength=self.keys.shape[1])


def chosen(votes: np.ndarray, most: int, least: int = 1) -> np.ndarray:
    """The rows that the most trees met, as many whole ranks of votes as hold at most so many rows, but at least so many."""
    above = np.cumsum(np.bincount(votes)[::-1])[::-1]  # rows with so many votes or more
    few = np.flatnonzero(above <= most)
    enough = int(np.flatnonzero(above >= min(least, len(votes)))[-1])
    return np.flatnonzero(votes >= min(int(few[0]) if len(few) else len(above), enough))


def _vectors(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return np.asarray(column.flatten()).reshape(-1, size)


_FOREST = "rows array<long>, ids array<long>, vectors binary, strings binary, places binary"


def _grown(trees: int, size: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    """A segment's vectors and forest as one row."""

    def run(segment: pa.Table) -> pa.Table:
        x = _vectors(segment["embedding"], size)
        forest = Forest.over(x, planes(trees, size, seed))
        whole = {c: pa.array([np.asarray(segment[o])], pa.list_(pa.int64())) for c, o in (("rows", "row"), ("ids", "vec_id"))}
        return pa.table(whole | {c: pa.array([v.tobytes()], pa.binary()) for c, v in (("vectors", x), ("strings", forest.keys), ("places", forest.order))})

    return run


def _first(found: list[tuple[np.ndarray, ...]], k: int) -> list[tuple[np.ndarray, ...]]:
    """The k best of each query among what some segments gave: query, its id, vec_id, score."""
    query, own, vec, score = (np.concatenate([f[i] for f in found]) for i in range(4))
    order = np.lexsort((vec, -score, query))
    query, own, vec, score = query[order], own[order], vec[order], score[order]
    start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    return [(query[rank < k], own[rank < k], vec[rank < k], score[rank < k])]


def _search(sent, trees: int, size: int, k: int, share: float, compared: float, seed: int, together: int = 1024) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best of a task's segments for each query of the sent block, by exact products over the forests' candidates."""

    def best(rows: np.ndarray, ids: np.ndarray, exact: np.ndarray, forest: Forest, queries: tuple[np.ndarray, ...], strings: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        own, own_ids, exact_q = queries
        n, squares = len(ids), (exact**2).sum(axis=1)
        long = squares > usual(squares)
        for lo in range(0, len(own), together):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i, votes in enumerate(forest.votes(strings[:, lo : lo + together], max(1, int(share * trees * n / 2))), lo):
                votes[long] = trees
                at = chosen(votes, max(int(compared * n), 8 * k), k + 1)
                at = at[rows[at] != own[i]]
                score = (exact[at] * exact_q[i]).sum(axis=1)  # the same for equal vectors, wherever they stand
                first = np.lexsort((ids[at], -score))[:k]
                for o, v in zip(out, (np.full(len(first), own[i]), np.full(len(first), own_ids[i]), ids[at[first]], score[first]), strict=True):
                    o.append(v)
            yield tuple(np.concatenate(o) for o in out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_ids, q = sent.value
        strings, kind, exact_q = _strings(q, np.zeros(len(q)), planes(trees, size, seed)), q.dtype, q.astype(np.float64)
        found: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            for row in range(b.num_rows):
                rows, ids, x, keys, order = (b.column(i)[row] for i in range(5))
                exact = np.frombuffer(x.as_buffer(), kind).reshape(-1, size).astype(np.float64)
                forest = Forest(np.frombuffer(keys.as_buffer(), np.uint64).reshape(trees, -1), np.frombuffer(order.as_buffer(), np.int32).reshape(trees, -1).astype(np.intp))
                found = _first([*found, *best(np.asarray(rows.values), np.asarray(ids.values), exact, forest, (own, own_ids, exact_q), strings)], k)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in found[0]], ["query", "query_id", "vec_id", "score"])

    return W.tidy(run)


def nearest(vectors: DataFrame, asked: Column, k: int = 20, trees: int = 128, share: float = 1 / 8, compared: float = 0.3, segment_size: int = 4096, block: int = 20_000, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id and score of the k vectors with the largest inner product found for each query.

    vectors has vec_id (whole numbers) and embedding (of floats, kept as such, or of doubles or other numbers, as doubles);
    asked, a condition on them, says which rows are queries. Vectors that are null, zero, of another length than most, or
    hold null or non-finite components take no part, nor do null ids. Rows that repeat an id are rows of their own, as
    candidates and as queries; a query does not find its own row. Ties go to the smaller id. With no vectors, or no queries, no rows.

    Vectors are dealt by bands of length (64 at most) and a hash into segments of about segment_size, so neither a crowded
    direction nor many copies make a task larger; each segment's forest is grown and written once. Queries, a stated set, meet the forests in
    blocks of a bounded number. A search ascends until a tree holds between half and the whole of `share` of the segment on average;
    of what it met, the rows in most trees are compared exactly, at most `compared` of the segment (8 k rows at least;
    rows that all trees alike hold, such as copies of the query, all), and the longest fiftieth of a segment always. The best of all segments are merged.
    """
    spark = vectors.sparkSession
    whole_ids(vectors, "vec_id")
    e = F.col("embedding")
    kind = "float" if isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast(f"array<{kind}>").alias("embedding"), F.coalesce(asked, F.lit(False)).alias("asked"))
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    usable = some.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(fine)
    base = written(usable.withColumns({"size": F.size("embedding"), "row": F.monotonically_increasing_id()}), "vectors")
    sizes = base.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return none
    size, total = int(sizes["size"]), int(sizes["count"])
    base = base.where(F.col("size") == size)
    count = base.where("asked").count()
    if not count:
        return none
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    segments = -(-total // segment_size)
    lengths = base.select("row", "vec_id", "embedding", square.alias("square"))
    edges = lengths.agg(F.percentile_approx("square", [i / min(segments, 64) for i in range(1, min(segments, 64))], 10_000)).first()[0] if segments > 1 else []
    band = F.size(F.filter(F.array(*[F.lit(float(v)) for v in edges]), lambda v: v < F.col("square"))) if edges else F.lit(0)
    lengths = lengths.withColumn("band", band)
    parts = F.broadcast(lengths.groupBy("band").agg(F.ceil(F.count("*") / segment_size).cast("int").alias("parts")))  # 64 rows at most
    dealt = lengths.join(parts, "band").withColumn("segment", F.col("band") + 64 * F.pmod(F.xxhash64("row"), F.col("parts"))).select("row", "vec_id", "embedding", "segment")
    grown = dealt.repartition(min(segments, 20 * tasks_for(spark)), "segment").groupBy("segment").applyInArrow(_grown(trees, size, seed), _FOREST)
    forests = written(grown, "forests")
    blocks, found = -(-count // block), None
    for n in range(blocks):
        own = base.where("asked").where(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(blocks)) == n).select("row", "vec_id", "embedding").toArrow()
        sent = spark.sparkContext.broadcast((np.asarray(own["row"]), np.asarray(own["vec_id"]), _vectors(own["embedding"], size)))
        part = forests.mapInArrow(_search(sent, trees, size, k, share, compared, seed), "query long, query_id long, vec_id long, score double")
        part = written(_best(part, k), "nearest")
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
