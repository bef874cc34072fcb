"""Mixing sources to target weights: random keys, a range sort in each source, prefix sums, an exact cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import running, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most_repeats: int = 3) -> DataFrame:
    """One row a source: its size, weight and target.

    Sources by code point, null last, take the weights in turn and share share x all sizes by them; a target stops at
    most_repeats times its source's size and what it leaves goes to the others by weight. The level at which all
    targets fit is found at once: sources sorted by how soon they fill up, the first few full, the rest level.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_repeats)
    whole = Window.partitionBy(F.lit(0))
    filled = whole.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(filled), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    )
    tried = capped.withColumn("level", level).withColumn("fits", F.col("cap") / F.col("weight") >= F.col("level"))
    at = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(at * F.col("weight"), F.col("cap").cast("double")))
    return tried.select("source", "source_size", "weight", target.alias("target"))


def _key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most_repeats: int = 3, seed: int = 17, ties: Sequence[str] = ()) -> DataFrame:
    """Adds source_size, target, taken and copies to rows of doc_id, source and size (columns so named are replaced;
    others may have any names).

    A source's rows get keys that look random (md5 of seed and id) and are sorted by them; prefix sums of sizes place
    each row in its source's line. The line is taken whole as often as the target holds it, then once more up to the
    budget, where the row across the cut goes in if at least half of it lies before. taken is size times the copies.
    Null ids share one key; rows of one id and size come by the columns of ties; equal rows differ by place only. Empty
    rows (size 0) take 0; a null source is one of its own. No rows: no rows. The narrow rows are written first, so what
    sizes are made of is read once.
    """
    new = ("source_size", "target", "taken", "copies")
    kept = [c for c in rows.columns if c.lower() not in new]
    told = {f"tie{i}": F.col(c) for i, c in enumerate(ties)}
    own = rows.select("source", "doc_id", F.col("size").cast("long").alias("size"), _key(seed).alias("key"), *[c.alias(n) for n, c in told.items()], F.struct(*kept).alias("row"))
    own = written(own, "mix-rows")
    lined = running(own, ["source", "key", "doc_id", "size", *told], {"start": "size"}, "mix", within=["source"])
    targets = source_targets(own, weights, share, most_repeats).withColumnRenamed("source", "of_source").drop("weight")
    both = lined.join(F.broadcast(targets) if _few(targets) else targets, F.col("source").eqNullSafe(F.col("of_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    once_more = (rest - F.col("start") >= F.col("size") / 2) & (epochs < most_repeats) & (F.col("size") > 0)
    copies = (epochs + F.when(once_more, 1).otherwise(0)).cast("long")
    both = both.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return both.select(*[F.col("row").getField(c).alias(c) for c in kept], *new)


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most_repeats: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: each row of docs (doc_id, source, text and more, under any names) as often as it is taken, columns
    unchanged.

    A source's cut is one place in its line of keys, so the rows need no join by id: a table of cuts, a row a source,
    tells each row its copies. Rows of one key, as those without an id, come by id, size and hashes of all columns; if the
    cut falls among wholly equal rows, as many of them as stand before it are taken once more. Rows without words stand
    in the line too. No rows: no rows.
    """
    size, hashes = word_count(F.col("text")), {f"h{i}": F.xxhash64(F.lit(i), *docs.columns) for i in (1, 2)}
    narrow = docs.select("doc_id", "source", size.alias("size"), *[h.alias(c) for c, h in hashes.items()])
    taken = mix(narrow, weights, share, most_repeats, seed, list(hashes)).withColumn("key", _key(seed))
    most = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("int")
    taken = taken.withColumn("epochs", most).withColumn("rest", F.struct("doc_id", "size", *hashes))
    more = (F.col("copies") > F.col("epochs")) & (F.col("size") > 0)
    lasts = taken.groupBy("source").agg(F.max("epochs").alias("times"), F.max(F.when(more, F.struct("key", "rest"))).alias("cut"))
    lasts = written(lasts.select(F.col("source").alias("of_source"), "times", F.col("cut.key").alias("last"), F.col("cut.rest").alias("last_rest")), "mix-lasts")
    at_last = (F.col("key") == F.col("last")) & (F.col("rest") == F.col("last_rest"))
    both = taken.join(F.broadcast(lasts) if _few(lasts) else lasts, F.col("source").eqNullSafe(F.col("of_source")) & at_last)
    ties = both.groupBy(F.col("source").alias("tie_source")).agg(F.count("*").alias("tied"), F.count(F.when(F.col("copies") > F.col("times"), 1)).cast("int").alias("some"))
    cuts = written(lasts.join(ties, F.col("of_source").eqNullSafe(F.col("tie_source")), "left").drop("tie_source"), "mix-cuts")
    rest = F.struct("doc_id", size.alias("size"), *[h.alias(c) for c, h in hashes.items()])
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("source"), _key(seed).alias("key"), rest.alias("rest"))
    keyed = keyed.join(F.broadcast(cuts) if _few(cuts) else cuts, F.col("source").eqNullSafe(F.col("of_source")))
    whole = F.col("some") == F.col("tied")
    first = (F.col("rest") < F.col("last_rest")) | (whole & (F.col("rest") == F.col("last_rest")))
    among = F.when(F.col("key") < F.col("last"), 1).when(F.col("key") == F.col("last"), F.when(first, 1).otherwise(0))
    copies = F.col("times") + F.coalesce(among, F.lit(0))
    out = keyed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")
    if not cuts.where(~whole).limit(1).count():
        return out
    split = keyed.where(~whole & (F.col("key") == F.col("last")) & (F.col("rest") == F.col("last_rest")))
    one = split.groupBy("of_source", "some").agg(F.first("row").alias("row"))
    return out.unionByName(one.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("some")))).select("row.*"))


def _few(targets: DataFrame, most: int = 100_000) -> bool:
    """Whether the sources are few enough to send to every task."""
    return targets.limit(most + 1).count() <= most
