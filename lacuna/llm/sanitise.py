"""Information-theoretic sanitisation: personal data by form, and the terms that give it away. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import free, written

#: Fixed forms, in the order in which spans are listed. They are the published patterns; what can't match anew after a failure is
#: kept from being tried again (possessive runs, runs entered at their start), so that no text costs more than its length.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold at least for each of them.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
RANK = {k: i for i, k in enumerate([*FORMS, "term"])}
WORD = r"[\p{L}\p{N}]+"


def _text(documents: DataFrame) -> DataFrame:
    """key, one for equal texts, and text; null is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.md5(text).alias("key"), text.alias("text"))


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    n = F.length(digits)
    return F.when(kind == "ip", small).when(kind == "card", n.between(16, 19) & F.call_function("luhn_check", digits)).when(kind == "phone", n.between(8, 15)).otherwise(True)


def _matches(texts: DataFrame, form: str, reach: int) -> DataFrame:
    """The leftmost matches of a form that don't overlap: what splits a text at them also says how far they are apart."""
    pieces, hits = F.split("text", form, -1), F.regexp_extract_all("text", F.lit(form), F.lit(0))
    both = texts.select("key", "copies", pieces.alias("pieces"), hits.alias("hits")).where(F.size("hits") > 0)
    each = both.select("key", "copies", F.posexplode(F.arrays_zip("hits", "pieces", F.slice("pieces", F.lit(2), F.size("hits")).alias("after"))))
    each = each.where("col.hits IS NOT NULL")
    before, after = F.col("col.pieces"), F.col("col.after")
    return each.select("key", "copies", "pos", F.col("col.hits").alias("match"), F.char_length(before).alias("gap"), F.right(before, F.lit(reach)).alias("before"), F.left(after, F.lit(reach)).alias("after"))


def base_spans(documents: DataFrame, reach: int = 300) -> DataFrame:
    """key, kind, start, end, match, copies, before and after of each address, number or account of the four fixed forms.

    Equal texts have one key and are searched once; copies says how many there are. start and end count code points, end
    exclusive. before and after are the up to `reach` code points on either side, to the next match of the kind.
    Matches that fail their kind's test (parts of an ip over 255, cards but 16 to 19 digits that pass Luhn's check, phones but 8 to
    15 digits) are dropped and not tried otherwise.
    """
    texts = _text(documents).where(F.col("text").rlike("|".join(SIGNS.values())))
    texts = written(texts.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "private-texts")
    found = None
    for kind, form in FORMS.items():
        own = _matches(texts.where(F.col("text").rlike(SIGNS[kind])), form, reach).withColumn("kind", F.lit(kind))
        found = own if found is None else found.unionByName(own)
    line = Window.partitionBy("key", "kind").orderBy("pos")
    size = F.char_length("match")
    end = F.sum(F.col("gap") + size).over(line).cast("long")
    placed = found.withColumn("end", end).withColumn("start", F.col("end") - size)
    return placed.where(_valid(F.col("kind"), F.col("match"))).select("key", "kind", "start", "end", "match", "copies", "before", "after")


def _small(df: DataFrame, few: int = 200_000) -> DataFrame:
    """A side of short rows, for all tasks if it is known to have few rows."""
    return F.broadcast(df) if df.limit(few + 1).count() <= few else df


def _terms(text: Column) -> Column:
    """The distinct words of a text of 3 code points or more, made small, and the classes they belong to."""
    own = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.char_length(w) >= 3))
    return F.array_union(own, F.transform(F.filter(own, lambda w: F.char_length(w) > 4), _class))


def _class(term: Column) -> Column:
    """What a term is generalised to: all terms that begin alike."""
    return F.concat(F.left(term, F.lit(3)), F.lit("*"))


def disclosures(documents: DataFrame, base: DataFrame, support: int = 3, share: float = 0.95) -> DataFrame:
    """term, label and removed: the terms that tell too much about an entity of the base spans.

    An entity is a value of the base spans, a term a word of 3 code points or more within reach of it on its line. Over all lines
    of all documents, n(e) lines show the entity, n(t) the term, n(e, t) both near each other; the term discloses
    log(N n(e, t) / n(e) n(t)) of the entity's log(N / n(e)) bits. A term goes if it discloses `share` of them or more and
    stands beside the entity in at least `support` different contexts, so that copies alone make nothing a secret. It is
    generalised to its class, the terms that begin with the same three letters, if the class discloses less, else removed.
    """
    value = F.when(F.col("kind") == "email", F.lower("match")).when(F.col("kind") == "ip", F.col("match")).otherwise(F.regexp_replace("match", "[^0-9]", ""))
    other = "|".join(f"(?:{p})" for p in FORMS.values() if r"\G" not in p) + "|" + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]*+"
    left, right = F.substring_index("before", "\n", -1), F.substring_index("after", "\n", 1)
    edge = F.char_length("before") == F.char_length(left)
    left = F.when(edge, F.regexp_replace(left, f"^{WORD}", "")).otherwise(left)  # the reach may cut a word
    right = F.when(F.char_length("after") == F.char_length(right), F.regexp_replace(right, f"{WORD}$", "")).otherwise(right)
    around = F.regexp_replace(F.concat(left, F.lit(" \n "), right), other, " ")
    near = base.select(F.concat("kind", F.lit(":"), value).alias("entity"), around.alias("around"), "copies")
    near = written(near.select("entity", F.xxhash64("around").alias("context"), "copies", _terms(F.col("around")).alias("terms")), "private-contexts")
    entities = near.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.countDistinct("context").alias("contexts")).where(F.col("contexts") >= support)
    each = near.select("entity", "context", "copies", F.explode("terms").alias("term")).join(entities, "entity")
    pairs = each.groupBy("entity", "term", "n_e").agg(F.sum("copies").alias("n_et"), F.countDistinct("context").alias("support"))
    pairs = written(pairs.where(F.col("support") >= support), "private-pairs")
    asked = written(pairs.select("term").distinct(), "private-terms")
    if not asked.limit(1).count():
        return documents.sparkSession.createDataFrame([], "term string, label string, removed boolean")
    lines = _text(documents).select(F.explode(F.split("text", "\n")).alias("line"))
    seen = lines.select(F.explode(_terms(F.col("line"))).alias("term")).join(_small(asked), "term").groupBy("term").agg(F.count("*").alias("n_t"))
    total = _text(documents).agg(F.sum(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0]
    n = F.lit(float(total))
    told = F.log2(n * F.least(F.col("n_et"), F.col("n_t")) / (F.col("n_e") * F.col("n_t"))) / F.greatest(F.log2(n / F.col("n_e")), F.lit(1e-9))
    known = written(pairs.join(written(seen, "private-counts"), "term").select("entity", "term", (told >= share).alias("tells")), "private-told")
    bad = known.where("tells AND NOT endswith(term, '*')").withColumn("class", F.when(F.char_length("term") > 4, _class(F.col("term"))))
    classes = known.select("entity", F.col("term").alias("class"), F.col("tells").alias("class_tells"))
    both = bad.join(classes, ["entity", "class"], "left").groupBy("term").agg(F.max(F.coalesce("class_tells", F.lit(True))).alias("removed"))
    return both.select("term", F.when(F.col("removed"), F.lit("[term]")).otherwise(_class(F.col("term"))).alias("label"), "removed")


def term_spans(documents: DataFrame, base: DataFrame, terms: DataFrame) -> DataFrame:
    """key, start, end and label of each place where a term stands as a word outside base spans, in any text. Only lines
    that hold a term are taken apart."""
    lines = F.posexplode(F.split("text", "\n")).alias("n", "line")
    words = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0)))
    side = _small(terms.select("term"))
    seen = _text(documents).select("key", lines).select("key", "n", F.explode(words).alias("term")).join(side, "term", "left_semi")
    seen = written(seen.select("key", "n").distinct(), "telling-lines")
    texts = _text(documents).join(_small(written(seen.select("key").distinct(), "telling-keys")), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    past = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = texts.select("key", lines).withColumn("at", F.coalesce(F.sum(F.char_length("line") + 1).over(past), F.lit(0)))
    placed = placed.join(_small(seen), ["key", "n"], "left_semi")
    hits, pieces = F.regexp_extract_all("line", F.lit(WORD), F.lit(0)), F.split("line", WORD, -1)
    each = placed.select("key", "n", "at", F.posexplode(F.arrays_zip(hits.alias("hits"), pieces.alias("pieces")))).where("col.hits IS NOT NULL")
    size = F.char_length("word")
    line = Window.partitionBy("key", "n").orderBy("pos")
    each = each.select("key", "n", "at", "pos", F.col("col.hits").alias("word"), F.char_length("col.pieces").alias("gap"))
    each = each.withColumn("end", F.col("at") + F.sum(F.col("gap") + size).over(line)).withColumn("start", F.col("end") - size)
    found = each.withColumn("term", F.lower("word")).join(_small(terms.select("term", "label")), "term").select("key", "start", "end", "label")
    own = base.select("key", "start", "end", F.lit(None).cast("string").alias("label"))
    here = Window.partitionBy("key").orderBy("start", "end")
    past, rest = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(1, Window.unboundedFollowing)
    mine = F.col("label").isNull()
    both = found.unionByName(own).withColumns({"covered": F.max(F.when(mine, F.col("end"))).over(past), "next": F.min(F.when(mine, F.col("start"))).over(rest)})
    free_ = (F.coalesce("covered", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return both.where(~mine & free_).select("key", "start", "end", "label")


def find_private(documents: DataFrame, support: int = 3, share: float = 0.95) -> DataFrame:
    """key (md5 of the text) and spans (rank, start, end, kind, label; in this order) of each distinct text that has any:
    base spans as base_spans finds them, and, as kind "term", places of the terms of disclosures."""
    base = written(base_spans(documents), "private-spans")
    all_ = base.select("key", "kind", "start", "end", F.concat(F.lit("["), F.col("kind"), F.lit("]")).alias("label"))
    terms = written(disclosures(documents, base, support, share), "telling-terms")
    if terms.limit(1).count():
        all_ = all_.unionByName(term_spans(documents, base, terms).withColumn("kind", F.lit("term")))
    rank = F.element_at(F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (k, v)]), F.col("kind"))
    return all_.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "label"))).alias("spans"))


def private_data(documents: DataFrame, support: int = 3, share: float = 0.95) -> DataFrame:
    """documents with `spans`, an array of find_private's, empty where a text has none, beside their own columns.

    Null and empty texts have no spans; equal texts have equal spans, whatever their ids; no rows, no rows. The new column
    takes another name if documents has one like it.
    """
    key, spans = free(documents.columns, "key", "spans")
    found = written(find_private(documents, support, share), "private-found").select(F.col("key").alias(key), F.col("spans").alias(spans))
    keyed = documents.withColumn(key, F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    none = F.array().cast(found.schema[spans].dataType)
    return keyed.join(found, key, "left").withColumn(spans, F.coalesce(spans, none)).drop(key)


def sanitised(private: DataFrame, spans: str = "spans", name: str = "sanitised") -> DataFrame:
    """private_data's rows with a column of texts whose spans are replaced by their labels: the kind of an entity, a term's
    class, or [term] where even the class would tell too much. Of spans that overlap, the first is replaced."""
    at = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def put(a: Column, s: Column) -> Column:
        part = F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), s["label"])
        return F.when(s["start"] >= a["at"], F.struct(part.alias("out"), s["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))

    done = F.aggregate(at, begin, put, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return private.withColumn(name, done)


def listed(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of spans, comma-joined; of some kinds only, if they are given."""
    own = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(private: DataFrame, spans: str = "spans") -> DataFrame:
    """doc_id, how many base spans of each kind, the digest of the base spans, and all spans as text."""
    own, kinds = F.col(spans), tuple(FORMS)
    names = F.transform(own, lambda s: s["kind"])
    counts = [(F.size(names) - F.size(F.array_remove(names, k))).cast("long").alias(f"n_{k}") for k in kinds]
    return private.select("doc_id", *counts, F.sha2(listed(own, kinds), 256).alias("base_sha256"), listed(own).alias("spans"))
