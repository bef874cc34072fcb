"""The queries of this subpackage, by name, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, jaccard, lattice, mixing, quality, sanitise, sharding, toxicity, turntrie, variants, wavelet
from .labelled import fold
from .store import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies; the same on all machines."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    wavelet.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return wavelet.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "segment")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), folds=5, held=0)
    out = quality.score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    one = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    both = turns.unionByName(one.select("conv_id", "t.turn", "t.role", F.lit(said).alias("text")))
    path = fresh_path(spark, "chat")
    chat.chat_windows(both, tokenizer=tokenizer_file("byte_bpe_50k.json")).write.parquet(path)
    return chat.digests(spark.read.schema(chat.SCHEMA).parquet(path))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_texts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("_md5"))
    out = sharding.shard_by_bytes(rows, 8, F.col("_md5"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(rows).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = toxicity.fit(docs, table(spark, sf_dir, "labels"), folds=3, held=1)
    out = toxicity.tag(docs, field)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.digests(sanitise.private_data(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.prefix_trie(turntrie.rebuilt(turntrie.turn_sequences(table(spark, sf_dir, "conversations"))))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS norm, least(len(w), 13) AS n
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
h AS (SELECT p.doc_id, p.i, v.n, v.item_id FROM p JOIN v ON p.n = v.n AND array_to_string(p.w[p.i:p.i + p.n - 1], ' ') = v.norm),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3 AS cap,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level FROM w
      WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT level FROM l WHERE cap / weight >= level ORDER BY cap / weight LIMIT 1)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('17:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN target - epochs * source_size - start >= size / 2 AND epochs < 3 AND size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""

def _crc32(codes: str) -> str:
    """SQL of the crc32 of a list of byte values, bit by bit."""
    steps = f"flatten(list_transform({codes}, lambda c: [c, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce([4294967295::BIGINT] || {steps}, lambda a, c: CASE WHEN c >= 0 THEN xor(a, c) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"


#: UTF-8 of text that has ASCII and Latin-1 letters only
_BYTES = lambda t: f"flatten(list_transform(string_split({t}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END))"

OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1
"""

OP12_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM d WHERE len(w) >= 6 GROUP BY 1, 2),
k AS (SELECT w, n, {_crc32(_BYTES("coalesce(doc_id::VARCHAR, '') || ':' || w"))} AS h FROM c),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substring(w, 1, (h % len(w))::BIGINT) || substring(w, (h % len(w) + 2)::BIGINT) ELSE w END AS word, n FROM k),
v AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE len(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
i AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v),
x AS (SELECT word, substring(word, 1, i - 1) || '*' || substring(word, i + 1) AS gap, substring(word, 1, i - 1) || substring(word, i + 1) AS cut FROM i),
p AS (SELECT a.word, b.word AS o FROM x a JOIN x b ON a.gap = b.gap AND a.word <> b.word UNION SELECT a.word, b.word FROM x a JOIN v b ON a.cut = b.word UNION SELECT b.word, a.word FROM x a JOIN v b ON a.cut = b.word),
t AS (SELECT p.word, count(*) AS n_near, arg_min(o, (-v.n, o)) AS best, max(v.n) AS best_n FROM p JOIN v ON v.word = o GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN t USING (word)),
r AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL),
l AS (SELECT r.word, r.at AS root FROM r JOIN f ON f.word = r.at WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN l USING (word)
"""

OP13_SQL = f"""
WITH e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, turn, role, md5(strlen(role) || ':' || role || text) AS k, length(text) AS n FROM e),
own AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, role, k) AS ks, list(n ORDER BY turn NULLS FIRST, role, k) AS ns FROM g GROUP BY 1),
c AS (SELECT *, {_crc32(_BYTES("conv_id::VARCHAR"))} % 6 AS h FROM own),
f AS (SELECT c.conv_id, coalesce(b.ks[1:h], []) || c.ks[h + 1:] AS ks, coalesce(b.ns[1:h], []) || c.ns[h + 1:] AS ns FROM c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, ks, ns, unnest(range(0, len(ks) + 1)) AS d FROM f),
m AS (SELECT ks[1:d] AS path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN ns[d] ELSE 0 END) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(ks)), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
k AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM m WHERE d > 0 GROUP BY 1, 2),
q AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN k USING (path, d)),
u AS (SELECT path, n_children, (n_convs - 1) * chars AS own, unnest(range(0, d + 1)) AS a FROM q),
t AS (SELECT path[1:a] AS path, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM u GROUP BY 1, 2)
SELECT q.conv_id, q.d AS depth, o.conv_id AS parent_conv_id, q.n_convs, q.n_children::BIGINT AS n_children, n_leaves, saved_tokens, q.ends_sha256
FROM q JOIN t USING (path, d) LEFT JOIN q o ON o.d = q.d - 1 AND o.path = q.path[1:q.d - 1]
"""


def queries() -> dict:
    return {
        "op1_token_files": op1_token_files,
        "op2_decontamination": op2_decontamination,
        "op3_nearest": op3_nearest,
        "op4_quality": op4_quality,
        "op5_chat": op5_chat,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_lm_scores": op7_lm_scores,
        "op8_sharding": op8_sharding,
        "op9_mixing": op9_mixing,
        "op10_toxicity": op10_toxicity,
        "op11_private_data": op11_private_data,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op6_jaccard_join": OP6_SQL, "op9_mixing": OP9_SQL, "op12_spelling_variants": OP12_SQL, "op13_conversation_trie": OP13_SQL}
