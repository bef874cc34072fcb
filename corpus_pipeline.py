"""A corpus made ready for training: quality, near duplicates, contamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, in the columns of documents; the last writes
token files and gives what they hold. Stages are written and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import decontaminate, jaccard, mixing, quality, wavelet
from lacuna.llm.queries import table, tokenizer_file
from lacuna.llm.store import fresh_path, written

KEEP_AT = 0.3  # documents whose quality score is lower are rejected
FEW = 1_000_000  # ids that may go to all tasks


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects. Null and empty texts get the score of the bare curve;
    equal texts fare alike, whatever their ids; rows without an id teach nothing but are scored; no rows, no rows."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "_score").where(F.col("_score") >= KEEP_AT).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, five words a shingle, similarity 0.8: the smallest id stays.

    Of rows that share an id one stays too; documents without words, or without an id, all stay.
    """
    groups = jaccard.jaccard_groups(docs, shingle=5, percent=80)
    gone = written(groups.where("component_id != doc_id").select("doc_id").distinct(), "near-copies")
    kept = docs.join(F.broadcast(gone) if gone.count() <= FEW else gone, "doc_id", "left_anti").select(*docs.columns)
    named = docs.where("doc_id IS NOT NULL").select("doc_id")
    if named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL"))
    return kept


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold too much of the benchmark. Null and empty texts have no words and stay; repeated rows
    fare alike; an empty benchmark rejects nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*docs.columns)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. A null source is one of its own; rows without words stand in
    their source's line like others; rows without an id come by id, size and hashes; no rows, no rows."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: a row a document, ascending by id, those without an id first. Null and
    empty texts are a lone end; repeated rows are written as often as they come; no rows, no files to read back."""
    path = fresh_path(spark, "tokens")
    wavelet.write_tokens(docs, path, tokenizer_file())
    return wavelet.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "segment")


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("mixing sources to target weights", mixed_documents),
    ("token-ID / binary output", token_files),
]
#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs
