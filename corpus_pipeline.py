"""From raw documents to token ids: quality, near-duplicates, benchmark, secrets, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which run() writes as Parquet to the folder that all
executors share and reads again for the next stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import bpe, secrets
from tramline.llm.decontaminate import contaminated_texts
from tramline.llm.graph import shared_dir
from tramline.llm.near_dedup import deduplicated
from tramline.llm.quality import judged

VOCABULARY = "word_bpe_49k.json"


def _with_text(docs: DataFrame, found: DataFrame, changed: Column, text: str) -> DataFrame:
    """The columns of docs, with the new text and its length where it changed."""
    new = {
        "text": F.when(changed, F.col(text)).otherwise(F.col("text")).alias("text"),
        "n_chars": F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    }
    return found.select(*(new.get(c, found[c]) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without lines that too many of their source's documents share.

    Rows are judged by their texts and sources: equal rows alike, ids may be null
    or repeated.  Null and empty texts fail; texts are judged whole.  Further
    columns of docs stay; none may be called as one that judged() adds.
    """
    return _with_text(docs, judged(docs).where("kept"), F.col("removed_words") > 0, "clean_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id.

    Of rows with the same id, or without, and equal texts one stays as well.  Rows
    without words are in no group and stay.  Further columns of docs stay.
    """
    return deduplicated(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Texts are told apart by their SHA-256, so that rows without an id, or with the
    same, are judged each by its own text; null texts count as empty and stay.
    Further columns of docs stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = contaminated_texts(docs, benchmark).withColumnRenamed("digest", "contaminated_")
    digest = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    return docs.join(gone, digest == F.col("contaminated_"), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark.

    Rows are scanned one by one, whole; null texts stay null.  Further columns of
    docs stay; none may be called as one that scan() adds, or clean_text.
    """
    found = secrets.scan(docs).withColumn("clean_text", secrets.redacted(F.col("text"), F.col("spans")))
    return _with_text(docs, found, F.size("spans") > 0, "clean_text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to.

    Rows are encoded one by one, whole; null texts have no tokens.  Further columns
    of docs stay; none may be called n_tokens, ids or decoded.
    """
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    return bpe.encode(docs, str(public_tokenizers.path(VOCABULARY)), keep=keep, decoded=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("bpe", encode),
]

#: SQL can express neither the sketches' candidates nor the merges; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
