"""The pipeline's stages: each takes (spark, docs, sf_dir); all but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, dedup, passages, toxicity
from tidemark.llm.common import small_batches

VOCABULARY = "byte_bpe_50k.json"


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, learned from the labelled ones among them, doesn't reject."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_civil(docs, toxicity.train(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), that with the smallest id."""
    small_batches(spark)
    return dedup.drop_near_duplicates(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; n_chars follows the text.  What is left empty goes."""
    small_batches(spark)
    made = passages.dedup_passages(docs)
    changed = F.col("n_words_removed") > 0
    kept = made.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are words of benchmark windows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contamination(docs, benchmark, keep=tuple(docs.columns)).where("not contaminated").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit) and the digests of ids and decoded text."""
    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), keep_ids=True)


STAGES = [
    ("toxicity", civil),
    ("near_duplicates", distinct),
    ("passages", unrepeated),
    ("decontamination", uncontaminated),
    ("bpe", encoded),
]
