"""The corpus pipeline: ``documents`` filtered for toxicity, near-duplicates, repeated passages and benchmark
contamination, then encoded.  Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import materialize, release_since, written
from tidemark.llm.stages import STAGES

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: The toxicity stage is a learned model, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``.  What a stage wrote, and its input, goes when its result is
    written; the last but one result stays, as the rows returned are made from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release_since(before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
