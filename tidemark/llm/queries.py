"""The operators over the standard tables, as the driver calls them: name -> f(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontam, dedup, html, passages, quality, tokenfile, toxicity, urlfilter, warc
from tidemark.llm.common import new_path, small_batches

VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_spans(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), new_path(spark, "tokens"), eos=2)


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


def op3_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_rows(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op8_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.BLOCK, urlfilter.ALLOW)


def op9_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_warc_archive": op2_warc_archive,
    "op3_toxicity_fm": op3_toxicity_fm,
    "op4_decontamination": op4_decontamination,
    "op5_html_tag_paths": op5_html_tag_paths,
    "op6_passage_dedup": op6_passage_dedup,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_url_cascade": op8_url_cascade,
    "op9_adaptive_quality": op9_adaptive_quality,
    "op10_bpe_automaton": op10_bpe_automaton,
}

#: DuckDB SQL for the queries that SQL can express on whole tables in reasonable time.
ORACLES: dict[str, str] = {
    "op2_warc_archive": warc.ORACLE,
    "op4_decontamination": decontam.ORACLE,
    "op7_near_duplicates": dedup.oracle(3, 85, 100),
    "op8_url_cascade": urlfilter.ORACLE,
    "op9_adaptive_quality": quality.oracle(),
}
