"""The pipeline over the smallest tables, each stage against its own input, and the contract of the entry file."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tidemark.llm import toxicity
from tidemark.llm.common import materialize, written

from .helpers import components, contamination, shingle_sets

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(corpus_pipeline.__file__)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(materialize(stage(spark, made[-1], SF), f"test-{name}"))
    return made


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert [f.dataType for df in stages[1:-1] for f in df.schema] == [f.dataType for f in stages[0].schema] * 4


def test_toxicity_stage(spark, stages):
    machine = toxicity.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in toxicity.score(stages[0], machine).where("predicted = 0").collect()}
    assert {r.doc_id for r in stages[1].collect()} == want


def test_near_duplicate_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    comp = components(shingle_sets(rows, 5), 80, 100)
    assert {r.doc_id for r in stages[2].collect()} == set(comp.values())


def test_passage_stage(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert set(after) <= set(before)
    for i, r in after.items():
        assert set((r.text or "").split()) <= set((before[i].text or "").split())
        assert r.text == before[i].text or r.n_chars == len(r.text)


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in stages[3].collect()]
    want = {r[0] for r in contamination(rows, items) if not r[5]}
    assert {r.doc_id for r in stages[4].collect()} == want


def test_encoding_stage(stages):
    rows = {r.doc_id: r for r in stages[5].collect()}
    texts = {r.doc_id: r.digest for r in stages[4].select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")).collect()}
    assert {i: r.decoded_sha256 for i, r in rows.items()} == texts and all(r.n_tokens * 4 == len(r.ids) for r in rows.values())


def test_run_is_the_stages(spark, stages):
    before = written()
    assert corpus_pipeline.run(spark, SF).count() == stages[-1].count()
    assert len(set(written()) - set(before)) <= 8  # the last two stages' tables


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    """Copied without this subpackage and the pipeline, the entry file still offers the other queries."""
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; n = e.queries(); assert 'query_by_trace' in n and 'pipeline' not in n and not any(x.startswith('op1_') for x in n); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": ""})


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "tidemark")):
        if "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, f)).read()
