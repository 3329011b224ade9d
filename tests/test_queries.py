"""Every query of the log against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidemark.operators import log
from tidemark.plans import live, queries

SF = "/root/testdata/sf0.001"
ALL = queries.QUERIES | live.QUERIES
SQL = queries.ORACLES | live.ORACLES
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("documents", "events", "orders", "pages"):
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


def plain(v):
    return None if v != v else int(v) if isinstance(v, float) and v == int(v) else v


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, con, name):
    df = ALL[name](spark, SF)
    got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    want = con.sql(SQL[name])
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == kinds
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(ALL) == set(SQL)


def test_newest_k_is_a_top_k_plan(spark):
    plan = queries.query_by_trace(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_ring_needs_no_window(spark):
    plan = queries.ring_view_after_eviction(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastNestedLoopJoin" in plan


@pytest.mark.parametrize("name", ["format_units_of_all", "progress_bars_of_all"])
def test_every_event_is_formatted(spark, name):
    assert ALL[name](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_format_units_reads_odd_and_even_events(spark):
    assert ALL["format_units"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_units_of_null_and_negative_ids_agree_with_sql(spark, tmp_path):
    path = tmp_path / "events.parquet"
    spark.createDataFrame([(i,) for i in (None, -101, -100, -1, 0, 1, 2, 97, 98)], "event_id long").write.parquet(str(path))
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{path}/*.parquet'")
    want = sorted(c.sql(SQL["format_units"]).fetchall(), key=str)
    assert len(want) == 9 and (None, None, None, None) in want
    assert sorted(map(tuple, ALL["format_units"](spark, str(tmp_path)).collect()), key=str) == want


def test_every_log_is_pruned(spark):
    df = spark.createDataFrame([(u, 10 * u + i, 300) for u in (1, 2) for i in range(3)] + [(None, 40, 300), (None, 41, 300)], "user_id int, offset long, length long")
    by = ("user_id",)
    got = log.prunable(log.segments(df, 400, by), 100, by).collect()
    assert sorted((str(r.user_id), r.seg_base) for r in got) == [("1", 10), ("1", 11), ("2", 20), ("2", 21), ("None", 40)]


@pytest.mark.parametrize("name", ["format_units_of_all", "format_units"])
def test_sizes_beyond_a_petabyte_agree_with_sql(spark, tmp_path, name):
    path = tmp_path / "events.parquet"
    spark.createDataFrame([(i,) for i in (0, 2, 954_036, 954_038, 5_999_998)], "event_id long").write.parquet(str(path))
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{path}/*.parquet'")
    want = sorted(c.sql(SQL[name]).fetchall())
    assert sorted(map(tuple, ALL[name](spark, str(tmp_path)).collect())) == want
    assert want[-1][1].endswith(" TB")
