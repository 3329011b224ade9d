from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.api import EventLog
from tidemark.operators import ingest, scratch
from tidemark.model import ConsoleFilter, EngineConfig, Headers
from tidemark.sources import load
from tidemark.streaming import delivery


@pytest.fixture
def events(spark, tmp_path):
    return EventLog(spark, str(tmp_path / "log"), EngineConfig.service(max_capacity=8, batch_size=2), clock=lambda: 1_725_482_400_123_456_789)


def test_enqueue_query_deliver(events):
    assert events.query_logs().count() == 0 and events.get_stats()["records"] == 0
    got = events.enqueue(['{"topic":"orders","payload":{"trace_id":"t1","level":"error"}}', '{"payload":1}', '{"payload":"x"}'], Headers(service="Billing"))
    assert [x.get("status", x.get("error")) for x in got] == ["accepted", "accepted", "accepted"] and got[1]["topic"] == "Billing"
    assert events.enqueue(["{broken"])[0] == {"error": "invalid_json"}
    assert [r.topic for r in events.query_logs(service="billing").collect()] == ["orders", "Billing", "Billing"]
    assert [r.id for r in events.query_logs(trace_id="t1").collect()] == [1]
    assert events.enqueue_ndjson('{"a":1}\n{bad\n{"a":2}', Headers(topic="web"))["status"] == "partial_success"
    assert events.enqueue_batch('[{"topic":"b","payload":1},{"payload":1}]')["index"] == 1
    assert events.enqueue_batch('[{"topic":"b","payload":1}]')["enqueued"] == 1
    stats = events.get_stats()
    assert (stats["total_ingested"], stats["records"]) == (6, 6)
    assert [r.offset for r in events.records().orderBy("offset").collect()] == list(range(6))
    assert events.grep(ConsoleFilter(level="error")).count() == 1
    full = events.enqueue(['{"topic":"t","payload":1}'] * 3)
    assert [x.get("error") for x in full] == [None, None, "spool_full"]
    sent = []
    counters = events.flush(lambda items, timeout: sent.extend(json.loads(x)["offset"] for x in items))
    assert sent == list(range(8)) and counters["delivered"] == 8 and events.checkpoint() == 8 and events.get_stats()["records"] == 0
    assert events.enqueue(['{"topic":"t","payload":1}'])[0]["status"] == "accepted"
    assert events.query_logs(limit=1).first().id == 9


def test_otlp_and_failed_delivery(events):
    body = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"body": {"stringValue": "x"}, "severityNumber": 17}]}]}]})
    assert events.enqueue_otlp(body) == {"enqueued": 1} and events.enqueue_otlp("{") == {"error": "invalid_request"}
    assert events.query_logs(level="error").first().topic == "otel_logs"

    def down(items, timeout):
        raise delivery.Transient("down")

    with pytest.raises(delivery.Transient):
        events.flush(down, max_attempts=2, sleep=lambda s: None)
    assert events.checkpoint() == 0


def test_each_batch_is_committed(events):
    events.enqueue(['{"topic":"t","payload":1}'] * 5)
    sent = []

    def third_fails(items, timeout):
        if len(sent) == 2:
            raise delivery.Transient("down")
        if len(sent) == 1:
            sent.append("rejected")
            raise delivery.Rejected("no")
        sent.append(len(items))

    with pytest.raises(delivery.Transient):
        events.flush(third_fails, max_attempts=2, sleep=lambda s: None)
    assert events.checkpoint() == 4  # the batch taken and the batch rejected are done
    assert events.flush(lambda items, timeout: sent.extend(items))["delivered"] == 1 and events.checkpoint() == 5


def test_close_drains_and_refuses(events):
    events.enqueue(['{"topic":"t","payload":1}'] * 3)

    def slow(items, timeout):
        raise delivery.Transient("down")

    assert events.close(slow, drain_s=0.2)["delivered"] == 0 and events.checkpoint() == 0
    assert events.close() == {}
    with pytest.raises(RuntimeError):
        events.enqueue(['{"topic":"t","payload":1}'])
    again = EventLog(events.spark, events.path, events.config)
    assert again.close(lambda items, timeout: None)["delivered"] == 3 and again.checkpoint() == 3


def test_one_writer(events):
    with events._writing(), pytest.raises(RuntimeError):
        events.enqueue(['{"topic":"t","payload":1}'])
    fs, lock = events._file("writer.lock")
    fs.createNewFile(lock)
    events.unlock()
    assert events.enqueue(['{"topic":"t","payload":1}'])[0]["status"] == "accepted"


@pytest.mark.parametrize("n", [0, 100_000, 600_000])
def test_offsets_are_dense_at_size(spark, n):
    rows = spark.range(0, n, 1, 8).select((F.hash("id") % 1000).alias("a"), F.col("id").alias("b"), F.repeat(F.col("id").cast("string"), 40).alias("payload"))
    got = ingest.assign(rows, ["a", "b"], 5, 10, 100)
    s = got.agg(F.count("*"), F.countDistinct("offset"), F.min("offset"), F.max("offset"), F.min(F.col("id") - F.col("offset")), F.countDistinct("b")).first()
    assert tuple(s) == ((n, n, 100, 99 + n, -89, n) if n else (0, 0, None, None, None, 0))
    before = F.lag(F.struct("a", "b")).over(Window.orderBy("offset"))
    assert got.select("offset", "a", "b").withColumn("p", before).where(F.col("p") > F.struct("a", "b")).count() == 0
    scratch.drop(got)


def test_load(spark):
    assert load.requests(spark, 10, workers=2).select("worker").distinct().count() == 2
    assert load.request_stream(spark, 5).isStreaming
