"""Fixture values of the metadata scanner, enrichment, validation and rendering."""

from __future__ import annotations

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import json as js
from tidemark.functions import text as tx
from tidemark.model import ConsoleFilter, EngineConfig, Headers, LogQuery, http_limit
from tidemark.operators import hub, ingest, log, metrics, otlp, render


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        ('{"trace_id":"t1","service":"svc","level":"warn"}', ("t1", "svc", "warn")),
        ('{"traceId":"t2"}', ("t2", "topic", "INFO")),
        ('{"traceId":"c","trace_id":"s"}', ("s", "topic", "INFO")),
        ('{"severity":"error"}', ("", "topic", "error")),
        ('{"level":"info","severity":"err"}', ("", "topic", "info")),
        ('{"meta":{"service":"inner","trace_id":"z"},"service":"outer","trace_id":"x"}', ("x", "outer", "INFO")),
        ('{"n":123,"tags":["a","b"],"ok":true,"service":"s","trace_id":"t"}', ("t", "s", "INFO")),
        ('{ "service" : "s" , "trace_id" : "t" }', ("t", "s", "INFO")),
        ('{"service":"a\\"b","trace_id":"t"}', ("t", 'a"b', "INFO")),
        ("plain text log line", ("", "topic", "INFO")),
        ("{}", ("", "topic", "INFO")),
        ('{"service":"a","service":"b"}', ("", "b", "INFO")),
        ('{"service":5}', ("", "topic", "INFO")),
        ('{"service":"a\\/b"}', ("", "a\\/b", "INFO")),
        ('{"service":"\\ud83d\\ude00"}', ("", "\\ud83d\\ude00", "INFO")),
        ('{"service":"a","level":"x', ("", "a", "INFO")),
        ('{"service":"a" "level":"warn"}', ("", "a", "warn")),
        ("", ("", "topic", "INFO")),
    ],
)
def test_scan(payload, want):
    assert js.scan_metadata("topic", payload) == want


def test_enrich():
    assert js.enrich('{"trace_id":"own","z":1}', "t", "s", "INFO") == '{"level":"INFO","service":"s","trace_id":"own","z":1}'
    assert js.enrich("hello", "t", "s", "v") == "hello"
    assert js.enrich('"plain-text-log-line"', "", "svc", "") == '"plain-text-log-line"'
    assert js.enrich('{"id":9223372036854775807,"t":1725482400123456789,"f":1.50e3}', "", "s", "") == '{"f":1.50e3,"id":9223372036854775807,"service":"s","t":1725482400123456789}'
    assert js.enrich('{"a":"<&>","service":null} tail', "", "s", "") == '{"a":"\\u003c\\u0026\\u003e","service":"s"}'
    assert js.enrich('{"service":"x"}', "", "s", "") == '{"service":"x"}'


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=5), x, max_size=3), max_leaves=8))
def test_dump_is_json(value):
    text = json.dumps(value)
    if js.valid(text):
        again = js.dump(js._DECODER.decode(text))
        assert json.loads(again) == json.loads(js.dump(json.loads(again, parse_int=js._Literal, parse_float=js._Literal)))


def test_valid():
    assert js.valid(' {"a":1} ') and js.valid("5") and not js.valid('{"a":1} x') and not js.valid("NaN") and not js.valid("01") and not js.valid("") and not js.valid(None)


def test_envelope():
    assert js.envelope('{"TOPIC":"t","payload": {"a": 1} ,"level":5}') == (True, False, "t", '{"a": 1}', "", "", "", "", "")
    assert js.envelope('"text"')[:2] == (True, False)
    assert js.envelope("{broken")[0] is False
    assert js.elements('[{"a":1}, 2,"x"]') == ['{"a":1}', "2", '"x"'] and js.elements("{}") is None and js.elements("[1") is None


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "single", "want"),
    [
        ("clean\ttext", True, "clean\ttext"), ("a\x1b[31mb", True, "a\\x1b[31mb"), ("x\r\ny", True, "x\\r\\ny"), ("x\r\ny", False, "x\\r\ny"), ("\x9b2J", True, "\\u009b2J"),
        ("a‮b⁦c", True, "a[BIDI]b[BIDI]c"), ("a​﻿b", True, "ab"), ("�", True, "\\uFFFD"), ("é\x7f", False, "é\\x7f"), ("", True, ""),
    ],
)
def test_sanitize(spark, raw, single, want):
    assert one(spark, raw, lambda c: tx.sanitize(c, single)) == want


@pytest.mark.parametrize("raw", ["", "plain", 'q"\\', "\b\f\n\r\t", "\x00\x01\x1f", "<a&b> ", "é😀"])
def test_json_quote_agrees(spark, raw):
    assert one(spark, raw, tx.json_quote) == js.quote(raw)


def test_units(spark):
    f = lambda v: one(spark, v, tx.format_bytes, "long")
    assert [f(512), f(1536), f(10485760), f(1280)] == ["512 B", "1.5 KB", "10.0 MB", "1.2 KB"]
    assert one(spark, 1234567, tx.format_number, "long") == "1,234,567"
    assert [one(spark, v, tx.format_uptime, "long") for v in (5, 65, 3605, 90061)] == ["5s", "1m 05s", "1h 00m 05s", "25h 01m 01s"]
    assert one(spark, 3, lambda c: tx.progress_bar(c, F.lit(0)), "long") == "[--------------------] 0.0%"


def test_trim(spark):
    assert one(spark, "   a b　\n", tx.trim) == "a b" and one(spark, "a", tx.trim) == "a" and one(spark, " ", tx.trim) == ""


def test_level_rank(spark):
    df = spark.createDataFrame([("DEBUG",), ("info",), (" Warn ",), ("ERROR",), ("FATAL",), ("odd",)], "v string")
    assert [r[0] for r in df.select(tx.level_rank(F.col("v"))).collect()] == [1, 2, 3, 4, 5, 0]


ENTRY = "offset long, id long, topic string, service string, trace_id string, level string, payload string"


def test_ring_fixture(spark):
    rows = [(i - 1, i, "t", "auth" if i % 2 == 0 else "billing", f"tr-{i % 3 + 1}", "INFO", "{}") for i in range(1, 26)]
    live = hub.ring(spark.createDataFrame(rows, ENTRY), 10)
    ids = lambda q: [r.id for r in hub.query(live, q).collect()]
    assert ids(LogQuery(limit=50)) == list(range(16, 26))
    assert ids(LogQuery(trace_id="tr-1")) == [18, 21, 24] and ids(LogQuery(service=" AUTH ")) == [16, 18, 20, 22, 24] and ids(LogQuery(trace_id="none")) == []
    assert ids(LogQuery(service="auth", limit=2)) == [22, 24]
    assert hub.query_json(hub.query(live.withColumn("ts", F.lit("2024-01-01").cast("timestamp")), LogQuery(trace_id="none"))).first().body == "[]"


def test_stats_fixture(spark):
    rows = [(i, i + 1, "t", f"svc-{i % 3}", f"trace-{i:03d}", "INFO", "{}") for i in range(15)]
    s = hub.stats(spark.createDataFrame(rows, ENTRY), 5).first()
    assert (s.current_size, s.total_ingested, s.indexed_traces, s.indexed_services) == (5, 15, 5, 3)


def test_bounded_subscriber(spark):
    rows = [(i, i, "t", "s", "", "INFO", "{}") for i in range(300)]
    assert hub.bounded_subscriber(spark.createDataFrame(rows, ENTRY)).first() == (256, 44, 255)


def test_console_filters(spark):
    rows = [(i, i, "t", "Payment-API", "trace-abc-123", v, p) for i, (v, p) in enumerate([("DEBUG", "order_456_failed"), ("INFO", "order_success"), ("WARN", "x"), ("ERROR", "x"), ("FATAL", "x")])]
    df = spark.createDataFrame(rows, ENTRY)
    ids = lambda f: [r.id for r in hub.console_filter(df, f).orderBy("offset").collect()]
    assert ids(ConsoleFilter(level="WARN")) == [2, 3, 4] and ids(ConsoleFilter(grep=r"order_\d+_failed")) == [0]
    assert ids(ConsoleFilter(service="payment-api", trace_id="trace-abc-123", limit=2)) == [0, 1] and ids(ConsoleFilter(trace_id="TRACE-abc-123")) == []
    assert ids(ConsoleFilter(level="unknown")) == [0, 1, 2, 3, 4]


def test_refused_and_limits(spark):
    assert hub.refused(spark.createDataFrame([(0, 0, "", None, "", "", "")], ENTRY)).count() == 1
    assert [http_limit(x) for x in (None, "x", "-1", "7")] == [100, 100, 100, 7] and LogQuery(limit=50_000).clamped() == 10_000


def ndjson(spark, body, strict=False, **headers):
    judged = ingest.ndjson(ingest.lines(spark.createDataFrame([(1, body)], "req int, body string")), Headers(**headers))
    kept = ingest.until_abort(judged, strict, ["req"]).persist()
    return kept, ingest.ndjson_summary(kept).first()


def test_ndjson(spark):
    _, s = ndjson(spark, '{"topic":"orders","payload":{"a":1}}\n{"topic":"orders","payload":2}\r\n\r\n\t\n{"topic":"orders"}')
    assert (s.status, s.ingested, s.errors, s.lines, s.first_error) == ("accepted", 3, 0, 5, None)
    _, s = ndjson(spark, '{"topic":"a"}\n{broken-json-payload-line\n{"topic":"b"}')
    assert (s.status, s.ingested, s.errors, s.first_error.line, s.first_error.code) == ("partial_success", 2, 1, 2, "invalid_json_line")
    k, _ = ndjson(spark, '{"topic":"a"}\n{broken\n{"topic":"b"}', strict=True)
    assert [(r.line, r.code) for r in k.orderBy("line").collect()] == [(1, None), (2, "invalid_json_line")]
    assert ndjson(spark, "")[1].status == "empty_body" and ndjson(spark, "{x\n{y")[1].status == "all_lines_invalid"
    k, s = ndjson(spark, '{"topic":"ok"}\n{"topic":"' + "x" * 65_536 + '"}')
    assert (s.ingested, s.errors, s.first_error.line, s.first_error.code) == (1, 1, 2, "topic_too_long")
    k, _ = ndjson(spark, '{"a":1}\n5\n{"topic":7,"payload":null}', topic="auth", trace_id="tr", service="svc", level="WARN")
    assert [(r.topic, r.service, r.trace_id, r.level) for r in k.collect()] == [("auth", "svc", "tr", "WARN")] * 3
    assert k.where("line = 2").first().payload == "5"


def test_batch(spark):
    def first(body, **h):
        items = ingest.batch_items(spark.createDataFrame([(1, body)], "req int, body string"), Headers(**h))
        return ingest.batch_summary(items, ("req",)).first()

    assert first('[{"topic":"a","payload":{"x":1}},{"service":" s ","payload":5}]').status == "ok"
    assert first("[]").status == "empty_batch" and first("{}").status == "invalid_json" and first('[{"topic":5,"payload":1}]').status == "invalid_json"
    assert first("[" + ",".join(['{"topic":"a","payload":1}'] * 1001) + "]").status == "batch_too_large"
    r = first('[{"topic":"a","payload":1},{"payload":1}]')
    assert (r.status, r["index"], r.message, r.enqueued) == ("invalid_batch_item", 1, "topic cannot be empty", 0)
    assert first('[{"topic":"a","payload":""}]').message == "payload cannot be empty" and first('[{"payload":1}]', service="s").status == "ok"


def test_single(spark):
    def code(body, **h):
        return ingest.single(spark.createDataFrame([(body,)], "body string"), Headers(**h)).first()

    assert code('{"topic":"t","payload":null}').code is None and code('{"topic":5}').code == "invalid_json" and code("x").code == "invalid_json"
    assert code('{"payload":1}').code == "topic_missing" and code('{"topic":"t"}').code == "payload_empty" and code('{"payload":1}', service=" s ").topic == "s"
    big = code('{"topic":"t","payload":"' + "x" * (1 << 20) + '"}')
    assert big.code == "payload_too_large"


def test_assign_is_dense(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("n"))
    rows = ingest.assign(df, ["n"], 7, last_id=10, next_offset=100).orderBy("n").collect()
    assert [r.offset for r in rows] == list(range(100, 1100)) and [r.id for r in rows][:2] == [11, 12]


def test_admission_and_segments(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([60, 50, 30, 10, 5])], "offset long, length long")
    assert [r.admitted for r in log.admit_by_bytes(rows, 100).orderBy("offset").collect()] == [True, False, True, True, False]
    assert [r.seg_base for r in log.segments(rows, 80).orderBy("offset").collect()] == [0, 1, 1, 3, 3]
    ev = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, -2), (4, 1)], "seq long, delta int")
    assert [r.admitted for r in log.admit_events(ev, 2).orderBy("seq").collect()] == [True, True, False, True, True]


def test_commit_target(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "offset long")
    assert log.commit_target(df, 0, 99).first() == (True, 0) and log.commit_target(df, 2, 0).first() == (False, 2) and log.commit_target(df, 0, 2).first() == (False, 3)


def test_capped_topics(spark):
    df = spark.range(5000).select(F.col("id").alias("offset"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("topic"))
    rows = metrics.capped_topic_counts(df).collect()
    assert len(rows) == 1000 and sum(r.n for r in rows) == 5000 and {r.topic: r.n for r in rows}["__overflow__"] == 4001


def test_sparkline(spark):
    f = lambda v: spark.createDataFrame([(v,)], "v array<double>").select(metrics.sparkline(F.col("v"))).first()[0]
    assert f([0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0]) == " ▂▃▄▅▆▇█" and f([5.0, 5.0]) == "▅▅" and f([0.0, 0.0]) == "  " and f([]) == ""


def test_exposition_scan(spark):
    text = ["# HELP x", "log_uncommitted_records 342", "log_storage_disk_bytes 10485760", 'log_delivered_records_total{topic="a b"} 500', 'log_delivered_records_total{topic="c"} 700', "log_sink_flushes_total 85", "log_sink_errors_total 2", "log_sink_retries_total 5", "log_uncommitted_records junk", ""]
    df = spark.createDataFrame(list(enumerate(text)), "line_no long, line string")
    assert metrics.scan_exposition(df).first() == (342, 10485760, 1200, 85, 2, 5)


def test_bounded_lines(spark):
    df = spark.createDataFrame([("a" * 12 + "\n" + "b" * 100 + "\n" + "c" * 12,)], "body string")
    assert [(len(r.data), r.truncated) for r in render.bounded_lines(df, 30).collect()] == [(12, False), (30, True), (12, False)]


def test_otlp_json(spark):
    trace = "0af7651916cd43dd8448eb211c80319c"
    body = json.dumps({"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "auth-service"}}]}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [{"timeUnixNano": "1725482400123456789", "severityNumber": 9, "severityText": "WARN", "traceId": trace, "body": {"kvlistValue": {"values": [{"key": "k", "value": {"arrayValue": {"values": [{"intValue": "5"}, {"doubleValue": 0.5}, {"bytesValue": "AQI="}]}}}]}}}]}]}]})
    (topic, payload), = otlp.decode_request(body, False, 0)
    p = json.loads(payload)
    assert topic == "auth-service" and p["level"] == "WARN" and p["trace_id"] == trace and p["timestamp"] == "2024-09-04T20:40:00.123456789Z" and p["body"] == {"k": [5, 0.5, "0102"]}
    df = spark.createDataFrame([(1, body), (2, "{bad")], "req int, body string")
    assert [(r.req, r.topic, r.code) for r in otlp.records(df, False, 0).orderBy("req").collect()] == [(1, "auth-service", None), (2, None, "invalid_request")]


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(no, data):
    return varint(no << 3 | 2) + varint(len(data)) + data


def test_otlp_protobuf(spark):
    text = lambda s: field(1, s.encode())
    pair = lambda k, v: field(1, k.encode()) + field(2, text(v))
    rec = varint(1 << 3 | 1) + (1_000_000_007).to_bytes(8, "little") + varint(2 << 3) + varint(17) + field(5, text("boom")) + field(9, bytes(range(16))) + field(6, pair("k", "v"))
    request = field(1, field(1, field(1, pair("service.name", "billing-service"))) + field(2, field(1, text("sc")) + field(2, rec)))
    df = spark.createDataFrame([(bytearray(request),), (bytearray(b"\xff"),)], "body binary")
    good, bad = otlp.records(df, True, 0).collect()
    p = json.loads(good.payload)
    assert good.topic == "billing-service" and p["level"] == "ERROR" and p["trace_id"] == bytes(range(16)).hex() and p["body"] == "boom" and p["attributes"] == {"k": "v"} and p["scope"] == "sc"
    assert p["timestamp"] == "1970-01-01T00:00:01.000000007Z" and bad.code == "invalid_request"


def test_settings():
    assert EngineConfig.from_settings({"batch_size": "7"}, {"LOG_BATCH_SIZE": "9", "LOG_RING_CAPACITY": "11"}).batch_size == 7
    assert EngineConfig.from_settings({}, {"LOG_RING_CAPACITY": "11"}).ring_capacity == 11
    with pytest.raises(ValueError):
        EngineConfig.from_settings({}, {"LOG_BATCH_SIZE": "many"})
