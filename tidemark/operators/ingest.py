"""Routing, validation and summaries of the three JSON ways in.  Each path resolves its fields in its own way.

Inputs are request bodies (or lines) as text; results are columns added to them: topic, trace_id, service,
level, payload, size, and code/message, null for what is accepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import json as js
from tidemark.functions.text import first_of, trim
from tidemark.model import MAX_BATCH_BYTES, MAX_BATCH_ITEMS, MAX_LINE_BYTES, MAX_PAYLOAD_BYTES, MAX_SINGLE_BODY_BYTES, MAX_TOPIC_BYTES, Headers
from tidemark.operators import scratch


def is_ndjson(content_type: Column) -> Column:
    c = F.lower(F.trim(content_type))
    return c.contains("ndjson") | c.contains("jsonl")


def record_fault(topic: Column, payload: Column, max_payload: int = MAX_PAYLOAD_BYTES) -> Column:
    """Code of the first validation fault of a record, null if it is valid; a limit <= 0 is no limit."""
    n = F.octet_length(payload)
    too_large = n > max_payload if max_payload > 0 else F.lit(False)
    return (
        F.when(F.octet_length(topic) == 0, "topic_missing")
        .when(F.octet_length(topic) > MAX_TOPIC_BYTES, "topic_too_long")
        .when(n == 0, "payload_empty")
        .when(too_large, "payload_too_large")
    )


def fault_status(code: Column) -> Column:
    """HTTP status of a reject code."""
    return F.when(code.isin("payload_too_large", "line_too_long", "batch_too_large"), 413).when(code.isin("spool_full", "storage_unavailable"), 503).when(code == "internal_error", 500).otherwise(400)


def _enriched(df: DataFrame, parity: str) -> DataFrame:
    """Replace ``payload`` by the payload with the routing metadata."""
    if parity == "exact":
        return df.withColumn("payload", js.enrich_udf(F.col("payload"), F.col("trace_id"), F.col("service"), F.col("level")))
    return df


def _read(df: DataFrame, body: str, parity: str) -> DataFrame:
    """Add struct ``_e`` with the envelope's fields."""
    if parity == "exact":
        return df.withColumn("_e", js.envelope_udf(F.col(body)))
    kind = "topic string, payload string, trace_id string, traceId string, service string, level string, severity string"
    parsed = F.from_json(F.col(body), kind)
    text = lambda c: F.coalesce(parsed[c], F.lit(""))
    raw = F.coalesce(F.get_json_object(body, "$.payload"), F.lit(""))
    return df.withColumn("_e", F.struct(js.is_json(F.col(body)).alias("valid"), F.lit(True).alias("typed"), text("topic").alias("topic"), raw.alias("payload"), text("trace_id").alias("trace_id"), text("traceId").alias("trace_camel"), text("service").alias("service"), text("level").alias("level"), text("severity").alias("severity")))


def single(bodies: DataFrame, headers: Headers = Headers(), parity: str = "exact") -> DataFrame:  # noqa: B008
    """One request per row (column ``body``): body fields win over headers and aren't trimmed, topic falls back to
    service, there is no default level, and a payload of null or "" is accepted."""
    e = _read(bodies, "body", parity)
    e = e.withColumns({
        "trace_id": first_of(F.col("_e.trace_id"), trim(F.lit(headers.trace_id))),
        "service": first_of(F.col("_e.service"), trim(F.lit(headers.service))),
        "level": first_of(F.col("_e.level"), trim(F.lit(headers.level))),
        "payload": F.col("_e.payload"),
    }).withColumn("topic", first_of(F.col("_e.topic"), F.col("service")))
    early = (
        F.when(F.octet_length("body") > MAX_SINGLE_BODY_BYTES, "payload_too_large")
        .when(~F.col("_e.valid") | ~F.col("_e.typed"), "invalid_json")
        .when(F.col("topic") == "", "topic_missing")
        .when(F.col("payload") == "", "payload_empty")
    )
    e = _enriched(e.withColumn("_early", early), parity)
    e = e.withColumn("code", F.coalesce("_early", record_fault(F.col("topic"), F.col("payload")))).withColumn("size", F.octet_length("payload").cast("long"))
    return e.drop("_e", "_early")


def lines(bodies: DataFrame, body: str = "body") -> DataFrame:
    """``line`` (from 1, blank lines count) and ``raw`` of every line that isn't blank, and the text ``trimmed``."""
    each = bodies.select("*", F.posexplode(F.split(body, "\r?\n")).alias("_at", "raw"))
    each = each.withColumn("line", (F.col("_at") + 1).cast("long")).withColumn("trimmed", trim(F.col("raw"))).drop("_at")
    return each.where("trimmed <> ''")


def ndjson(each: DataFrame, headers: Headers = Headers(), parity: str = "exact") -> DataFrame:  # noqa: B008
    """One line per row (``line``, ``trimmed``).  Trace: trace_id, traceId, header; level: level, severity, header,
    INFO; topic: field, header, service; a line without payload is its own payload; wrongly typed fields are empty."""
    e = _read(each, "trimmed", parity)
    header = lambda v: trim(F.lit(v))
    e = e.withColumns({
        "trace_id": first_of(F.col("_e.trace_id"), F.col("_e.trace_camel"), header(headers.trace_id)),
        "_service": first_of(F.col("_e.service"), header(headers.service)),
        "level": first_of(F.col("_e.level"), F.col("_e.severity"), header(headers.level), F.lit("INFO")),
    })
    e = e.withColumn("topic", first_of(F.col("_e.topic"), header(headers.topic), F.col("_service"))).withColumn("service", first_of(F.col("_service"), F.col("topic")))
    own = F.col("_e.payload")
    e = e.withColumn("payload", F.when((own != "") & (trim(own) != "null"), own).otherwise(F.col("trimmed")))
    early = F.when(F.octet_length("trimmed") > MAX_LINE_BYTES, "line_too_long").when(~F.col("_e.valid"), "invalid_json_line").when(F.col("topic") == "", "topic_missing")
    e = _enriched(e.withColumn("_early", early), parity)
    e = e.withColumn("code", F.coalesce("_early", record_fault(F.col("topic"), F.col("payload")))).withColumn("size", F.octet_length("payload").cast("long"))
    message = F.when(F.col("code") == "invalid_json_line", "invalid json payload").when(F.col("code") == "topic_missing", "topic cannot be empty").otherwise(F.col("code"))
    return e.withColumn("message", F.when(F.col("code").isNotNull(), message)).drop("_e", "_early", "_service")


def until_abort(judged: DataFrame, strict: bool, by: list[str]) -> DataFrame:
    """Rows of each request up to its abort: a line that is too long ends it, and in strict mode any fault does."""
    stops = F.col("code").isNotNull() if strict else F.col("code") == "line_too_long"
    first = judged.where(stops).groupBy(*by).agg(F.min("line").alias("_stop"))
    return judged.join(first, by, "left").where(F.col("_stop").isNull() | (F.col("line") <= F.col("_stop"))).drop("_stop")


def ndjson_summary(judged: DataFrame, total_lines: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """status, ingested, enqueued, errors, bytes, lines and first_error of each request (all rows are one if ``by`` is empty)."""
    good = F.col("code").isNull()
    one = judged.groupBy(*by).agg(
        F.count_if(good).alias("ingested"),
        F.count_if(~good).alias("errors"),
        F.coalesce(F.sum(F.when(good, F.col("size"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.max("line"), F.lit(0)).alias("lines"),
        F.min(F.when(~good, F.struct("line", "code", "message"))).alias("first_error"),
    )
    status = F.when((F.col("ingested") == 0) & (F.col("errors") == 0), "empty_body").when(F.col("ingested") == 0, "all_lines_invalid").when(F.col("errors") > 0, "partial_success").otherwise("accepted")
    return one.select(*by, status.alias("status"), "ingested", F.col("ingested").alias("enqueued"), "errors", "bytes", "lines", "first_error")


def batch_items(bodies: DataFrame, headers: Headers = Headers(), parity: str = "exact") -> DataFrame:  # noqa: B008
    """One item per row of the JSON arrays in ``body``: index, the resolved fields (all trimmed) and code/message.

    A body that is no array of well-typed objects, is empty or has too many items gives one row with index null.
    """
    b = bodies.withColumn("_items", js.elements_udf(F.col("body")) if parity == "exact" else F.from_json("body", "array<string>"))
    n = F.size("_items")
    whole = F.when(F.octet_length("body") > MAX_BATCH_BYTES, "payload_too_large").when(F.col("_items").isNull(), "invalid_json").when(n == 0, "empty_batch").when(n > MAX_BATCH_ITEMS, "batch_too_large")
    b = b.withColumn("_whole", whole)
    each = b.select("*", F.posexplode_outer(F.when(F.col("_whole").isNull(), F.col("_items"))).alias("index", "item")).drop("_items")
    e = _read(each, "item", parity)
    header = lambda v: trim(F.lit(v))
    e = e.withColumns({
        "trace_id": first_of(trim(F.col("_e.trace_id")), header(headers.trace_id)),
        "service": first_of(trim(F.col("_e.service")), header(headers.service)),
        "level": first_of(trim(F.col("_e.level")), header(headers.level)),
        "payload": F.col("_e.payload"),
    }).withColumn("topic", first_of(trim(F.col("_e.topic")), F.col("service")))
    early = (
        F.when(F.col("_whole").isNotNull(), F.col("_whole"))
        .when(~F.col("_e.valid") | ~F.col("_e.typed"), "invalid_json")
        .when((F.col("topic") == "") | (F.octet_length("topic") > MAX_TOPIC_BYTES), "invalid_batch_item")
        .when(trim(F.col("payload")).isin("", "null", '""') | (F.octet_length("payload") > MAX_PAYLOAD_BYTES), "invalid_batch_item")
    )
    why = (
        F.when(F.col("topic") == "", "topic cannot be empty")
        .when(F.octet_length("topic") > MAX_TOPIC_BYTES, F.format_string(f"topic length %d exceeds limit of {MAX_TOPIC_BYTES} bytes", F.octet_length("topic")))
        .when(trim(F.col("payload")).isin("", "null", '""'), "payload cannot be empty")
        .otherwise(f"payload size exceeds limit of {MAX_PAYLOAD_BYTES} bytes")
    )
    e = _enriched(e.withColumn("_early", early).withColumn("_why", why), parity)
    grown = F.when(F.octet_length("payload") > MAX_PAYLOAD_BYTES, "invalid_batch_item")
    e = e.withColumn("code", F.coalesce("_early", grown))
    e = e.withColumn("message", F.when(F.col("code") == "invalid_batch_item", F.when(F.col("_early").isNotNull(), F.col("_why")).otherwise(f"payload size exceeds limit of {MAX_PAYLOAD_BYTES} bytes after metadata enrichment")))
    return e.withColumn("size", F.octet_length("payload").cast("long")).drop("_e", "_early", "_why", "_whole")


def batch_summary(items: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """All or nothing: status ok with enqueued and size_bytes, or the error of the first bad item."""
    bad = F.col("code").isNotNull()
    one = items.groupBy(*by).agg(F.count("*").alias("total"), F.sum("size").alias("bytes"), F.min(F.when(bad, F.struct(F.col("code") != "invalid_json", F.col("index"), "code", "message"))).alias("f"))
    failed = F.col("f").isNotNull()
    return one.select(*by, F.when(failed, F.col("f.code")).otherwise("ok").alias("status"), F.when(failed, 0).otherwise(F.col("total")).cast("long").alias("enqueued"), F.when(failed, 0).otherwise(F.col("bytes")).cast("long").alias("size_bytes"), F.col("f.index").cast("long").alias("index"), F.col("f.message").alias("message"))


def rejects(judged: DataFrame, src: str, raw: str) -> DataFrame:
    """The refused rows as a REJECT table."""
    number = F.col("line") if "line" in judged.columns else F.col("index") if "index" in judged.columns else F.lit(None)
    message = F.col("message") if "message" in judged.columns else F.lit(None)
    return judged.where("code is not null").select(F.lit(src).alias("src"), number.cast("long").alias("line"), "code", message.cast("string").alias("message"), F.col(raw).alias("raw"))


def assign(accepted: DataFrame, order: list[str], now_nanos: int, last_id: int = 0, next_offset: int = 0) -> DataFrame:
    """Dense offsets and ids in the given order, without moving all rows to one task.

    Rows are range-partitioned and written once, each with its partition and its place in it; the partitions' counts
    (one number each) give every partition its base.  Counting and numbering read that table: planned twice, the
    exchange would sample other bounds or be coalesced otherwise.  The result reads the table too; ``scratch.drop``
    deletes it when the result has been written.
    """
    laid = accepted.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    laid = scratch.stage(laid.select("*", F.spark_partition_id().alias("_p"), place.alias("_m")), "assign")
    base, rows = next_offset, []
    for r in sorted(laid.groupBy("_p").count().collect()):
        rows.append((r["_p"], base))
        base += r["count"]
    start = F.broadcast(accepted.sparkSession.createDataFrame(rows or [(0, next_offset)], "_p int, _base long"))
    out = laid.join(start, "_p").withColumn("offset", F.col("_base") + F.col("_m"))
    out = out.withColumns({"id": F.col("offset") - next_offset + last_id + 1, "ts_nanos": F.lit(now_nanos).cast("long")}).drop("_p", "_m", "_base")
    out._stored_at = laid._stored_at
    return out
