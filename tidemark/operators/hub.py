"""The queryable window over the log: normalisation, the ring of recent entries, queries, live filters, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import json as js
from tidemark.functions.text import equal_fold, first_of, json_quote, level_rank, trim
from tidemark.model import LEVEL_RANKS, SUBSCRIBER_QUEUE, ConsoleFilter, LogQuery
from tidemark.operators.render import entry_json


def extract(records: DataFrame, parity: str = "exact") -> DataFrame:
    """Add trace_id, service and level read from ``payload`` (text): service falls back to topic, level to INFO.

    ``exact`` scans as the writers' scanner does; ``fast`` uses built-in functions and agrees on well-formed
    objects without repeated keys.
    """
    if parity == "exact":
        out = records.withColumn("_m", js.metadata_udf(F.col("topic"), F.col("payload")))
        return out.select(*records.columns, "_m.trace_id", "_m.service", "_m.level")
    # the payload is parsed once, and each member read once, before the members are put together
    names = ("trace_id", "traceId", "service", "level", "severity")
    found = records.withColumn("_v", F.when(F.col("payload").startswith("{"), F.try_parse_json("payload")))
    found = found.withColumn("_m", F.struct(*(F.try_variant_get("_v", f"$.{n}", "variant").alias(f"m{i}") for i, n in enumerate(names))))
    text = [F.when(F.schema_of_variant(F.col(f"_m.m{i}")) == "STRING", F.try_variant_get(F.col(f"_m.m{i}"), "$", "string")) for i in range(len(names))]
    return found.select(
        *records.columns, first_of(text[0], text[1]).alias("trace_id"), first_of(text[2], F.col("topic")).alias("service"),
        first_of(text[3], text[4], F.lit("INFO")).alias("level"),
    )


def normalise(entries: DataFrame) -> DataFrame:
    """Topic and service stand in for one another, then level is upper-cased, service lower-cased, all trimmed."""
    topic, service = F.coalesce("topic", F.lit("")), F.coalesce("service", F.lit(""))
    return entries.withColumns({
        "topic": F.when(topic == "", service).otherwise(topic),
        "service": F.lower(trim(F.when(service == "", topic).otherwise(service))),
        "trace_id": trim(F.coalesce("trace_id", F.lit(""))),
        "level": F.coalesce(F.nullif(F.upper(trim(F.coalesce("level", F.lit("")))), F.lit("")), F.lit("INFO")),
    })


def wrap_payload(payload: Column, parity: str = "exact") -> Column:
    """Valid JSON stays as it is, anything else becomes a JSON string."""
    ok = js.valid_udf(payload) if parity == "exact" else js.is_json(payload)
    return F.when(ok, payload).otherwise(json_quote(payload))


def refused(entries: DataFrame) -> DataFrame:
    """Entries that name neither topic nor service."""
    return entries.where((F.coalesce("topic", F.lit("")) == "") & (F.coalesce("service", F.lit("")) == ""))


def ring(entries: DataFrame, capacity: int = 50_000, session_start: int | None = None) -> DataFrame:
    """The last ``capacity`` entries by offset (offsets are dense), from ``session_start`` on if given.

    A scalar maximum decides, so only one number per task is exchanged and the filter stays on the scan.
    """
    capacity = capacity if capacity > 0 else 50_000
    top = entries.agg(F.max("offset").alias("_top"))
    out = entries.join(F.broadcast(top)).where(F.col("offset") > F.col("_top") - capacity).drop("_top")
    return out if session_start is None else out.where(F.col("offset") >= session_start)


def _all(predicates: list[Column]) -> Column:
    return reduce(Column.__and__, predicates, F.lit(True))


def query(entries: DataFrame, q: LogQuery) -> DataFrame:
    """The newest entries that match, oldest first, with their position ``pos`` from 0."""
    wanted = {"trace_id": q.trace_id.strip(), "service": q.service.strip().lower(), "level": q.level.strip().upper()}
    newest = entries.where(_all([F.col(c) == v for c, v in wanted.items() if v])).orderBy(F.desc("offset")).limit(q.clamped())
    # at most MAX_LIMIT rows are left to number
    return newest.withColumn("pos", (F.row_number().over(Window.orderBy("offset")) - 1).cast("long")).orderBy("pos")


def live_filter(entries: DataFrame, service: str = "", level: str = "") -> DataFrame:
    """What a subscriber with this filter is sent."""
    given = [(c, v) for c, v in (("service", service.strip()), ("level", level.strip())) if v]
    return entries.where(_all([equal_fold(F.col(c), F.lit(v)) for c, v in given]))


def console_filter(entries: DataFrame, f: ConsoleFilter) -> DataFrame:
    """Console predicates; ``limit`` keeps the first matches by offset."""
    p = []
    if f.service:
        p.append(equal_fold(F.col("service"), F.lit(f.service)))
    if f.topic:
        p.append(F.col("topic") == f.topic)
    if f.trace_id:
        p.append(F.col("trace_id") == f.trace_id)
    least = LEVEL_RANKS.get(f.level.strip().upper(), 0)
    if least:
        p.append(level_rank(F.col("level")) >= least)
    if f.grep:
        p.append(F.col("payload").rlike(f.grep))
    out = entries.where(_all(p))
    return out.orderBy("offset").limit(f.limit) if f.limit > 0 else out


def stats(entries: DataFrame, capacity: int = 50_000, active_streams: int = 0, dropped: int = 0) -> DataFrame:
    """One row: capacity, sizes, and the distinct traces and services within the ring."""
    total = entries.agg(F.count("*").alias("total_ingested"))
    name = lambda c: F.nullif(F.col(c), F.lit(""))
    live = ring(entries, capacity).agg(F.count("*").alias("current_size"), F.countDistinct(name("trace_id")).alias("indexed_traces"), F.countDistinct(name("service")).alias("indexed_services"))
    return total.join(F.broadcast(live)).select(
        F.lit(capacity).cast("long").alias("capacity"), "current_size", "total_ingested", F.lit(active_streams).cast("long").alias("active_streams"),
        "indexed_traces", "indexed_services", F.lit(dropped).cast("long").alias("dropped_events"),
    )


def bounded_subscriber(entries: DataFrame, service: str = "", level: str = "", queue: int = SUBSCRIBER_QUEUE) -> DataFrame:
    """A subscriber that never reads keeps the first ``queue`` matches; the newest are dropped.  One row: kept, dropped,
    last_kept (offset)."""
    matching = live_filter(entries, service, level)
    kept = matching.orderBy("offset").limit(queue).agg(F.count("*").alias("kept"), F.max("offset").alias("last_kept"))
    total = matching.agg(F.count("*").alias("n"))
    return total.join(F.broadcast(kept)).select("kept", (F.col("n") - F.col("kept")).alias("dropped"), "last_kept")


def query_json(found: DataFrame) -> DataFrame:
    """One row ``body``: the JSON array of a query's rows, [] if there are none; empty trace and level are left out."""
    rows = found.select("pos", entry_json().alias("j")).agg(F.array_sort(F.collect_list(F.struct("pos", "j"))).alias("a"))
    return rows.select(F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["j"]), ","), F.lit("]")).alias("body"))
