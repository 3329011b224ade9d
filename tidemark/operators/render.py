"""Text forms of entries: server-sent events, console lines, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import json_quote, sanitize

EVENT = "id long, timestamp string, topic string, service string, trace_id string, level string"


def entry_json() -> Column:
    """An entry as one JSON object; empty trace_id and level are left out, the payload is verbatim."""
    pair = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    stamp = F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format("ts", ".SSSSSS"), r"\.?0+$", ""), F.lit('Z"'))
    some = lambda c: F.when(F.col(c) != "", pair(c, json_quote(F.col(c))))
    parts = [pair("id", F.col("id").cast("string")), pair("timestamp", stamp), pair("topic", json_quote(F.col("topic"))), pair("service", json_quote(F.col("service"))), some("trace_id"), some("level"), pair("payload", F.col("payload"))]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def sse_lines(entries: DataFrame) -> DataFrame:
    """offset and ``frame``, the event as it is sent."""
    return entries.select("offset", F.concat(F.lit("data: "), entry_json(), F.lit("\n\n")).alias("frame"))


def parse_sse(lines: DataFrame) -> DataFrame:
    """The events in lines of a stream: blank lines, comments and data that is no JSON are skipped."""
    data = F.trim(F.regexp_replace("line", r"^data:", ""))
    found = lines.where(F.col("line").startswith("data:")).withColumn("_j", data).where(F.try_parse_json("_j").isNotNull())
    e = F.from_json("_j", EVENT)
    return found.select(*[c for c in lines.columns if c != "line"], *(e[c].alias(c) for c in ("id", "timestamp", "topic", "service", "trace_id", "level")), F.get_json_object("_j", "$.payload").alias("payload"))


def bounded_lines(texts: DataFrame, most: int, body: str = "body") -> DataFrame:
    """line, data (binary, at most ``most`` bytes) and truncated; reading goes on at the next newline."""
    bound = most if most > 0 else 1 << 20
    each = texts.select(*[c for c in texts.columns if c != body], F.posexplode(F.split(body, "\r?\n")).alias("_at", "_l"))
    raw = F.col("_l").cast("binary")
    return each.select(*[c for c in each.columns if c not in ("_at", "_l")], (F.col("_at") + 1).cast("long").alias("line"), F.substring(raw, 1, bound).alias("data"), (F.octet_length(raw) > bound).alias("truncated"))


#: Terminal colours of the level badges.
_COLOURS = {"ERROR": "31;1", "FATAL": "31;1", "WARN": "33;1", "INFO": "32;1", "DEBUG": "36"}


def pretty(entries: DataFrame, colour: bool = False, truncated: Column | None = None) -> DataFrame:
    """offset and ``text``: [time] [LEVEL] [service] payload trace_id=..."""
    level = F.coalesce(F.nullif(F.upper("level"), F.lit("")), F.lit("INFO"))
    badge = F.concat(F.lit("["), level, F.lit("]"))
    if colour:
        code = F.create_map(*(F.lit(x) for kv in _COLOURS.items() for x in kv))
        found = F.try_element_at(code, level)
        badge = F.when(found.isNull(), badge).otherwise(F.concat(F.lit("\x1b["), found, F.lit("m"), badge, F.lit("\x1b[0m")))
    service = F.coalesce(F.nullif(sanitize(F.col("service"), True), F.lit("")), sanitize(F.col("topic"), True))
    mark = F.when(truncated, " [TRUNCATED]").otherwise("") if truncated is not None else F.lit("")
    trace = F.concat(F.lit("\x1b[90mtrace_id=" if colour else "trace_id="), sanitize(F.col("trace_id"), True), F.lit("\x1b[0m" if colour else ""))
    extra = F.when(F.col("trace_id") != "", F.concat(F.lit(" "), trace)).otherwise("")
    text = F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss.SSS"), F.lit("] "), badge, F.lit(" ["), service, F.lit("] "), sanitize(F.col("payload"), True), mark, extra)
    return entries.select("offset", text.alias("text"))


def raw(entries: DataFrame) -> DataFrame:
    return entries.select("offset", sanitize(F.col("payload"), False).alias("text"))


def as_json(entries: DataFrame) -> DataFrame:
    return entries.select("offset", entry_json().alias("text"))
