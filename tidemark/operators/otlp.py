"""OpenTelemetry log exports: JSON and protobuf requests to routed records."""

from __future__ import annotations

import base64
import binascii
import json
import math
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import json as js
from tidemark.functions.text import first_of, json_quote, severity_text, trim

DEFAULT_TOPIC = "otel_logs"
_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,bytesValue:string>"
_KV = f"array<struct<key:string,value:{_VALUE}>>"
#: Shape of a JSON export whose values are scalars.
REQUEST = (
    f"resourceLogs array<struct<resource:struct<attributes:{_KV}>,scopeLogs:array<struct<scope:struct<name:string>,"
    f"logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{_VALUE},"
    f"traceId:string,spanId:string,attributes:{_KV}>>>>>>"
)


def any_value(v: Column) -> Column:
    """A scalar value as JSON text, null if there is none."""
    number = F.when(v["doubleValue"] == F.floor(v["doubleValue"]), v["doubleValue"].cast("decimal(38,0)").cast("string")).otherwise(v["doubleValue"].cast("string"))

    return F.coalesce(json_quote(v["stringValue"]), v["boolValue"].cast("string"), v["intValue"], number, json_quote(F.lower(F.hex(F.unbase64(v["bytesValue"])))))


def attributes(kvs: Column) -> Column:
    """map<key, JSON text>: empty keys skipped, the last of repeated keys wins."""
    named = F.filter(F.coalesce(kvs, F.array().cast(_KV)), lambda a: F.coalesce(a["key"], F.lit("")) != "")
    last = F.filter(named, lambda a, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda b: b["key"] == a["key"]))
    return F.map_from_entries(F.transform(last, lambda a: F.struct(a["key"], F.coalesce(any_value(a["value"]), F.lit("null")))))


def service_name(kvs: Column, default: str = DEFAULT_TOPIC) -> Column:
    """The first non-empty text attribute service.name, else the default."""
    named = F.filter(F.coalesce(kvs, F.array().cast(_KV)), lambda a: (a["key"] == "service.name") & (F.coalesce(a["value"]["stringValue"], F.lit("")) != ""))
    return F.coalesce(F.get(named, 0)["value"]["stringValue"], F.lit(default or DEFAULT_TOPIC))


def json_id(value: Column, text_length: int) -> Column:
    """A trace or span id of a JSON export: hex text of the right length verbatim, else the hex of its base64 bytes."""
    v = F.coalesce(value, F.lit(""))
    return F.when((v == "") | (F.octet_length(v) == text_length), v).otherwise(F.lower(F.hex(F.try_to_binary(v, F.lit("base64")))))


def flatten(requests: DataFrame, body: str = "body", default_topic: str = DEFAULT_TOPIC) -> DataFrame:
    """One row per log record of JSON exports with scalar values, by built-in functions.

    Columns: the input's, topic, level, ts_nanos (null: no time given), trace_id, span_id, scope, body_json,
    attributes and resource (maps of JSON text).
    """
    r = requests.withColumn("_r", F.from_json(F.col(body), REQUEST)).withColumn("_rl", F.explode("_r.resourceLogs"))
    r = r.withColumn("_sl", F.explode("_rl.scopeLogs")).withColumn("_lr", F.explode("_sl.logRecords"))
    rec, res = F.col("_lr"), F.col("_rl.resource.attributes")
    attrs = attributes(rec["attributes"])
    named = F.filter(F.coalesce(rec["attributes"], F.array().cast(_KV)), lambda a: a["key"] == "service.name")
    override = F.element_at(F.when(F.size(named) > 0, named), -1)["value"]["stringValue"]
    nanos = F.coalesce(F.nullif(rec["timeUnixNano"].cast("long"), F.lit(0)), F.nullif(rec["observedTimeUnixNano"].cast("long"), F.lit(0)))
    level = F.upper(trim(F.coalesce(rec["severityText"], F.lit(""))))
    keep = [c for c in requests.columns if c != body]
    return r.select(
        *keep, first_of(override, service_name(res, default_topic)).alias("topic"),
        F.when(level != "", level).otherwise(severity_text(F.coalesce(rec["severityNumber"], F.lit(0)))).alias("level"),
        nanos.alias("ts_nanos"), json_id(rec["traceId"], 32).alias("trace_id"), json_id(rec["spanId"], 16).alias("span_id"),
        F.coalesce(F.col("_sl.scope.name"), F.lit("")).alias("scope"), F.coalesce(any_value(rec["body"]), F.lit("null")).alias("body_json"),
        attrs.alias("attributes"), attributes(res).alias("resource"),
    )


# Exact decoding of whole requests, nested values included.


class Refused(ValueError):
    """The request as a whole can't be read."""


def _member(obj: dict, *names):
    return next((obj[n] for n in names if n in obj and obj[n] is not None), None)


def _b64(text: str) -> bytes:
    t = text.replace("-", "+").replace("_", "/").rstrip("=")
    try:
        return base64.b64decode(t + "=" * (-len(t) % 4), validate=True)
    except (binascii.Error, ValueError) as e:
        raise Refused(str(e)) from e


def _json_value(v):
    """AnyValue of a JSON export."""
    if not v:
        return None
    for name, read in (("string", str), ("bool", bool), ("int", int), ("double", float), ("bytes", lambda x: _b64(x).hex())):
        found = _member(v, f"{name}Value", f"{name}_value")
        if found is not None:
            return read(found)
    array, pairs = _member(v, "arrayValue", "array_value"), _member(v, "kvlistValue", "kvlist_value")
    if array is not None:
        return [_json_value(x) for x in array.get("values") or []]
    if pairs is not None:
        return {kv.get("key", ""): _json_value(kv.get("value")) for kv in pairs.get("values") or []}
    return None


# Numbers of the severity names, and the field numbers of the export's messages.
_SEVERITIES = {f"SEVERITY_NUMBER_{n}{i or ''}": b + (i - 1 if i else 0) for b, n in ((1, "TRACE"), (5, "DEBUG"), (9, "INFO"), (13, "WARN"), (17, "ERROR"), (21, "FATAL")) for i in (0, 2, 3, 4)}


def _wire(data: bytes):
    """(field, value) of a protobuf message: int for varint and fixed, bytes for length-delimited."""
    at = 0

    def varint():
        nonlocal at
        shift = out = 0
        while True:
            if at >= len(data) or shift > 63:
                raise Refused("truncated message")
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out & (1 << 64) - 1
            shift += 7

    while at < len(data):
        key = varint()
        kind, size = key & 7, 0
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) if kind != 2 else varint()
        if size is None or at + size > len(data):
            raise Refused("malformed message")
        chunk = data[at : at + size]
        at += size
        yield key >> 3, chunk if kind == 2 else int.from_bytes(chunk, "little")


def _text(b: bytes) -> str:
    try:
        return b.decode()
    except UnicodeDecodeError as e:
        raise Refused("text is not UTF-8") from e


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _proto_value(data: bytes | None):
    out = None
    for f, v in _wire(data or b""):
        if f == 1:
            out = _text(v)
        elif f == 2:
            out = bool(v)
        elif f == 3:
            out = _signed(v)
        elif f == 4:
            out = struct.unpack("<d", v.to_bytes(8, "little"))[0]
        elif f == 5:
            out = [_proto_value(x) for g, x in _wire(v) if g == 1]
        elif f == 6:
            out = dict(_proto_pair(x) for g, x in _wire(v) if g == 1)
        elif f == 7:
            out = v.hex()
    return out


def _proto_pair(data: bytes):
    key, value = "", None
    for f, v in _wire(data):
        if f == 1:
            key = _text(v)
        elif f == 2:
            value = _proto_value(v)
    return key, value


def _records_json(text: str):
    """(resource pairs, scope, record fields) of every record of a JSON export."""
    try:
        request = json.loads(text)
    except (ValueError, RecursionError) as e:
        raise Refused(str(e)) from e
    if not isinstance(request, dict):
        raise Refused("expected an object")
    pairs = lambda o: [(a.get("key", ""), _json_value(a.get("value"))) for a in (o or {}).get("attributes") or []]
    for rl in _member(request, "resourceLogs", "resource_logs") or []:
        for sl in _member(rl, "scopeLogs", "scope_logs") or []:
            for r in _member(sl, "logRecords", "log_records") or []:
                number = _member(r, "severityNumber", "severity_number") or 0
                ids = []
                for names, size in ((("traceId", "trace_id"), 24), (("spanId", "span_id"), 12)):
                    raw = _b64(_member(r, *names) or "")
                    ids.append(base64.b64encode(raw).decode() if len(raw) == size else raw.hex())
                yield pairs(rl.get("resource")), (sl.get("scope") or {}).get("name", ""), {
                    "time": int(_member(r, "timeUnixNano", "time_unix_nano") or 0), "observed": int(_member(r, "observedTimeUnixNano", "observed_time_unix_nano") or 0),
                    "number": _SEVERITIES.get(number, 0) if isinstance(number, str) else int(number), "severity": _member(r, "severityText", "severity_text") or "",
                    "body": _json_value(r.get("body")), "trace": ids[0], "span": ids[1], "attributes": pairs(r),
                }


def _records_proto(data: bytes):
    for f, rl in _wire(data):
        if f != 1:
            continue
        resource, scopes = [], []
        for g, v in _wire(rl):
            if g == 1:
                resource += [_proto_pair(a) for h, a in _wire(v) if h == 1]
            elif g == 2:
                scopes.append(v)
        for sl in scopes:
            scope, logs = "", []
            for g, v in _wire(sl):
                if g == 1:
                    scope = next((_text(x) for h, x in _wire(v) if h == 1), scope)
                elif g == 2:
                    logs.append(v)
            for record in logs:
                got = {"time": 0, "observed": 0, "number": 0, "severity": "", "body": None, "trace": "", "span": "", "attributes": []}
                for g, v in _wire(record):
                    if g == 6:
                        got["attributes"].append(_proto_pair(v))
                    elif g in (1, 2, 3, 5, 9, 10, 11):
                        name, read = {1: ("time", int), 11: ("observed", int), 2: ("number", int), 3: ("severity", _text), 5: ("body", _proto_value), 9: ("trace", bytes.hex), 10: ("span", bytes.hex)}[g]
                        got[name] = read(v)
                yield resource, scope, got


def _stamp(nanos: int) -> str:
    second, rest = divmod(nanos, 1_000_000_000)
    fraction = f"{rest:09d}".rstrip("0")
    return pd.Timestamp(second, unit="s").strftime("%Y-%m-%dT%H:%M:%S") + (f".{fraction}" if fraction else "") + "Z"


def _dump(value) -> str:
    """Compact JSON with sorted keys; floats in their shortest form."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return js.dump(value)
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a JSON number")
        if value == int(value) and abs(value) < 1e21:
            return str(int(value))
        text = repr(value)
        return text.replace("e-0", "e-") if "e" in text else text
    if isinstance(value, int):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{js.quote(k)}:{_dump(value[k])}" for k in sorted(value)) + "}"
    return "[" + ",".join(map(_dump, value)) + "]"


def decode_request(body, protobuf: bool, now_nanos: int, default_topic: str = DEFAULT_TOPIC) -> list[tuple[str, str]]:
    """(topic, payload) of every record of one export request."""
    out = []
    for resource, scope, r in _records_proto(body) if protobuf else _records_json(body):
        attrs = {k: v for k, v in r["attributes"] if k}
        base = next((v for k, v in resource if k == "service.name" and isinstance(v, str) and v), default_topic or DEFAULT_TOPIC)
        own = attrs.get("service.name")
        topic = own if isinstance(own, str) and own else base
        n = r["number"]
        level = r["severity"].strip().upper() or next((t for a, b, t in ((1, 8, "DEBUG"), (9, 12, "INFO"), (13, 16, "WARN"), (17, 20, "ERROR"), (21, 24, "FATAL")) if a <= n <= b), "INFO")
        fields = {"timestamp": _stamp(r["time"] or r["observed"] or now_nanos), "service": topic, "level": level, "body": r["body"]}
        more = {"trace_id": r["trace"], "span_id": r["span"], "scope": scope, "attributes": attrs, "resource": {k: v for k, v in resource if k}}
        try:
            payload = _dump(fields | {k: v for k, v in more.items() if v})
        except ValueError:
            payload = f'{{"service":{js.quote(topic)},"level":{js.quote(level)},"body":{js.quote(str(r["body"]))}}}'
        out.append((topic, payload))
    return out


def records(requests: DataFrame, protobuf: bool, now_nanos: int, body: str = "body", default_topic: str = DEFAULT_TOPIC) -> DataFrame:
    """The input's other columns, index, topic, payload and code: one row per record, or one with code invalid_request
    for a request that can't be read."""
    keep = [c for c in requests.columns if c != body]

    @F.pandas_udf("struct<code:string,items:array<struct<topic:string,payload:string>>>")
    def read(bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for b in bodies:
            try:
                rows.append((None, [{"topic": t, "payload": p} for t, p in decode_request(b or (b"" if protobuf else ""), protobuf, now_nanos, default_topic)]))
            except (Refused, TypeError, AttributeError, ValueError):
                rows.append(("invalid_request", [{"topic": None, "payload": None}]))
        return pd.DataFrame(rows, columns=["code", "items"])

    each = requests.withColumn("_r", read(F.col(body)))
    return each.select(*keep, "_r.code", F.posexplode("_r.items").alias("index", "_i")).select(*keep, F.col("index").cast("long"), "_i.topic", "_i.payload", "code")
