"""JSON handling that must agree byte for byte with the log's writers, as Arrow-batched functions.

The metadata scanner is deliberately not a JSON parser: keys are compared raw, only strings count, the last
duplicate wins, and a malformed tail keeps what came before it.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = " \t\n\r"
_PADDING = "\t\n\v\f\r \x85\xa0                　"
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*+"', re.DOTALL)
#: One member of an object: key, colon, then a string or a scalar and a comma if there is one, or the begin of a container.
_BLANK, _BODY = r"[ \t\n\r]*+", r'((?:[^"\\]|\\.)*+)"'
_MEMBER = re.compile(rf'{_BLANK}"{_BODY}{_BLANK}:{_BLANK}(?:(?:"{_BODY}|(?!["{{\[])[^,}}\] \t\n\r]*+){_BLANK},?+|(?=([{{\[])))', re.DOTALL)
_NEXT, _GAP = re.compile(rf"{_BLANK},?+"), re.compile(_BLANK)
_STRUCTURE = re.compile(r'["{}\[\]]')
_SIMPLE = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"'}
_QUOTED = re.compile(r"\\(?:([abfnrtv\\\"])|x([0-9a-fA-F]{2})|([0-7]{3})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8}))|([^\\\n])", re.DOTALL)


def unquote(body: str) -> str:
    """Interpreted string literal rules; text that breaks them is returned raw."""
    out, at = [], 0
    while at < len(body):
        m = _QUOTED.match(body, at)
        if m is None:
            return body
        simple, byte, octal, short, long, plain = m.groups()
        if plain is not None:
            out.append(plain.encode("utf-8", "surrogatepass"))
        elif simple is not None:
            out.append(_SIMPLE[simple].encode())
        elif byte is not None or octal is not None:
            value = int(byte, 16) if byte is not None else int(octal, 8)
            if value > 255:
                return body
            out.append(bytes([value]))
        else:
            value = int(short or long, 16)
            if value > 0x10FFFF or 0xD800 <= value < 0xE000:
                return body
            out.append(chr(value).encode())
        at = m.end()
    return b"".join(out).decode("utf-8", "replace")


def _skip(text: str, at: int) -> int:
    return _GAP.match(text, at).end()


def _container_end(text: str, at: int) -> int:
    depth = 0
    while m := _STRUCTURE.search(text, at):
        at = m.end()
        if m[0] == '"':
            end = _STRING_END.match(text, at)
            if end is None:
                return -1
            at = end.end()
        else:
            depth += 1 if m[0] in "{[" else -1
            if depth == 0:
                return at
    return -1


def scan_metadata(topic: str, payload: str) -> tuple[str, str, str]:
    """(trace_id, service, level) of a payload; service falls back to the topic, level to INFO."""
    text, got = (payload or "").strip(_PADDING), {}
    member = _MEMBER.match(text, 1) if text.startswith("{") else None
    while member:
        name, value, container = member.groups()
        at = member.end()
        if container:
            at = _container_end(text, at)
            if at < 0:
                break
            at = _NEXT.match(text, at).end()
        elif value is not None:
            got[name] = unquote(value) if "\\" in value else value
        member = _MEMBER.match(text, at)
    pick = lambda *names: next((got[n] for n in names if got.get(n)), "")
    return pick("trace_id", "traceId"), pick("service") or topic, pick("level", "severity") or "INFO"


class _Literal(str):
    """A number kept as it was written."""


def _refuse(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_float=_Literal, parse_int=_Literal, parse_constant=_refuse)
_ESCAPED = re.compile("[\"\\\\<>&\x00-\x1f  \ud800-\udfff]")
_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def quote(text: str) -> str:
    one = lambda m: _SHORT.get(m[0]) or ("�" if "\ud800" <= m[0] <= "\udfff" else f"\\u{ord(m[0]):04x}")
    return f'"{_ESCAPED.sub(one, text)}"'


def dump(value) -> str:
    """Compact JSON with sorted keys and numbers as written."""
    if isinstance(value, _Literal):
        return str(value)
    if isinstance(value, str):
        return quote(value)
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, dict):
        return "{" + ",".join(f"{quote(k)}:{dump(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(dump, value)) + "]"
    return json.dumps(value)


def valid(text: str | None) -> bool:
    """Strict JSON: one value, nothing after it, no NaN."""
    try:
        _DECODER.decode((text or "").strip(_SPACE))
    except (ValueError, RecursionError):
        return False
    return True


def enrich(payload: str, trace_id: str, service: str, level: str) -> str:
    """Add missing metadata to an object payload; anything else, and objects that have it, stay byte-identical."""
    text = (payload or "").strip(_PADDING)
    if not (trace_id or service or level) or not text.startswith("{"):
        return payload
    try:
        found, _ = _DECODER.raw_decode(text)
    except (ValueError, RecursionError):
        return payload
    missing = lambda *names: all(found.get(n) is None for n in names)
    added = {}
    if trace_id and missing("trace_id", "traceId"):
        added["trace_id"] = trace_id
    if service and missing("service"):
        added["service"] = service
    if level and missing("level", "severity"):
        added["level"] = level
    return dump(found | added) if added else payload


#: Envelope fields and whether they are kept raw.
FIELDS = {"topic": False, "payload": True, "trace_id": False, "traceId": False, "service": False, "level": False, "severity": False}
ENVELOPE = "valid boolean, typed boolean, " + ", ".join(f"`{f if f != 'traceId' else 'trace_camel'}` string" for f in FIELDS)
_FOLDED = {f.lower(): f for f in FIELDS}


def members(text: str):
    """(key, raw value, value) of the object at the start of ``text``."""
    at = _skip(text, 1)
    if text[at : at + 1] == "}":
        return
    while True:
        at = _skip(text, at)
        key, at = json.decoder.scanstring(text, at + 1)
        at = _skip(text, _skip(text, at) + 1)
        value, end = _DECODER.raw_decode(text, at)
        yield key, text[at:end], value
        at = _skip(text, end)
        if text[at] == "}":
            return
        at += 1


def envelope(text: str | None) -> tuple:
    """(valid, typed, topic, payload, trace_id, traceId, service, level, severity) of one request object.

    ``typed`` is false if some field has the wrong type or the value isn't an object: strict readers refuse
    that, line readers take the field as empty.  Keys match without regard to case.
    """
    body = (text or "").strip(_PADDING)
    if not valid(body):
        return (False, False, *[""] * len(FIELDS))
    if not body.startswith("{"):
        return (True, body == "null", *[""] * len(FIELDS))
    got, typed = dict.fromkeys(FIELDS, ""), True
    for key, raw, value in members(body):
        name = key if key in FIELDS else _FOLDED.get(key.lower())
        if name is None:
            continue
        if FIELDS[name]:
            got[name] = raw
        elif isinstance(value, str) and not isinstance(value, _Literal):
            got[name] = value.encode("utf-8", "replace").decode() if any("\ud800" <= c <= "\udfff" for c in value) else value
        elif value is not None:
            typed = False
    return (True, typed, *got.values())


def elements(text: str | None) -> list[str] | None:
    """Raw elements of a JSON array; None if the text doesn't start with one."""
    body = (text or "").strip(_PADDING)
    out, at = [], 1
    try:
        if not body.startswith("["):
            return [] if body == "null" else None
        _DECODER.raw_decode(body)
        at = _skip(body, at)
        while body[at] != "]":
            _, end = _DECODER.raw_decode(body, at)
            out.append(body[at:end])
            at = _skip(body, end)
            at = _skip(body, at + 1) if body[at] == "," else at
    except (ValueError, RecursionError):
        return None
    return out


def metadata_udf(topic: Column, payload: Column) -> Column:
    """struct<trace_id, service, level> by the exact scanner."""

    @F.pandas_udf("trace_id string, service string, level string")
    def scan(topics: pd.Series, payloads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan_metadata(t or "", p or "") for t, p in zip(topics, payloads, strict=True)], columns=["trace_id", "service", "level"])

    return scan(topic, payload)


def enrich_udf(payload: Column, trace_id: Column, service: Column, level: Column) -> Column:
    @F.pandas_udf("string")
    def add(p: pd.Series, t: pd.Series, s: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([enrich(*(x or "" for x in row)) for row in zip(p, t, s, v, strict=True)], dtype=object)

    return add(payload, trace_id, service, level)


def valid_udf(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(valid).astype(bool)

    return check(text)


def envelope_udf(text: Column) -> Column:
    @F.pandas_udf(ENVELOPE)
    def read(texts: pd.Series) -> pd.DataFrame:
        names = ["valid", "typed", *(f if f != "traceId" else "trace_camel" for f in FIELDS)]
        return pd.DataFrame([envelope(t) for t in texts], columns=names)

    return read(text)


def elements_udf(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(elements)

    return split(text)


def field(payload: Column, name: str) -> Column:
    """A top-level string member by built-in functions: '' if it is missing or no string."""
    v = F.try_parse_json(payload)
    path = f"$.{name}"
    return F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string")), F.lit(""))


def is_json(text: Column) -> Column:
    """Built-in check; unlike ``valid_udf`` it accepts text after the value."""
    return F.try_parse_json(text).isNotNull()
