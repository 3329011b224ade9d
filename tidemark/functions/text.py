"""Text functions as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import LEVEL_RANKS, MAX_TRACKED_TOPIC_BYTES, OVERFLOW_TOPIC

DEFAULT_ADDRESS = "http://127.0.0.1:9099"  # fixed value

#: Fixed value: Unicode white space.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.btrim(c, F.lit(SPACES))


def first_of(*cs: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))


def equal_fold(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def level_rank(c: Column) -> Column:
    """1 to 5, and 0 for a level that isn't known."""
    ranks = F.create_map(*(F.lit(x) for kv in LEVEL_RANKS.items() for x in kv))
    return F.coalesce(F.try_element_at(ranks, F.upper(trim(c))), F.lit(0))


def severity_text(number: Column) -> Column:
    """Severity numbers 1-8, 9-12, 13-16, 17-20, 21-24; others are INFO."""
    bounds = ((1, 8, "DEBUG"), (9, 12, "INFO"), (13, 16, "WARN"), (17, 20, "ERROR"), (21, 24, "FATAL"))
    return reduce(lambda e, b: e.when(number.between(b[0], b[1]), b[2]), bounds[1:], F.when(number.between(1, 8), "DEBUG")).otherwise("INFO")


def escape_label(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def topic_label(c: Column) -> Column:
    return F.when(F.octet_length(c) > MAX_TRACKED_TOPIC_BYTES, OVERFLOW_TOPIC).otherwise(c)


def swap_all(c: Column, pairs: dict[str, str]) -> Column:
    """Replace one text after the other, as a fold: many pairs stay a small plan."""
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs.items()))
    return F.aggregate(table, c, lambda out, p: F.replace(out, p["a"], p["b"]))


#: How JSON output escapes characters beside the quote and the backslash.
_ESCAPES = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029"}


def json_quote(c: Column) -> Column:
    """A JSON string literal; HTML-relevant characters and line separators are written as escapes."""
    usual = {"\\": "\\\\", '"': '\\"'} | _ESCAPES
    rare = usual | {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in _ESCAPES}
    body = F.when(c.rlike(r"[\x00-\x07\x0B\x0E-\x1F]"), swap_all(c, rare)).when(c.rlike(r'["\\\x08-\x0D<>&\x{2028}\x{2029}]'), swap_all(c, usual)).otherwise(c)
    return F.concat(F.lit('"'), body, F.lit('"'))


def rfc3339_nanos(ns: Column) -> Column:
    """UTC, fraction without trailing zeros."""
    second, rest = F.floor(ns / 1_000_000_000).cast("long"), F.pmod(ns, F.lit(1_000_000_000))
    fraction = F.rtrim(F.lpad(rest.cast("string"), 9, "0"), F.lit("0"))
    return F.concat(F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss"), F.when(rest > 0, F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))


def format_bytes(b: Column, units: str = "KMGTPE") -> Column:
    """1024-based, one decimal rounded half to even; below 1024 the count itself.  Beyond the last of ``units`` its number
    goes on growing."""
    out = F.concat(b.cast("string"), F.lit(" B"))
    for i, unit in enumerate(units, 1):
        scaled = F.bround(b.cast("double") / float(1 << (10 * i)), 1)
        out = F.when(b >= (1 << (10 * i)), F.concat(F.format_string("%.1f", scaled), F.lit(f" {unit}B"))).otherwise(out)
    return out


def format_number(n: Column) -> Column:
    return F.format_number(n, 0)


def format_uptime(seconds: Column) -> Column:
    s = F.round(seconds).cast("long")
    h, m, r = F.expr("1") * F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    full = F.format_string("%dh %02dm %02ds", h.cast("long"), m.cast("long"), r)
    return F.when(s >= 3600, full).when(s >= 60, F.format_string("%dm %02ds", m.cast("long"), r)).otherwise(F.concat(s.cast("string"), F.lit("s")))


def progress_bar(current: Column, capacity: Column, width: int = 20) -> Column:
    """[████░░░░] percent (current / capacity); the percentage is rounded half to even from the exact quotient."""
    width = width if width > 0 else 20
    ratio = F.least(F.greatest(current.cast("double") / capacity, F.lit(0.0)), F.lit(1.0))
    filled = F.floor(ratio * width).cast("int")
    share = F.least(F.greatest(current.cast("decimal(38,12)") * 100 / capacity.cast("decimal(20,0)"), F.lit(0)), F.lit(100))
    percent = F.lpad(F.bround(share, 1).cast("decimal(4,1)").cast("string"), 5, " ")
    bar = F.concat(F.lit("["), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), width - filled), F.lit("] "), percent, F.lit("% ("), current.cast("string"), F.lit(" / "), capacity.cast("string"), F.lit(")"))
    return F.when(capacity <= 0, F.lit("[--------------------] 0.0%")).otherwise(bar)


def sanitize(c: Column, single_line: bool) -> Column:
    """Control characters, direction overrides and zero-width characters made harmless; clean ASCII passes untouched."""
    pairs = {"\ufffd": "\\uFFFD"} | {chr(i): f"\\x{i:02x}" for i in [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]} | {"\r": "\\r"} | ({"\n": "\\n"} if single_line else {})
    out = swap_all(c, pairs | {chr(i): f"\\u00{i:02x}" for i in range(0x80, 0xA0)})
    out = F.regexp_replace(out, r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]", "[BIDI]")
    out = F.regexp_replace(out, r"[\x{200B}-\x{200F}\x{FEFF}]", "")
    odd = r"[^\x09\x20-\x7E]" if single_line else r"[^\x09\x0A\x20-\x7E]"
    return F.when(c.rlike(odd), out).otherwise(c)


def outcome(status: Column, failed: Column) -> Column:
    """Delivery outcome of an HTTP status; ``failed``: the request had no status, or could not be encoded ('encode')."""
    return (
        F.when(failed == "encode", "permanent")
        .when(failed.isNotNull(), "transient")
        .when(status.between(200, 299), "ok")
        .when(status.isin(408, 429), "transient")
        .when(status.between(400, 499), "permanent")
        .otherwise("transient")
    )


def service_address(raw: str) -> str:
    """Base address of a log service: the default if empty, http unless a scheme is given, without slashes at the end.
    Other schemes, and addresses without a host, are refused."""
    from urllib.parse import urlsplit

    address = raw.strip() or DEFAULT_ADDRESS
    address = address if "://" in address else f"http://{address}"
    parts = urlsplit(address)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise ValueError(f"no http or https address: {raw!r}")
    return f"{parts.scheme}{address[address.index(':') :]}".rstrip("/")
