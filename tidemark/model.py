"""Schemas, limits and settings of the event log."""

from __future__ import annotations

from dataclasses import dataclass, replace

RECORD = "offset long, id long, ts_nanos long, topic string, payload binary, checksum long"
LOG_ENTRY = "offset long, id long, ts timestamp, topic string, service string, trace_id string, level string, payload string"
FRAME_INDEX = "offset long, id long, ts_nanos long, topic string, payload binary, checksum long, seg_base long, pos long, length int, crc_ok boolean"
REJECT = "src string, line long, code string, message string, raw string"

# The limits of the wire and file formats.
MAX_TOPIC_BYTES = 65_535
MAX_PAYLOAD_BYTES = 1 << 20
MAX_FRAME_BYTES = 10 << 20
MAX_LINE_BYTES = 1 << 20
MAX_SINGLE_BODY_BYTES = 2 << 20
MAX_BATCH_ITEMS = 1000
MAX_BATCH_BYTES = 10 << 20
FRAME_HEADER_BYTES = 29
DEFAULT_LIMIT, MAX_LIMIT = 100, 10_000
SUBSCRIBER_QUEUE = 256
MAX_TRACKED_TOPICS, MAX_TRACKED_TOPIC_BYTES, OVERFLOW_TOPIC = 1000, 128, "__overflow__"
LEVEL_RANKS = {"DEBUG": 1, "INFO": 2, "WARN": 3, "ERROR": 4, "FATAL": 5}


@dataclass(frozen=True)
class EngineConfig:
    """Settings of log, ring and delivery; ``library`` and ``service`` are the two presets."""

    batch_size: int = 100
    flush_interval_s: float = 0.05
    initial_backoff_s: float = 0.02
    max_backoff_s: float = 1.0
    max_payload: int = MAX_PAYLOAD_BYTES
    max_capacity: int = 10_000
    max_bytes: int = 0
    max_segment_bytes: int = 0
    ring_capacity: int = 50_000
    delivery_timeout_s: float = 10.0

    @staticmethod
    def library(**changes) -> EngineConfig:
        return replace(EngineConfig(), **changes)

    @staticmethod
    def service(**changes) -> EngineConfig:
        return replace(EngineConfig(batch_size=50, max_capacity=50_000, max_bytes=1 << 30, max_segment_bytes=64 << 20), **changes)

    @staticmethod
    def from_settings(given: dict[str, str], env: dict[str, str], prefix: str = "LOG_") -> EngineConfig:
        """``given`` wins over ``env`` (names upper-cased behind ``prefix``), env over the service preset; bad numbers raise."""
        base = EngineConfig.service()
        found = {}
        for name in base.__dataclass_fields__:
            raw = given.get(name, env.get(prefix + name.upper()))
            if raw not in (None, ""):
                found[name] = type(getattr(base, name))(raw)
        out = replace(base, **found)
        if out.batch_size < 1 or out.ring_capacity < 1 or out.max_capacity < 0:
            raise ValueError("batch_size and ring_capacity must be positive")
        return out


@dataclass(frozen=True)
class LogQuery:
    """Newest ``limit`` entries with the given trace, service and level; '' is no predicate."""

    trace_id: str = ""
    service: str = ""
    level: str = ""
    limit: int = 0

    def clamped(self) -> int:
        return DEFAULT_LIMIT if self.limit <= 0 else min(self.limit, MAX_LIMIT)


def http_limit(raw: str | None) -> int:
    """A limit as the query route reads it: the default if missing, not a number, or not positive."""
    try:
        n = int(raw or "")
    except ValueError:
        return DEFAULT_LIMIT
    return n if n > 0 else DEFAULT_LIMIT


@dataclass(frozen=True)
class ConsoleFilter:
    """Console predicates: minimum level, exact topic and trace, folded service, regular expression, first ``limit``."""

    service: str = ""
    topic: str = ""
    trace_id: str = ""
    level: str = ""
    grep: str = ""
    limit: int = 0


@dataclass(frozen=True)
class Headers:
    """Request headers that rows inherit."""

    topic: str = ""
    trace_id: str = ""
    service: str = ""
    level: str = ""
