"""An event log in a folder: enqueue, query, stream, deliver.

``records`` holds what was accepted (offset, id, ts_nanos, topic, payload) together with the columns that queries
ask for, extracted once at ingest, so that their predicates reach the Parquet scan.  One writer at a time: the
next offset and id are read from the table when a batch is appended, so an append holds the folder's lock file,
and a second writer is refused; ``unlock`` takes away the lock of a writer that died.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import ConsoleFilter, EngineConfig, Headers, LogQuery
from tidemark.operators import hub, ingest, log, otlp, scratch
from tidemark.sources import frames
from tidemark.streaming import delivery

RETRY_AFTER_S = 1  # fixed value: what a refused writer is told to wait
SCHEMA = "offset long, id long, ts_nanos long, ts timestamp, topic string, payload string, service string, trace_id string, level string, crc_ok boolean"


class EventLog:
    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None, clock: Callable[[], int] = time.time_ns):
        self.spark, self.path, self.config, self.clock = spark, path.rstrip("/"), config or EngineConfig.service(), clock
        self.closed = False

    def _file(self, name: str):
        """(file system, path) of something in the log's folder."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    @contextmanager
    def _writing(self) -> Iterator[None]:
        if self.closed:
            raise RuntimeError("the log is closed")
        fs, lock = self._file("writer.lock")
        if not fs.createNewFile(lock):
            raise RuntimeError(f"another writer holds {self.path}/writer.lock")
        try:
            yield
        finally:
            fs.delete(lock, False)

    def unlock(self) -> None:
        fs, lock = self._file("writer.lock")
        fs.delete(lock, False)

    def records(self) -> DataFrame:
        fs, p = self._file("records")
        if not fs.exists(p):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/records")

    def _append(self, judged: DataFrame, order: list[str]) -> tuple[int, int]:
        """Append what is valid and fits; (appended, refused for lack of room)."""
        with self._writing():
            return self._add(judged, order)

    def _add(self, judged: DataFrame, order: list[str]) -> tuple[int, int]:
        have = self.records().agg(F.coalesce(F.max("offset"), F.lit(-1)).alias("o"), F.coalesce(F.max("id"), F.lit(0)).alias("i")).first()
        numbered = ingest.assign(judged.where("code is null").select("topic", "payload", *order), order, self.clock(), have.i, have.o + 1)
        try:
            rows, total = numbered, numbered.count()
            if self.config.max_capacity > 0:
                room = max(self.config.max_capacity - (have.o + 1 - self.checkpoint()), 0)
                full = rows.where(F.col("offset") > have.o + room).count()
                rows = rows.where(F.col("offset") <= have.o + room)
            else:
                full = 0
            n = total - full
            if n:
                entry = hub.normalise(hub.extract(rows, "exact"))
                entry = entry.withColumn("ts", F.timestamp_micros(F.floor(F.col("ts_nanos") / 1000).cast("long"))).withColumn("crc_ok", F.lit(True))
                fields = [f.split()[0] for f in SCHEMA.split(", ")]
                entry.withColumn("topic", F.coalesce("topic", F.lit(""))).select(*fields).write.mode("append").parquet(f"{self.path}/records")
            return n, full
        finally:
            scratch.drop(numbered)

    def enqueue(self, bodies: list[str], headers: Headers = Headers()) -> list[dict]:  # noqa: B008
        """One request each: status accepted with topic and size, or the code it was refused with."""
        df = self.spark.createDataFrame(list(enumerate(bodies)), "n long, body string")
        judged = ingest.single(df, headers).persist()
        try:
            n, _ = self._append(judged, ["n"])
            out, taken = [], 0
            for r in judged.orderBy("n").collect():
                if r.code is None:
                    taken += 1
                code = r.code or ("spool_full" if taken > n else None)
                out.append({"status": "accepted", "topic": r.topic, "size_bytes": r.size} if code is None else {"error": code} | ({"retry_after_s": RETRY_AFTER_S} if code == "spool_full" else {}))
            return out
        finally:
            judged.unpersist()

    def enqueue_ndjson(self, body: str, headers: Headers = Headers(), strict: bool = False) -> dict:  # noqa: B008
        """Lines of one request: the summary; in strict mode lines from the first fault on are not taken."""
        df = self.spark.createDataFrame([(1, body)], "req int, body string")
        judged = ingest.until_abort(ingest.ndjson(ingest.lines(df), headers), strict, ["req"]).persist()
        try:
            n, full = self._append(judged, ["line"])
            s = ingest.ndjson_summary(judged).first().asDict(recursive=True)
            return {"error": "spool_full", "enqueued": n, "retry_after_s": RETRY_AFTER_S} if full else s
        finally:
            judged.unpersist()

    def enqueue_batch(self, body: str, headers: Headers = Headers()) -> dict:  # noqa: B008
        """A JSON array: all of its items or none."""
        items = ingest.batch_items(self.spark.createDataFrame([(1, body)], "req int, body string"), headers).persist()
        try:
            s = ingest.batch_summary(items, ("req",)).drop("req").first().asDict()
            if s["status"] != "ok":
                return s
            n, full = self._append(items, ["index"])
            return {"error": "spool_full", "enqueued": n, "total": n + full, "retry_after_s": RETRY_AFTER_S} if full else s
        finally:
            items.unpersist()

    def enqueue_otlp(self, body: str | bytes) -> dict:
        """One OpenTelemetry export request, JSON text or protobuf bytes."""
        binary = isinstance(body, bytes)
        df = self.spark.createDataFrame([(1, bytearray(body) if binary else body)], f"req int, body {'binary' if binary else 'string'}")
        rows = otlp.records(df, binary, self.clock()).withColumn("code", F.coalesce("code", ingest.record_fault(F.col("topic"), F.col("payload")))).persist()
        try:
            bad = rows.where("code is not null").first()
            if bad is not None:
                return {"error": bad.code}
            n, full = self._append(rows, ["index"])
            return {"error": "spool_full", "enqueued": n, "total": n + full, "retry_after_s": RETRY_AFTER_S} if full else {"enqueued": n}
        finally:
            rows.unpersist()

    def query_logs(self, trace_id: str = "", service: str = "", level: str = "", limit: int = 0) -> DataFrame:
        """The newest matching entries of the ring, oldest first."""
        return hub.query(hub.ring(self.records(), self.config.ring_capacity), LogQuery(trace_id, service, level, limit))

    def grep(self, f: ConsoleFilter) -> DataFrame:
        return hub.console_filter(self.records(), f)

    def stream_logs(self, service: str = "", level: str = "") -> DataFrame:
        """Entries appended from now on, or from where the streaming query's checkpoint left off."""
        return delivery.live_tail(self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/records"), service, level)

    def get_stats(self) -> dict:
        return hub.stats(self.records(), self.config.ring_capacity).first().asDict() | log.uncommitted(self.records(), self.checkpoint()).first().asDict()

    def checkpoint(self) -> int:
        """The next offset to deliver."""
        return frames.read_checkpoint(self.path)

    def flush(self, sink: Callable[[list[str], float], None], **options) -> dict:
        """Deliver all that is pending, in order; the checkpoint moves after each batch that was taken or rejected, so
        what fails or crashes later doesn't repeat it."""
        d = delivery.Dispatcher(sink, self.config, on_commit=lambda next_offset: frames.write_checkpoint(self.path, next_offset), **options)
        pending = log.pending(self.records(), self.checkpoint())
        if not pending.isEmpty():
            d(pending, 0)
        return d.counters

    def close(self, sink: Callable[[list[str], float], None] | None = None, drain_s: float = 5.0) -> dict:
        """Refuse further writes and deliver what is pending for at most ``drain_s`` seconds; what is left then stays
        pending.  A second call does nothing."""
        if self.closed:
            return {}
        self.closed = True
        if sink is None:
            return {}
        until = time.monotonic() + drain_s
        d = delivery.Dispatcher(sink, self.config, on_commit=lambda next_offset: frames.write_checkpoint(self.path, next_offset), until=until)
        try:
            d(log.pending(self.records(), self.checkpoint()), 0)
        except delivery.OutOfTime:
            pass
        return d.counters
