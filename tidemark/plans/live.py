"""Queries that run through files and streams: frame logs, delivery, live tails."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import EngineConfig
from tidemark.operators import hub, scratch
from tidemark.plans.queries import RAW_SQL, records, table
from tidemark.sources import frames
from tidemark.streaming import delivery

SEGMENT = 1 << 20
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _logged(spark, d) -> DataFrame:
    """All events as log records."""
    r = records(spark, d)
    return r.select("offset", "id", (F.col("offset") * 1000).alias("ts_nanos"), "topic", F.col("payload").cast("binary").alias("payload"))


@_query(f"""WITH {RAW_SQL} SELECT "offset", id, "offset" * 1000 AS ts_nanos, topic, payload, CAST(29 + strlen(topic) + strlen(payload) AS INTEGER) AS length, true AS crc_ok FROM ent""")
def frame_round_trip(spark, d):
    path = scratch.scratch_path(spark, "frames")
    frames.write_log(_logged(spark, d), path, SEGMENT)
    got = spark.read.format("framelog").option("path", path).load()
    return got.select("offset", "id", "ts_nanos", "topic", F.col("payload").cast("string").alias("payload"), "length", "crc_ok")


@_query(f"""WITH {RAW_SQL} SELECT "offset", id FROM ent WHERE "offset" >= 700""")
def frame_scan_from_offset(spark, d):
    path = scratch.scratch_path(spark, "frames")
    frames.write_log(_logged(spark, d), path, SEGMENT)
    return spark.read.format("framelog").option("path", path).option("from_offset", 700).load().select("offset", "id")


@_query("""SELECT count(*) AS delivered, count(*) AS committed, CAST(ceil(count(*) / 50) AS BIGINT) AS delivery_attempts, CAST(0 AS BIGINT) AS retries, max(event_id) + 1 AS checkpoint FROM events""")
def delivery_counters(spark, d):
    path = scratch.scratch_path(spark, "frames")
    frames.write_log(_logged(spark, d), path, SEGMENT)
    stream = spark.readStream.format("framelog").option("path", path).option("records_per_batch", 0).load()
    dispatcher = delivery.Dispatcher(lambda items, timeout: None, EngineConfig(batch_size=50))
    q = delivery.deliver(stream, dispatcher, scratch.scratch_path(spark, "delivery"))
    q.awaitTermination()
    c = dispatcher.counters
    # the source is told of a finished batch when the next one is planned; drained, the driver commits the rest
    frames.write_checkpoint(path, c["committed"])
    row = (c["delivered"], c["committed"], c["delivery_attempts"], c["retries"], frames.read_checkpoint(path))
    return spark.createDataFrame([row], "delivered long, committed long, delivery_attempts long, retries long, checkpoint long")


@_query(f"""WITH {RAW_SQL} SELECT "offset", service, level FROM ent WHERE service = 'svc-4' AND level = 'WARN'""")
def live_tail(spark, d):
    """A stream of the events with one subscriber, drained into a table."""
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    name = f"tail_{uuid.uuid4().hex}"
    rows = hub.normalise(hub.extract(_as_records(source), "fast"))
    seen = delivery.live_tail(rows, "SVC-4", "warn").select("offset", "service", "level")
    q = seen.writeStream.format("memory").queryName(name).option("checkpointLocation", scratch.scratch_path(spark, "tail")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _as_records(events: DataFrame) -> DataFrame:
    level = F.when(F.col("event_type") == "purchase", " Warn ").otherwise("x")
    user = F.col("user_id").cast("string")
    payload = F.concat(F.lit('{"trace_id":"tr-'), user, F.lit('","service":"Svc-'), (F.col("user_id") % 7).cast("string"), F.lit('","level":"'), level, F.lit('"}'))
    return events.select(F.col("event_id").alias("offset"), (F.col("event_id") + 1).alias("id"), "ts", F.col("event_type").alias("topic"), payload.alias("payload"))


@_query("""SELECT date_trunc('hour', ts) AS start, event_type AS topic, count(*) AS n FROM events GROUP BY 1, 2""")
def event_rates(spark, d):
    """Extension, over a bounded table."""
    got = delivery.event_rates(records(spark, d), "1 hour")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "topic", "n")
