"""The ordered log as a table: pending records, delivery batches, admission, segments, pruning, accounting.

Offsets are dense, so most "running" questions are answered from offsets and scalar aggregates; where a running
value is needed it is made per block of offsets and shifted by the blocks before.  Only the two greedy rules
(byte quota, segment rotation) are sequential by nature: they fold each log's rows in order, streaming.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.model import FRAME_HEADER_BYTES, MAX_FRAME_BYTES


def frame_length(topic: Column, payload: Column) -> Column:
    return (F.lit(FRAME_HEADER_BYTES) + F.octet_length(topic) + F.octet_length(payload)).cast("long")


def frame_ok(frame: Column, checksum: Column) -> Column:
    """CRC-32 of everything behind the checksum field."""
    return F.crc32(F.substring(frame, 8, F.octet_length(frame))) == checksum


def oversized(records: DataFrame) -> DataFrame:
    return records.where(frame_length(F.col("topic"), F.col("payload")) > MAX_FRAME_BYTES)


def pending(records: DataFrame, checkpoint: int) -> DataFrame:
    return records.where(F.col("offset") >= checkpoint)


def read_batch(records: DataFrame, checkpoint: int, n: int) -> DataFrame:
    """Up to ``n`` records from the checkpoint on, ending before the first corrupt one (``crc_ok`` false)."""
    return valid_prefix(pending(records, checkpoint)).orderBy("offset").limit(max(n, 0))


def valid_prefix(records: DataFrame) -> DataFrame:
    """Records before the first corrupt one: one scalar minimum, no window."""
    first = records.where(~F.col("crc_ok")).agg(F.min("offset").alias("_bad"))
    return records.join(F.broadcast(first)).where(F.col("_bad").isNull() | (F.col("offset") < F.col("_bad"))).drop("_bad")


def commit_target(records: DataFrame, checkpoint: int, offset: int) -> DataFrame:
    """One row: the checkpoint after ``commit(offset)`` and whether it is refused (beyond the end of the log)."""
    end = records.agg((F.coalesce(F.max("offset"), F.lit(-1)) + 1).alias("end"))
    refused = F.lit(offset) >= F.col("end")
    return end.select(refused.alias("refused"), F.when(refused, F.lit(checkpoint)).otherwise(F.greatest(F.lit(checkpoint), F.lit(offset + 1))).cast("long").alias("checkpoint"))


def batches(records: DataFrame, checkpoint: int, batch_size: int, block: int = 1 << 20) -> DataFrame:
    """offset, batch_id, batch_pos of every deliverable record: contiguous runs of at most ``batch_size`` that don't
    span a corrupt record; batch_id is the offset of the run's first record.

    The last corrupt offset before a row is a running maximum within its block of offsets, or comes from the blocks
    before (one row per block).
    """
    rows = pending(records, checkpoint).select("offset", "crc_ok").withColumn("_b", F.floor(F.col("offset") / block))
    bad = F.when(~F.col("crc_ok"), F.col("offset"))
    totals = rows.groupBy("_b").agg(F.max(bad).alias("_last"))
    before = totals.withColumn("_prior", F.max("_last").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", "_prior")
    here = F.max(bad).over(Window.partitionBy("_b").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))
    run = rows.withColumn("_here", here).join(before, "_b").where("crc_ok")
    start = F.greatest(F.coalesce(F.greatest("_here", "_prior") + 1, F.lit(checkpoint)), F.lit(checkpoint))
    at = F.col("offset") - start
    first = (F.col("offset") - F.pmod(at, F.lit(batch_size))).cast("long")
    return run.select("offset", first.alias("batch_id"), F.pmod(at, F.lit(batch_size)).cast("long").alias("batch_pos"))


def uncommitted(records: DataFrame, checkpoint: int) -> DataFrame:
    """One row: how many records, and how many serialized bytes, wait behind the checkpoint."""
    size = frame_length(F.col("topic"), F.col("payload"))
    return pending(records, checkpoint).agg(F.count("*").alias("records"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def last_id(records: DataFrame) -> DataFrame:
    return records.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))


def admit_by_count(records: DataFrame, capacity: int, backlog: int = 0) -> DataFrame:
    """Records with ``admitted``: while nothing is committed the first capacity - backlog by offset are."""
    low = records.agg(F.min("offset").alias("_low"))
    return records.join(F.broadcast(low)).withColumn("admitted", F.col("offset") - F.col("_low") < max(capacity - backlog, 0)).drop("_low")


def _fold(rows: DataFrame, schema: str, order: list[str], by: list[str], step: Callable, start: Callable) -> DataFrame:
    """Fold each group's rows in order.  ``step(state, row) -> (state, value)``; rows stream, only the state is held."""
    names = rows.columns

    def run(found):
        key, state = object(), None
        for batch in found:
            columns = batch.to_pydict()
            made = []
            for i in range(batch.num_rows):
                row = {c: columns[c][i] for c in names}
                now = tuple(row[c] for c in by)
                if now != key:
                    key, state = now, start()
                state, value = step(state, row)
                made.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], [*names, schema.split()[0]])

    laid = rows.repartition(*by) if by else rows.coalesce(1)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return laid.sortWithinPartitions(*by, *order).mapInArrow(run, f"{kinds}, {schema}")


def admit_events(events: DataFrame, capacity: int, by: tuple[str, ...] = (), backlog: int = 0) -> DataFrame:
    """events: seq, delta (+1 asks for a place, -n frees n): ``admitted`` in order of seq; frees never go below zero."""

    def step(used, row):
        if row["delta"] < 0:
            return max(used + row["delta"], 0), True
        return (used + 1, True) if used + 1 <= capacity else (used, False)

    return _fold(events, "admitted boolean", ["seq"], list(by), step, lambda: backlog)


def admit_by_bytes(records: DataFrame, quota: int, by: tuple[str, ...] = (), used: int = 0) -> DataFrame:
    """records: offset, length: a record that doesn't fit is refused, a later smaller one may still fit."""

    def step(total, row):
        fits = quota <= 0 or total + row["length"] <= quota
        return (total + row["length"] if fits else total), fits

    return _fold(records, "admitted boolean", ["offset"], list(by), step, lambda: used)


def segments(records: DataFrame, max_bytes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """records: offset, length: seg_base of the segment each goes to.  A new one begins when the current is not empty
    and would grow beyond ``max_bytes``; a larger record has a segment of its own.  0: one segment."""

    def step(state, row):
        base, at = state
        if base is None or (max_bytes > 0 and at > 0 and at + row["length"] > max_bytes):
            base, at = row["offset"], 0
        return (base, at + row["length"]), base

    return _fold(records, "seg_base long", ["offset"], list(by), step, lambda: (None, 0))


def positions(assigned: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Byte position of each record in its segment (a segment is bounded, so the window is)."""
    w = Window.partitionBy(*by, "seg_base").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    return assigned.withColumn("pos", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))


def prunable(assigned: DataFrame, checkpoint: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Segments that may be deleted: all of their offsets lie before the checkpoint, and they aren't their log's newest."""
    per = assigned.groupBy(*by, "seg_base").agg(F.max("offset").alias("last_offset"), F.count("*").alias("records"), F.sum("length").alias("bytes"))
    if by:
        per = per.withColumn("_active", F.max("seg_base").over(Window.partitionBy(*by)))
    else:
        per = per.join(F.broadcast(per.agg(F.max("seg_base").alias("_active"))))
    return per.where((F.col("seg_base") < F.col("_active")) & (F.col("last_offset") < checkpoint)).drop("_active")


def disk_bytes(spark, path: str) -> DataFrame:
    """One row: total size of the log files below ``path``, from file listings."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def sink_rows(records: DataFrame) -> DataFrame:
    """offset and ``item``, the JSON object that a batch sink receives; payloads that aren't JSON are quoted."""
    from tidemark.functions.text import json_quote
    from tidemark.operators.hub import wrap_payload

    pair = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    fields = [pair("offset", F.col("offset").cast("string")), pair("id", F.col("id").cast("string")), pair("timestamp_nano", F.col("ts_nanos").cast("string")), pair("topic", json_quote(F.col("topic"))), pair("payload", wrap_payload(F.col("payload").cast("string"), "fast"))]
    return records.select("offset", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("item"))
