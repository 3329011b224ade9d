"""Frames, segment directories, streaming delivery."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.model import EngineConfig
from tidemark.sources import frames
from tidemark.streaming import delivery


def put(folder, base, n, start=0):
    data = b"".join(frames.encode(start + i + 1, 1000 + i, "t", b"payload-%d" % i) for i in range(n))
    (folder / f"segment-{base:012d}.wal").write_bytes(data)
    return data


def load(spark, path, **options):
    frames.register(spark)
    r = spark.read.format("framelog").option("path", str(path))
    for k, v in options.items():
        r = r.option(k, v)
    return r.load().orderBy("offset").collect()


def test_frame_codec():
    f = frames.encode(5, -7, "tópic", b"\x00\xff")
    got = frames.decode(f + b"padding")
    assert (got["id"], got["ts_nanos"], got["topic"], got["payload"], got["length"]) == (5, -7, "tópic", b"\x00\xff", 29 + 6 + 2)
    for bad, kind in ((f[:20], "truncated"), (f[:-1], "truncated"), (b"XX" + f[2:], "magic"), (f[:2] + b"\x09" + f[3:], "version"), (f[:-1] + b"\x00", "checksum")):
        with pytest.raises(frames.FrameError) as e:
            frames.decode(bad)
        assert e.value.kind == kind


def test_torn_tail_and_corruption(spark, tmp_path):
    data = put(tmp_path, 0, 5)
    (tmp_path / "segment-000000000000.wal").write_bytes(data + b"\x57\x53\x01junk")
    assert len(load(spark, tmp_path)) == 5
    one = len(data) // 5
    broken = bytearray(data)
    broken[2 * one - 2] ^= 1
    (tmp_path / "segment-000000000000.wal").write_bytes(bytes(broken))
    assert [r.crc_ok for r in load(spark, tmp_path)] == [True, False, True, True, True]


def test_segments_in_order(spark, tmp_path):
    put(tmp_path, 0, 3)
    put(tmp_path, 3, 4, 3)
    rows = load(spark, tmp_path)
    assert [r.offset for r in rows] == list(range(7)) and [r.id for r in rows] == list(range(1, 8)) and rows[4].pos == rows[3].length
    assert [r.offset for r in load(spark, tmp_path, from_offset=5)] == [5, 6]


def test_directories_that_are_refused(tmp_path):
    assert frames.classify(str(tmp_path)) == []
    frames.write_checkpoint(str(tmp_path), 5)
    frames.write_checkpoint(str(tmp_path), 3)
    assert frames.read_checkpoint(str(tmp_path)) == 5
    with pytest.raises(ValueError):
        frames.classify(str(tmp_path))
    put(tmp_path, 0, 1)
    with pytest.raises(ValueError):
        frames.classify(str(tmp_path), segmented=False)
    (tmp_path / "active.wal").write_bytes(b"x")
    with pytest.raises(ValueError):
        frames.classify(str(tmp_path))
    (tmp_path / "active.wal").unlink()
    (tmp_path / "segment-x.wal").write_bytes(b"")
    with pytest.raises(ValueError):
        frames.classify(str(tmp_path))
    (tmp_path / "segment-x.wal").unlink()
    os.symlink(tmp_path / "segment-000000000000.wal", tmp_path / "segment-000000000001.wal")
    with pytest.raises(ValueError):
        frames.classify(str(tmp_path))


def test_short_checkpoint(tmp_path):
    (tmp_path / frames.CHECKPOINT).write_bytes(b"\x00\x01")
    assert frames.read_checkpoint(str(tmp_path)) == 0


def test_write_rotates(spark, tmp_path):
    rows = spark.range(25).select(F.col("id").alias("offset"), (F.col("id") + 1).alias("id"), F.lit(1).cast("long").alias("ts_nanos"), F.lit("t").alias("topic"), F.repeat(F.lit("x"), 20).cast("binary").alias("payload"))
    frames.write_log(rows, str(tmp_path / "log"), 200)
    files = sorted(os.listdir(tmp_path / "log"))
    assert len(files) >= 5 and all(os.path.getsize(tmp_path / "log" / f) <= 200 for f in files)
    assert [r.offset for r in load(spark, tmp_path / "log")] == list(range(25))


def stream(spark, path, most=0):
    frames.register(spark)
    return spark.readStream.format("framelog").option("path", str(path)).option("records_per_batch", most).load()


def test_transient_failures_are_retried(spark, tmp_path):
    put(tmp_path, 0, 10)
    calls, got = [], []

    def sink(items, timeout):
        calls.append(len(items))
        if len(calls) < 3:
            raise delivery.Transient("down")
        got.extend(items)

    d = delivery.Dispatcher(sink, EngineConfig(batch_size=4), sleep=lambda s: None)
    delivery.deliver(stream(spark, tmp_path), d, str(tmp_path / "ck")).awaitTermination()
    assert len(got) == 10 and d.counters["retries"] == 2 and d.counters["delivered"] == 10 and calls == [4, 4, 4, 4, 2]


def test_rejected_and_corrupt_are_passed_over(spark, tmp_path):
    data = bytearray(put(tmp_path, 0, 6))
    data[len(data) // 6 * 3 - 2] ^= 1  # the third frame
    (tmp_path / "segment-000000000000.wal").write_bytes(bytes(data))
    got = []

    def sink(items, timeout):
        if '"offset":0' in items[0]:
            raise delivery.Rejected("no")
        got.append(len(items))

    d = delivery.Dispatcher(sink, EngineConfig(batch_size=2), sleep=lambda s: None)
    delivery.deliver(stream(spark, tmp_path), d, str(tmp_path / "ck")).awaitTermination()
    assert list(d.rejects) == [0, 1] and d.counters["corrupt_skips"] == 1 and got == [2, 1] and d.counters["committed"] == 6


def test_unfinished_batches_come_again(spark, tmp_path):
    put(tmp_path, 0, 3)
    seen = []

    def failing(items, timeout):
        seen.append(len(items))
        raise delivery.Transient("down")

    d = delivery.Dispatcher(failing, max_attempts=1, sleep=lambda s: None)
    with pytest.raises(Exception):  # noqa: B017
        delivery.deliver(stream(spark, tmp_path), d, str(tmp_path / "ck")).awaitTermination()
    d = delivery.Dispatcher(lambda items, timeout: seen.append(len(items)))
    delivery.deliver(stream(spark, tmp_path), d, str(tmp_path / "ck")).awaitTermination()
    assert seen == [3, 3]


def test_recovery_cuts_clamps_and_prunes(tmp_path):
    put(tmp_path, 0, 3)
    put(tmp_path, 3, 2, 3)
    data = put(tmp_path, 5, 4, 5)
    last = tmp_path / "segment-000000000005.wal"
    last.write_bytes(data + b"\x57\x53\x01junk")
    frames.write_checkpoint(str(tmp_path), 4)
    assert frames.recover(str(tmp_path)) == 7 and last.read_bytes() == data
    assert sorted(f for f in os.listdir(tmp_path) if f.endswith(".wal")) == ["segment-000000000003.wal", "segment-000000000005.wal"]
    assert frames.recover(str(tmp_path)) == 0 and frames.read_checkpoint(str(tmp_path)) == 4
    last.write_bytes(data[:-1])
    frames.write_checkpoint(str(tmp_path), 9)
    assert frames.recover(str(tmp_path)) == len(data) // 4 - 1 and frames.read_checkpoint(str(tmp_path)) == 8
    assert frames.prune(str(tmp_path)) == [] and len(frames.classify(str(tmp_path))) == 1  # the newest stays


def test_stream_sees_what_is_appended(spark, tmp_path):
    put(tmp_path, 0, 3)
    reader = frames._StreamReader(str(tmp_path), 0)
    assert reader.latestOffset() == {"offset": 3}
    whole = put(tmp_path, 0, 7)
    assert reader.latestOffset() == {"offset": 7} and reader.seen == (0, len(whole), 7)
    put(tmp_path, 7, 2, 7)
    assert reader.latestOffset() == {"offset": 9} and reader.latestOffset() == {"offset": 9}


def test_backoff_stays_within_bounds():
    rng, delay = random.Random(1), 0.0
    for _ in range(200):
        delay = delivery.next_backoff(delay, 0.02, 1.0, rng)
        assert 0.02 <= delay <= 1.0
    assert 0 < delivery.next_backoff(0, 0, 0, rng) <= 0.02


def test_status_classes():
    assert [delivery.classify_status(s) for s in (200, 299, 408, 429, 400, 404, 500, 302, None)] == ["ok", "ok", "transient", "transient", "permanent", "permanent", "transient", "transient", "transient"]


def test_fan_out_runs_after_the_append(spark):
    rows = spark.createDataFrame([(0, "a", "INFO"), (1, "b", "WARN")], "offset long, service string, level string")
    given, order = {}, []
    each = delivery.fan_out({"all": ("", ""), "warn": ("B", "warn")}, lambda n, r: (order.append(n), given.update({n: [x.offset for x in r]})), lambda df, i: order.append("append"))
    each(rows, 0)
    assert given == {"all": [0, 1], "warn": [1]} and order[0] == "append"
    lost = {}
    delivery.fan_out({"all": ("", "")}, lambda n, r: given.update({n: [x.offset for x in r]}), queue=1, dropped=lost.__setitem__)(rows, 1)
    assert given["all"] == [0] and lost == {"all": 1}
