"""The log's binary frames and segment directories, and a Spark data source over them.

A frame is big-endian: magic (2 bytes), version (1), CRC-32 of all that follows (4), id (8), time in nanoseconds
(8), topic length (2), payload length (4), topic, payload.  A directory holds segments named by the offset of
their first record, or one unsegmented file; ``checkpoint`` is the next offset to deliver, 8 bytes.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidemark.model import FRAME_HEADER_BYTES, FRAME_INDEX, MAX_FRAME_BYTES

# Fixed values of the file format.
MAGIC, VERSION = b"\x57\x53", 1
HEADER = struct.Struct(">2sBIQqHI")
SEGMENT = re.compile(r"^segment-(\d{12})\.wal$")
SINGLE, CHECKPOINT = "active.wal", "checkpoint.bin"


class FrameError(ValueError):
    """Bytes that are no whole, sound frame; ``kind``: truncated, magic, version or checksum."""

    def __init__(self, kind: str):
        super().__init__(f"frame: {kind}")
        self.kind = kind


def encode(id: int, ts_nanos: int, topic: str, payload: bytes) -> bytes:
    t = topic.encode()
    tail = struct.pack(">QqHI", id, ts_nanos, len(t), len(payload)) + t + payload
    return MAGIC + bytes([VERSION]) + struct.pack(">I", zlib.crc32(tail)) + tail


def decode(data: bytes, check: bool = True) -> dict:
    """Fields of the frame at the start of ``data``; what follows it is ignored."""
    if len(data) < FRAME_HEADER_BYTES:
        raise FrameError("truncated")
    magic, version, crc, id_, ts, nt, np_ = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise FrameError("magic")
    if version != VERSION:
        raise FrameError("version")
    end = FRAME_HEADER_BYTES + nt + np_
    if len(data) < end:
        raise FrameError("truncated")
    ok = zlib.crc32(data[7:end]) == crc
    if check and not ok:
        raise FrameError("checksum")
    topic = data[FRAME_HEADER_BYTES : FRAME_HEADER_BYTES + nt]
    return {"id": id_, "ts_nanos": ts, "topic": topic.decode("utf-8", "replace"), "payload": data[FRAME_HEADER_BYTES + nt : end], "checksum": crc, "length": end, "crc_ok": ok}


def walk(f, size: int):
    """(position, frame) of the good prefix of an open segment: it ends at a short header, foreign bytes, an
    impossible length or a body past the end.  Checksums are reported, not enforced."""
    pos = 0
    while True:
        head = f.read(FRAME_HEADER_BYTES)
        if len(head) < FRAME_HEADER_BYTES or head[:2] != MAGIC or head[2] != VERSION:
            return
        nt, n = struct.unpack_from(">HI", head, 23)
        length = FRAME_HEADER_BYTES + nt + n
        if length > MAX_FRAME_BYTES or pos + length > size:
            return
        body = f.read(nt + n)
        if len(body) < nt + n:
            return
        yield pos, decode(head + body, check=False)
        pos += length


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def read_checkpoint(path: str) -> int:
    """Next offset to deliver; 0 if there is no whole checkpoint."""
    fs, base = _store(path)
    try:
        with fs.open_input_stream(f"{base}/{CHECKPOINT}", compression=None) as f:
            data = f.read(8)
    except FileNotFoundError:
        return 0
    return struct.unpack(">Q", data)[0] if len(data) == 8 else 0


def write_checkpoint(path: str, offset: int) -> None:
    """Replace the checkpoint in one step; an older offset than the stored one changes nothing."""
    if offset <= read_checkpoint(path):
        return
    fs, base = _store(path)
    tmp = f"{base}/.{CHECKPOINT}.{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp, compression=None) as f:
        f.write(struct.pack(">Q", offset))
    fs.move(tmp, f"{base}/{CHECKPOINT}")


def recover(path: str) -> int:
    """Before appending: cut every segment to its good prefix, clamp a checkpoint beyond the log's end, and prune.
    Returns the bytes cut off.  A segment is replaced in one step, by a rename."""
    fs, _ = _store(path)
    parts, lost, end = classify(path), 0, 0
    for part in parts:
        good = 0
        end = part.base
        with fs.open_input_stream(part.file, compression=None) as f:
            for pos, r in walk(f, part.size):
                good, end = pos + r["length"], end + 1
        if good < part.size:
            lost += part.size - good
            _cut(fs, part.file, good)
    if parts and read_checkpoint(path) > end:
        fs.delete_file(f"{_store(path)[1]}/{CHECKPOINT}")
        write_checkpoint(path, end)
    prune(path)
    return lost


def _cut(fs, file: str, size: int, chunk: int = 1 << 20) -> None:
    folder, _, name = file.rpartition("/")
    tmp = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_input_stream(file, compression=None) as f, fs.open_output_stream(tmp, compression=None) as out:
        while size > 0 and (data := f.read(min(chunk, size))):
            out.write(data)
            size -= len(data)
    fs.move(tmp, file)


def prune(path: str) -> list[str]:
    """Delete the leading segments whose records are all before the checkpoint; the newest stays.  Returns their names."""
    fs, _ = _store(path)
    parts, committed, gone = classify(path), read_checkpoint(path), []
    for part, after in zip(parts[:-1], parts[1:], strict=True):
        if after.base > committed:
            break
        fs.delete_file(part.file)
        gone.append(part.file.rpartition("/")[2])
    return gone


@dataclass
class Segment(InputPartition):
    base: int
    file: str
    size: int


def classify(path: str, segmented: bool = True) -> list[Segment]:
    """The segments of a directory in order; refuses directories that can't be one log."""
    from pyarrow import fs as pfs

    fs, base = _store(path)
    found, single = [], None
    listed = fs.get_file_info(pfs.FileSelector(base, allow_not_found=True))
    for info in listed:
        name = info.base_name
        if not name.endswith(".wal"):
            continue
        if fs.type_name == "local":
            import os

            if os.path.islink(info.path):
                raise ValueError(f"{name} is a symbolic link")
        if name == SINGLE:
            single = info
        elif m := SEGMENT.match(name):
            found.append(Segment(int(m[1]), info.path, info.size))
        else:
            raise ValueError(f"{name} is no name of a segment")
    if found and not segmented:
        raise ValueError("a segmented log can't be opened as one file")
    if single is not None and single.size > 0 and any(s.base == 0 for s in found):
        raise ValueError(f"{SINGLE} and segment 0 both hold records")
    if single is not None and (single.size > 0 or not found):
        found.append(Segment(0, single.path, single.size))
    if not found and read_checkpoint(path) > 0:
        raise ValueError("a checkpoint without a log")
    return sorted(found, key=lambda s: s.base)


def _rows(path: str, part: Segment, low: int = 0, high: int | None = None):
    fs, _ = _store(path)
    with fs.open_input_stream(part.file, compression=None) as f:
        for i, (pos, r) in enumerate(walk(f, part.size)):
            at = part.base + i
            if high is not None and at >= high:
                return
            if at >= low:
                yield at, r["id"], r["ts_nanos"], r["topic"], r["payload"], r["checksum"], part.base, pos, r["length"], r["crc_ok"]


class _Reader(DataSourceReader):
    def __init__(self, path: str, low: int, segmented: bool):
        self.path, self.low, self.segmented = path, low, segmented

    def partitions(self):
        parts = classify(self.path, self.segmented)
        # a segment whose successor begins at or before ``low`` holds nothing that is asked for
        ends = [p.base for p in parts[1:]] + [None]
        return [p for p, end in zip(parts, ends, strict=True) if end is None or end > self.low]

    def read(self, partition):
        yield from _rows(self.path, partition, self.low)


class _StreamReader(DataSourceStreamReader):
    """Micro-batches of at most ``most`` records; the end of a finished batch becomes the log's checkpoint."""

    def __init__(self, path: str, most: int):
        self.path, self.most, self.at = path, most, None
        self.seen = (-1, 0, 0)  # base of the last segment, bytes and records of it that were walked

    def initialOffset(self):
        return {"offset": read_checkpoint(self.path)}

    def latestOffset(self):
        parts = classify(self.path)
        if not parts:
            return self.initialOffset()
        last = parts[-1]
        at, n = self.seen[1:] if self.seen[0] == last.base and self.seen[1] <= last.size else (0, 0)
        fs, _ = _store(self.path)
        with fs.open_input_file(last.file) as f:  # only what was added since
            f.seek(at)
            grown = 0
            for pos, r in walk(f, last.size - at):
                n, grown = n + 1, pos + r["length"]
        self.seen = (last.base, at + grown, n)
        end = last.base + n
        start = read_checkpoint(self.path) if self.at is None else self.at
        self.at = max(start, min(end, start + self.most)) if self.most > 0 else end
        return {"offset": self.at}

    def partitions(self, start, end):
        parts = classify(self.path)
        ends = [p.base for p in parts[1:]] + [None]
        wanted = [p for p, stop in zip(parts, ends, strict=True) if (stop is None or stop > start["offset"]) and p.base < end["offset"]]
        return [_Slice(p.base, p.file, p.size, start["offset"], end["offset"]) for p in wanted]

    def read(self, partition):
        yield from _rows(self.path, partition, partition.low, partition.high)

    def commit(self, end):
        write_checkpoint(self.path, end["offset"])


@dataclass
class _Slice(Segment):
    low: int
    high: int


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceWriter):
    """Rows with seg_base, sorted by offset: a file per segment, made under an attempt name and renamed on commit."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, iterator):
        fs, base = _store(self.path)
        fs.create_dir(base, recursive=True)
        files, out, current = [], None, None
        for row in iterator:
            r = dict(zip(self.names, row, strict=True))
            if r["seg_base"] != current:
                if out is not None:
                    out.close()
                current = r["seg_base"]
                tmp = f"{base}/.{current}.{uuid.uuid4().hex}"
                out = fs.open_output_stream(tmp, compression=None)
                files.append((tmp, f"{base}/segment-{current:012d}.wal"))
            out.write(encode(r["id"], r["ts_nanos"], r["topic"], bytes(r["payload"])))
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages):
        fs, _ = _store(self.path)
        for m in messages:
            for tmp, name in m.files if m else []:
                fs.move(tmp, name)

    def abort(self, messages):
        fs, _ = _store(self.path)
        for m in messages:
            for tmp, _ in m.files if m else []:
                fs.delete_file(tmp)


class FrameLog(DataSource):
    """``spark.read.format("framelog").option("path", dir)``; options: from_offset, segmented, records_per_batch (100,000;
    0: the whole backlog)."""

    @classmethod
    def name(cls):
        return "framelog"

    def schema(self):
        return FRAME_INDEX

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("from_offset", 0)), self.options.get("segmented", "true").lower() == "true")

    def streamReader(self, schema):
        return _StreamReader(self.options["path"], int(self.options.get("records_per_batch", 100_000)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], schema.names)


def register(spark) -> None:
    spark.dataSource.register(FrameLog)


def write_log(records, path: str, max_segment_bytes: int) -> None:
    """Write records (offset, id, ts_nanos, topic, payload binary) as segments of at most ``max_segment_bytes``."""
    from pyspark.sql import functions as F

    from tidemark.operators.log import frame_length, segments

    register(records.sparkSession)
    sized = records.withColumn("length", frame_length(F.col("topic"), F.col("payload")))
    placed = segments(sized.select("offset", "length"), max_segment_bytes)
    rows = records.join(placed.select("offset", "seg_base"), "offset")
    laid = rows.repartition("seg_base").sortWithinPartitions("seg_base", "offset")
    laid.select("offset", "id", "ts_nanos", "topic", "payload", "seg_base").write.format("framelog").option("path", path).mode("append").save()
