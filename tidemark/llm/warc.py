"""Deterministic sharded WARC writing and reading.

Records are range-sorted, written as one gzip member each, and rolled into files of about ``roll_bytes``
compressed bytes.  Headers and digests are regenerated from the payload.  A file is written under an attempt
name and renamed when whole; ``MANIFEST.json``, written last, lists the files with their sizes and record
counts, and a reader opens only what it lists.  The same table gives the same bytes: gzip headers carry no
time, record ids are derived from the content, and ``date`` is a parameter.  Every file begins with a warcinfo record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keyed_join, materialize, release, store
from tidemark.llm.pretoken import blocks

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _record_id(page_id, url, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {payload_digest} {url}')}>"


def _clean(value: str) -> str:
    """Header values hold no line ends; all else, percent signs included, stays as it is."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _member(head: list[str], block: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def info(name: str, date: str) -> bytes:
    """The warcinfo record at the start of a file."""
    block = b"format: WARC File Format 1.1\r\n"
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id(name, None, digest(block))}", f"WARC-Date: {date}", f"WARC-Filename: {name}"]
    return _member([*head, f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/warc-fields"], block)


def record(page_id, url, payload: bytes, holder: dict | None, date: str) -> bytes:
    """One gzip member: a response, or a revisit that names the record (page_id, url) with the same payload."""
    own = digest(payload)
    revisit = holder is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, url, own)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
        if _clean(url) != url:
            head.append(f"X-Url-Base64: {base64.b64encode(url.encode()).decode()}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(holder['page_id'], holder['url'], own)}", f"WARC-Refers-To-Date: {date}"]
        if holder["url"] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(holder['url'])}")
        head.append(f"X-Refers-To-Page-Id: {holder['page_id']}")
    head += [f"WARC-Payload-Digest: sha1:{own}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response"]
    return _member(head, block)


def members(stream, size: int = 1 << 20):
    """The uncompressed gzip members of a file, one after the other; one record in memory."""
    z, parts = zlib.decompressobj(31), []
    data = stream.read(size)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []
            if not data:
                data = stream.read(size)
        else:
            data = stream.read(size)
    if parts:
        raise ValueError("the archive ends inside a record")


def unpacked(member: bytes):
    """The records of a member: one, unless a file was packed anew."""
    while member:
        head = member.partition(b"\r\n\r\n")[0]
        length = next(int(line[16:]) for line in head.split(b"\r\n") if line.startswith(b"Content-Length: "))
        end = len(head) + 4 + length + 4
        yield member[:end]
        member = member[end:]


def parse(raw: bytes) -> dict | None:
    """Fields of a record, None for a warcinfo record; both digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{digest(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    if fields["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or f"sha1:{digest(payload)}" != fields["WARC-Payload-Digest"]):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    url = base64.b64decode(fields["X-Url-Base64"]).decode() if "X-Url-Base64" in fields else fields.get("WARC-Target-URI")
    return {
        "page_id": number("X-Page-Id"), "url": url,
        "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"),
    }


class _Roller:
    """Writes records to numbered files, a new one after ``roll_bytes``."""

    def __init__(self, root: str, part: int, roll_bytes: int, date: str):
        self.fs, self.base = store(root)
        self.part, self.roll, self.date, self.n, self.out, self.made = part, roll_bytes, date, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.n:05d}.warc.gz"
            self.tmp = f"{self.base}/_{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.rows, self.sha = self.fs.open_output_stream(self.tmp, compression=None), 0, 0, hashlib.sha256()
            self._write(info(self.name, self.date))
        self._write(data)
        self.rows += 1
        if self.size >= self.roll:
            self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.tmp, f"{self.base}/{self.name}")
            self.made.append((self.name, self.size, self.rows, self.sha.hexdigest()))
            self.out, self.n = None, self.n + 1


def write_archive(pages: DataFrame, root: str, min_revisit_bytes: int = 0, roll_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> dict:
    """Write a record per row, ordered by page_id (null first), then payload digest and url; returns the manifest.

    Null html is an empty payload.  Of records with equal payloads of ``min_revisit_bytes`` or more, the rows
    with the largest page_id are responses and the others revisits; repeated rows are repeated records, and
    rows that tie for the largest page_id are all responses.  Pages without an id become revisits if some
    page with an id has their payload, else responses.  An empty table gives a manifest without files.
    """
    fs, base = store(root)
    fs.create_dir(base, recursive=True)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.unhex(F.sha1(payload)).alias("sha"), "page_id", "url", F.octet_length(payload).alias("size")).where(F.col("size") >= min_revisit_bytes)
    holders = keyed.where("page_id is not null").groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("h")).select("sha", F.col("h.page_id").alias("holder"), F.col("h.url").alias("at"))
    holders = holders.join(keyed.groupBy("sha").agg(F.count("*").alias("n")).where("n > 1"), "sha")
    holders = materialize(holders, "warc-holders")
    # narrow rows (page, payload) -> holder and its url; they travel with the pages through the one exchange of payloads
    notes = keyed_join(keyed.select("sha", "page_id"), holders, "sha", "n").where("page_id is null or page_id <> holder").distinct()
    sha = F.unhex(F.sha1(payload)).alias("sha")
    rows = pages.select("page_id", F.lit(1).alias("kind"), "url", payload.alias("payload"), F.lit(None).cast("long").alias("holder"), sha).unionByName(
        notes.select("page_id", F.lit(0).alias("kind"), F.col("at").alias("url"), F.col("sha").alias("payload"), "holder", "sha")
    )

    def run(batches):
        out, page, held = _Roller(root, TaskContext.get().partitionId(), roll_bytes, date), None, None
        for batch in batches:
            for a, n in blocks(batch.column(3)):
                for page_id, kind, url, data, holder, sha in zip(*(c.to_pylist() for c in batch.slice(a, n).columns), strict=True):
                    if (page_id, sha) != page:
                        page, held = (page_id, sha), None
                    if kind == 0:
                        held = {"page_id": holder, "url": url}
                    else:
                        out.add(record(page_id, url, data, held, date))
        out.close()
        names = ["file", "bytes", "records", "sha256"]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in out.made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names)

    # the digest deals out many rows of one id, such as null, and keeps a note with the pages it is about
    ordered = rows.repartitionByRange("page_id", "sha").sortWithinPartitions("page_id", "sha", "kind", "url")
    # a row per archive file: the manifest is bounded by bytes written / roll_bytes plus the partitions
    files = sorted(tuple(r) for r in ordered.mapInArrow(run, "file string, bytes long, records long, sha256 string").collect())
    release(holders)
    manifest = {"files": [dict(zip(("file", "bytes", "records", "sha256"), f, strict=True)) for f in files]}
    with fs.open_output_stream(f"{base}/_MANIFEST.tmp") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{base}/_MANIFEST.tmp", f"{base}/MANIFEST.json")
    return manifest


def read_archive(spark, root: str) -> DataFrame:
    """Every record of the files in the manifest; the payload of revisits is null."""
    fs, base = store(root)
    with fs.open_input_stream(f"{base}/MANIFEST.json") as f:
        files = [(x["file"], x["records"]) for x in json.loads(f.read())["files"]]

    def run(batches):
        fs, base = store(root)
        for batch in batches:
            for name, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size, n = [], 0, 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for raw in (r for m in members(f) for r in unpacked(m)):
                        found = parse(raw)
                        if found is None:
                            continue
                        rows.append(found)
                        size, n = size + len(raw), n + 1
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if n != records:
                    raise ValueError(f"{name} has {n} of {records} records")
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return spark.createDataFrame(files, "file string, records long").repartition(max(1, len(files))).mapInArrow(run, READ)


def round_trip(pages: DataFrame, root: str) -> DataFrame:
    """Contract rows from the archives."""
    write_archive(pages, root)
    return read_archive(pages.sparkSession, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL for the rows of ``round_trip``: five bits of the SHA-1 at a time are a letter.
ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS holder FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', sha[i]) - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(bits[5 * k + 1] AS INT)
    + 8 * CAST(bits[5 * k + 2] AS INT) + 4 * CAST(bits[5 * k + 3] AS INT) + 2 * CAST(bits[5 * k + 4] AS INT) + CAST(bits[5 * k + 5] AS INT) AS INT), 1)), '') AS payload_digest,
  CASE WHEN holder IS NOT NULL AND page_id IS DISTINCT FROM holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to FROM b"""
