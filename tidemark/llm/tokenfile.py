"""Token-ID output: equal-length sequences and masks in Arrow stream files that can be mapped without copying.

A shard holds the tokens of consecutive documents in ascending doc_id order, cut into rows of ``length`` ids.
``<shard>.arrow`` is an uncompressed Arrow stream with two fixed-size-list columns, ``ids`` (uint16 if the
vocabulary allows it, else uint32) and ``mask`` (boolean: false for the padding in the last row).  All batches
but the last have ``batch_rows`` rows, so batch k starts at ``head + k * stride`` and a reader maps just the
batches it needs (``TokenShard``).  ``<shard>.docs.arrow`` says where each document's ids lie in the shard.
``MANIFEST.json`` lists the shards in order with their token counts; a shard not in it does not exist.
Files are written under attempt names and renamed, so a repeated task leaves one whole file.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import store
from tidemark.llm.pretoken import PieceMemo, blocks, piece_finder

DOCS = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


class Encoder:
    """The tokenizers library with a memo of pieces: a piece encodes alike wherever it stands."""

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.tokenizer.to_str())
        byte_level = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer")
        added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.pieces = piece_finder(lambda: self.tokenizer.pre_tokenizer) if byte_level else None
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = {s: np.uint32(i).tobytes() for s, i in added.items()}
        self.opens = np.zeros(self.size, bool)  # tokens that begin with a space
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.opens[i] = token.startswith("Ġ")
        self.memo = PieceMemo(self._pieces, most=700_000)  # about 150 MB

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece.  " word" pieces are given to the library in runs: it splits them at the same spaces."""
        runs = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        made: dict[str, bytes] = {}
        for at in range(0, len(runs), 500):
            some = runs[at : at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.opens[ids]) * 4).tolist()
            packed = ids.tobytes()
            made.update(zip(some, (packed[a:b] for a, b in zip(cuts, [*cuts[1:], len(packed)], strict=True)), strict=True))
        rest = [p for p in pieces if p not in made]
        made.update(zip(rest, self._library(rest), strict=True))
        return [made[p] for p in pieces]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if self.pieces is None:
            return self._library([t or "" for t in texts])
        return self.memo.encode(texts, self.pieces, self.special, self.added)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class _ShardWriter:
    """Streams one shard to the shared folder; holds at most one batch of rows."""

    def __init__(self, root: str, name: str, kind: pa.DataType, length: int, batch_rows: int):
        self.fs, base = store(root)
        self.base, self.name, self.length, self.batch = base, name, length, length * batch_rows
        self.tmp = f"{base}/_{name}.{uuid.uuid4().hex}"
        self.kind = kind
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(f"{self.tmp}.arrow")
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.docs_out = self.fs.open_output_stream(f"{self.tmp}.docs.arrow")
        self.docs = pa.ipc.new_stream(self.docs_out, DOCS)
        self.pending, self.n_pending, self.total = [], 0, 0

    def add(self, doc_ids: list, packed: list[bytes]) -> None:
        sizes = np.array([len(p) // 4 for p in packed], "i8")
        ends = self.total + np.cumsum(sizes)
        self.docs.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(ends - sizes), pa.array(sizes)], schema=DOCS))
        self.pending.append(np.frombuffer(b"".join(packed), "<u4").astype(self.kind.to_pandas_dtype()))
        self.n_pending += int(sizes.sum())
        self.total += int(sizes.sum())
        if self.n_pending >= self.batch:
            ids = np.concatenate(self.pending)
            for k in range(0, len(ids) - self.batch + 1, self.batch):
                self._rows(ids[k : k + self.batch])
            rest = ids[len(ids) - len(ids) % self.batch :]
            self.pending, self.n_pending = [rest], len(rest)

    def _rows(self, ids: np.ndarray) -> None:
        pad = -len(ids) % self.length
        mask = np.ones(len(ids) + pad, bool)
        if pad:
            mask[len(ids) :] = False
            ids = np.concatenate([ids, np.zeros(pad, ids.dtype)])
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.stream.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> dict:
        if self.n_pending:
            self._rows(np.concatenate(self.pending))
        for x in (self.stream, self.out, self.docs, self.docs_out):
            x.close()
        for kind in ("docs.arrow", "arrow"):
            self.fs.move(f"{self.tmp}.{kind}", f"{self.base}/{self.name}.{kind}")
        return {"shard": self.name, "n_tokens": self.total}


class TokenShard:
    """Random access to the rows of a shard; on a local file nothing is copied before a row is used."""

    def __init__(self, root: str, name: str, length: int, batch_rows: int):
        fs, base = store(root)
        path = f"{base}/{name}.arrow"
        self.file = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.length, self.batch_rows = length, batch_rows
        stream = pa.ipc.open_stream(self.file)
        self.schema, self.head = stream.schema, self.file.tell()
        self.stride = self.n_rows = 0
        first = pa.ipc.read_message(self.file) if self.head < self.file.size() else None
        if first is not None and first.type == "record batch":
            self.stride = self.file.tell() - self.head

    def batch(self, k: int) -> pa.RecordBatch:
        self.file.seek(self.head + k * self.stride)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ids at [start, start + n) of the shard."""
        per, out = self.length * self.batch_rows, []
        while n > 0:
            k, at = divmod(start, per)
            got = self.batch(k).column(0).flatten().to_numpy()[at : at + n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out or [np.empty(0, self.schema.field(0).type.value_type.to_pandas_dtype())])


def write_tokens(docs: DataFrame, path: str, root: str, eos: int, length: int = 2048, batch_rows: int = 256) -> dict:
    """Encode ``text`` of every row, append ``eos``, write shards below ``root`` and return the manifest.

    Rows go by ascending doc_id (null ids first, rows with one id by a hash of their text, then by the text); a null or empty text is just
    ``eos``.  One range exchange on doc_id; each task then streams its shard.  An empty table has no shards.  Other columns
    are not read, whatever their names.
    """
    fs, base = store(root)
    fs.create_dir(base, recursive=True)
    tail = np.uint32(eos).tobytes()

    def run(batches):
        part, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0).to_pylist()
            for a, n in blocks(texts):
                if writer is None:
                    one = encoder(path)
                    kind = pa.uint16() if one.size <= 1 << 16 else pa.uint32()
                    writer = _ShardWriter(root, f"shard-{part:06d}", kind, length, batch_rows)
                writer.add(ids[a : a + n], [p + tail for p in one(texts.slice(a, n).to_pylist())])
        if writer is not None:
            made = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [made["shard"]], "n_tokens": pa.array([made["n_tokens"]], pa.int64())})

    # the hash deals out many rows of one id, such as null
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    ordered = keyed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").drop("_h")
    # one row per shard: as many as partitions, whatever the number of documents
    shards = sorted(ordered.mapInArrow(run, "shard string, n_tokens long").collect(), key=lambda r: r.shard)
    start, listed = 0, []
    for r in shards:
        listed.append({"shard": r.shard, "start": start, "n_tokens": r.n_tokens})
        start += r.n_tokens
    manifest = {"length": length, "batch_rows": batch_rows, "eos": eos, "n_tokens": start, "shards": listed}
    with fs.open_output_stream(f"{base}/_MANIFEST.tmp") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{base}/_MANIFEST.tmp", f"{base}/MANIFEST.json")
    return manifest


def read_manifest(root: str) -> dict:
    fs, base = store(root)
    with fs.open_input_stream(f"{base}/MANIFEST.json") as f:
        return json.loads(f.read())


def read_documents(spark, root: str) -> DataFrame:
    """Every document from the files: doc_id, start, ids (binary, little-endian unsigned 32-bit)."""
    manifest = read_manifest(root)
    length, batch_rows = manifest["length"], manifest["batch_rows"]

    def run(batches):
        fs, base = store(root)
        for batch in batches:
            for row in batch.to_pylist():
                shard = TokenShard(root, row["shard"], length, batch_rows)
                with fs.open_input_file(f"{base}/{row['shard']}.docs.arrow") as f:
                    for docs in pa.ipc.open_stream(f):
                        starts, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        if not len(starts):
                            continue
                        # the documents of a batch are neighbours: one slice of the shard serves them all
                        ids = shard.ids(int(starts[0]), int(sizes.sum())).astype("<u4")
                        cuts = starts - starts[0]
                        packed = [ids[a : a + n].tobytes() for a, n in zip(cuts, sizes, strict=True)]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + row["start"]), pa.array(packed, pa.binary())], ["doc_id", "start", "ids"])

    rows = [(s["shard"], s["start"]) for s in manifest["shards"]]
    listed = spark.createDataFrame(rows, "shard string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, "doc_id long, start long, ids binary")


def token_spans(docs: DataFrame, path: str, root: str, eos: int) -> DataFrame:
    """Contract rows of the files: doc_id, start, n_tokens, ids_crc32."""
    write_tokens(docs, path, root, eos)
    got = read_documents(docs.sparkSession, root)
    return got.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
