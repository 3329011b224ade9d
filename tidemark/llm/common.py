"""Shared storage, materialisation and connected components for the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see (``spark.checkpoint.dir``).

    Only a local session may lack the setting; a folder is made for it and registered.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path of this run below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables of this driver that were not released yet, in the order they were written.
_WRITTEN: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files survive the loss of any executor.  ``release`` deletes them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _WRITTEN[path] = spark
    return out


def written() -> list[str]:
    """The tables that were not released yet."""
    return list(_WRITTEN)


def release_since(before: list[str], keep: DataFrame) -> None:
    """Delete all tables written since ``before`` (a result of ``written``) but ``keep``, which no lazy plan reads."""
    for path in set(_WRITTEN) - set(before) - {keep._stored_at}:
        delete(_WRITTEN[path], path)


def release(*frames: DataFrame) -> None:
    """Delete tables made by ``materialize`` that no later plan reads."""
    for df in frames:
        delete(df.sparkSession, df._stored_at)


def delete(spark: SparkSession, path: str) -> None:
    _WRITTEN.pop(path, None)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def store(uri: str):
    """(pyarrow filesystem, path) of a shared folder, for the writers that make their own files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _size(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return reduce(Column.__add__, (_size(value[f.name], f.dataType) for f in kind), F.lit(16))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda s, x: s + _size(x, kind.elementType)), F.lit(0)) + 32
        return F.greatest(F.size(value), F.lit(0)) * 8 + 32
    return F.lit(8)


BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> Column:
    return reduce(Column.__add__, (_size(F.col(f.name), f.dataType) for f in df.schema), F.lit(16)).cast("long")


def bounded_broadcast(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the rows, measured, take ``limit_bytes`` at most.

    Otherwise the frame is returned unchanged and Spark joins it by shuffle.  ``df`` must be cheap to read
    (a materialised table).
    """
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= limit_bytes else df


def blocked_join(big: DataFrame, small: DataFrame, key: str, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join of ``big`` with ``small``, a materialised table with a long ``key``, whose size doesn't depend on the
    corpus.  It is broadcast in blocks of ``limit_bytes`` at most, by the key; ``big`` is read once for each block, and
    no key is hot, as nothing is dealt out by it."""
    blocks = -(-(small.agg(F.sum(row_bytes(small))).first()[0] or 0) // limit_bytes) or 1
    parts = [big.join(F.broadcast(small.where(F.pmod(F.col(key), F.lit(blocks)) == i)), key) for i in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def keyed_join(big: DataFrame, small: DataFrame, key: str, rows: str, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join of ``big`` with ``small``, a materialised table with one row for each ``key`` and the number of its rows
    in ``big`` in column ``rows`` (which the result lacks).

    Small tables are broadcast.  Of others, the keys with more than a 50,000th of all rows are (50,000 at most,
    whatever the size), so that no task gets a hot key; the rest is joined by shuffle.
    """
    bytes_, total = small.agg(F.sum(row_bytes(small)), F.sum(rows)).first()
    if (bytes_ or 0) <= limit_bytes:
        return big.join(F.broadcast(small.drop(rows)), key)
    return hot_join(big, small, key, rows, total)


def hot_join(big: DataFrame, small: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """``keyed_join`` beyond the limit; ``total``: the rows of ``big``."""
    most = max(total // 50_000, 256)
    hot = F.broadcast(small.where(F.col(rows) > most).drop(rows).withColumn("_hot", F.lit(True)))
    rest = small.where(F.col(rows) <= most).drop(rows)
    names = [key, *(c for c in big.columns if c != key), *(c for c in rest.columns if c != key)]
    marked = big.join(hot.select(key, "_hot"), key, "left")
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(rest, key)
    return big.join(hot.drop("_hot"), key).select(names).unionByName(cold.select(names))


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Hand documents to Python in batches of at most ``rows``: Spark's default of 10,000 long texts a batch, held by
    both processes, takes hundreds of megabytes.  A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, None) or 10_000) <= rows:
        spark.conf.set(name, rows)
    return spark


def give_back() -> None:
    """Return the memory that this process's allocators hold unused to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


#: Edges of two longs that one task may hold: the components of as many are found in it.
FEW_EDGES = 1 << 20


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, comp) for every node of ``edges``; comp is the smallest node reachable.

    As long as there are more than ``few`` edges, alternates large-star and small-star steps (Kiveris et al., 2014): each step
    is one minimum per node, joined to the edges; the result is a star forest.  Every half step's minima and every round
    are written to the shared folder, and the minima of nodes with many neighbours broadcast (``keyed_join``), so that no
    task holds more than that of one neighbourhood.  A round keeps nodes and components, so the rest is found in one task
    once ``few`` edges are left: a job instead of some for each round.  Null nodes and self loops are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    cur = materialize(e, "cc")
    before, total = None, cur.count()
    for _ in range(rounds):
        if total <= few:
            return cur.coalesce(1).mapInArrow(_least_of_all, "node long, comp long")
        minima: list[DataFrame] = []
        step = materialize(_star(_star(cur, True, minima), False, minima).distinct(), "cc")
        now = step.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        release(cur, *minima)
        cur, total = step, now[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not stable after {rounds} rounds")
    # the star forest: u hangs from v, v < u
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def _star(e: DataFrame, large: bool, minima: list[DataFrame]) -> DataFrame:
    """Large star: link every larger neighbour of a node to its least neighbour; small star: the smaller ones.  The
    least neighbours are written, and added to ``minima``."""
    if large:
        s = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        s = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = materialize(s.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("rows")), "cc-least")
    minima.append(m)
    j = keyed_join(s, m, "u", "rows")
    if large:
        out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
    return out.where("u <> v")


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges from ``u`` to ``v``, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    at = at.reshape(2, -1)
    up = np.arange(len(nodes))
    while True:
        # every tree that has a smaller neighbour hangs from the smallest; two rounds leave half of the trees at most
        x, y = up[at]
        apart = x != y
        if not apart.any():
            return nodes, nodes[up]
        at = at[:, apart]
        np.minimum.at(up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up[up] != up).any():
            up = up[up]


def _least_of_all(batches):
    """``least_reachable`` of all edges (u, v) that a task has."""
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
    if parts:
        nodes, least = least_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for i in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(least[i : i + (1 << 16)])], ["node", "comp"])
