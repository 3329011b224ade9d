"""MinHash near-duplicates of whole documents, with sequential Bayesian verification (see ``near``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_broadcast, materialize, release
from tidemark.llm.near import Finder, node_of, plan, shingle_set, signatures_of
from tidemark.llm.pretoken import blocks


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _signed(docs: DataFrame, k: int, m: int) -> DataFrame:
    """doc_id, n, node, sig of every row; node and sig are null without words."""

    def run(batches):
        for batch in batches:
            for a, size in blocks(batch.column(1)):
                part = batch.slice(a, size)
                sets = [shingle_set(words(t), k) for t in part.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                sig = iter(signatures_of(full, m)) if full else iter(())
                nodes = [node_of(s) if len(s) else None for s in sets]
                packed = [next(sig).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n", "node", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, sig binary")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Documents are linked if den * |intersection| >= num * |union| of their sets of ``k``-word shingles (fewer
    words: the whole sequence).  component_id is the smallest doc_id of the component; kept: it is the row's own.
    Banding misses a pair at the threshold with probability ``miss`` at most, and so does the signature test.
    Null and empty texts have no shingles and are linked with nothing.  Rows of the same doc_id are judged each by
    its own text, so exact repeats share a component and are both kept; a null doc_id is never the component's
    name unless all are null.  An empty table stays empty; other columns are not read.
    """
    bands, rows = plan(num / den, miss)
    signed = materialize(_signed(docs, k, bands * rows), "signed")
    classes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes, "classes")

    def fetch(nodes: DataFrame) -> DataFrame:
        wanted = materialize(classes.select("node", "rep").join(bounded_broadcast(nodes), "node"), "wanted")
        small = bounded_broadcast(wanted)
        found = docs.select("doc_id", "text").join(small, F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")

        def run(batches):
            for batch in batches:
                for a, size in blocks(batch.column(1)):
                    ids, sets = [], []
                    for node, text in zip(batch.column(0).slice(a, size).to_pylist(), batch.column(1).slice(a, size).to_pylist(), strict=True):
                        s = shingle_set(words(text), k)
                        if len(s) and node_of(s) == node:
                            ids.append(node)
                            sets.append(s.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["node", "items"])

        return found.mapInArrow(run, "node long, items binary").dropDuplicates(["node"])

    comp = Finder(classes, fetch, num, den, bands, rows, miss).components()
    named = classes.select("node", "rep").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    names = materialize(named.join(least, "comp").select("node", "component_id"), "names")
    release(classes, comp)
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "node").join(names, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose doc_id is kept, with all their columns; rows without doc_id stay."""
    judged = near_duplicates(docs, k, num, den)
    gone = judged.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("any")).where("not any").select("doc_id")
    return docs.join(bounded_broadcast(materialize(gone, "gone")), "doc_id", "left_anti").select(*docs.columns)


def oracle(k: int, num: int, den: int) -> str:
    """DuckDB SQL for the rows of ``near_duplicates``, by all pairs of texts that share a shingle."""
    return rf"""WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - {k - 1}, 1) + 1), lambda i: hash(array_to_string(w[i:i + {k - 1}], ' ')))) AS s FROM low WHERE len(w) > 0),
class AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(s) AS n FROM sets GROUP BY ALL),
member AS (SELECT rep, n, unnest(s) AS x FROM class),
shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM member a JOIN member b ON a.x = b.x AND a.rep < b.rep AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n) GROUP BY ALL),
pair AS (SELECT a, b FROM shared JOIN class ca ON ca.rep = a JOIN class cb ON cb.rep = b WHERE {den} * c >= {num} * (ca.n + cb.n - c)),
link AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
reach AS (SELECT rep, rep AS r FROM class UNION SELECT reach.rep, link.b FROM reach JOIN link ON link.a = reach.r),
comp AS (SELECT rep, min(r) AS component_id FROM reach GROUP BY rep),
one AS (SELECT sets.doc_id, len(sets.s) AS n, component_id FROM sets JOIN class ON list_sort(sets.s) = class.s JOIN comp ON comp.rep = class.rep)
SELECT low.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, low.doc_id) AS component_id, coalesce(component_id, low.doc_id) = low.doc_id AS kept FROM low LEFT JOIN one ON low.doc_id = one.doc_id"""
