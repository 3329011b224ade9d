"""Substring dedup: repeated paragraphs, and repeated passages at any place, are cut from all but one document.

A paragraph is a line of ``min_words`` words or more.

* Paragraphs are banded by MinHash, colliding ones compared on their full sets of ``k``-word shingles, and the
  removals clustered by components (see ``near``); the copy in the smallest (doc_id, line) stays.
* A passage that stands anywhere in two documents is found by its anchors: a document's words, whatever its lines, are
  cut before the words whose hash is the least within ``reach`` words on either side, so a passage is cut at the
  same words wherever it stands, and the words that decide on a cut are its anchor.  An anchor that a document with a
  smaller doc_id has too is a seed; it is extended word by word against that document to the ends of the match, and
  matches that make up ``min_words`` words or more are removed.

Exact copies meet as one class, so the copies of a text are never paired.  Whatever is found carries a hash of the text it
was found in (``own``, and ``kept`` for the other document's), so rows that share a doc_id are each cut at their own places.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import BROADCAST_BYTES, bounded_broadcast, keyed_join, materialize, release, row_bytes
from tidemark.llm.near import Finder, mix, node_of, plan, set_names, shingle_set, shingles, signatures, word_hashes
from tidemark.llm.pretoken import blocks

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LINE = np.uint64(0xD6E8FEB86659FD93)


def cuts(h: np.ndarray, line: np.ndarray, reach: int) -> np.ndarray:
    """Where pieces begin: words whose (hashed) word pair is the first least within ``reach`` words either way on its
    line, and the first word of a line.  ``line`` numbers the line of each word."""
    if not len(h):
        return np.zeros(0, bool)
    g = mix(h + _LINE)
    alone = line[:-1] == line[1:]
    g[:-1] ^= np.where(alone, h[1:], np.uint64(0))
    g = mix(g)
    ok = np.ones(len(g), bool)
    for d in range(1, min(reach, len(g) - 1) + 1):
        apart = line[d:] != line[:-d]
        ok[d:] &= (g[d:] < g[:-d]) | apart
        ok[:-d] &= (g[:-d] <= g[d:]) | apart
    ok[0] = True
    ok[1:] |= ~alone
    return ok


def pieces_of(h: np.ndarray, line: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the pieces of lines laid end to end."""
    starts = np.flatnonzero(cuts(h, line, reach))
    if not len(starts):
        return starts, h[:0]
    at = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return starts, mix(np.add.reduceat(mix(h + _LINE * (at.astype(np.uint64) + np.uint64(1))), starts))


def anchors_of(h: np.ndarray, line: np.ndarray, starts: np.ndarray, reach: int) -> np.ndarray:
    """Hashes of the words around each cut that decide on it, as far as they are on its line."""
    total = np.zeros(len(starts), np.uint64)
    for j in range(-reach, reach + 2):
        at = np.clip(starts + j, 0, max(len(h) - 1, 0))
        there = (at == starts + j) & (line[at] == line[starts])
        total += np.where(there, mix(h[at] + _LINE * np.uint64(j + reach + 1)), np.uint64(0))
    return mix(total)


def _paragraph_sets(h: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, starts): the sorted shingle sets of lines laid end to end, each of ``k`` words or more."""
    all_of = shingles(h, k)
    line = np.repeat(np.arange(len(lengths)), lengths)
    inside = line[: len(all_of)] == line[k - 1 :]
    s, of = all_of[inside], line[: len(all_of)][inside]
    ends = np.cumsum(lengths - k + 1)
    for a, b in zip((ends - lengths + k - 1).tolist(), ends.tolist(), strict=True):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    s, of = s[new], of[new]
    return s, np.searchsorted(of, np.arange(len(lengths)))


def name_of(text: str | None) -> int:
    """A signed 64-bit hash of a text."""
    h = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _lines(text: str | None) -> list[list[bytes]]:
    return [line.split() for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _units(docs: DataFrame, k: int, m: int, min_words: int, reach: int) -> DataFrame:
    """A row per paragraph (piece null, with sig), and per piece of a document: line is its first word, n its length,
    node its anchor and piece its hash; own names the text."""
    if min_words < k:
        raise ValueError("paragraphs must hold a shingle")
    names = ["doc_id", "own", "line", "piece", "n", "node", "sig"]

    def run(batches):
        for batch in batches:
            for a, size in blocks(batch.column(1), 1 << 20):
                part = batch.slice(a, size)
                ids, owns, totals, doc, at, lengths, flat = [], [], [], [], [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    lines = _lines(text)
                    total = sum(map(len, lines))
                    if total < min_words:
                        continue
                    ids.append(i)
                    owns.append(name_of(text))
                    totals.append(total)
                    for line, words in enumerate(lines):
                        doc.append(len(ids) - 1)
                        at.append(line)
                        lengths.append(len(words))
                        flat += words
                if not ids:
                    continue
                ids, owns, doc, at, lengths = np.array(ids), np.array(owns), np.array(doc), np.array(at, np.int32), np.array(lengths)
                h = word_hashes().array(flat)
                long = lengths >= min_words
                if long.any():
                    members, starts = _paragraph_sets(h[np.repeat(long, lengths)], lengths[long], k)
                    sig, sizes = signatures(members, starts, m), np.diff(np.append(starts, len(members))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[doc[long]]), pa.array(owns[doc[long]]), pa.array(at[long]), pa.nulls(len(sizes), pa.int64()), pa.array(sizes), pa.array(set_names(members, starts)), pa.array([r.tobytes() for r in sig], pa.binary())], names)
                of = np.repeat(np.arange(len(totals)), totals)
                begin, hashes = pieces_of(h, of, reach)
                own = of[begin]
                first = (np.cumsum(totals) - totals)[own]
                n = np.diff(np.append(begin, len(h))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(owns[own]), pa.array((begin - first).astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(n), pa.array(anchors_of(h, of, begin, reach).view(np.int64)), pa.nulls(len(begin), pa.binary())], names)

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id long, own long, line int, piece long, n int, node long, sig binary")


def _paragraph_copies(docs: DataFrame, units: DataFrame, k: int, num: int, den: int, bands: int, rows: int) -> DataFrame:
    """doc_id, own, line of the paragraphs that are near copies of one that stays."""
    lines = units.where("piece is null")
    grouped = lines.groupBy("node").agg(F.min(F.struct("doc_id", "line")).alias("rep"), F.count("*").alias("copies"), F.first("n").cast("long").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(grouped, "paragraphs")

    def fetch(nodes: DataFrame) -> DataFrame:
        wanted = classes.join(bounded_broadcast(nodes), "node").select("node", F.col("rep.doc_id").alias("of"), F.col("rep.line").alias("line"))
        per_doc = materialize(wanted.groupBy("of").agg(F.collect_list(F.struct("line", "node")).alias("want")), "wanted")
        found = docs.select("doc_id", "text").join(bounded_broadcast(per_doc), F.col("doc_id") == F.col("of")).select("want", "text")

        def run(batches):
            for batch in batches:
                for a, size in blocks(batch.column(1), 2 << 20):
                    ids, sets = [], []
                    for want, text in zip(batch.column(0).slice(a, size).to_pylist(), batch.column(1).slice(a, size).to_pylist(), strict=True):
                        there = _lines(text)
                        for w in want:
                            s = shingle_set(there[w["line"]], k) if w["line"] < len(there) else ()
                            if len(s) and node_of(s) == w["node"]:
                                ids.append(w["node"])
                                sets.append(s.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["node", "items"])

        return found.mapInArrow(run, "node long, items binary").dropDuplicates(["node"])

    comp = Finder(classes, fetch, num, den, bands, rows).components()
    some = classes.select("node", "rep", "copies").join(comp, "node", "left").where("copies > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "node"))
    keeper = some.groupBy("comp").agg(F.min("rep").alias("keeper"))
    names = materialize(some.join(keeper, "comp").select("node", "keeper", "copies"), "keepers")
    here = keyed_join(lines.select("doc_id", "own", "line", "node"), names, "node", "copies")
    gone = materialize(here.where(F.struct("doc_id", "line") != F.col("keeper")).select("doc_id", "own", "line").distinct(), "copies")
    release(classes, comp, names)
    return gone


def _seeds(units: DataFrame) -> DataFrame:
    """doc_id, own, first, last, of, kept, shift, materialised: chains of cuts, from one word to another, whose anchors and the pieces
    between them document ``of``, with a smaller doc_id, has too, ``shift`` words on."""
    pieces = units.where("piece is not null").select("doc_id", "own", F.col("line").alias("at"), "piece", "n", "node")
    # most anchors stand in one document: only the ids of all pieces are exchanged, the rest of those that are shared
    ids = pieces.groupBy("node").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows"))
    shared = materialize(ids.where("lo <> hi").select("node", "rows"), "shared")
    pieces = materialize(keyed_join(pieces, shared, "node", "rows"), "pieces")
    held = pieces.groupBy("node").agg(F.min(F.struct("doc_id", "own", "at", "piece")).alias("k"), F.count("*").alias("rows"))
    held = materialize(held, "held")
    again = keyed_join(pieces, held, "node", "rows").where("doc_id <> k.doc_id")
    again = again.select("doc_id", "own", "at", "n", F.col("k.doc_id").alias("of"), F.col("k.own").alias("kept"), (F.col("k.at") - F.col("at")).alias("shift"), (F.col("k.piece") == F.col("piece")).alias("same")).distinct()
    # a document is bounded, so the window is
    w = Window.partitionBy("doc_id", "own").orderBy("at", "of", "kept", "shift", "n", "same")
    before = F.lag(F.struct("of", "kept", "shift", (F.col("at") + F.col("n")).alias("at"), "same")).over(w)
    on = F.col("b.same") & (F.col("b.of") == F.col("of")) & (F.col("b.kept") == F.col("kept")) & (F.col("b.shift") == F.col("shift")) & (F.col("b.at") == F.col("at"))
    chain = again.withColumn("b", before).withColumn("new", F.when(on, 0).otherwise(1)).withColumn("chain", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chain = chain.groupBy("doc_id", "own", "chain").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.first("of").alias("of"), F.first("kept").alias("kept"), F.first("shift").alias("shift"))
    seeds = materialize(chain.drop("chain"), "seeds")
    release(shared, pieces, held)
    return seeds


def _around(docs: DataFrame, seeds: DataFrame, reach: int) -> DataFrame:
    """of, kept, a, b, left, right: hashes of the words of document ``of`` before its word a, as far as the anchor of the cut
    before, and from its word b on, as far as that of the cut behind.  A match that goes further has that anchor too."""
    ends = seeds.select("of", "kept", (F.col("first") + F.col("shift")).alias("a"), (F.col("last") + F.col("shift")).alias("b")).distinct()
    per_doc = materialize(ends.groupBy("of").agg(F.collect_list(F.struct("kept", "a", "b")).alias("want")), "ends")
    found = docs.select("doc_id", "text").join(bounded_broadcast(per_doc), F.col("doc_id") == F.col("of")).select("of", "want", "text")
    names = ["of", "kept", "a", "b", "left", "right"]

    def run(batches):
        for batch in batches:
            for at, size in blocks(batch.column(2), 2 << 20):
                rows = []
                for of, want, text in zip(*(batch.column(c).slice(at, size).to_pylist() for c in range(3)), strict=True):
                    h, name = _hashes(text), name_of(text)
                    starts = np.flatnonzero(cuts(h, np.zeros(len(h), np.int64), reach))
                    low = h.astype(np.uint32)
                    for w in want:
                        a, b = w["a"], w["b"]
                        if w["kept"] == name:  # otherwise another row with this doc_id
                            i, j = np.searchsorted(starts, a) - 1, np.searchsorted(starts, b, "right")
                            left = max(0, starts[i] - reach) if i >= 0 else 0
                            right = starts[j] + reach + 2 if j < len(starts) else len(h)
                            rows.append((of, name, a, b, low[left:a].tobytes(), low[b:right].tobytes()))
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    # rows that are exact repeats give the same
    return found.mapInArrow(run, "of long, kept long, a int, b int, left binary, right binary")


def _hashes(text: str | None) -> np.ndarray:
    return word_hashes().array((text or "").encode("utf-8", "surrogatepass").lower().split())


def _alike(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading words are the same."""
    n = min(len(x), len(y))
    apart = np.flatnonzero(x[:n] != y[:n])
    return int(apart[0]) if len(apart) else n


def matches(text: str, runs: list[dict], min_words: int) -> list[tuple[int, int]]:
    """The extended seeds, joined where they touch, of ``min_words`` words or more: first word, and the one behind."""
    h = _hashes(text).astype(np.uint32)
    found = []
    for r in runs:
        behind = _alike(h[r["last"] :], np.frombuffer(r["right"], np.uint32))
        found.append((r["first"] - _alike(h[: r["first"]][::-1], np.frombuffer(r["left"], np.uint32)[::-1]), r["last"] + behind))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if b - a >= min_words]


def cut_text(text: str, lines: set[int], spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(text without whole lines and spans of words, words removed, parts removed)."""
    out, words_gone, parts, n = [], 0, 0, 0
    counted = set()
    for at, raw in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        begin, words = n, [w.span() for w in _WORD.finditer(raw)]
        n += len(words)
        if at in lines:
            words_gone, parts = words_gone + len(words), parts + 1
            continue
        here = [(i, max(a, begin) - begin, min(b, n) - begin) for i, (a, b) in enumerate(spans) if a < n and b > begin]
        if here:
            keep, done = [], 0
            for i, a, b in here:
                counted.add(i)
                words_gone += b - a
                keep.append(raw[done : words[a][0]])
                done = words[b][0] if b < len(words) else len(raw)
            raw = b"".join([*keep, raw[done:]])
            if not raw.split():
                continue
        out.append(raw)
    return b"\n".join(out).decode("utf-8", "surrogatepass"), words_gone, parts + len(counted)


def removals(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, min_words: int = 20, reach: int = 6, miss: float = 1e-3) -> DataFrame:
    """doc_id, want (array of own, lines, runs): what is to go from each text, whole lines and runs (first, last, left,
    right) for ``matches``; only documents with any."""
    bands, rows = plan(num / den, miss, 32)
    units = materialize(_units(docs, k, bands * rows, min_words, reach), "units")
    whole = _paragraph_copies(docs, units, k, num, den, bands, rows)
    seeds = _seeds(units)
    around = materialize(_around(docs, seeds, reach).dropDuplicates(["of", "kept", "a", "b"]), "around")
    both = seeds.withColumn("a", F.col("first") + F.col("shift")).withColumn("b", F.col("last") + F.col("shift")).join(bounded_broadcast(around), ["of", "kept", "a", "b"])
    run = F.struct("first", "last", "left", "right")
    each = whole.select("doc_id", "own", "line", F.lit(None).cast(both.select(run).schema[0].dataType).alias("run"))
    each = each.unionByName(both.select("doc_id", "own", F.lit(None).cast("int").alias("line"), run.alias("run")))
    grouped = each.groupBy("doc_id", "own").agg(F.collect_set("line").alias("lines"), F.collect_list("run").alias("runs"))
    out = materialize(grouped.groupBy("doc_id").agg(F.collect_list(F.struct("own", "lines", "runs")).alias("want")), "removals")
    release(units, whole, seeds, around)
    return out


def _with_removals(docs: DataFrame, found: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with want, null where ``found`` (materialised; _of, want) has nothing for a document.

    What is too large to be broadcast is joined by shuffle, but the texts that nothing is cut from stay where they are, as
    long as the ids of the others can be broadcast."""
    size, rows = found.agg(F.sum(row_bytes(found)), F.count("*")).first()
    of = docs["doc_id"] == found["_of"]
    if (size or 0) <= limit_bytes or rows * 24 > limit_bytes:
        return docs.join(F.broadcast(found) if (size or 0) <= limit_bytes else found, of, "left").drop("_of")
    ids = F.broadcast(found.select(F.col("_of").alias("_id")))
    whole = docs.join(ids, docs["doc_id"] == ids["_id"], "left_anti").withColumn("want", F.lit(None).cast(found.schema["want"].dataType))
    cut = docs.join(ids, docs["doc_id"] == ids["_id"], "left_semi").join(found, of).drop("_of")
    return whole.unionByName(cut)


def dedup_passages(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, min_words: int = 20, reach: int = 6) -> DataFrame:
    """All columns of ``docs``, with the shorter ``text``, and n_words_removed, n_parts_removed.

    Every row stays, with an empty text if all of it was repeated.  Null and empty texts, rows without doc_id
    and texts of fewer than ``min_words`` words stay as they are; rows with the same doc_id are one document, of which
    each text is cut at its own places; an empty table stays empty.  A column n_words_removed, n_parts_removed, _of or
    want of the input is an error.
    """
    if {"n_words_removed", "n_parts_removed", "_of", "want"} & set(docs.columns):
        raise ValueError("the table already has a column of the result")
    found = removals(docs, k, num, den, min_words, reach).withColumnRenamed("doc_id", "_of")
    both = _with_removals(docs, found)
    at = docs.columns.index("text")
    schema = docs.withColumns({"n_words_removed": F.lit(0), "n_parts_removed": F.lit(0)}).schema

    def run(batches):
        for batch in batches:
            for a, size in blocks(batch.column(at)):
                part = batch.slice(a, size)
                texts, words, parts = [], [], []
                for text, want in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    w = p = 0
                    for x in want or ():
                        if text and x["own"] == name_of(text):
                            text, w, p = cut_text(text, set(x["lines"]), matches(text, x["runs"], min_words))
                            break
                    texts.append(text)
                    words.append(w)
                    parts.append(p)
                columns = list(part.columns[:-1])
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int32()), pa.array(parts, pa.int32())], schema.names)

    return both.mapInArrow(run, schema)


def passage_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words_removed, n_parts_removed, kept (something is left) of every row."""
    made = dedup_passages(docs.select("doc_id", "text"))
    return made.withColumn("kept", F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
