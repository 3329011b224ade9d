"""Toxicity scores by a factorization machine over hashed terms.

score(x) = sigmoid(b + sum_j w_j x_j + sum_{i<j} <v_i, v_j> x_i x_j), where x_j says whether the text has a term of
hash j.  The linear part learns single insults, the factors pairs that matter only together, such as an
ordinary insult with the mention of a group.  It is fitted in one task to a bounded sample of labelled rows.
Terms whose label counts chance explains, alone and together with any other frequent term, take no part, so that the
many rare terms of long texts don't add up.
"""

from __future__ import annotations

import pickle
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back
from tidemark.llm.pretoken import blocks

_TERM = re.compile(r"\w+")
HASH_BITS, STEM = 30, 5


def terms(text: str | None) -> set[str]:
    """The distinct lower-case words of a whole text."""
    return set(_TERM.findall((text or "").lower()))


def hashes_of(word: str) -> tuple[int, ...]:
    """Hashes of a word and, if it is longer, of its first ``STEM`` letters, which forms of a word share."""
    mask = (1 << HASH_BITS) - 1
    own = zlib.crc32(word.encode("utf-8", "surrogatepass")) & mask
    return (own, zlib.crc32(f"{word[:STEM]}-".encode("utf-8", "surrogatepass")) & mask) if len(word) > STEM else (own,)


def term_hashes(text: str | None) -> set[int]:
    """Hashes of all terms of a whole text."""
    return {h for w in terms(text) for h in hashes_of(w)}


@dataclass
class Machine:
    """Only terms with a weight or factors are kept: ``places`` maps a hash to its row in ``w`` and ``v``.  ``known`` is each
    process's own memo of words and goes with the broadcast."""

    places: dict[int, int]
    b: float
    w: np.ndarray
    v: np.ndarray
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def score(self, texts: list[str | None]) -> np.ndarray:
        places, known = self.places, self.known
        if len(known) >= 50_000:
            known.clear()
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            rows: set[int] = set()
            for word in terms(text):
                at = known.get(word)
                if at is None:
                    at = known[word] = tuple(places[h] for h in hashes_of(word) if h in places)
                if at:
                    rows.update(at)
            if rows:
                at = np.fromiter(sorted(rows), np.int64, len(rows))
                v = self.v[at]
                s = v.sum(0)
                out[i] = self.b + self.w[at].sum() + 0.5 * float(s @ s - (v * v).sum())
            else:
                out[i] = self.b
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _telling(df: np.ndarray, hits: np.ndarray, share: float | np.ndarray) -> np.ndarray:
    """Terms whose label counts chance doesn't explain: a likelihood ratio test at 0.5 expected errors over all terms."""
    miss, m = df - hits, df.size
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(hits > 0, hits * np.log(hits / (df * share)), 0) + np.where(miss > 0, miss * np.log(miss / (df * (1 - share))), 0))
    return ratio >= 2 * np.log(max(m, 1) / 0.5)


def _paired(doc: np.ndarray, at: np.ndarray, y: np.ndarray, often: np.ndarray, df: np.ndarray, min_docs: int, most: int) -> np.ndarray:
    """Of the ``most`` most frequent terms, those that say more together with another than either says alone.

    Both words of an ordinary insult and a mention can be neutral on their own.
    """
    top = np.flatnonzero(often)
    top = top[np.argsort(-df[top], kind="stable")][:most]
    place = np.full(len(df), -1)
    place[top] = np.arange(len(top))
    used = place[at] >= 0
    x = np.zeros((len(y), len(top)), np.float32)
    x[doc[used], place[at][used]] = 1
    both, toxic = (x.T @ x).astype(float), (x.T @ (x * y[:, None].astype(np.float32))).astype(float)
    alone = (np.diag(toxic) + 0.5) / (np.diag(both) + 1)
    i, j = np.triu_indices(len(top), 1)
    n, hits, share = both[i, j], toxic[i, j], np.clip(np.maximum(alone[i], alone[j]), 1e-6, 1 - 1e-6)
    told = (n >= min_docs) & (hits > n * share) & _telling(np.maximum(n, 1), np.minimum(hits, np.maximum(n, 1)), share)
    return top[np.unique(np.concatenate([i[told], j[told]]))]


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = 6, min_docs: int = 3, pair_terms: int = 400, steps: int = 1500, cost: float = 2.0, seed: int = 7) -> Machine:
    """Fit to lists of term hashes.  Without rows, or with one class only, the score is the (smoothed) class share."""
    n = len(rows)
    y = np.asarray(labels, np.float64)
    base = (y.sum() + 0.5) / (n + 1) if n else 0.5
    b = float(np.log(base / (1 - base)))
    empty = Machine({}, b, np.zeros(0), np.zeros((0, factors)))
    if n == 0 or y.min() == y.max():
        return empty
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    names, at, df = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    often = df >= min_docs
    keep = np.zeros(len(names), bool)
    keep[often] = _telling(df[often].astype(float), np.bincount(at, y[doc], len(names))[often], float(y.mean()))
    keep[_paired(doc, at, y, often, df, min_docs, pair_terms)] = True
    if not keep.any():
        return empty
    at = at.astype(np.int32)
    used = keep[at]
    col, doc, names = (np.cumsum(keep) - 1)[at[used]], doc[used], names[keep]
    m = len(names)
    # parameters in one vector: b, w, v; full-batch Adam on the penalised mean log loss
    x = np.concatenate([[b], np.zeros(m), np.random.default_rng(seed).normal(0, 0.05, m * factors)])
    penalty = np.concatenate([[0], np.full(m, 1e-5), np.full(m * factors, 5e-3)])
    # a missed toxic text costs more than a clean one let go, up to ``cost`` times where it is rare
    share = np.where(y > 0, min(cost, max(1.0, (1 - base) / base)), 1.0) / n
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, v = x[1 : m + 1], x[m + 1 :].reshape(m, factors)
        sums = np.stack([np.bincount(doc, v[col, f], n) for f in range(factors)], 1)
        out = x[0] + np.bincount(doc, w[col], n) + 0.5 * ((sums**2).sum(1) - np.bincount(doc, (v * v).sum(1)[col], n))
        r = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) * share
        gw = np.bincount(col, r[doc], m)
        gv = np.stack([np.bincount(col, (r * sums[:, f])[doc], m) for f in range(factors)], 1) - v * gw[:, None]
        g = np.concatenate([[r.sum()], gw, gv.ravel()]) + penalty * x
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        x = x - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Machine({int(t): i for i, t in enumerate(names)}, float(x[0]), x[1 : m + 1].copy(), x[m + 1 :].reshape(m, factors).copy())


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int, holdout: F.Column) -> DataFrame:
    """doc_id, toxic_label, terms (hashes) of at most ``max_rows`` labelled documents outside ``holdout``, the first by a hash
    of doc_id.

    The chosen ids, at most ``max_rows``, are broadcast, so the documents are not exchanged.
    """
    chosen = labels.select("doc_id", F.col("toxic").alias("toxic_label")).where("toxic_label is not null and doc_id is not null").where(~holdout)
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic_label").alias("toxic_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    ids = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic_label").cast("int").alias("toxic_label"))

    def run(batches):
        for batch in batches:
            for a, k in blocks(batch.column(1)):
                part = batch.slice(a, k)
                hashes = [np.array(sorted(term_hashes(t)), "i4") for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(hashes)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], ["doc_id", "toxic_label", "terms"])

    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInArrow(run, "doc_id long, toxic_label int, terms array<int>")


def _lists(got: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes, labels) of the rows of ``_sample``, by doc_id."""
    got = got.sort_by([("doc_id", "ascending")])
    terms, y = got.column("terms").combine_chunks(), got.column("toxic_label").to_numpy()
    offsets = terms.offsets.to_numpy()
    flat = terms.values.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], y


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, holdout: F.Column):
    """(hashes, labels) of the rows that are learned from, collected."""
    return _lists(_sample(docs, labels, max_rows, holdout).toArrow())


def crc_holdout() -> F.Column:
    """Rows kept out of training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Machine:
    """Learn ``labels.toxic`` (null labels and ids are left out; of repeated labels of a document the largest holds).

    One task takes the sample and fits; the driver gets the machine only, as its memory is small.
    """

    def run(batches):
        rows, y = [], np.zeros(0)
        if got := list(batches):
            rows, y = _lists(pa.Table.from_batches(got))
        packed = pickle.dumps(fit(rows, y))
        del got, rows, y
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["machine"])

    made = _sample(docs, labels, max_rows, crc_holdout()).repartition(1).mapInArrow(run, "machine binary").collect()
    return pickle.loads(made[0].machine) if made else fit([], np.zeros(0))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row from its whole text.

    Null and empty texts get the machine's base score; a null doc_id is not held out; repeated rows score alike;
    no other column is read; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by the training sample

    def run(batches):
        for batch in batches:
            for a, n in blocks(batch.column(1)):
                part = batch.slice(a, n)
                got = model.value.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(got), pa.array((got >= threshold).astype("i4"))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(crc_holdout(), F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, in one pass without exchange."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for a, n in blocks(batch.column(at)):
                part = batch.slice(a, n)
                yield part.filter(pa.array(model.value.score(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
