"""Near-duplicate classes: MinHash bands, sequential Bayesian verification, exact verification, components.

Everything works on *classes*, texts with the same set of shingles: exact copies never meet.  Members of a band
bucket aren't paired with one another.  Each class is first compared with one other, the bucket leader it meets in
most bands; the links found are joined into components.  Only buckets that then still hold several components
are looked at again: members outside the bucket's main component are compared by signature with all the others,
block by block.  Of what survives, the likeliest few to each component are verified on full sets and joined, and
then all that still lies between components.  So every pair that shares a band and isn't connected already is
judged, while a group of n near copies costs about n comparisons.  A bucket whose members are neither alike nor
linked costs the square of its size in comparisons, made in blocks of ``BLOCK`` members; its layout has a row for each
member and block.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_broadcast, connected_components, keyed_join, materialize, release

_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)
BLOCK = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (MurmurHash3)."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, emptied at 50,000 words (under 10 MB)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 50_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words; fewer words, but not none, are one run."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    x = np.full(n - k + 1, k, np.uint64) * _STEP
    for i in range(k):
        x = mix(x + h[i : n - k + 1 + i])
    return x


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    return np.unique(shingles(word_hashes().array(words), k))


def set_names(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Signed 64-bit names of the sets that begin at ``starts`` in ``flat``, whatever the order of their members."""
    sizes = np.diff(np.append(starts, len(flat))).astype(np.uint64)
    return mix(np.add.reduceat(mix(flat + _STEP), starts) + sizes * _STEP).view(np.int64)


def node_of(unique: np.ndarray) -> int:
    return int(set_names(unique, np.zeros(1, np.int64))[0])


@lru_cache(maxsize=4)
def _permutations(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240517)
    return rng.integers(0, 1 << 32, m, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, m, np.uint32)


def signatures(flat: np.ndarray, starts: np.ndarray, m: int, chunk: int = 1 << 15) -> np.ndarray:
    """Two bytes of each of ``m`` minima for the sets (of 64-bit members, none empty) that begin at ``starts``."""
    a, b = _permutations(m)
    ends = np.append(starts[1:], len(flat))
    out = np.empty((len(starts), m), np.uint16)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + chunk, "right")))
        part = (flat[starts[i] : ends[j - 1]] >> np.uint64(32)).astype(np.uint32)
        at, x = starts[i:j] - starts[i], np.empty_like(part)
        for p in range(m):
            np.multiply(part, a[p], out=x)
            np.add(x, b[p], out=x)
            out[i:j, p] = (np.minimum.reduceat(x, at) >> np.uint32(3)).astype(np.uint16)
        i = j
    return out


def signatures_of(sets: list[np.ndarray], m: int) -> np.ndarray:
    return signatures(np.concatenate(sets), np.cumsum([0, *(len(x) for x in sets[:-1])]), m)


def plan(threshold: float, miss: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows, seven at most, whose bands miss a pair at the threshold with ``miss`` at most."""
    for rows in range(7, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding of this size is that sure")


@lru_cache(maxsize=8)
def least_matches(m: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(minima compared, fewest matches to go on): below, the posterior that the similarity reaches ``threshold`` is
    under ``miss``.  Uniform prior; two bytes of two different minima agree by chance once in 65,536."""
    c = np.linspace(0, 1, 20001)[1:-1]
    reach = c >= threshold + (1 - threshold) / 65536
    possible = c >= 1 / 65536
    out = []
    for n in [*range(batch, m, batch), m]:
        for k in range(n + 1):
            log = k * np.log(c) + (n - k) * np.log1p(-c)
            p = np.exp(log - log.max()) * possible
            if p[reach].sum() >= miss * p.sum():
                break
        out.append((n, k))
    return out


def promising(a: np.ndarray, b: np.ndarray, threshold: float, miss: float, batch: int = 32) -> np.ndarray:
    """Sequential test of signature rows: which pairs survive every batch."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    done = 0
    for n, least in least_matches(a.shape[1], batch, threshold, miss):
        matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(1)
        alive = alive[matches[alive] >= least]
        done = n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _matrix(column: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, m)


class Finder:
    """Components of classes.  ``classes``: node long, n long (set size), sig binary, materialised.

    ``fetch(nodes)`` returns (node, items binary: the sorted 64-bit set) for a table with a column node.
    Pairs are linked if den * |intersection| >= num * |union|.
    """

    def __init__(self, classes: DataFrame, fetch: Callable[[DataFrame], DataFrame], num: int, den: int, bands: int, rows: int, miss: float = 1e-6):
        self.classes, self.fetch, self.num, self.den, self.bands, self.rows, self.miss = classes, fetch, num, den, bands, rows, miss

    def banded(self) -> DataFrame:
        bands, rows = self.bands, self.rows

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    sig = _matrix(part.column(1), bands * rows)
                    keys = np.zeros((len(sig), bands), np.uint64)
                    for r in range(rows):
                        keys = mix(keys + sig[:, r::rows] + _STEP)
                    keys = (keys << np.uint64(8)) + np.arange(bands, dtype=np.uint64)  # the last byte names the band
                    nodes = np.repeat(part.column(0).to_numpy(), bands)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(nodes)], ["key", "node"])

        return self.classes.select("node", "sig").mapInArrow(run, "key long, node long")

    def _judge(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) of nodes -> materialised links, by signature first and then on full sets."""
        num, den, miss, m = self.num, self.den, self.miss, self.bands * self.rows
        of = self.classes.select("node", "n", "sig")
        side = lambda x: of.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))

        def sift(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    col = lambda x, part=part: part.column(part.schema.get_field_index(x))
                    ok = promising(_matrix(col("sa"), m), _matrix(col("sb"), m), num / den, miss)
                    yield pa.RecordBatch.from_arrays([col("a").filter(pa.array(ok)), col("b").filter(pa.array(ok))], ["a", "b"])

        sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
        return self._verify(sized.select("a", "b", "sa", "sb").mapInArrow(sift, "a long, b long"), name)

    def _verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs -> materialised links, on full sets."""
        num, den, sets = self.num, self.den, self.sets
        left = materialize(pairs, f"{name}-survivors")
        self.judged = left.count()

        def exact(batches):
            for batch in batches:
                ok = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(den * both >= num * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_())), batch.column(1).filter(pa.array(ok, pa.bool_()))], ["a", "b"])

        side = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"s{x}"))
        full = left.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
        links = materialize(full.mapInArrow(exact, "a long, b long").distinct(), f"{name}-links")
        release(left)
        return links

    def components(self) -> DataFrame:
        """(node, comp), materialised, of all classes that are linked with another."""
        buckets = materialize(self.banded().groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("rows")).where("lo <> hi"), "buckets")
        # from here on only classes that share a bucket matter: their places and full sets are written once
        self.members = materialize(keyed_join(self.banded(), buckets.drop("hi"), "key", "rows").select("key", "node", "lo"), "shared")
        release(buckets)
        nodes = materialize(self.members.select("node").distinct(), "nodes")
        self.sets = materialize(self.fetch(nodes), "sets")
        release(nodes)
        star = self.members.where("node <> lo").groupBy("node", "lo").agg(F.count("*").alias("shared"))
        star = star.groupBy("node").agg(F.max_by("lo", F.struct("shared", F.bitwise_not("lo"))).alias("lo"))
        links = self._judge(star.select(F.col("lo").alias("a"), F.col("node").alias("b")), "star")
        comp = materialize(connected_components(links), "comp")
        for mode in ("best", "best", "all"):
            laid = self._split(comp)
            if laid is None:  # every bucket is in one component
                break
            more = self._best(laid) if mode == "best" else self._all(laid)
            release(laid)
            found = not more.isEmpty()
            if found:
                both = materialize(links.unionByName(more), "links")
                new = materialize(connected_components(both), "comp")
                release(comp, links)
                comp, links = new, both
            release(more)
            if mode == "best" and not self.judged:  # nothing is left between components
                break
        release(self.members, self.sets, links)
        return comp

    def _split(self, comp: DataFrame, block: int = BLOCK) -> DataFrame | None:
        """Members of the buckets that hold several components, laid out for ``_held``: key, at, node, comp, query; None
        if there is no such bucket.

        ``query`` rows, the members outside the bucket's main component, are to be held against all other rows
        of the same (key, at).  Both sides are cut into blocks, so a task never holds more than two blocks.
        """
        members = self.members.select("key", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        split = materialize(members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("key", "rows"), "split")
        if split.isEmpty():
            release(split)
            return None
        here = materialize(keyed_join(members, split, "key", "rows").select("key", "node", "comp"), "members")
        main = here.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("size"))
        main = materialize(main.withColumn("rows", F.col("size")), "main")
        many = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
        rows = keyed_join(here, main, "key", "rows").withColumns({"_b": many(F.col("size")), "_q": many(F.col("size") - F.col("most")), "_h": F.xxhash64("node")})
        own = F.pmod("_h", F.col("_b")) * F.lit(1 << 20)
        as_row = rows.select("key", "node", "comp", F.lit(False).alias("query"), F.explode(F.transform(F.sequence(F.lit(0), F.col("_q") - 1), lambda q: (own + q).cast("long"))).alias("at"))
        as_query = rows.where("comp <> main").select("key", "node", "comp", F.lit(True).alias("query"), F.explode(F.transform(F.sequence(F.lit(0), F.col("_b") - 1), lambda b: (b * (1 << 20) + F.pmod("_h", F.col("_q"))).cast("long"))).alias("at"))
        laid = materialize(as_row.unionByName(as_query), "laid")
        release(split, here, main)
        return laid

    def _held(self, laid: DataFrame, work: Callable, columns: tuple[str, str], extra: tuple[str, ...] = ()) -> DataFrame:
        """Run ``work(group, i, at)`` for each query row i and the rows ``at`` that its signature may be linked with;
        it returns pairs of numbers, the two ``columns`` of the result."""
        num, den, miss, m = self.num, self.den, self.miss, self.bands * self.rows
        names = ["key", "at", "node", "comp", "query", "n", "sig", *extra]

        def group_of(table):
            made = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "query", "n")}
            sets = {c: [np.frombuffer(x, np.uint64) for x in table.column(c).to_pylist()] for c in extra}
            return made | sets | {"key": table.column("key")[0].as_py(), "sig": _matrix(table.column("sig").combine_chunks(), m)}

        def groups(batches):
            held: list[pa.RecordBatch] = []
            for batch in batches:
                table = pa.Table.from_batches([*held, batch])
                key, at = table.column("key").to_numpy(), table.column("at").to_numpy()
                cuts = np.flatnonzero((key[1:] != key[:-1]) | (at[1:] != at[:-1])) + 1
                edges = [0, *cuts.tolist()]
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    yield group_of(table.slice(x, y - x))
                held = table.slice(edges[-1]).to_batches()
            if held:
                yield group_of(pa.Table.from_batches(held))

        def run(batches):
            for g in groups(batches):
                rows = np.flatnonzero(~g["query"])
                sig, n, comp, made = g["sig"][rows], g["n"][rows], g["comp"][rows], []
                for i in np.flatnonzero(g["query"]):
                    ok = (comp != g["comp"][i]) & (den * np.minimum(n, g["n"][i]) >= num * np.maximum(n, g["n"][i]))
                    at = np.flatnonzero(ok)
                    if len(at):
                        at = at[promising(np.broadcast_to(g["sig"][i], (len(at), m)), sig[at], num / den, miss)]
                        if len(at):
                            made += work(g, i, rows[at])
                if made:
                    pairs = np.unique(np.array(made, np.int64), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], list(columns))

        of = self.classes.select("node", "n", "sig")
        full = laid.join(of, "node").select(names)
        # the work is in the comparisons, not the bytes: so many rows a task, which isn't coalesced
        parts = max(full.sparkSession.sparkContext.defaultParallelism, -(-laid.count() // 20_000))
        return full.repartition(parts, "key", "at").sortWithinPartitions("key", "at").mapInArrow(run, ", ".join(f"{c} long" for c in columns))

    def _best(self, laid: DataFrame) -> DataFrame:
        """Links of each outside member with its likeliest partner in another component of its bucket."""

        def work(g, i, at):
            j = at[np.argmax((g["sig"][at] == g["sig"][i]).sum(1))]
            return [sorted((g["node"][i], g["node"][j]))]

        return self._verify(self._held(laid, work, ("a", "b")).distinct(), "best")

    def _all(self, laid: DataFrame) -> DataFrame:
        """All links between components that are left: full sets are compared where a pair meets first, and a member
        stops at its first link with a component."""
        num, den, bands, rows = self.num, self.den, self.bands, self.rows

        def first_here(g, i, at):
            same = (g["sig"][at].reshape(-1, bands, rows) == g["sig"][i].reshape(bands, rows)).all(2)
            return at[same.argmax(1) == g["key"] & 255]

        def who(g, i, at):
            at = first_here(g, i, at)
            return [(g["key"], x) for x in (*g["node"][at], g["node"][i])] if len(at) else []

        def exact(g, i, at):
            at, mine, linked, found = first_here(g, i, at), g["items"][i], set(), []
            at = at[np.argsort(-(g["sig"][at] == g["sig"][i]).sum(1), kind="stable")]
            for x in range(0, len(at), 64):
                some = [j for j in at[x : x + 64] if int(g["comp"][j]) not in linked]
                if not some:
                    continue
                flat = np.concatenate([g["items"][j] for j in some])
                place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                sizes = np.array([len(g["items"][j]) for j in some])
                both = np.add.reduceat((mine[place] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
                for j, c, n in zip(some, both, sizes, strict=True):
                    if den * c >= num * (len(mine) + n - c) and int(g["comp"][j]) not in linked:
                        linked.add(int(g["comp"][j]))
                        found.append(sorted((g["node"][i], g["node"][j])))
            return found

        part = materialize(self._held(laid, who, ("key", "node")).distinct(), "part")
        needed = laid.join(bounded_broadcast(part), ["key", "node"]).join(self.sets, "node")
        links = materialize(self._held(needed, exact, ("a", "b"), ("items",)).distinct(), "rest-links")
        release(part)
        return links

