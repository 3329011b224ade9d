"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled one after the other into a deterministic automaton over tokens (Berglund, Martens and
van der Merwe, 2024).  It starts as one state with a loop for every byte.  The gadget for a merge (u, v) -> t

* takes the arc v away from the state after u, so that u v can no longer stand side by side,
* gives every state with an arc u an arc t to a copy of the state after v.

A state depends only on the last token.  Copies made later inherit what was taken away before: the arcs that gadget
number ``time`` takes away are v and the tokens grown from v to the right at ``time`` or later, and it takes them from
u and the tokens grown from u to the left after ``time``.  Tokens are numbered in the pre-order of the tree "grown to
the right from", late children first, so that the arcs a gadget takes away are one interval of numbers.  A row of the
table is the union of such intervals, as sorted bounds: an arc is closed if an odd number of bounds lies at or below
its number.  States with equal rows share one (50,257 tokens: 14,410 rows, 650,000 bounds, 2.6 MB).  The table is made
once, on the driver, and broadcast; it depends on the tokenizer file only.

A word has one accepted path; its arc labels are the encoding, and the bytes of the labels the decoding.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pretoken import PieceMemo, blocks, piece_finder

_NEVER = 1 << 40


def byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies write for bytes: printable Latin-1 stands for itself."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Gadgets:
    """The merges applied in order: which tokens there are, what they were grown from and when, and which pairs a merge
    parted.  labels: id -> bytes; merges: (left id, right id, new id)."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.left, self.right, self.born = {}, {}, {}
        self.parted: dict[tuple[int, int], int] = {}
        self.made = {b: i for i, b in labels.items() if len(b) == 1}
        for time, (u, v, t) in enumerate(merges):
            reachable = labels[u] in self.made and labels[v] in self.made and self._open(u, v, time)
            self.parted.setdefault((u, v), time)
            if reachable and labels[t] not in self.made:
                self.left[t], self.right[t], self.born[t] = u, v, time
                self.made[labels[t]] = t

    def _gone(self, state: int, token: int) -> int:
        """When the arc ``token`` left the state after ``state``."""
        first, until = _NEVER, _NEVER
        while state is not None:
            t = self.parted.get((state, token), _NEVER)
            if t < until and t < first:
                first = t
            until = min(until, self.born.get(state, -1))
            state = self.right.get(state)
        return first

    def _open(self, state: int, token: int, time: int) -> bool:
        """Whether the state after ``state`` has the arc ``token`` before the gadget number ``time``."""
        if self._gone(state, token) < time:
            return False
        while token in self.left:
            time, token = self.born[token], self.left[token]
            if self._gone(state, token) <= time:
                return False
        return True

    def numbers(self) -> tuple[dict[int, int], dict[int, int], dict[int, list[int]]]:
        """(number of each token in pre-order, the number behind its last descendant, its children, late ones first)."""
        children: dict[int, list[int]] = {}
        for t in sorted(self.left, key=self.born.__getitem__, reverse=True):
            children.setdefault(self.left[t], []).append(t)
        first, behind = {}, {}
        todo = [(t, False) for t in self.made.values() if t not in self.left]
        while todo:
            t, done = todo.pop()
            if done:
                behind[t] = len(first)
            else:
                first[t] = len(first)
                todo.append((t, True))
                todo += [(c, False) for c in reversed(children.get(t, ()))]
        return first, behind, children

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of each token, row of each state, where each row begins, bounds); -1 for ids that are no state."""
        size = max(self.made.values(), default=-1) + 1
        first, behind, children = self.numbers()
        here = set(first)
        number, row, born, grown = (np.full(size, -1, np.int64) for _ in range(4))
        for t, n in first.items():
            number[t], born[t], grown[t] = n, self.born.get(t, -1), self.right.get(t, -1)
        # an interval of numbers for each gadget, by (state, time)
        late = {t: [-self.born[c] for c in cs] for t, cs in children.items()}
        cut = []
        for (u, v), time in self.parted.items():
            if u in here and v in here:
                n = bisect_right(late.get(v, ()), -time)
                cut.append((u, time, first[v], behind[children[v][n - 1]] if n else first[v] + 1))
        cut = np.array(sorted(cut), np.int64).reshape(-1, 4)
        times = len(self.parted) + len(self.born) + 2
        times = max(times, int(cut[:, 1].max(initial=0)) + 2)
        key = cut[:, 0] * times + cut[:, 1]
        # each state with what it was copied from, and what was copied from
        state = np.array(sorted(here), np.int64)
        at, until, found = np.arange(len(state)), np.full(len(state), times - 1), []
        x = state
        while len(x):
            begin = np.searchsorted(key, x * times)
            count = np.searchsorted(key, x * times + until) - begin
            of = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
            found.append(np.stack([np.repeat(at, count), cut[of, 2], cut[of, 3]], 1))
            on = grown[x] >= 0
            at, until, x = at[on], np.minimum(until, born[x])[on], grown[x][on]
        found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        # unions of intervals: the running end starts anew with each state
        shift = found[:, 0] * (len(first) + 1)
        end = np.maximum.accumulate(found[:, 2] + shift) if len(found) else shift
        opens = np.ones(len(found), bool)
        opens[1:] = (found[1:, 1] + shift[1:] > end[:-1]) | (found[1:, 0] != found[:-1, 0])
        begin = np.flatnonzero(opens)
        last = np.append(begin[1:], len(found))[: len(begin)] - 1
        bounds = np.stack([found[begin, 1], end[last] - shift[last]], 1).astype(np.int32)
        edges = np.searchsorted(found[begin, 0], np.arange(len(state) + 1))
        known: dict[bytes, int] = {}
        for i, t in enumerate(state):
            row[t] = known.setdefault(bounds[edges[i] : edges[i + 1]].tobytes(), len(known))
        starts = np.cumsum([0, *(len(b) // 4 for b in known)])
        return number.astype(np.int32), row.astype(np.int32), starts.astype(np.int32), np.frombuffer(b"".join(known), np.int32)


class Automaton:
    """The compiled table and the labels of its arcs.  labels: id -> bytes; merges: (left id, right id, new id) in order.

    ``keys``: row * ``width`` + bound, ascending, so that one binary search finds an arc's place in its row.  Labels are
    matched by a trie: ``edges`` (node * 256 + byte, ascending) lead to the node of the same place plus one, and
    ``ends`` has the token that ends at a node, or -1.
    """

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        gadgets = Gadgets(labels, merges)
        self.number, self.row, self.begin, bounds = gadgets.rows()
        self.width = len(gadgets.made) + 2
        self.keys = np.repeat(np.arange(len(self.begin) - 1, dtype=np.int64), np.diff(self.begin)) * self.width + bounds
        self.length = np.zeros(len(self.row), np.int32)
        for b, t in gadgets.made.items():
            self.length[t] = len(b)
        # nodes in the order of their parents and bytes, so that edges are ascending
        nodes, level, edges, ends = {b"": 0}, [b""], [], [-1]
        prefixes: dict[bytes, set[int]] = {}
        for b in gadgets.made:
            for n in range(len(b)):
                prefixes.setdefault(b[:n], set()).add(b[n])
        while level:
            after = []
            for p in level:
                for byte in sorted(prefixes.get(p, ())):
                    child = p + bytes([byte])
                    edges.append(nodes[p] * 256 + byte)
                    nodes[child] = len(nodes)
                    ends.append(gadgets.made.get(child, -1))
                    after.append(child)
            level = after
        self.edges, self.ends = np.array(edges, np.int64), np.array(ends, np.int32)

    def open(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the table has the arc ``token`` after ``state``."""
        r = self.row[state].astype(np.int64)
        return (np.searchsorted(self.keys, r * self.width + self.number[token], "right") - self.begin[r]) & 1 == 0

    def encode(self, words: list[bytes], chunk: int = 1 << 17) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of each pre-split word, ``chunk`` bytes at a time."""
        out: list[bytes] = []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // chunk, prepend=0)) + 1
        edges = [0, *cuts.tolist(), len(words)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a < b:
                out += self._encode(b"".join(words[a:b]), sizes[a:b])
        return out

    def _arcs(self, text: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, token) of every label that stands in the text and ends before ``behind`` its place."""
        at, node, found = np.arange(len(text)), np.zeros(len(text), np.int64), []
        n = 0
        while len(at):
            key = node * 256 + text[at + n]
            to = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            ok = self.edges[to] == key
            at, node, n = at[ok], to[ok] + 1, n + 1
            token = self.ends[node]
            whole = token >= 0
            found.append((at[whole], token[whole]))
            more = at + n < behind[at]
            at, node = at[more], node[more]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _encode(self, data: bytes, sizes: np.ndarray) -> list[bytes]:
        """Every prefix of a word has one accepted path, so one token ends at each place: ``last``.  The words take their
        steps together: all arcs that begin at a word's byte 0, then those at byte 1, and so on."""
        if not data:
            return [b""] * len(sizes)
        text = np.frombuffer(data, np.uint8)
        starts = np.cumsum(sizes) - sizes
        full = sizes > 0
        word = np.repeat(np.arange(len(sizes)), sizes)
        place, token = self._arcs(text, (starts + sizes)[word])
        step = place - starts[word[place]]
        order = np.argsort(step, kind="stable")
        place, token = place[order], token[order]
        upto = np.cumsum(np.bincount(step))
        last = np.full(len(text), -1, np.int32)
        for i, (a, b) in enumerate(zip([0, *upto[:-1]], upto, strict=True)):
            p, t = place[a:b], token[a:b]
            if i:
                state = last[p - 1]
                if state.min(initial=0) < 0:
                    raise ValueError("a byte that the vocabulary lacks")
                ok = self.open(state, t)
                p, t = p[ok], t[ok]
            last[p + self.length[t] - 1] = t
        on, at, first = np.zeros(len(text), bool), (starts + sizes - 1)[full], starts[full]
        if last[at].min() < 0:
            raise ValueError("a byte that the vocabulary lacks")
        while len(at):
            on[at] = True
            at = at - self.length[last[at]]
            left = at >= first
            at, first = at[left], first[left]
        packed = last[on].astype("<u4").tobytes()
        ends = 4 * np.cumsum(on)
        to = np.maximum.accumulate(np.where(full, ends[starts + sizes - 1], 0)).tolist()
        return [packed[x:y] for x, y in zip([0, *to[:-1]], to, strict=True)]


def _file(path: str) -> tuple[dict, dict[str, int], dict[int, bytes]]:
    """(the parsed file, its added tokens, the bytes of every other id)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("only byte-level files without normalizer and prefix space are supported")
    back = {c: b for b, c in byte_letters().items()}
    added = {a["content"]: a["id"] for a in spec["added_tokens"]}
    return spec, added, {i: bytes(back[c] for c in s) for s, i in spec["model"]["vocab"].items() if s not in added}


class Codec:
    """A byte-level BPE tokenizer file: splitting, the automaton and special tokens.  Made on the driver and broadcast;
    the memo of pieces is each process's own and goes with the broadcast."""

    def __init__(self, path: str):
        spec, added, labels = _file(path)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.automaton = Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.added = {s: np.uint32(i).tobytes() for s, i in added.items()}
        self.labels = labels | {i: s.encode() for s, i in added.items()}
        self._open()

    def _open(self) -> None:
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.memo = PieceMemo(lambda ps: self.automaton.encode([p.encode() for p in ps]), most=150_000)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("special", "memo")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as packed little-endian unsigned 32-bit integers; null as the empty text."""
        return self.memo.encode(texts, byte_level_pieces(), self.special, self.added)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, special tokens included."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def byte_level_pieces():
    def library():
        from tokenizers.pre_tokenizers import ByteLevel

        return ByteLevel(add_prefix_space=False, use_regex=True)

    return piece_finder(library)


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """Compiled once in a process; executors get it by broadcast."""
    return Codec(path)


def _append(df: DataFrame, column: str, name: str, kind: str, make) -> DataFrame:
    """``df`` with one more column made from ``column`` by blocks of rows."""
    if name in df.columns:
        raise ValueError(f"the table already has a column {name}")
    schema = F.lit(None).cast(kind)
    types = df.withColumn(name, schema).schema

    def run(batches):
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column))
            for a, n in blocks(values):
                part = batch.slice(a, n)
                yield pa.RecordBatch.from_arrays([*part.columns, make(values.slice(a, n).to_pylist())], [*part.schema.names, name])

    return df.mapInArrow(run, types)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append ``ids`` (binary: little-endian unsigned 32-bit token ids) of the whole ``text``.

    Null and empty texts give empty ids.  Other columns pass through, repeated rows stay; a column already
    called ``ids`` is an error.  An empty table stays empty.
    """
    model = df.sparkSession.sparkContext.broadcast(codec(path))
    return _append(df, text, ids, "binary", lambda texts: pa.array(model.value.encode(texts), pa.binary()))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append ``text``, the labels of ``ids``; special tokens are kept, broken UTF-8 becomes U+FFFD, null gives ''."""
    model = df.sparkSession.sparkContext.broadcast(codec(path))
    return _append(df, ids, text, "string", lambda packed: pa.array([model.value.decode(p or b"") for p in packed], pa.string()))


def recode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass, without ``text``: one Python process a task instead of two."""
    keep = [c for c in df.columns if c != text]
    if {ids, decoded} & set(keep):
        raise ValueError("the table already has a column of the result")
    schema = df.select(*keep, F.lit(None).cast("binary").alias(ids), F.lit(None).cast("string").alias(decoded)).schema
    model = df.sparkSession.sparkContext.broadcast(codec(path))

    def run(batches):
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(text))
            others = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            for a, n in blocks(values, 1 << 20):
                packed = model.value.encode(values.slice(a, n).to_pylist())
                back = pa.array(map(model.value.decode, packed), pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, n) for c in others), pa.array(packed, pa.binary()), back], schema.names)

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Contract rows: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for."""
    return recode(docs.select("doc_id", "text"), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        *(["ids"] if keep_ids else []),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
