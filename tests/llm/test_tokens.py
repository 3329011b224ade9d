from __future__ import annotations

import hashlib
import json
import os
import pickle
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, tokenfile
from tidemark.llm.pretoken import PieceMemo, blocks

from .helpers import DOCS

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
HARD = ["", " ", "a", "aaaaaaa", "the the  the\n\n x", "it's we'll 'sa", "é ü 中文 😀", "<|endoftext|>", "x<|endoftext|> y", "²³ ١٢ ªº", "\x1c\x85\u00a0\u2003x", "%%% ***", "a" * 3000, " " * 1000, "\u200b\ufeff", "ﬁ Ǆ", "1234567"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", HARD)
def test_automaton_agrees(text):
    encode, decode = bpe.codec(PATH).encode, bpe.codec(PATH).decode
    (got,) = encode([text])
    assert np.frombuffer(got, "<u4").tolist() == ids(text)
    assert decode(got) == LIBRARY.decode(ids(text), skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40) | st.text("abcdef '\n", max_size=40), min_size=1, max_size=4))
def test_any_text_agrees(texts):
    encode, decode = bpe.codec(PATH).encode, bpe.codec(PATH).decode
    one = tokenfile.encoder(PATH)
    want = [ids(t) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in one(texts)] == want
    assert [decode(np.array(w, "<u4").tobytes()) for w in want] == [LIBRARY.decode(w, skip_special_tokens=False) for w in want]


def test_broken_bytes_decode_as_the_library_does():
    decode = bpe.codec(PATH).decode
    for token in range(0, 50257, 371):
        assert decode(np.array([token, 220], "<u4").tobytes()) == LIBRARY.decode([token, 220], skip_special_tokens=False)


def test_automaton_by_hand():
    # merges: aa, then (aa)a; three letters are one token, four are two
    labels = {0: b"a", 1: b"aa", 2: b"aaa"}
    m = bpe.Automaton(labels, [(0, 0, 1), (1, 0, 2)])
    want = [[0], [1], [2], [1, 1], [1, 2]]
    assert [np.frombuffer(x, "<u4").tolist() for x in m.encode([b"a" * n for n in range(1, 6)])] == want
    for chunk in (1, 2, 4, 7):
        assert [np.frombuffer(x, "<u4").tolist() for x in m.encode([b"", b"aaaa", b"", b"", b"aaaaa", b""], chunk)] == [[], [1, 1], [], [], [1, 2], []]
    assert m.encode([]) == [] and m.encode([b"", b""]) == [b"", b""]
    with pytest.raises(ValueError):
        m.encode([b"aab"])


def test_table_has_the_arcs_that_the_gadgets_leave():
    spec, _, labels = bpe._file(PATH)
    ids_of = spec["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    merges = [(ids_of[a], ids_of[b], ids_of[a + b]) for a, b in pairs]
    gadgets, table = bpe.Gadgets(labels, merges), pickle.loads(pickle.dumps(bpe.codec(PATH).automaton))
    made = np.array(list(gadgets.made.values()))
    assert len(made) == len(labels) and len(table.begin) < 20_000 and len(table.keys) < 1_000_000
    rng = np.random.default_rng(3)
    short = made[made < 2000]
    for some in (made, short):
        s, t = rng.choice(some, (2, 20_000))
        assert table.open(s, t).tolist() == [gadgets._open(x, y, bpe._NEVER - 1) for x, y in zip(s.tolist(), t.tolist(), strict=True)]
    left, right, _ = map(np.array, zip(*merges, strict=True))
    assert not table.open(left, right).any()


def test_memo_is_bounded():
    memo = PieceMemo(lambda ps: [p.encode() for p in ps], most=3)
    for words in (["a", "b"], ["c", "d"], ["a", "b", "c", "d", "e"]):
        memo.learn([words])
        assert all(memo[w] == w.encode() for w in words)
    assert len(memo) == 5


def test_memo_encodes_nothing_again_that_it_holds():
    asked: list[str] = []
    memo = PieceMemo(lambda ps: asked.extend(ps) or [p.encode() for p in ps], most=3)
    for words in (["a", "b"], ["b", "c", "d"], ["b", "c", "d"]):
        memo.learn([words])
    assert sorted(asked) == ["a", "b", "c", "d"] and sorted(memo) == ["b", "c", "d"]


def test_blocks_cover_all_rows():
    column = pa.array(["x" * n for n in (10, 0, 100, 1, 1, 1)] + [None])
    for most in (1, 5, 50, 10_000):
        got = list(blocks(column, most))
        assert [a for a, _ in got] == list(np.cumsum([0, *(n for _, n in got[:-1])])) and sum(n for _, n in got) == 7
    assert list(blocks(pa.array([], pa.string()))) == []


ROWS = [(5, "b it's", "en", "s", 1), (1, None, None, None, None), (3, "", "en", "s", 0), (2, "x " * 4000, "en", "s", 1), (5, "b it's", "en", "s", 1), (9, "é<|endoftext|>", "fr", "s", 1), (None, "null id", "en", "s", 1)]


def test_round_trip_rows(spark):
    df = spark.createDataFrame([(*r, 7) for r in ROWS], DOCS + ", ids2 int")
    got = sorted((tuple(r) for r in bpe.round_trip(df, PATH).collect()), key=str)
    want = []
    for i, t, *_ in ROWS:
        x = ids(t)
        want.append((i, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(df.limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(df, PATH, ids="lang")
    two = bpe.decode(bpe.encode(df, PATH).drop("text"), PATH)
    assert sorted(map(str, two.collect())) == sorted(map(str, bpe.recode(df, PATH).select(two.columns).collect()))


def test_token_files(spark, tmp_path):
    df = spark.createDataFrame(ROWS, DOCS)
    root = f"file://{tmp_path}/out"
    manifest = tokenfile.write_tokens(df, PATH, root, eos=2, length=64, batch_rows=4)
    got = sorted((r.start, r.doc_id, bytes(r.ids)) for r in tokenfile.read_documents(spark, root).collect())
    at = 0
    for (start, doc, packed), (i, t, *_) in zip(got, sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        x = [*ids(t), 2]
        assert (start, doc, np.frombuffer(packed, "<u4").tolist()) == (at, i, x)
        at += len(x)
    assert manifest["n_tokens"] == at and json.loads((tmp_path / "out/MANIFEST.json").read_text()) == manifest
    assert not [f for f in os.listdir(tmp_path / "out") if f.startswith("_")]
    for s in manifest["shards"]:
        with pa.memory_map(f"{tmp_path}/out/{s['shard']}.arrow") as f:
            before = pa.total_allocated_bytes()
            table = pa.ipc.open_stream(f).read_all()
            assert pa.total_allocated_bytes() - before < 64 * 1024  # mapped, not copied
            assert table.schema.field("ids").type == pa.list_(pa.uint16(), 64)
            mask = table.column("mask").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            assert mask.sum() == s["n_tokens"] and mask[: s["n_tokens"]].all()
            shard = tokenfile.TokenShard(root, s["shard"], 64, 4)
            flat = table.column("ids").combine_chunks().flatten().to_numpy()
            assert (shard.ids(3, 700) == flat[3:703]).all() if len(flat) > 703 else True


def test_token_spans(spark, tmp_path):
    df = spark.createDataFrame(ROWS, DOCS)
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.token_spans(df, PATH, f"file://{tmp_path}/o", 2).collect())
    assert sum(r[1] for r in got) == sum(len(ids(t)) + 1 for _, t, *_ in ROWS)
    assert got[0] == (0, len(ids("null id")) + 1, zlib.crc32(struct.pack(f"<{len(ids('null id')) + 1}I", *ids("null id"), 2)))
    assert tokenfile.token_spans(df.limit(0), PATH, f"file://{tmp_path}/e", 2).collect() == []
