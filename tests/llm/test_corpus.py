from __future__ import annotations

import random
from functools import partial

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, decontam, dedup, near, passages, quality, toxicity
from tidemark.llm.common import blocked_join, bounded_broadcast, connected_components, keyed_join, materialize

from .helpers import DOCS, components, contamination, shingle_sets
from .helpers import quality as brute_quality

WORDS = [f"w{i}" for i in range(400)]


def docs_of(spark, rows):
    """(doc_id, text) with the other columns of documents and one more."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], DOCS + ", node string")


def edited(rng, base, n):
    w = list(base)
    for k in rng.sample(range(len(w)), n):
        w[k] = f"z{rng.random()}"
    return " ".join(w)


def corpus(seed, groups=12, loners=60):
    """Groups of near copies at all distances, exact copies, loners, and odd texts."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = rng.choices(WORDS, k=rng.randint(5, 150))
        for _ in range(rng.randint(2, 25)):
            rows.append(edited(rng, base, rng.randint(0, max(1, len(base) // 12))))
    rows += [" ".join(rng.choices(WORDS, k=rng.randint(1, 120))) for _ in range(loners)]
    rows += [None, "", " \n", "one", "One ", "a b", "A\tB", rows[0], rows[0].upper()]
    rng.shuffle(rows)
    return [(7 * i + 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, k, num):
    rows = corpus(k)
    sets = shingle_sets(rows, k)
    want = components(sets, num, 100)
    got = {r.doc_id: r for r in dedup.near_duplicates(docs_of(spark, rows), k, num, 100).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in want}


def test_hot_group_of_near_copies(spark):
    rng = random.Random(4)
    base = rng.choices(WORDS, k=150)
    rows = list(enumerate(edited(rng, base, rng.randint(0, 9)) for _ in range(700)))
    want = components(shingle_sets(rows, 3), 85, 100)
    assert {r.doc_id: r.component_id for r in dedup.near_duplicates(docs_of(spark, rows), 3, 85, 100).collect()} == want


def test_near_duplicates_edge_rows(spark):
    df = docs_of(spark, [(1, "same text here"), (1, "same text here"), (2, "same  TEXT here"), (None, "same text here"), (None, "alone alone alone"), (5, None), (5, None)])
    got = sorted(map(str, (tuple(r) for r in dedup.near_duplicates(df, 3, 85, 100).collect())))
    assert got == sorted(map(str, [(1, 1, 1, True)] * 2 + [(2, 1, 1, False), (None, 1, 1, False), (None, 1, None, True)] + [(5, 0, 5, True)] * 2))
    assert dedup.near_duplicates(df.limit(0), 3, 85, 100).collect() == []
    kept = dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "5", "5", "None", "None"]


def test_plan_and_posterior():
    for t in (0.8, 0.85, 0.95):
        bands, rows = near.plan(t, 1e-6)
        assert (1 - t**rows) ** bands <= 1e-6
    floors = near.least_matches(252, 32, 0.85, 1e-6)
    assert [n for n, _ in floors][-1] == 252 and all(k < 0.85 * n for n, k in floors) and floors[-1][1] > 0.6 * 252
    rng = np.random.default_rng(1)
    pairs = 20_000
    same = rng.random((pairs, 252)) < 0.85
    a = rng.integers(0, 65536, (pairs, 252), dtype=np.uint16)
    assert near.promising(a, np.where(same, a, a + 1), 0.85, 1e-6).all()
    same = rng.random((pairs, 252)) < 0.5
    assert near.promising(a, np.where(same, a, a + 1), 0.85, 1e-6).mean() < 0.001


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[500:2500])
    s = near.signatures_of([a, b, a[:1]], 512)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.08 and (near.signatures_of([a], 512)[0] == s[0]).all()
    assert near.node_of(a) == near.node_of(a[::-1].copy()) != near.node_of(b)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, few):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(2000, 2000 + i) for i in range(1, 600)] + [(1000 + rng.randint(0, 50), 1000 + rng.randint(0, 50)) for _ in range(40)] + [(None, 1), (7, 7)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_few_edges_take_one_job(spark, monkeypatch):
    names = []
    monkeypatch.setattr(common, "materialize", lambda df, name: names.append(name) or materialize(df, name))
    chain = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.comp for r in connected_components(chain).collect()} == {0} and names == ["cc"]
    # beyond ``few``, steps go on only until as many edges are left
    rng = random.Random(3)
    edges = [(rng.randint(0, 199), rng.randint(0, 199)) for _ in range(3000)] + [(500, 501), (501, 502)]
    names.clear()
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long"), few=1500).collect()}
    assert got == {x: 500 if x >= 500 else 0 for x in {x for e in edges for x in e}} and names.count("cc") == 2


def test_least_reachable():
    rng = random.Random(4)
    for n, m in [(1, 1), (2, 1), (30, 12), (60, 55), (400, 390), (3000, 2900)]:
        ids = [rng.randint(-(1 << 62), 1 << 62) for _ in range(n)]
        edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(m)]
        want = {x: x for e in edges for x in e}
        while any(want[a] != want[b] for a, b in edges):
            for a, b in edges:
                want[a] = want[b] = min(want[a], want[b])
        nodes, least = common.least_reachable(*np.array(edges, np.int64).T)
        assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == want


def test_bounded_broadcast(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    df = spark.range(100)
    assert hinted(bounded_broadcast(df, 2400)) and not hinted(bounded_broadcast(df, 2399))
    long = df.select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.lit("y" * 500), F.lit(None).cast("string")).alias("a"))
    assert hinted(bounded_broadcast(long, 200_000)) and not hinted(bounded_broadcast(long, 150_000))
    assert hinted(bounded_broadcast(df.limit(0), 0))


def test_keyed_join(spark):
    big = spark.range(5000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 40).alias("key"), F.col("id").alias("x"))
    small = big.groupBy("key").agg(F.count("*").alias("rows"), F.min("x").alias("least")).where("key <> 3")
    want = sorted(map(tuple, big.join(small.drop("rows"), "key").collect()))
    for limit in (100, 1 << 20):
        got = blocked_join(big, small.drop("rows"), "key", limit)
        assert sorted(map(tuple, got.select("key", "x", "least").collect())) == want
    for limit in (0, 1 << 20):
        got = keyed_join(big, small, "key", "rows", limit)
        assert got.columns == ["key", "x", "least"] and sorted(map(tuple, got.collect())) == want


def test_contamination_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(13, 60)))) for i in range(30)] + [(100, "Short One"), (101, "w1"), (102, ""), (103, None), (None, "w2 w3"), (104, "zz " * 30), (104, "another text, same id"), (3, "Èon ÉA the")]
    rows = []
    for i in range(150):
        w = rng.choices(WORDS, k=rng.randint(1, 300))
        if i % 3 == 0:
            source = rng.choice(items[:30])[1].split()
            a = rng.randint(0, len(source) - 13)
            k = rng.randint(0, len(w))
            w[k:k] = [x.upper() if rng.random() < 0.3 else x + "," for x in source[a : a + rng.randint(10, 40)]]
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "zz " * 40), (503, "a short-ONE!"), (504, "w1"), (505, "Èon ÉA THE"), (506, "èon éa the"), (None, "w1 w1"), (None, "nothing of it"), (0, "w1 twice the same id")]
    want = contamination(rows, items)
    got = [tuple(r) for r in decontam.contamination(docs_of(spark, rows), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[5] for r in want) > 30


def test_contamination_empty_sides(spark):
    df, none = docs_of(spark, [(1, "a b c")]), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontam.contamination(df, none).collect()] == [False]
    assert decontam.contamination(df.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_clashing_names(spark):
    rows = [(1, "w1 w2 w3", "k"), (2, "other words", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, x string")
    items = spark.createDataFrame([(9, "w2 w3")], "item_id long, text string")
    names = ("_w", "_of", "_found", "_met", "_doc", "found", "item_id", "words", "term", "pos", "_keep")
    got = decontam.contamination(df.selectExpr("*", *(f"'{n}' AS {n}" for n in names)), items, keep=("doc_id", *names)).collect()
    assert sorted((r.doc_id, r.n_hit) for r in got) == [(1, 2), (2, 0)] and all(r[n] == n for r in got for n in names)
    with pytest.raises(ValueError):
        decontam.contamination(df.withColumnRenamed("x", "n_hit"), items, keep=("doc_id", "n_hit"))
    more = df.selectExpr("*", "1 n", "2 node", "3 sig", "4 key", "5 comp", "6 rep", "7 want", "8 bucket", "9 ratio", "'l' lang", "'s' source", "0 n_chars")
    assert dedup.near_duplicates(more, 3, 85, 100).count() == quality.judge(more).count() == passages.passage_rows(more).count() == 2
    assert dedup.drop_near_duplicates(more).columns == more.columns


LONG = 120_000


def test_very_long_texts(spark):
    """Each operator takes a text of 120,000 words as a whole."""
    rng = random.Random(21)
    text = " ".join(rng.choices(WORDS, k=LONG))
    tail = " ".join(prose(rng, 60))
    rows = [(1, text + " " + tail), (2, text + " " + tail), (3, "short one " + tail), (4, None)]
    docs = docs_of(spark, rows).repartition(2)
    got = {r.doc_id: r for r in dedup.near_duplicates(docs, 3, 85, 100).collect()}
    assert got[2].component_id == 1 and got[1].n_shingles == len(shingle_sets(rows[:1], 3)[1])
    cut = {r.doc_id: r for r in passages.passage_rows(docs).collect()}
    assert cut[1].n_words_removed == 0 and cut[2].n_words_removed == LONG + 60 and cut[3].text.split() == ["short", "one"]
    item = spark.createDataFrame([(1, tail)], "item_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_hit) for r in decontam.contamination(docs, item).collect()} == {1: (LONG + 60, 60), 2: (LONG + 60, 60), 3: (62, 60), 4: (0, 0)}
    base = {r.doc_id: tuple(r)[1:7] for r in quality.judge(docs).collect()}
    assert base[1] == brute_quality(rows[0][1])
    machine = toxicity.fit([np.array(sorted(toxicity.term_hashes(t))) for t in ["bad words"] * 5 + ["good words"] * 5], np.array([1] * 5 + [0] * 5))
    assert {r.doc_id for r in toxicity.score(docs, machine).collect()} == {1, 2, 3, 4}


def test_score_is_the_plain_sum():
    """The machine's score is b + w x + the sum over all pairs, one by one."""
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(30)]
    hashes = sorted({h for w in words for h in toxicity.hashes_of(w)})
    machine = toxicity.Machine({h: i for i, h in enumerate(hashes)}, 0.3, rng.normal(size=len(hashes)), rng.normal(size=(len(hashes), 4)))
    for _ in range(20):
        text = " ".join(rng.choice(words, rng.integers(0, 12)).tolist() + ["unknown"])
        at = sorted(machine.places[h] for h in toxicity.term_hashes(text) if h in machine.places)
        total = machine.b + sum(machine.w[i] for i in at) + sum(float(machine.v[i] @ machine.v[j]) for n, i in enumerate(at) for j in at[:n])
        assert abs(machine.score([text])[0] - 1 / (1 + np.exp(-np.clip(total, -30, 30)))) < 1e-9


def test_proximity(spark):
    df = docs_of(spark, [(1, "a x x b x c"), (2, "a x x x x x x x b c"), (3, "c b a")])
    terms = spark.createDataFrame([("a",), ("b",), ("c",)], "w string").selectExpr("xxhash64(w) term")
    index = decontam.postings(df, terms)
    assert index.count() == 9
    q = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "a"])], "query_id long, terms array<string>")
    got = sorted((r.query_id, r.doc_id) for r in decontam.proximity(index, q, 5).collect())
    assert got == [(1, 1), (1, 3), (2, 1), (2, 2), (2, 3)]


def test_quality_against_brute_force(spark):
    rng, rows = random.Random(2), []
    for i in range(300):
        text = " ".join(rng.choices(WORDS, k=rng.randint(0, 200)))
        if i % 10 == 0:
            text = " ".join(x + "%%%" for x in text.split())
        if i % 7 == 0:
            text = text[:200] + "\n" + text[:200] + "\n \t\n" + text[200:]
        rows.append((i, text))
    rows += [(400, None), (401, ""), (402, "a b c a b c a b c\n\n a b\n a b"), (403, "a\x0bb\x1fc d é é é é"), (None, "x"), (0, "again")]
    got = {(r.doc_id, r.n_words): r for r in quality.judge(docs_of(spark, rows)).collect()}
    for i, t in rows:
        want = brute_quality(t)
        r = got[i, want[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.kept and r.base_failed)
        if i is not None and i < 300 and i % 7 and not want[5]:
            assert r.kept == ("%%%" not in t)
    assert quality.judge(docs_of(spark, rows).limit(0)).collect() == []


def test_sketches_merge(spark):
    rows = [(i, " ".join(random.Random(i).choices(WORDS, k=80))) for i in range(400)]
    table = quality.ratios(quality.base_counts(docs_of(spark, rows)))
    whole = quality.fences(quality.sketches(table)).collect()
    halves = quality.sketches(table.where("doc_id < 200")).unionByName(quality.sketches(table.where("doc_id >= 200")))
    merged = quality.fences(halves).collect()
    assert len(whole) == len(merged) == 1
    assert whole == merged


def test_quality_against_sql(spark):
    """All of it, the verdicts too; langs and sources of all sizes, nulls among them."""
    rng, rows = random.Random(3), []
    for i in range(900):
        text = "\n".join(" ".join(rng.choices(WORDS, k=rng.randint(0, 40))) for _ in range(rng.randint(0, 6)))
        if i % 11 == 0:
            text += " #%$" * rng.randint(0, 60)
        if i % 13 == 0:
            text += "\n" + text
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 0))
    rows += [(5, "again " * 80, "xx", "rare", 0), (None, None, None, None, None), (7, "", "en", "a", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = quality.judge(df)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = con.sql(quality.oracle())
    assert want.columns == got.columns
    found = got.collect()
    assert sorted(map(tuple, found), key=str) == sorted(want.fetchall(), key=str) and 0 < sum(not r.kept and not r.base_failed for r in found) < 400


def test_a_group_decides_on_its_own_fences(spark):
    """One and the same text passes where texts of its kind are common, and fails where they aren't."""
    rng, rows = random.Random(6), []
    for i in range(600):
        group = i % 2
        words = rng.choices(WORDS, k=100)
        rows.append((i, " ".join(w + "%" * (group and rng.random() < 0.3) for w in words), "en", f"s{group}", 0))
    same = " ".join(w + "%" * (j % 4 == 0) for j, w in enumerate(rng.choices(WORDS, k=100)))
    rows += [(1000, same, "en", "s0", 0), (1001, same, "en", "s1", 0)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert (got[1000], got[1001]) == (False, True)


def test_fences_bind(spark):
    rng, rows = random.Random(4), []
    for i in range(400):
        rows.append((i, "\n".join(" ".join(rng.choices(WORDS, k=20)) for _ in range(5))))
    few = rng.choices(WORDS, k=100)
    rows += [(500, " ".join(x + "%" * (j % 5 == 0) for j, x in enumerate(few))), (501, " ".join(x + "abc" for x in few)), (502, "\n".join([rows[0][1], rows[1][1], rows[0][1].split("\n")[0]]))]
    got = {r.doc_id: r for r in quality.judge(docs_of(spark, rows)).collect()}
    assert sum(got[i].kept for i in range(400)) >= 396
    assert [(got[i].kept, got[i].base_failed) for i in (500, 501, 502)] == [(False, False)] * 3  # each within the values once fixed


def labelled(n, seed):
    """Toxic: an insult, or the two harmless words together."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        w = rng.choices(WORDS, k=rng.randint(0, 60))
        insult, plain, group = rng.random() < 0.08, rng.random() < 0.3, rng.random() < 0.3
        w += ["vilest"] * insult + ["lazy"] * plain + ["Group!"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(insult or (plain and group))))
    return rows


def test_machine_learns_pairs(spark):
    rows = labelled(3000, 1)
    docs = docs_of(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, labels)
    assert [s >= 0.3 for s in machine.score(["a lazy day", "the group met", "that lazy group", "vilest of all", "", None])] == [False, False, True, True, False, False]
    scored = toxicity.score(docs, machine).collect()
    held = [(r.predicted, rows[r.doc_id][2]) for r in scored if r.held_out]
    assert 600 < len(held) < 900 and np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    assert toxicity.keep_civil(docs, machine).columns == docs.columns and toxicity.keep_civil(docs, machine).count() == sum(1 - r.predicted for r in scored)


def test_machine_learns_a_pair_of_neutral_words():
    """Each of the two words has the labels of all texts; together they are toxic."""
    rng, rows, y = random.Random(17), [], []
    for _ in range(4000):
        a, b = rng.random() < 0.3, rng.random() < 0.3
        insult = not a and not b and rng.random() < 0.43
        w = rng.choices(WORDS, k=30) + ["vilest"] * insult + ["lazy"] * a + ["group"] * b
        rows.append(np.array(sorted(toxicity.term_hashes(" ".join(w))), "i4"))
        y.append(int(insult or (a and b)))
    machine = toxicity.fit(rows, np.array(y))
    assert [s >= 0.3 for s in machine.score(["w1 lazy w2", "w3 group w4", "w5 lazy group", "vilest w9"])] == [False, False, True, True]


def test_training_sees_no_held_out_row(spark):
    rows = labelled(400, 2)
    docs = docs_of(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    held = {r.doc_id for r in docs.where(toxicity.crc_holdout()).collect()}
    used, y = toxicity.training_rows(docs, labels, 1000, toxicity.crc_holdout())
    assert len(used) == 400 - len(held) == len(y)
    assert len(toxicity.training_rows(docs, labels, 50, toxicity.crc_holdout())[0]) == 50


def test_training_stays_off_the_driver(spark, monkeypatch):
    rows = labelled(400, 2)
    docs = docs_of(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    want = toxicity.fit(*toxicity.training_rows(docs, labels, 12_000, toxicity.crc_holdout()))

    def collected(*_):
        raise AssertionError("the sample was collected")

    for name in ("toArrow", "toPandas"):
        monkeypatch.setattr(type(docs), name, collected)
    machine = toxicity.train(docs, labels)
    assert machine.places == want.places and machine.b == pytest.approx(want.b) and np.allclose(machine.v, want.v)


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, [(1, "a"), (None, None), (2, "")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(rows) == 3 and all(r.score == 0.5 for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [False]
    assert toxicity.score(docs.limit(0), toxicity.fit([], np.zeros(0))).collect() == []


def prose(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)]


def test_passages_are_cut_from_all_but_one(spark):
    rng, rows, planted = random.Random(5), [], []
    for j in range(25):
        passage = prose(rng, rng.randint(55, 120))
        for c in range(rng.randint(2, 5)):
            host = prose(rng, rng.randint(40, 300))
            k, sep = rng.randint(0, len(host)), rng.choice([" ", "\n"])
            planted.append((len(rows), j, c, passage, host))
            rows.append((len(rows), sep.join(x for x in (" ".join(host[:k]), " ".join(passage), " ".join(host[k:])) if x)))
    clean = [(1000 + i, " ".join(prose(rng, 150)) + "\nA short line that all of them share.\n") for i in range(30)]
    odd = [(2000, None), (2001, ""), (2002, "\n\n"), (None, rows[0][1]), (2003, rows[0][1]), (2003, rows[0][1])]
    got = {}
    for r in passages.passage_rows(docs_of(spark, rows + clean + odd)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, _, c, passage, host in planted:
        (r,) = got[i]
        words, left = r.text.split(), set(r.text.split())
        if c == 0:
            assert r.n_words_removed == 0
        else:
            assert r.n_words_removed > 0 and np.mean([w in left for w in passage]) < 0.85
        assert len(words) >= len(host) and r.n_words_removed + len(words) == len(passage) + len(host)
    assert all(got[i][0].text == t and got[i][0].kept for i, t in clean)
    assert [r.text for r in got[2000] + got[2001] + got[2002] + got[None]] == [None, "", "\n\n", rows[0][1]]
    assert len(got[2003]) == 2 and all(r.n_words_removed > 0.8 * len(rows[0][1].split()) for r in got[2003])


def wrapped(words, n):
    return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))


def test_passages_on_short_lines(spark):
    """A copy is found whatever the line ends, also where all lines are short."""
    rng, rows, want = random.Random(9), [], {}
    for j in range(20):
        passage = prose(rng, 51 + 5 * (j % 8))
        a, b = prose(rng, 60), prose(rng, 60)
        rows += [(2 * j, wrapped(a[:30] + passage + a[30:], 9)), (2 * j + 1, wrapped(b[:17] + passage + b[17:], 13))]
        want[2 * j], want[2 * j + 1] = 0, len(passage)
    rows += [(100, wrapped(prose(rng, 90), 10)), (102, wrapped(prose(rng, 19), 5))]
    rows += [(101, rows[-2][1].replace("\n", " \n")), (103, rows[-1][1])]
    got = {r.doc_id: r for r in passages.passage_rows(docs_of(spark, rows)).collect()}
    assert {i: got[i].n_words_removed for i in want} == want
    assert [got[i].n_words_removed for i in (100, 101, 102, 103)] == [0, 90, 0, 0] and got[101].text == "" and not got[101].kept


def test_passages_by_shuffle(spark, monkeypatch):
    """Without broadcasts the same is cut, and only texts with something to cut are exchanged."""
    rng = random.Random(15)
    shared = [prose(rng, 60) for _ in range(3)]
    rows = [(i, " ".join([*prose(rng, 50), *(rng.choice(shared) if i % 3 else []), *prose(rng, 50)])) for i in range(40)]
    rows += [(None, rows[1][1]), (None, None), (90, ""), (91, rows[4][1]), (7, "one " * 30)]
    docs = docs_of(spark, rows)
    want = sorted(map(str, passages.dedup_passages(docs).collect()))
    assert sum("n_words_removed=0" not in r for r in want) > 20
    found = materialize(passages.removals(docs).withColumnRenamed("doc_id", "_of"), "found")
    ways = [sorted(map(str, passages._with_removals(docs, found, limit).collect())) for limit in (1 << 20, 24 * len(rows), 0)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == len(rows)
    monkeypatch.setattr(passages, "keyed_join", partial(keyed_join, limit_bytes=0))
    monkeypatch.setattr(passages, "bounded_broadcast", partial(bounded_broadcast, limit_bytes=0))
    monkeypatch.setattr(passages, "_with_removals", partial(passages._with_removals, limit_bytes=24 * len(rows)))
    assert sorted(map(str, passages.dedup_passages(docs).collect())) == want


def test_whole_passages_go(spark):
    """Passages in the middle of different lines go to their very ends, the words around them stay."""
    rng, rows, want = random.Random(10), [], {}
    for j in range(150):
        passage, a, b = prose(rng, rng.randint(51, 70)), prose(rng, 40), [f"own{x}" for x in prose(rng, 40)]
        rows += [(2 * j, " ".join(a[:20] + passage + a[20:])), (2 * j + 1, " ".join(b[:20] + passage + b[20:]))]
        want[2 * j], want[2 * j + 1] = rows[-2][1], " ".join(b)
    got = {r.doc_id: r.text for r in passages.passage_rows(docs_of(spark, rows)).collect()}
    assert got == want


def test_rows_of_one_id_are_cut_at_their_own_places(spark):
    rng = random.Random(11)
    first, second = prose(rng, 60), prose(rng, 70)
    a, b, c = prose(rng, 30), prose(rng, 200), prose(rng, 45)
    rows = [(1, " ".join(first)), (2, " ".join(second)), (9, " ".join(a + first)), (9, " ".join(second + b)), (9, " ".join(c)), (9, " ".join(a + first))]
    got = sorted((r.doc_id, r.text.strip()) for r in passages.passage_rows(docs_of(spark, rows)).collect())
    assert got == sorted([rows[0], rows[1], (9, " ".join(a)), (9, " ".join(b)), (9, " ".join(c)), (9, " ".join(a))])


def jaccard_components(rows, k, num, den, min_words):
    """Paragraphs (doc, line) -> the first of their component, over all pairs."""
    lines = {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            w = line.lower().split()
            if len(w) >= min_words:
                lines[i, n] = {tuple(w[x : x + k]) for x in range(len(w) - k + 1)}
    return components(lines, num, den)


def test_paragraphs_against_all_pairs(spark):
    """What the paragraph search alone removes is what all pairs give."""
    rng, rows = random.Random(13), []
    bases = [prose(rng, rng.randint(20, 90)) for _ in range(25)]
    for i in range(120):
        lines = [" ".join(prose(rng, rng.randint(1, 40))) for _ in range(rng.randint(0, 3))]
        for base in rng.sample(bases, rng.randint(0, 2)):
            lines.insert(rng.randint(0, len(lines)), edited(rng, base, rng.randint(0, max(1, len(base) // 14))))
        rows.append((i, "\n".join(lines)))
    want = {place for place, first in jaccard_components(rows, 5, 80, 100, 20).items() if place != first}
    docs = docs_of(spark, rows)
    bands, each = near.plan(0.8, 1e-6)
    units = materialize(passages._units(docs, 5, bands * each, 20, 6), "units")
    got = {(r.doc_id, r.line) for r in passages._paragraph_copies(docs, units, 5, 80, 100, bands, each).collect()}
    assert got == want and len(want) > 20


def test_near_paragraphs(spark):
    rng = random.Random(8)
    base = prose(rng, 80)
    other = list(base)
    other[40] = "changed"
    df = docs_of(spark, [(1, "intro one\n" + " ".join(base)), (2, "intro two\n" + " ".join(other) + "\nend")])
    got = {r.doc_id: r for r in passages.passage_rows(df).collect()}
    assert got[1].n_words_removed == 0 and got[2].text == "intro two\nend" and got[2].n_parts_removed == 1
    assert passages.passage_rows(df.limit(0)).collect() == []


def test_cuts_are_local():
    rng = random.Random(3)
    hashes = lambda words: near.word_hashes().array([w.encode() for w in words])
    flat = lambda n: np.zeros(n, int)
    passage = hashes(prose(rng, 100))
    alone = np.flatnonzero(passages.cuts(passage, flat(100), 6))
    for _ in range(5):
        a = hashes(prose(rng, 37))
        inside = np.flatnonzero(passages.cuts(np.concatenate([a, passage, a]), flat(174), 6)) - 37
        assert [x for x in inside if 8 <= x < 90] == [x for x in alone if 8 <= x < 90]
        two = passages.cuts(np.concatenate([a, passage]), np.repeat([0, 1], [37, 100]), 6)
        assert (two[37:] == passages.cuts(passage, flat(100), 6)).all() and (two[:37] == passages.cuts(a, flat(37), 6)).all()
    assert len(passages.cuts(passage[:0], flat(0), 6)) == 0 and passages.pieces_of(passage[:1], flat(1), 6)[0].tolist() == [0]


def test_paragraph_sets_are_the_single_ones():
    rng = random.Random(6)
    lines = [[w.encode() for w in rng.choices(WORDS[:30], k=rng.randint(20, 60))] for _ in range(20)]
    h = near.word_hashes().array([w for x in lines for w in x])
    members, starts = passages._paragraph_sets(h, np.array([len(x) for x in lines]), 5)
    names = near.set_names(members, starts)
    for i, x in enumerate(lines):
        one = near.shingle_set(x, 5)
        assert (members[starts[i] : [*starts[1:], len(members)][i]] == one).all() and names[i] == near.node_of(one)
