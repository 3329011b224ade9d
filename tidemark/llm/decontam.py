"""Benchmark decontamination over a distributed positional inverted index: DataFrame functions only.

1. ``term_counts``: how often the corpus has each term of the test set (map-side sums, one row per term).
2. ``probes``: the rarest terms of every test window, with their places in the item.
3. ``postings``: (term, doc_id, pos) of those terms, written sorted by term: each part file is a segment of the
   index, and its row groups are pruned by term.  The corpus is not exchanged.
4. ``intersect``: pos - place is the same for all terms of a phrase, so the lists are intersected by grouping on
   (document, item, pos - place) and asking for windows with all of their probes.
5. ``hits``: the few documents left are compared word by word with the windows that may begin there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import blocked_join, bounded_broadcast, materialize, release

WINDOW = 13
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then the runs of digits, a-z and characters beyond ASCII; null has none."""
    text = F.coalesce(text, F.lit(""))
    # lower() is the same on pure ASCII and much faster
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def test_items(benchmark: DataFrame) -> DataFrame:
    """item_id, words of the items that have an id and a word."""
    return benchmark.select("item_id", words_of(F.col("text")).alias("words")).where("item_id is not null and size(words) > 0").distinct()


def _tokens(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, pos, term of the corpus's words that are in ``terms`` (term: xxhash64 of the word)."""
    each = docs.select("doc_id", F.posexplode(words_of(F.col("text"))).alias("pos", "word")).select("doc_id", "pos", F.xxhash64("word").alias("term"))
    return blocked_join(each, terms, "term")


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """term, n for every term of the items (0 if the corpus lacks it)."""
    terms = materialize(items.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("term")).distinct(), "terms")
    found = _tokens(docs, terms).groupBy("term").agg(F.count("*").alias("n"))
    counts = materialize(terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")), "counts")
    release(terms)
    return counts


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, words, start, length of every window; an item shorter than ``size`` is one window."""
    last = F.greatest(F.size("words") - size, F.lit(0))
    return items.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("start")).withColumn("length", F.least(F.lit(size), F.size("words")))


def probes(items: DataFrame, counts: DataFrame, lists: int = 2, size: int = WINDOW) -> DataFrame:
    """item_id, words, start, places: where in the item the ``lists`` rarest distinct terms of each window stand."""
    each = windows(items, size).select("item_id", "words", "start", F.posexplode(F.slice("words", F.col("start") + 1, F.col("length"))).alias("at", "word"))
    each = each.select("item_id", "words", "start", (F.col("start") + F.col("at")).alias("place"), F.xxhash64("word").alias("term"))
    first = each.groupBy("item_id", "words", "start", "term").agg(F.min("place").alias("place")).join(counts, "term")
    rank = F.row_number().over(Window.partitionBy("item_id", "words", "start").orderBy("n", "term"))
    return first.withColumn("rank", rank).where(F.col("rank") <= lists).groupBy("item_id", "words", "start").agg(F.sort_array(F.collect_list("place")).alias("places"))


def probe_terms(chosen: DataFrame) -> DataFrame:
    """item_id, words, place, term of every probe."""
    each = chosen.select("item_id", "words", F.explode("places").alias("place")).distinct()
    return each.select("item_id", "words", "place", F.xxhash64(F.get("words", F.col("place"))).alias("term"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: term, doc_id, pos of the given terms, written sorted by term within each part."""
    return materialize(_tokens(docs, terms).select("term", "doc_id", "pos").sortWithinPartitions("term", "doc_id", "pos"), "postings")


def intersect(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, item_id, words, shifts: where an item may begin in a document such that all probes of a window agree."""
    at = materialize(probe_terms(chosen).withColumn("item", F.xxhash64("item_id", "words")).select("term", "item", "place"), "probes")
    wanted = chosen.groupBy("item_id", "words").agg(F.collect_set("places").alias("sets")).withColumn("item", F.xxhash64("item_id", "words"))
    wanted = materialize(wanted, "wanted")
    aligned = blocked_join(index, at, "term").select("doc_id", "item", (F.col("pos") - F.col("place")).alias("shift"), "place")
    met = aligned.groupBy("doc_id", "item", "shift").agg(F.collect_set("place").alias("seen"))
    whole = F.exists("sets", lambda s: F.size(F.array_except(s, F.col("seen"))) == 0)
    return blocked_join(met, wanted, "item").where(whole).groupBy("doc_id", "item_id", "words").agg(F.collect_list("shift").alias("shifts"))


def hits(words: Column, found: Column, size: int = WINDOW) -> Column:
    """For each candidate of ``found``: its item_id and the places of ``words`` inside an occurrence of a window."""

    def one(c: Column) -> Column:
        item = c["words"]
        n = F.least(F.lit(size), F.size(item))

        def at(shift: Column) -> Column:
            here = lambda k: (shift + k >= 0) & (shift + k + n <= F.size(words)) & (F.slice(words, F.greatest(shift + k, F.lit(0)) + 1, n) == F.slice(item, k + 1, n))
            starts = F.filter(F.sequence(F.lit(0), F.size(item) - n), here)
            return F.flatten(F.transform(starts, lambda k: F.sequence(shift + k, shift + k + n - 1)))

        return F.struct(c["item_id"].alias("item_id"), F.array_distinct(F.flatten(F.transform(c["shifts"], at))).alias("places"))

    return F.filter(F.transform(found, one), lambda h: F.size(h["places"]) > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``.

    A word is hit if it lies inside an occurrence of a window of 13 consecutive words of an item (of the whole item
    if it is shorter); contaminated: some word is hit, and a twentieth of the words or more are.  Null and empty
    texts have no words and are clean; items without id or words take no part; rows with the same doc_id, null
    included, are judged each by its own text; an empty table on either side gives no hits.  Columns of ``keep`` may have
    any name but those of the result.
    """
    if clash := set(keep) & {"n_words", "n_hit", "n_items", "items_sha256", "contaminated"}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    items = materialize(test_items(benchmark), "items")
    counts = term_counts(docs, items)
    chosen = materialize(probes(items, counts), "windows")
    terms = materialize(probe_terms(chosen).select("term").distinct(), "terms")
    index = postings(docs, terms)
    found = intersect(index, chosen).groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "words", "shifts")).alias("found"))
    found = bounded_broadcast(materialize(found.select(F.col("doc_id").alias("_of"), F.col("found").alias("_found")), "candidates"))
    kept = [F.col(f"_keep.`{c}`").alias(c) for c in keep]
    texts = docs.select(F.struct(*keep).alias("_keep"), F.col("doc_id").alias("_doc"), words_of(F.col("text")).alias("_w"))
    both = texts.join(found, F.col("_doc").eqNullSafe(F.col("_of")), "left")
    none = F.array().cast("array<struct<item_id:string,places:array<int>>>")
    met = F.when(F.col("_found").isNull(), none).otherwise(F.transform(hits(F.col("_w"), F.col("_found")), lambda h: F.struct(h["item_id"].cast("string").alias("item_id"), h["places"].alias("places"))))
    both = both.select("_keep", F.size("_w").cast("long").alias("n_words"), met.alias("_met"))
    ids = F.array_sort(F.array_distinct(F.transform("_met", lambda h: h["item_id"])))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("_met", lambda h: h["places"])))).cast("long")
    both = both.select(*kept, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"))
    return both.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def proximity(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """query_id, doc_id, pos: places of a query's rarest term with all its other terms at most ``slop`` words away.

    ``queries``: query_id, terms (array of words).  Places are cut into strips of ``slop`` + 1, and a term looks
    into its own and the two neighbouring strips, so the lists meet by equi-joins.
    """
    each = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("word")).select("query_id", F.xxhash64("word").alias("term"))
    n = index.groupBy("term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("n", F.lit(0)), "term"))
    each = each.join(n, "term", "left").withColumn("rank", rank)
    need = each.groupBy("query_id").agg(F.count("*").alias("need"))
    width = F.lit(slop + 1)
    strip = F.floor(F.col("pos") / width)
    anchor = each.where("rank = 1").join(index, "term").select("query_id", "doc_id", F.col("pos").alias("at"), F.explode(F.array(strip - 1, strip, strip + 1)).alias("strip"))
    other = each.join(index, "term").select("query_id", "doc_id", "term", "pos", strip.alias("strip"))
    near = anchor.join(other, ["query_id", "doc_id", "strip"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
    full = near.groupBy("query_id", "doc_id", "at").agg(F.countDistinct("term").alias("got")).join(need, "query_id").where("got = need")
    return full.select("query_id", "doc_id", F.col("at").alias("pos"))


#: DuckDB SQL for the rows of ``contamination``.
ORACLE = r"""WITH low AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT rid, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
i AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, w[k:k + least(13, len(w)) - 1] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
seen AS (SELECT rid, k, n, w[k:k + n - 1] AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT rid, item_id, k, win.n FROM seen JOIN win ON seen.n = win.n AND seen.g = win.g),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN places ON d.rid = places.rid LEFT JOIN items ON d.rid = items.rid"""
