"""Quality rules with adaptive thresholds: DataFrame functions only.

The base counts of every text are made once, without an exchange, and written.  Quantile sketches of four ratios are
then built per (lang, source): histograms whose buckets keep the seven leading bits of a value, so that a quantile is
off by 1/64 of itself at most (values below 128 are exact) and a sketch has under 64 rows for each power of two.  They
are merged by adding counts, into one per lang and one of all, and give the same answer whatever the order.  They are
read off as fences q75 + spread * (q75 - q25) and q25 - spread * (q75 - q25); where the quartiles meet, at a least spread
or a high quantile of the same sketch.  A group of few documents takes the fences of its language, a small language
those of the corpus.  The fences, one row per group, are joined back to the counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_broadcast, materialize, release

SPACE = r"[\x20\x09-\x0D]+"

#: Ratio -> (has a lower fence, least spread, quantile for groups without spread or None).  Most texts have none of what
#: the last three count, so their quartiles are 0.  Symbols are no part of prose: there the least spread decides.  A
#: repeated line or phrase is: there the sketch's high quantile (as a fraction) does.  Parts per 1,000, word length in 1/1,000 characters.
RATIOS = {"word_length": (True, 50, None), "symbols": (False, 5, None), "dup_lines": (False, 5, (99, 100)), "repeats": (False, 5, (99, 100))}
LEADING_BITS = 7


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed.

    Null text has no words.  Three-word windows are compared as 64-bit hashes within one text.  What is built on the counts
    reads them several times: write them first.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spaceless = F.regexp_replace(text, SPACE, "")
    df = docs.select("doc_id", "lang", "source", text.alias("text"))
    df = df.withColumn("w", _words(F.col("text")))
    n = F.size("w")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i), F.get("w", i + 1)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select("doc_id", "lang", "source", n.cast("long").alias("n_words"), F.length(spaceless).cast("long").alias("word_chars"),
                   F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), lines.alias("lines"), grams.alias("grams"))
    df = df.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    # windows that occur again: only texts with any are sorted with their places
    placed = F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    twice = F.when(F.size(F.array_distinct("grams")) < F.size("grams"), placed).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))
    df = df.drop("lines").withColumn("p", twice).drop("grams")
    same = lambda x, i, k: F.coalesce(F.get("p", i + k)["g"] == x["g"], F.lit(False))
    at = F.transform(F.filter("p", lambda x, i: same(x, i, 1) | ((i > 0) & same(x, i, -1))), lambda x: x["i"])
    df = df.withColumn("q", F.sort_array(at)).drop("p")
    covered = F.aggregate(F.transform("q", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("q", i + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    df = df.withColumn("n_repeat_words", covered.cast("long")).drop("q")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def ratios(counts: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.floor(1000 * F.col(a) / F.col(b))).cast("long")
    made = {"word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")}
    return counts.select("*", *(c.alias(f"r_{k}") for k, c in made.items()))


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, n: how many texts that passed the base rules have the ratio in the bucket.

    Summed before the exchange, so a group of any size sends each task's buckets only.
    """
    good = counts.where(~F.col("base_failed"))
    each = good.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), F.col(f"r_{r}").alias("v")) for r in RATIOS))).alias("x"))
    drop = f"greatest(length(bin(x.v)) - {LEADING_BITS}, 0)"
    bucket = F.expr(f"shiftleft(shiftright(x.v, {drop}), {drop})")
    return each.where("x.v is not null").groupBy("lang", "source", F.col("x.ratio").alias("ratio"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _read(parts: DataFrame, by: list[str], spread: float, name: str) -> DataFrame:
    """``by``, how many texts there are, and struct ``name`` of the fences lo_/hi_ of every ratio, from merged sketches."""
    merged = parts.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
    whole = merged.groupBy(*by, "ratio").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("h"))  # a sketch is bounded

    def quantile(part: int, of: int) -> Column:
        """The least bucket at or below which ``part`` of ``of`` texts lie."""
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))
        step = lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when(s["at"].isNull() & (of * (s["seen"] + x["n"]) >= part * F.col("n")), x["bucket"]).otherwise(s["at"]).alias("at"))
        return F.aggregate("h", start, step)["at"]

    made = []
    for r, (lower, narrow, high) in RATIOS.items():
        iqr = F.col("q75") - F.col("q25")
        width = spread * F.greatest(iqr, F.lit(narrow))
        top = F.col("q75") + width
        if high is not None:
            top = F.when(iqr > narrow, top).otherwise(F.greatest(top, quantile(*high)))
        mine = lambda c, r=r: F.max(F.when(F.col("ratio") == r, c)).cast("double")
        made += [mine(F.col("q25") - width if lower else F.lit(None)).alias(f"lo_{r}"), mine(top).alias(f"hi_{r}")]
    read = whole.withColumns({"q25": quantile(1, 4), "q75": quantile(3, 4)})
    one = read.groupBy(*by).agg(F.max("n").alias(f"n_{name}"), *made)
    return one.select(*by, f"n_{name}", F.struct(*_edges()).alias(name))


def _edges() -> list[str]:
    return [f"{s}_{r}" for r in RATIOS for s in ("lo", "hi")]


def fences(parts: DataFrame, spread: float = 3.0, least: int = 100) -> DataFrame:
    """lang, source and the fences lo_/hi_ of every ratio; ``parts`` are rows of ``sketches``, of any number of runs."""
    group, corpus = _read(parts, ["lang", "source"], spread, "own"), _read(parts, [], spread, "of_all")
    lang = _read(parts, ["lang"], spread, "of_lang").withColumnRenamed("lang", "l")
    both = group.join(lang, F.col("lang").eqNullSafe(F.col("l"))).join(F.broadcast(corpus))  # one row
    pick = F.when(F.col("n_own") >= least, F.col("own")).when(F.col("n_of_lang") >= least, F.col("of_lang")).otherwise(F.col("of_all"))
    return both.select("lang", "source", pick.alias("f")).select("lang", "source", *(F.col(f"f.{e}").alias(e) for e in _edges()))


def judge(docs: DataFrame, spread: float = 3.0) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row.

    ``kept`` is false where a base rule fails or a ratio lies outside the fences of the row's lang and source
    (null lang and source are groups of their own; a ratio without a denominator passes).  Null and empty texts
    have no words and fail.  Repeated rows are judged alike and count each; other columns are not read; an
    empty table stays empty.
    """
    table = ratios(materialize(base_counts(docs), "quality"))
    parts = materialize(sketches(table), "sketches")
    limits = materialize(fences(parts, spread), "fences")
    release(parts)
    limits = bounded_broadcast(limits.withColumnsRenamed({"lang": "l", "source": "s"}))
    on = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    ok = [F.coalesce(F.col(f"r_{r}") >= F.col(f"lo_{r}"), F.lit(True)) & F.coalesce(F.col(f"r_{r}") <= F.col(f"hi_{r}"), F.lit(True)) for r in RATIOS]
    kept = ~F.col("base_failed") & reduce(Column.__and__, ok)
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return table.join(limits, on, "left").select(*out, kept.alias("kept"))


def oracle(spread: int = 3, least: int = 100) -> str:
    """DuckDB SQL for the rows of ``judge``: all quantiles are of bucketed values, as in the sketches."""
    fence = []
    for r, (lower, narrow, high) in RATIOS.items():
        width = f"{spread} * greatest(q75 - q25, {narrow})"
        top = f"q75 + {width}"
        if high is not None:
            top = f"CASE WHEN q75 - q25 > {narrow} THEN {top} ELSE greatest({top}, q{high[0]}) END"
        fence.append(f"WHEN '{r}' THEN {{'lo': {f'q25 - {width}' if lower else 'NULL'}, 'hi': {top}}}")
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, lang, source, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, w[i:i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS d(k) GROUP BY rid),
base AS (SELECT w.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  coalesce(cover.n, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines FROM w LEFT JOIN cover ON w.rid = cover.rid),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
r AS (SELECT rid, lang, source, base_failed, x.r AS r, x.v AS v FROM (SELECT *, unnest([{{'r': 'word_length', 'v': 1000 * word_chars // nullif(n_words, 0)}},
  {{'r': 'symbols', 'v': 1000 * n_symbols // nullif(word_chars, 0)}}, {{'r': 'dup_lines', 'v': 1000 * n_dup_lines // nullif(n_lines, 0)}},
  {{'r': 'repeats', 'v': 1000 * n_repeat_words // nullif(n_words, 0)}}]) AS x FROM judged)),
b AS (SELECT lang, source, r, v - v % (1 << greatest(length(bin(v)) - {LEADING_BITS}, 0)) AS b FROM r WHERE NOT base_failed AND v IS NOT NULL),
h AS (SELECT 0 AS level, lang, source, r, b, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT 1, lang, NULL, r, b, count(*) FROM b GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, r, b, count(*) FROM b GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, r ORDER BY b) AS upto, sum(n) OVER (PARTITION BY level, lang, source, r) AS total FROM h),
q AS (SELECT level, lang, source, r, total, min(b) FILTER (4 * upto >= total) AS q25, min(b) FILTER (4 * upto >= 3 * total) AS q75, min(b) FILTER (100 * upto >= 99 * total) AS q99 FROM c GROUP BY ALL),
f AS (SELECT level, lang, source, r, total, CASE r {' '.join(fence)} END AS f FROM q),
ok AS (SELECT r.rid, bool_and(coalesce(v >= e.lo, true) AND coalesce(v <= e.hi, true)) AS ok FROM (
  SELECT r.rid, r.v, CASE WHEN own.total >= {least} THEN own.f WHEN lang.total >= {least} THEN lang.f ELSE every.f END AS e FROM r
  LEFT JOIN f own ON own.level = 0 AND own.lang IS NOT DISTINCT FROM r.lang AND own.source IS NOT DISTINCT FROM r.source AND own.r = r.r
  LEFT JOIN f lang ON lang.level = 1 AND lang.lang IS NOT DISTINCT FROM r.lang AND lang.r = r.r
  LEFT JOIN f every ON every.level = 2 AND every.r = r.r) r GROUP BY r.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept FROM judged JOIN ok ON judged.rid = ok.rid"""
