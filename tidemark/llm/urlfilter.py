"""URL filters by a Bloom filter cascade.

A list holds rules (host, path): a rule fits its host and all subdomains where the url's path starts with the
rule's.  The keys a url asks for are all of its host suffixes joined with every path prefix as long as some
rule's path.  For each list, level 1 of a cascade encodes the listed keys; level 2 the keys of the corpus that
pass level 1 without being listed; level 3 the listed keys that pass level 2, and so on until a level lets
nothing wrong through.  For every key of the corpus the cascade then answers exactly, without a join.

Level 1 has a false positive rate of about listed / (sqrt(2) * universe), so its size grows with the logarithm
of the corpus only, and about 0.7 * listed false positives remain for level 2: all levels are bounded by the
list.  They are gathered to the driver, which holds the list itself.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str]


class Bloom:
    def __init__(self, n: int, rate: float, salt: int):
        bits = max(64, math.ceil(max(n, 1) * math.log(1 / rate) / math.log(2) ** 2))
        self.hashes = max(1, round(math.log(1 / rate, 2)))
        self.bits, self.salt = bits, salt
        self.words = np.zeros(bits // 8 + 1, np.uint8)

    def _places(self, key: str):
        d = hashlib.blake2b(key.encode(), digest_size=16, salt=self.salt.to_bytes(16, "little")).digest()
        a, b = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def add(self, key: str) -> None:
        for p in self._places(key):
            self.words[p >> 3] |= 1 << (p & 7)

    def __contains__(self, key: str) -> bool:
        return all(self.words[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class Cascade:
    """Exact for the listed keys and for every key of the universe it was built over."""

    def __init__(self):
        self.levels: list[Bloom] = []

    def __contains__(self, key: str) -> bool:
        for depth, level in enumerate(self.levels):
            if key not in level:
                return depth % 2 == 1
        return len(self.levels) % 2 == 1

    def grow(self, keys, rate: float) -> None:
        level = Bloom(len(keys), rate, len(self.levels) + 1)
        for k in keys:
            level.add(k)
        self.levels.append(level)


def rule_text(rule: Rule) -> str:
    return rule[0] + rule[1]


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Columns (host, path) of a url: both empty for null and without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.regexp_extract(rest, r"(?s)\A([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)\A([^/]*)", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every key that a rule fitting this url could be, the longest first."""
    if not host:
        return []
    labels = host.split(".")
    suffixes = [".".join(labels[i:]) for i in range(len(labels))]
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return sorted((s + p for s in suffixes for p in prefixes), key=len, reverse=True)


def _listed_keys(rules: list[Rule]) -> set[str]:
    return {rule_text(r) for r in rules}


def _wrong(urls: DataFrame, cascade: Cascade, listed: set[str], lengths: list[int]) -> list[str]:
    """Distinct keys of the corpus that the cascade takes for listed and that are not (about 0.7 per listed key)."""

    def run(batches):
        for batch in batches:
            got = {k for h, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k in keys_of(h, p, lengths) if k not in listed and k in cascade}
            yield pa.RecordBatch.from_pydict({"key": pa.array(sorted(got), pa.string())})

    return [r.key for r in urls.select("host", "path").mapInArrow(run, "key string").distinct().collect()]


def build_cascade(urls: DataFrame, rules: list[Rule], lengths: list[int], universe: int) -> Cascade:
    """``urls``: host, path of the whole corpus; ``universe``: an upper bound of its number of keys."""
    listed, cascade = _listed_keys(rules), Cascade()
    if not listed:
        return cascade
    cascade.grow(listed, min(0.5, max(1e-9, len(listed) / (math.sqrt(2) * max(universe, 1)))))
    other = _wrong(urls, cascade, listed, lengths)
    inside, outside = sorted(listed), other
    while outside:
        cascade.grow(outside, 0.5)
        wrong = [k for k in inside if k in cascade.levels[-1]]
        if not wrong:
            break
        inside = wrong
        cascade.grow(inside, 0.5)
        outside = [k for k in outside if k in cascade.levels[-1]]
    return cascade


def judge(pages: DataFrame, block: list[Rule], allow: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row; the longest fitting rule wins, ``default`` without any.  Of fitting
    rules of one length, that with the longer host wins.

    Null urls and urls without '://' have empty host and path and fit no rule.  A rule in both lists, or two
    rules of the same text, is an error.  Repeated rows are judged alike; an empty table stays empty; other
    columns are not read.
    """
    both = [rule_text(r) for r in [*block, *allow]]
    if len(set(both)) < len(both):
        raise ValueError("a rule stands twice")
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    lengths = sorted({len(p) for _, p in [*block, *allow]})
    labels = F.size(F.split("host", r"\.")).cast("long")
    universe = urls.agg(F.coalesce(F.sum(labels), F.lit(0)).alias("n")).first().n * max(1, len(lengths))
    cascades = {v: build_cascade(urls, rules, lengths, universe) for v, rules in (("block", block), ("allow", allow))}

    def run(batches):
        for batch in batches:
            ids, hosts, paths = (batch.column(i) for i in range(3))
            rules, verdicts = [], []
            for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True):
                rule, verdict = None, default
                for key in keys_of(h, p, lengths):
                    found = next((v for v, c in cascades.items() if key in c), None)
                    if found:
                        rule, verdict = key, found
                        break
                rules.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([ids, hosts, paths, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


#: The rules of the standard query.
BLOCK = [("net", "/"), ("example.com", "/de/")]
ALLOW = [("example.net", "/en/"), ("org", "/fr/")]

#: The same judgement in DuckDB SQL.
ORACLE = r"""
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END, '^([^?#]*)', 1), '') AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(regexp_extract(rest, '^([^/]*)', 1)) + 1) AS path FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
