"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import collections
import hashlib
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = r"[^\x20\x09-\x0D]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_sets(rows, k):
    """doc_id -> set of k-word shingles."""
    out = {}
    for i, t in rows:
        w = re.findall(SPACE, low(t))
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def components(sets, num, den):
    """doc_id -> smallest doc_id reachable over all linked pairs."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    shared = collections.Counter()
    for ids in inverted.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[b], ids[a]] += 1
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def contamination(docs, items):
    """Rows as the decontamination operator returns them, for (doc_id, text) and (item_id, text)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in docs:
        w, hit, met = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    met |= found
        ids = ",".join(sorted(map(str, met)))
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    w = re.findall(SPACE, t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)
