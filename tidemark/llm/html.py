"""Main text of web pages by tag-path ratios.

A page is read as blocks of text, each with the path of tags from the root to it.  Text length, clause punctuation and
linked text are summed per path; a block's ratios are those of its path: text per block, punctuation per block, and the
share outside links.  They are smoothed over neighbouring blocks, averaged per path and multiplied.  Paths whose product
reaches a share of the page's weighted mean are content paths.  The content node is the innermost element that holds
nine tenths of the text on content paths, or the article or main element around it.  The main text is everything on
content paths, and everything in the content node: the article's short parts (headings, list items) count too.

Parts that are no article text whatever their ratios (menus, buttons, hidden parts, ...) are never read.  Parts that only
their tag or name speaks against (forms, sidebars, comments, ...) are left out if they are a minor part of the page: one
that holds most of its text and its title, or nearly all of it, is a wrapper.  Reading is linear in the markup.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.pretoken import blocks

# Element kinds of HTML, and the names that sites give to parts outside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("nav footer button select option dialog menu label head audio video canvas map datalist object svg math".split())
RARELY = frozenset("aside form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar side aside footer foot masthead topbar toolbar comment comments commentlist disqus respond "
    "replies reply cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing "
    "social related recommended widget pager pagination copyright skip search form alert".split()
)
LAYOUT = frozenset("no non not with without has have is by".split())  # "no-sidebar", "side-by-side"
CLOSED_BY = {  # an open element of the key ends where one of the values begins
    "p": BLOCK - {"html", "head", "body"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
    "head": frozenset({"body"}),
}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",)}
PUNCTUATION = re.compile(r"[,.;:!?…،。，！？；：、؟]")

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PART = re.compile(r"([a-z]+)(?:\d.*)?")
_QUOTED_UP_TO = 4096  # a tag with quotes left open behind this many characters ends at its first >


@lru_cache(maxsize=4096)
def _named(value: str) -> bool:
    """Whether a class or id names a part outside the article."""
    for token in value.lower().split():
        parts = re.split("[-_]+", token)
        if not LAYOUT.intersection(parts) and any((m := _PART.fullmatch(p)) and m[1] in NAMES for p in parts):
            return True
    return False


@dataclass(slots=True)
class Element:
    """A block element; ``doubtful``: its tag or name says that it is outside the article."""

    parent: int
    name: str
    path: int
    doubtful: bool
    titled: bool = False
    size: int = 0


@dataclass(slots=True)
class Block:
    text: str
    element: int  # the innermost block element, -1 outside all
    linked: int


class _Reader:
    """One pass over the markup; ``blocks`` holds all text but that of parts that are never read."""

    def __init__(self, markup: str):
        self.blocks: list[Block] = []
        self.elements: list[Element] = []
        self.paths: dict[tuple[int, str], int] = {}  # (path of the parent, step) -> path
        self.stack: list[tuple[str, int, bool]] = []  # name, innermost block element, never read
        self.at: dict[str, list[int]] = {}  # name -> where it is in the stack
        self.block_at: list[int] = []  # where block elements are in the stack
        self.parts: list[str] = []
        self.unclosed: set[str] = set()
        self.linked = self.links = self.foreign = self.articles = 0
        self._read(markup)
        self._flush()

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.stack[-1][1] if self.stack else -1, self.linked))
        self.parts, self.linked = [], 0

    def _text(self, raw: str) -> None:
        if self.stack and self.stack[-1][2]:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if self.links:
            self.linked += len(text.strip())
        self.parts.append(text)

    def _pop_to(self, depth: int) -> None:
        if self.block_at and self.block_at[-1] >= depth:
            self._flush()
        while len(self.stack) > depth:
            name = self.stack.pop()[0]
            self.at[name].pop()
            if self.block_at and self.block_at[-1] == len(self.stack):
                self.block_at.pop()
            self.links -= name == "a"
            self.foreign -= name in FOREIGN
            self.articles -= name in ("article", "main")

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            if self.foreign and not self.at.get("foreignobject"):  # HTML ends a drawing or formula that was left open
                self._pop_to(min(self.at[f][0] for f in FOREIGN if self.at.get(f)))
            while self.block_at:
                there = self.stack[self.block_at[-1]][0]
                if there in SCOPE.get(name, ()) or name not in CLOSED_BY.get(there, ()):
                    break
                self._pop_to(self.block_at[-1])
            self._flush()
        if name in VOID:
            if name == "br":
                self._text(" ")
            return
        given = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip("/ \t\r\n") else {}
        inner = self.stack[-1][1] if self.stack else -1
        never = bool(self.stack and self.stack[-1][2]) or name in NEVER or self._hidden(given)
        doubtful = name in RARELY or name == "header" and not self.articles or self._doubtful(name, given)
        if name in BLOCK:
            mark = (given.get("class", "").split() or [given.get("id", "")])[0]
            step = (self.elements[inner].path if inner >= 0 else -1, f"{name}.{mark}" if mark else name)
            self.elements.append(Element(inner, name, self.paths.setdefault(step, len(self.paths)), doubtful, name in ("h1", "article", "main")))
            self.block_at.append(len(self.stack))
            inner = len(self.elements) - 1
        else:
            never = never or doubtful
        self.links += name == "a"
        self.foreign += name in FOREIGN
        self.articles += name in ("article", "main")
        self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, inner, never))

    def _hidden(self, given: dict[str, str]) -> bool:
        if not given:
            return False
        return given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true" or bool(_HIDDEN.search(given.get("style", "")))

    def _doubtful(self, name: str, given: dict[str, str]) -> bool:
        return bool(given) and name not in ("html", "body", "article", "main") and any(_named(given[k]) for k in ("class", "id") if given.get(k))

    def _close(self, name: str) -> None:
        depth = self.at[name][-1] if self.at.get(name) else -1
        # an inline end tag doesn't close blocks
        if depth >= 0 and (name in BLOCK or name in NEVER or not self.block_at or self.block_at[-1] < depth):
            self._pop_to(depth)
        elif name in BLOCK:
            self._flush()

    def _raw(self, markup: str, name: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup; -1 if there is none."""
        if name in self.unclosed:
            return -1
        close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(markup, at)
        if close is None:
            self.unclosed.add(name)
            return -1
        return close.end()

    def _read(self, markup: str) -> None:
        at, end = 0, len(markup)
        while at < end:
            lt = markup.find("<", at)
            if lt < 0:
                self._text(markup[at:])
                return
            if lt > at:
                self._text(markup[at:lt])
            after = markup[lt + 1 : lt + 2]
            if markup.startswith("<!--", lt):
                stop = markup.find("-->", lt + 4)
                at = end if stop < 0 else stop + 3
            elif after in ("!", "?") and after:
                stop = markup.find(">", lt)
                at = end if stop < 0 else stop + 1
            elif after.isascii() and after.isalpha() or after == "/":
                tag = _TAG.match(markup, lt, lt + _QUOTED_UP_TO) or _LOOSE.match(markup, lt)
                if tag is None:
                    stop = markup.find(">", lt)
                    at = end if stop < 0 else stop + 1  # an unfinished tag, or </ without a name
                    continue
                at = tag.end()
                name = tag[2].lower()
                if tag[1]:
                    self._close(name)
                elif name in RAW:
                    if not tag[3].endswith("/"):
                        stop = self._raw(markup, name, at)
                        if stop >= 0:
                            at = stop
                        elif name in ("noscript", "template", "iframe"):  # left open: it ends with its parent
                            self._open(name, "hidden")
                        else:
                            at = end
                elif not (tag[3].endswith("/") and (name in FOREIGN or self.foreign)):
                    self._open(name, tag[3])
            else:
                self._text("<")
                at = lt + 1


def _smooth(values: list[float]) -> list[float]:
    """A binomial window of five blocks, cut at the ends."""
    out = []
    for i in range(len(values)):
        pairs = [(w, values[i + k]) for k, w in zip(range(-2, 3), (1, 4, 6, 4, 1), strict=True) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in pairs) / sum(w for w, _ in pairs))
    return out


def _without_parts(page: _Reader) -> list[Block]:
    """The blocks outside doubtful parts, but for those that turn out to be wrappers."""
    elements = page.elements
    for b in page.blocks:
        if b.element >= 0:
            elements[b.element].size += len(b.text)
    for e in reversed(elements):  # parents come before their children
        if e.parent >= 0:
            above = elements[e.parent]
            above.size += e.size
            above.titled = above.titled or e.titled
    total, out = sum(len(b.text) for b in page.blocks), []
    for e in elements:
        wrapper = 2 * e.size > total and (e.titled or 10 * e.size >= 9 * total >= 2000)
        out.append(e.parent >= 0 and out[e.parent] or e.doubtful and not wrapper)
    return [b for b in page.blocks if b.element < 0 or not out[b.element]]


def content_paths(found: list[Block], paths: list[int], share: float = 0.3) -> set[int]:
    """The paths above the threshold; ``paths`` has the path of each block."""
    sums: dict[int, list[int]] = {}
    for b, p in zip(found, paths, strict=True):
        s = sums.setdefault(p, [0, 0, 0, 0])
        s[0] += len(b.text)
        s[1] += 1
        s[2] += len(PUNCTUATION.findall(b.text))
        s[3] += b.linked
    text = _smooth([sums[p][0] / sums[p][1] for p in paths])
    marks = _smooth([sums[p][2] / sums[p][1] for p in paths])
    fused = dict.fromkeys(sums, 0.0)
    for p, t, m in zip(paths, text, marks, strict=True):
        fused[p] += math.log1p(t) * math.log1p(1 + m) / sums[p][1]
    for p, s in sums.items():
        fused[p] *= 1 - min(1, s[3] / s[0])
    level = share * sum(fused[p] * s[0] for p, s in sums.items()) / sum(s[0] for s in sums.values())
    return {p for p, f in fused.items() if f >= level and f > 0}


def content_blocks(page: _Reader) -> list[Block]:
    """The blocks of the main text, in page order."""
    found, elements = _without_parts(page), page.elements
    if not found:
        return []
    paths = [elements[b.element].path if b.element >= 0 else -1 for b in found]
    content = content_paths(found, paths)
    if not content:
        return found
    # the innermost element that holds nine tenths of the text on content paths
    size = [0] * len(elements)
    total = 0
    for b, p in zip(found, paths, strict=True):
        if p in content:
            total += len(b.text)
            if b.element >= 0:
                size[b.element] += len(b.text)
    for i in range(len(elements) - 1, -1, -1):
        if elements[i].parent >= 0:
            size[elements[i].parent] += size[i]
    node = max((i for i in range(len(elements)) if 10 * size[i] >= 9 * total), default=-1)  # of nested ones, the innermost has the largest number
    # a lone paragraph is no container: take the element around it
    if node >= 0 and elements[node].parent >= 0 and any(b.element == node and p in content for b, p in zip(found, paths, strict=True)):
        node = elements[node].parent
    at = node
    while at >= 0:
        if elements[at].name in ("article", "main"):
            node = at
            break
        at = elements[at].parent
    inside = [False] * len(elements)
    for i, e in enumerate(elements):
        inside[i] = i == node or e.parent >= 0 and inside[e.parent]
    return [b for b, p in zip(found, paths, strict=True) if p in content or b.element >= 0 and inside[b.element]]


def main_text(markup: str | None) -> str:
    """Blocks of the article in page order, one to a line; '' for null, empty and markup without text."""
    return "\n".join(b.text for b in content_blocks(_Reader(markup or "")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row, from the whole html.

    Null and empty html, and pages without text, give '' and 0.  Repeated rows stay, null ids and urls pass
    through, other columns are not read, an empty table stays empty.
    """

    def run(batches):
        for batch in batches:
            for a, n in blocks(batch.column(2)):
                part = batch.slice(a, n)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
