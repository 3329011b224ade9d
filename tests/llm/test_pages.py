from __future__ import annotations

import base64
import gzip
import hashlib
import os
import random
import re
import time
from html.parser import HTMLParser

import duckdb
import pytest

from tidemark.llm import html, urlfilter, warc

PAGES = "page_id long, url string, html string, extra int"


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/x%20y", "x" * 5000, 0), (2, None, "", 0), (3, "http://c/%0A\n", None, 0), (9, "u", "é", 0), (4, "u", "é", 0), (4, "u", "é", 0), (None, "n", "é", 0), (7, "s", "solo", 0), (None, None, "alone", 0)]
    df = spark.createDataFrame(rows, PAGES)
    root = f"file://{tmp_path}/w"
    manifest = warc.write_archive(df, root, roll_bytes=300)
    assert len(manifest["files"]) > 1 and sum(f["records"] for f in manifest["files"]) == len(rows)
    got = sorted((tuple(r[c] for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.read_archive(spark, root).collect()), key=str)
    largest = {}
    for i, _, h, _ in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    want = []
    for i, u, h, _ in rows:
        b = (h or "").encode()
        holder = largest.get(h or "")
        revisit = holder is not None and i != holder
        want.append((i, u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", holder if revisit else None))
    assert got == sorted(want, key=str)
    again = warc.write_archive(df.repartition(3), f"file://{tmp_path}/w2", roll_bytes=300)
    assert [f["sha256"] for f in again["files"]] == [f["sha256"] for f in manifest["files"]]  # the same bytes, however the rows lie
    assert not [f for f in os.listdir(tmp_path / "w") if f.startswith("_")]
    text = b"".join(gzip.decompress((tmp_path / "w" / f["file"]).read_bytes()) for f in manifest["files"])
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.count(b"WARC-Type: warcinfo") == len(manifest["files"])
    assert b"WARC-Target-URI: http://a/x%20y\r\n" in text and b"WARC-Target-URI: http://c/%0A%0A\r\n" in text
    own = dict(re.findall(rb"WARC-Record-ID: (\S+)\r\n(?:[^\r]+\r\n)*?X-Page-Id: (\d+)\r\n", text))
    referred = re.findall(rb"WARC-Refers-To: (\S+)\r\nWARC-Refers-To-Date: 1970-01-01T00:00:00Z\r\nWARC-Refers-To-Target-URI: u\r\nX-Refers-To-Page-Id: 9\r\n", text)
    assert len(referred) == 3 and all(own[x] == b"9" for x in referred)
    con = duckdb.connect()
    con.register("pages", df.toArrow())
    assert sorted(con.sql(warc.ORACLE).fetchall(), key=str) == sorted((tuple(r) for r in warc.round_trip(df, f"file://{tmp_path}/w4").collect()), key=str)
    assert warc.round_trip(df.limit(0), f"file://{tmp_path}/w3").collect() == []


def test_warc_damage_is_seen(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "payload", 0)], PAGES)
    root = f"file://{tmp_path}/w"
    name = warc.write_archive(df, root)["files"][0]["file"]
    raw = gzip.decompress((tmp_path / "w" / name).read_bytes()).replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n")
    (tmp_path / "w" / name).write_bytes(gzip.compress(raw))
    (tmp_path / "w" / f".{name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, root).collect()


URLS = ["https://a.example.net/en/1", "https://a.example.net/fr/1", "http://EXAMPLE.COM/de/x?y", "http://example.com/dex", "http://x.org/fr/", "http://org/fr/a", "http://net", "http://net/", "http://xnet/", "no scheme", None, "", "http://a.b.example.com:80/de/", "x://h?q#f", "http://h#f/net/", "http://notexample.com/de/"]


def test_urls_against_sql(spark):
    rows = [(i, u, "", 0) for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, PAGES)
    got = sorted(map(tuple, urlfilter.judge(df, urlfilter.BLOCK, urlfilter.ALLOW).collect()))
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [r[:2] for r in rows])
    assert got == sorted(con.sql(urlfilter.ORACLE).fetchall())
    assert urlfilter.judge(df.limit(0), urlfilter.BLOCK, urlfilter.ALLOW).collect() == []
    with pytest.raises(ValueError):
        urlfilter.judge(df, [("a", "/")], [("a", "/")])


def test_cascade_is_exact_over_the_universe(spark):
    listed = [(f"site{i}.com", "/") for i in range(0, 3000, 3)]
    df = spark.createDataFrame([(i, f"http://www.site{i}.com/p", "", 0) for i in range(3000)], PAGES)
    got = {r.page_id: r.verdict for r in urlfilter.judge(df, listed, []).collect()}
    assert got == {i: "block" if i % 3 == 0 else "allow" for i in range(3000)}
    host, path = urlfilter.split_url(df.url)
    urls = df.select(host.alias("host"), path.alias("path"))
    c = urlfilter.build_cascade(urls, listed, [1], 6)  # a first level far too small: the others make up for it
    assert len(c.levels) >= 2 and all((f"site{i}.com/" in c) == (i % 3 == 0) for i in range(3000))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=1>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, as you know, everywhere.</p></div><div id="wrap"><div class="sidebar"><p>Popular things you may like, really.</p></div>
<div class="content"><h2>Title &amp; more</h2><p>First   para, with&nbsp;some text.<br>Same block.</p><!-- ad --><div class="ad"><p>Buy now, pay later, or never.</p></div>
<p><b>Second bold text, longer than the first one. Yes.<p>Short.</p><ul><li>one, two<li>three</ul><script>var a="</p>";</script>
<section id="comments"><p>I disagree, strongly, with everything here.</p></section></div></div><form><p>Subscribe now, please.</p></form><footer>(c) x, y</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Title & more\nFirst para, with some text. Same block.\nSecond bold text, longer than the first one. Yes.\nShort.\none, two\nthree"


LONG = "A sentence of the body, long enough, with commas, and an end. Another one follows, as long."


@pytest.mark.parametrize(
    ("before", "inside", "after"),
    [
        ("<h1>Heading</h1><p>The lead, in a sentence, of its own.</p><div class=body>", "<p>{}</p>", "</div>"),
        ("<section><h2>One</h2>", "<p>{}</p>", "</section><section><h2>Two</h2><p>The short one, which counts, too.</p></section>"),
        ("<p>Words before the list, as usual.</p><ul>", "<li>{}</li>", "</ul><p>Words after the list, as usual.</p>"),
    ],
)
@pytest.mark.parametrize("around", ["article", "div"])
def test_parts_around_the_largest_stay(before, inside, after, around):
    own = before + "".join(inside.format(LONG) for _ in range(20)) + after
    page = f"<html><body><nav><a href=1>Home</a></nav><{around}>{own}</{around}><footer>End, of all.</footer></body></html>"
    got = html.main_text(page).split("\n")
    want = [t.strip() for t in re.split(r"<[^>]*>", own) if t.strip()]
    if around == "article":
        assert got == want
    else:
        assert got.count(LONG) == 20 and [t for t in want if t.endswith(".")] == [t for t in got if t.endswith(".")]


@pytest.mark.parametrize(("markup", "want"), [(None, ""), ("", ""), ("<p>", ""), ("plain text", "plain text"), ("<p>a &lt;b&gt; &#233;&amp</p><p", "a <b> é&"), ("<p>x < y</p>", "x < y"), ("<!-- open", ""), ("<script>never closed", ""), ("</p></div>text", "text"), ("<p>a</p>" * 3, "a\na\na"), ("<div hidden><p>no</p></div><p>yes, this.</p>", "yes, this.")])
def test_odd_markup(markup, want):
    assert html.main_text(markup) == want


TEXT = f"<p>{LONG}</p>" * 4


@pytest.mark.parametrize(
    "page",
    [
        '<body><div class="content no-sidebar">{}</div></body>',
        '<body><div class="layout with-sidebar">{}<div class="sidebar"><p>Popular things, of all kinds.</p></div></div></body>',
        '<body><div class="side-by-side">{}</div></body>',
        "<body><form>{}<input><select><option>One</select></form></body>",
        '<body><div class="search-page"><h1 hidden>Title</h1>{}</div></body>',
        "<body><div><svg><path d='1'></div><article>{}</article></body>",
        "<body><svg><path d='1'><article>{}</article></body>",
        "<body><div><object data=x>Your browser, sadly, shows nothing.</div>{}</body>",
        "<body><noscript><p>Switch it on, please.</p></noscript><div><noscript>left open</div>{}</body>",
        '<body><div class="comments"><p>I disagree, strongly, with it.</p></div><div>{}</div></body>',
    ],
)
def test_wrappers_are_no_reason_to_lose_the_article(page):
    assert html.main_text(page.format(TEXT)) == "\n".join([LONG] * 4)


def test_a_page_of_notices_has_no_main_text():
    assert html.main_text('<body><div class="cookie-notice"><p>We use cookies, as you know, everywhere.</p></div><nav>Home</nav></body>') == ""


@pytest.mark.parametrize("markup", ["<div>x, y." * 20_000, '<p title="x>' + "<b>z" * 20_000, "<b>" * 20_000 + "<p>x" * 20_000, "<i>" * 20_000 + "</b>" * 20_000, "<noscript>a" * 20_000, "<li>a, b" * 20_000])
def test_odd_markup_is_read_in_linear_time(markup):
    began = time.process_time()
    html.main_text(markup)
    assert time.process_time() - began < 5


class Plain(HTMLParser):
    """The article's blocks by the standard library's parser, for well-formed pages with an article element."""

    def __init__(self, markup):
        super().__init__()
        self.inside, self.skip, self.out = 0, [], [""]
        self.feed(markup)

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        outside = tag in ("aside", "nav", "footer", "form", "script", "style", "button") or any(k == "class" and re.search(r"\b(ad|advert|promo|comments?|share|related|notice|newsletter)\b", v or "") for k, v in attrs)
        if tag not in html.VOID:
            self.skip.append(outside or bool(self.skip and self.skip[-1]))
        if tag in html.BLOCK:
            self.out.append("")
        if tag == "br":
            self.out[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in html.VOID and self.skip:
            self.skip.pop()
        if tag in html.BLOCK:
            self.out.append("")

    def handle_data(self, data):
        if self.inside and not (self.skip and self.skip[-1]):
            self.out[-1] += data


def test_against_a_plain_extractor():
    """Random well-formed pages: the article is what a parser that knows the article element returns."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", "?", ", and more."])
    for _ in range(200):
        own = [f"<h1>{sentence(4)}</h1>"]
        for _ in range(rng.randint(3, 12)):
            t = sentence(rng.randint(12, 40)).replace(" ", ", ", 2)
            own.append(rng.choice([f"<p>{t}</p>", f"<p>{t[:20]}<b>{t[20:30]}</b>{t[30:]} &amp; <a href='/x'>{word()}</a></p>", f"<h2>{sentence(3)}</h2><p>{t}</p>", f"<ul><li>{t}</li><li>{sentence(5)}</li></ul>", f"<blockquote><p>{t}</p></blockquote>", f"<div class='ad'><p>{sentence(6)}</p></div><p>{t}</p>"]))
        links = "".join(f"<li><a href='/{word()}'>{word()} {word()}</a></li>" for _ in range(rng.randint(2, 9)))
        page = f"<html><head><title>{sentence(3)}</title></head><body><header><h2>{word()}</h2></header><nav><ul>{links}</ul></nav><div class='sidebar'><p>{sentence(20)}</p></div><article>{''.join(own)}</article><section class='comments'><p>{sentence(25)}</p></section><footer><p>{sentence(9)}</p></footer></body></html>"
        want = "\n".join(x for x in (" ".join(b.split()) for b in Plain(page).out) if x)
        assert html.main_text(page) == want


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "<p>" + "word, " * 50_000, 5), (1, "u", PAGE, 5)], PAGES)
    rows = html.extract(df).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)
    assert {(r.page_id, r.n_chars) for r in rows if r.page_id} == {(1, len(html.main_text(PAGE))), (2, 0)}
    assert max(r.n_chars for r in rows) == len("word, " * 50_000) - 1
    assert html.extract(df.limit(0)).collect() == []
