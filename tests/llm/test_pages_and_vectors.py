"""Operators on pages and vectors against brute force, with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import io
import random
import re
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import pivot_index, url_filter, warc
from lodeline.llm.html_text import extract_text, main_text, parse
from lodeline.session import work_dir

PAGES = "page_id long, url string, html string"


# URLs.
URLS = [
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("no scheme example.org/es/", "", "", None, "allow"),
    ("casino", "", "", None, "block"),
    ("https://Example.ORG/ES/1", "example.org", "/ES/1", "org/", "allow"),
    ("https://www.example.org/es/1?a=://x", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"),
    ("https://casino.org/x", "casino.org", "/x", "org/", "allow"),
    ("https://org", "org", "", None, "allow"),
    ("http://a.com/de/", "a.com", "/de/", "com/de/", "block"),
    ("http://casino.com/fr/x", "casino.com", "/fr/x", "com/fr/", "allow"),
    ("http://a.com?x/de/", "a.com", "", None, "allow"),
    ("http://my-CASINO-win.net/", "my-casino-win.net", "/", None, "block"),
    ("http://occasino.net/", "occasino.net", "/", None, "allow"),
    ("http://sussex.net/essex", "sussex.net", "/essex", None, "allow"),
    ("http://cheap.net/cheap", "cheap.net", "/cheap", None, "allow"),
    ("http://cheap2.net/?q=pills", "cheap2.net", "/", None, "block"),
    ("http://freebets.net/", "freebets.net", "/", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
]


def test_url_filter(spark):
    rows = [(i, u[0], "mine") for i, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = url_filter.filter_urls(df).orderBy("page_id").collect()
    assert [tuple(r)[1:6] for r in got] == URLS
    assert url_filter.filter_urls(df.where("false")).count() == 0
    kept = url_filter.allowed(df.drop("verdict"))
    assert kept.columns == ["page_id", "url"] and kept.count() == sum(u[4] == "allow" for u in URLS)
    none = url_filter.filter_urls(df, rules=(), strict=(), soft=())
    assert {r.verdict for r in none.collect()} == {"allow"}


# HTML.
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies, you know, for all of it.</div>
<form action="/"><div id="wrapper" class="with-sidebar"><main><article><header class="entry-header"><h1>Title &amp; more</h1></header>
<p>First,   para <a href=x>link</a>&nbsp;text.<ul><li>one<li>two</ul><blockquote>Quote, yes.</blockquote>
<table><tr><td>a<td>b</table><!-- <p>no</p> --><script>var t="</p>";</script><p title="a > b" hidden>gone</p>
<div class="share-buttons">Share</div><aside>side</aside><div class="ad-box ad">Buy, now, please.</div>
<section id="comments"><article class="comment"><p>I, a reader, comment, a lot, and lots, of text, here.</p></article></section>
</article></main><div class="sidebar"><p>Side, text, that is long, and has commas, too.</p></div></div></form><footer>foot</footer></body></html>"""

PLAIN = """<body><div id=top><ul class=menu><li><a href=1>Home</a></ul></div><div id="content"><h2>Head</h2>
<p>Some text, with commas, and so on, that is long enough to be read as a paragraph.</p>loose text<br>more
<p>Another one, here, with text that goes on and on for quite some time.</div>
<div id="x"><p><a href=1>link list one</a> <a href=2>link two</a></p></div></body>"""


def test_main_text():
    assert main_text(PAGE) == "Title & more\nFirst, para link text.\none\ntwo\nQuote, yes.\na\nb"
    assert main_text(PLAIN).split("\n") == [
        "Head",
        "Some text, with commas, and so on, that is long enough to be read as a paragraph.",
        "loose text more",
        "Another one, here, with text that goes on and on for quite some time.",
    ]
    titled = '<main><h1>Title</h1><article><p>One, two.</p></article><article class="comment"><p>I say, no.</p></article></main>'
    assert main_text(titled) == "Title\nOne, two."
    framed = '<div class="content has-comments no-sidebar"><p>Text, here.</p><div class="comments-area"><p>Well, no.</p></div></div>'
    assert main_text(framed) == "Text, here."
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x</script>") == ""
    assert main_text("plain &lt;text&gt;, a < b") == "plain <text>, a < b"
    long = "<article>" + "<p>" + "word, " * 200_000 + "</p><p>last</p></article>"
    assert main_text(long) == ("word, " * 200_000).strip() + "\nlast"
    assert main_text("<article>" + "<div>" * 3000 + "<p>deep" + "</div>" * 3000 + "</article>") == "deep"


def test_values_of_any_length_and_raw_elements():
    for n in (60_000, 70_000, 1_000_000):
        assert main_text(f'<p>One, <img src="data:{"A" * n}"> two.</p>') == "One, two."
        gone = f"<div data-state='{'>' * n}' class=\"comments\"><p>Well, no.</p></div>"
        assert main_text(f"<div><p>One.</p>{gone}<p>Two.</p></div>") == "One.\nTwo."
    # What begins inside a raw element does not reach out of it.
    assert main_text('<script>var s="<!--";</script><p>One</p><p>Two</p>') == "One\nTwo"
    assert main_text("<style>a<b c='</style><p>One</p><p title='x'>Two</p>") == "One\nTwo"
    # A stray quote opens no value; one that is never shut leaves the text in place.
    assert main_text('<p><b a="x"">One</b> <img alt="5" wide" src="y">two</p><p c="d">Three</p>') == "One two\nThree"
    assert main_text('<p>One</p><p>a <b c="two</b></p><p>Three</p>').endswith("\nThree")
    # Open ends cost no more than their length.
    began = time.perf_counter()
    for piece in ("<a ", "<a", '<a b="', "<a b='\" c=\"'", "<!", '<a b=" c="', "<a =", "<!-"):
        for tail in ("", '"', ' ">', " x='", "<p>y</p>"):
            parse(piece * 100_000 + tail)
    assert time.perf_counter() - began < 120


def test_cuts_leave_the_body_of_a_page():
    body = "<p>Some text, with commas, and so on.</p><p>More of it, as long as that.</p>"
    want = "Some text, with commas, and so on.\nMore of it, as long as that."
    menu = '<div class="menu"><a href="/">Home</a></div>'
    talk = '<div class="comments"><p>Well, no, and no again, for a long while, longer than the text itself, and longer, and longer.</p></div>'
    form = f'<body><form id="form1" action="x"><input name="v">{menu}<div class="content">{body}</div>{talk}</form></body>'
    assert main_text(form) == want
    assert main_text(f'<body><form class="main-form" role="form"><div>{body}</div></form><p>Bye.</p></body>') == want
    for names in ("review-body", "post feedback"):
        assert main_text(f'<body>{menu}<div class="{names}">{body}</div>{talk}</body>') == want
    # Nothing else is left.
    for names in ("discussion", "comments", "sidebar"):
        assert main_text(f'<body>{menu}<div class="{names}">{body}</div></body>') == want
    # What is no article stays cut.
    form = '<form><label>Mail</label>Your mail, please</form>'
    assert main_text(f"<body><div>{body}</div>{form}{talk}</body>") == want
    links = "".join(f'<p><a href="/{i}">Text {i}</a></p>' for i in range(9))
    assert main_text(f"<body>{links}{form}</body>").startswith("Text 0\nText 1")
    assert main_text('<div class="menu"><a href="/">Home</a></div>') == main_text("<nav>Home</nav>") == ""
    deep = "<form>" * 3000 + "<p>deep" + "</form>" * 3000
    assert main_text(deep) == "deep"


def brute_article(page):
    """For pages of the given tables: what stands in the article, by its blocks."""
    import html

    body = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = re.split(r"</?(?:h1|p)>", re.sub("<br>", " ", re.sub("</?b>", "", body)))
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_extract_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = extract_text(pages.withColumn("text", F.lit(1)).withColumn("lang", F.lit("x"))).collect()
    assert len(got) == pages.count()
    for r in got:
        assert r.text == brute_article(r.html) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", "")], PAGES)
    assert [r.text for r in extract_text(odd).collect()] == ["", "", ""]
    assert extract_text(odd.where("false")).count() == 0


# WARC.
def test_ranges_own_each_record_once():
    data = b"".join(warc.record(i, f"http://x/{i}\r\n", b"<p>\x1f\xc2\x8b\x08 hello" * (i * 40), None if i % 3 else 1, "d") for i in range(30))
    whole = list(warc.records_in(io.BytesIO(data), 0, len(data)))
    assert [r.headers["warc-record-id"] for r in whole] == [f"<urn:x-page:{i}>" for i in range(30)]
    for step in (1, 7, 64, 1000):
        parts = [r.start for s in range(0, len(data), step) for r in warc.records_in(io.BytesIO(data), s, min(len(data), s + step))]
        assert parts == [r.start for r in whole]
    # Bytes that look like a member but hold no WARC header are passed over.
    import gzip

    noise = warc.MAGIC * 5 + gzip.compress(b"no warc") + b"WARC/1.1\r\n"
    assert [r.start for r in warc.records_in(io.BytesIO(noise + data), 0, 10**9)] == [r.start + len(noise) for r in whole]
    with pytest.raises(EOFError):
        list(warc.records_in(io.BytesIO(data[:-20]), 0, len(data)))


def test_records_across_read_buffers(monkeypatch):
    data = b"".join(warc.record(i, None, b"abc" * i, None, "d") for i in range(20))
    for size in (1, 2, 3, 17):
        monkeypatch.setattr(warc, "READ", size)
        assert len(list(warc.records_in(io.BytesIO(b"\x1f\x8b" + data), 0, 10**6))) == 20


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 300_000
    rows = [(1, "http://a", "x" * 100), (2, "http://b", "x" * 100), (3, None, "x" * 99), (4, "u\n", "x" * 99), (5, "c", None), (6, "d", ""),
            (7, "e", big), (9, "g", big), (8, "f", big), (None, "n", "x" * 100), (10, "r", "twice" * 30), (10, "r", "twice" * 30)]
    df = spark.createDataFrame(rows, PAGES).withColumn("owner", F.lit(0)).withColumn("digest", F.lit("x"))
    folder = work_dir(spark, "warc-test")
    files = warc.write_archives(df.repartition(3), folder, file_bytes=400)
    assert files.agg(F.sum("records")).first()[0] == len(rows) and files.count() > 3
    for split in (64, 1 << 20):
        got = warc.read_archives(spark, files, split).collect()
        want = []
        for i, u, h in rows:
            data = (h or "").encode()
            same = [j for j, _, x in rows if j is not None and (x or "") == (h or "")]
            ref = min(same) if len(data) >= 100 and i is not None and i != min(same) else None
            want.append((i, u and u.replace("\n", "%0A"), "response" if ref is None else "revisit", ref, len(data),
                         hashlib.sha256(data).hexdigest(), data if ref is None else None))
        assert sorted(((*r[:6], r[6] and bytes(r[6])) for r in map(tuple, got)), key=str) == sorted(
            ((*w[:6], w[6] or (None if w[6] is None else w[6])) for w in want), key=str
        )
    assert warc.round_trip(df.where("false")).count() == 0


def test_long_headers_and_lost_records(spark):
    url = "http://x/" + "".join(random.Random(1).choices(string.ascii_letters + string.digits, k=300_000))
    data = b"".join(warc.record(i, url if i % 2 else "short", b"abc" * i, None, "d") for i in range(6))
    for step in (1 << 30, 50_000):
        got = [r for s in range(0, len(data), step) for r in warc.records_in(io.BytesIO(data), s, min(len(data), s + step))]
        assert [r.headers["warc-target-uri"] for r in got] == ["short", url] * 3
    with pytest.raises(EOFError):
        list(warc.records_in(io.BytesIO(data[:-100_000]), 0, len(data)))
    df = spark.createDataFrame([(1, url, "x" * 100), (2, "b", "x" * 100), (3, None, "y")], PAGES)
    files = warc.write_archives(df.coalesce(1), work_dir(spark, "warc-long"))
    got = {r["page_id"]: (r["url"], r["record_type"]) for r in warc.read_archives(spark, files, 100_000).collect()}
    assert got == {1: (url, "response"), 2: ("b", "revisit"), 3: (None, "response")}
    # A record that cannot be read is an error, not a missing row.
    path, starts = files.select("path", "starts").first()
    path = path.removeprefix("file:")
    with open(path, "r+b") as file:
        file.seek(starts[1])
        file.write(b"\0")
    with pytest.raises(Exception, match="were written there"):
        warc.read_archives(spark, files).collect()


# Vectors.
def brute_vectors(rows, t=0.95):
    def ok(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    vec = {i: np.array(v, np.float64) for i, v in rows if ok(v)}
    ids = {i for i, _ in rows}
    links = {i: set() for i in ids}
    for a in vec:
        for b in vec:
            if a != b and len(vec[a]) == len(vec[b]):
                if vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b]) >= t:
                    links[a].add(b)
    root = {i: i for i in ids}
    while True:
        new = {i: min([root[i], *(root[j] for j in links[i])]) for i in ids}
        if new == root:
            return sorted((i, len(links[i]), root[i], i == root[i]) for i, _ in rows)
        root = new


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = []

    def add(v):
        rows.append((len(rows), [float(x) for x in np.asarray(v, np.float32)]))

    for _ in range(60):
        v = rng.normal(size=16)
        add(v)
        for _ in range(rng.integers(0, 4)):
            add(v + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.2]))
    hot = rng.normal(size=16)
    for k in range(90):
        add(hot if k % 3 == 0 else hot + rng.normal(size=16) * 0.03)
    wide = rng.normal(size=16)
    for k in range(60):
        add(wide + rng.normal(size=16) * 0.17)  # a chain of links, wider than a cell
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [None, *[1.0] * 15]), (n + 4, []),
             (n + 5, [float("inf"), *[1.0] * 15]), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, [3.0, 1.0, 2.0]), rows[3], rows[3],
             (n + 9, [2 * x for x in rows[0][1]]), (n + 10, [1e30 * x for x in rows[0][1]])]
    return rows


@pytest.mark.parametrize("block", [pivot_index.BLOCK, 8])
def test_near_vectors(spark, vectors, block):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rep", F.lit("x"))
    got = sorted(map(tuple, pivot_index.near_vectors(df, pivots=32, block=block).collect()))
    want = brute_vectors(vectors)
    found, real = sum(r[1] for r in got), sum(r[1] for r in want)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and found >= 0.97 * real
    # With all pivots near every vector the lists hold all pairs, and nothing may be missed.
    every = pivot_index.near_vectors(df, pivots=6, nearest=6, block=block)
    assert sorted(map(tuple, every.collect())) == want


def test_near_vectors_recall_and_edges(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert sorted(map(tuple, pivot_index.near_vectors(df).collect())) == brute_vectors(rows)
    assert pivot_index.near_vectors(df.where("false")).count() == 0
    one = spark.createDataFrame([(5, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, pivot_index.near_vectors(one).collect())) == [(5, 0, 5, True)]
    bad = spark.createDataFrame([(5, None)], "vec_id long, embedding array<float>")
    assert list(map(tuple, pivot_index.near_vectors(bad).collect())) == [(5, 0, 5, True)]


PARAGRAPH = "<p>A sentence, with commas, and enough words to count as a paragraph of text.</p>"
KEPT = [
    '<h2 id="discussion">Discussion</h2>', '<h2 id="related-work">Related work</h2>', '<h3 id="search-algorithms">Search</h3>',
    '<h2 id="navigation">Navigation</h2>', f'<section id="legal-history"><h2>Legal history</h2>{PARAGRAPH}</section>',
    '<p class="follow-up">A follow up, of text.</p>', '<p id="notice">Notice this.</p>', '<ul><li id="menu-costs">Menu costs</li></ul>',
    '<div class="header"><h2>Head of a part</h2></div>',
]
GONE = [
    '<section id="comments"><p>First, nice, very nice, thanks, a lot.</p></section>', '<div class="comment-list"><p>reader</p></div>',
    '<div class="related-posts"><ul><li><a href=x>Other</a></li></ul></div>', '<div class="share-buttons"><a href=x>Share</a></div>',
    '<div class="ad-slot">Buy now</div>', '<p class="advert">Buy</p>', '<div id="cookie-notice">Cookies, cookies.</div>',
]


@pytest.mark.parametrize("part", KEPT + GONE)
def test_names_of_parts(part):
    page = f"<body><article><h1>T</h1>{PARAGRAPH * 2}{part}{PARAGRAPH}</article></body>"
    words = re.sub("<[^>]*>", "\n", part).split("\n")
    inside = [w for w in words if w]
    got = main_text(page).split("\n")
    plain = re.sub("<[^>]*>", "", PARAGRAPH)
    assert got == ["T", plain, plain, *(inside if part in KEPT else []), plain]


def test_frames_and_siblings():
    plain = re.sub("<[^>]*>", "", PARAGRAPH)
    assert main_text(f'<body><div class="widget-list">{PARAGRAPH * 9}</div><div><p>tiny, bit.</p></div></body>').split("\n")[:9] == [plain] * 9
    short = f"<p>{'word, ' * 11}</p>"
    assert main_text(f"<body><div>{short * 3}</div><div>{short * 2}</div><div>{short}</div></body>").count("\n") == 5
    teaser = f'<article class="teaser"><h2>other</h2>{PARAGRAPH}</article>'
    assert main_text(f"<body><article><h1>x</h1>{PARAGRAPH * 2}</article>{teaser}</body>") == f"x\n{plain}\n{plain}"
    assert "other" in main_text(f"<body>{teaser}</body>")
