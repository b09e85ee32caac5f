"""Archives and main text of pages."""

import base64
import hashlib

import pytest

from stratatext.llm import html, warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a\r\n/5", "x\r\n\r\n" * 50_000), (None, "http://a/6", "é漢"), (7, "http://a/7", "WARC/1.1\r\n\r\n"), (2, "http://a/2", "<p>same</p>")]
    return spark.createDataFrame([(*r, "more") for r in rows], "page_id long, url string, html string, body string")


def test_archives(pages):
    rows = [(r["page_id"], r["html"] or "") for r in pages.collect()]
    first = {}
    for k, h in rows:
        if k is not None:
            first[h] = min(k, first.get(h, k))
    want = []
    for k, h in rows:
        again = h in first and first[h] != k
        want.append((k, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if again else "response", first[h] if again else None, None if again else h))
    out = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["html"]) for r in warc.round_trip(pages).collect()]
    assert sorted(out, key=repr) == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_some_records(spark, pages):
    folder = warc.new_path(spark, "warc")
    warc.write_archives(pages, folder)
    index = warc.index_archives(spark, folder)
    some = warc.read_records(index.where("page_id in (5, 7)")).collect()
    assert {(r["page_id"], r["html"]) for r in some} == {(r["page_id"], r["html"]) for r in pages.where("page_id in (5, 7)").collect()}


def test_ranges_are_joined():
    got = list(warc.ranges([("a", 0, 10), ("a", 20, 10), ("a", 30 + warc.GAP + 1, 5), ("b", 0, 5)]))
    assert [(f, b, e, len(s)) for f, b, e, s in got] == [("a", 0, 30, 2), ("a", 30 + warc.GAP + 1, 35 + warc.GAP + 1, 1), ("b", 0, 5, 1)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a> Site</header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div class="cookie-notice">We use cookies, and more of them.</div>
<div id=main-content><h1>Title &amp; more</h1><p>First <b>bold</b> text,
 with&nbsp;space &lt;b&gt;. It goes on for a while, as texts do.<p>Second one.<br>After the break.<!-- no --><script>var x = "</p>";</script>
<aside>Read this too</aside><form><p>Your mail <input></form><blockquote>A quote, said.</blockquote>
<div class="comments"><p>I like this a lot, thank you for it.</p></div></div><div class="sidebar"><p>Side text, which is also long enough.</p></div><footer>&copy; All</footer>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<article>x"), (5, "u", "<" * 2000 + "<p" + "<div>" * 3000 + "deep"), (6, "u", "no markup at all")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    out = {r["page_id"]: r for r in html.extract(df).collect()}
    assert out[1]["text"] == "Title & more\nFirst bold text, with space <b>. It goes on for a while, as texts do.\nSecond one. After the break.\nA quote, said."
    assert out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == out[3]["text"] == "" and out[None]["text"] == "x"
    assert len(out) == 6 and html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("around", [("<body class='has-sidebar'>", ""), ("<main class='no-comments'>", "</main>"), ("<div id='page' class='with-header share-enabled'>", "</div>"), ("<form id=aspnet>", "</form>")])
@pytest.mark.parametrize("article", ["article", "div"])
def test_names_of_what_holds_the_page(around, article):
    """A name or form around the page doesn't take its content away; one in it still counts."""
    text = "".join(f"<p>Sentence number {i} of the article, which goes on for a while, as they do.</p>" for i in range(6))
    page = f"<nav><a href=/a>One</a></nav>{around[0]}<{article}><h1>Title</h1>{text}<div class=comments><p>I like this.</p></div></{article}><aside>Read this too</aside>{around[1]}<footer>All</footer>"
    got = html.main_text(page, {"tag p": 1.0, "tag h1": 1.0}).split("\n")
    assert [x for x in got if x.startswith("Sentence")] == [f"Sentence number {i} of the article, which goes on for a while, as they do." for i in range(6)]
    assert not {"One", "Read this too", "All", "I like this."} & {*got}


def test_one_keyword_is_outweighed():
    """Edges and looks can overturn a name, which is what the cut is for."""
    text = "".join(f"<p>Sentence number {i} of the article, which goes on for a while.</p>" for i in range(4))
    inner = "<p class=notice>One of the paragraphs, of the same kind, has a listed name.</p>"
    page = f"<article><h1>Title</h1>{text}{inner}{text}</article>"
    assert "listed name" in html.main_text(page, {})
    assert "listed name" not in html.main_text(page, {"tag p": -9.0})


def test_cut_is_minimal():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        costs = rng.normal(0, 1, n).tolist()
        links = [(i, j, float(rng.random() * 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        price = lambda s: sum(-c for c, x in zip(costs, s, strict=True) if x) + sum(w for i, j, w in links if s[i] != s[j])  # noqa: B023, E731
        best = min(price(s) for s in itertools.product([False, True], repeat=n))
        assert abs(price(html.minimum_cut(costs, links)) - best) < 1e-6
