"""Main text of pages: given pages against a plain reading of their article, and sites of invented templates."""

import html
import re
import time

import pytest

from strataseek.llm import html_text
from strataseek.llm.html_text import Page

PAGE = "page_id long, url string, html string"


def run(spark, rows, schema=PAGE):
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(rows, schema)).collect()}


def plain(page):
    """The text of a given page: between its article tags, cut at headings and paragraphs."""
    inside = page[page.index("<article>") + 9 : page.rindex("</article>")].replace("<br>", " ")
    parts = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", inside))
    return "\n".join(t for t in (re.sub(r"[\x20\x09-\x0D]+", " ", html.unescape(x)).strip(" ") for x in parts) if t)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_given_pages(spark, sf, size):
    pages = spark.read.parquet(f"{sf}/../{size}/pages.parquet")
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in html_text.extract(pages).collect())


def test_site_without_names(spark):
    """Menus, notices and footers that no tag or class names are found by the site's tree; a site's prose stays, copies too."""
    rows = []
    for i in range(60):
        copy = "A copied paragraph that a third of the site's pages share, word by word." if i % 3 == 0 else f"Prose number {i} that stands on one page only."
        rows.append((i, f"https://a.example.com/{i}", f"<div><div>Home</div><div>Products</div></div><div class=x><h2>Title {i % 50}</h2><p>{copy}<p>More of page {i}, with <a href=1>a link</a> in it.</div><div class=y>All rights belong to us.</div>"))
    rows.append((99, "https://b.example.com/", "<div>One page of another site</div><div>All rights belong to us.</div>"))
    got = run(spark, rows)
    assert got[4][0] == "Title 4\nProse number 4 that stands on one page only.\nMore of page 4, with a link in it."
    assert got[3][0] == "Title 3\nA copied paragraph that a third of the site's pages share, word by word.\nMore of page 3, with a link in it."
    assert got[99][0] == "One page of another site\nAll rights belong to us."


def test_line_that_every_article_of_a_site_repeats(spark):
    rows = [(i, "https://a.example.com/", f"<article><h1>Head {i}</h1><p>Text {i}</p><div class=z>Read our other stories.</div></article>") for i in range(40)]
    rows += [(100 + i, "https://b.example.com/", "<article><p>One text on all pages of a site.</p></article>") for i in range(40)]
    got = run(spark, rows)
    assert got[7][0] == "Head 7\nText 7"
    assert got[120][0] == "One text on all pages of a site."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<nav>Menu</nav><p>Text", "Text"),
        ("<header><h1>Site</h1></header><main><h1>Head</h1><p>Text</main><footer>End</footer>", "Head\nText"),
        ("<main><p>Text<aside>Beside</aside><section id=comments><p>I agree</section></main>", "Text"),
        ("<article><header><h1>Head</h1><p>By someone</header><p>Text<article><p>A comment</article></article>", "Head\nText"),
        ('<body class="has-sidebar"><div id="cookieNotice">We use cookies</div><div class="post-content"><p>Text</div><div class="sidebar-left"><p>Other</div>', "Text"),
        ("<form id=all><article>Text<form>Search <input></form> goes on</article></form>", "Text\ngoes on"),
        ("<p>One <span class=ad>Buy!</span> two <b><span class=ads>Buy!</b> three", "One\ntwo\nthree"),
        ("<ul><li>One<li>Two<p>Three</ul><table><tr><td>a<td>b<tr><td>c</table>", "One\nTwo\nThree\na\nb\nc"),
        ("<p>x &lt;b&gt; &amp &eacute;&#x41;&#66; &nosuch; &am<!-- -->p;\xa0 y\r\n\tz", "x <b> & éAB &nosuch; &amp;\xa0 y z"),
        ("a<script>if (x < 1) '</p>'</script>b<style>p{}</style>c<!-- <p>no --> d", "abc d"),
        ('<p title="a > b" hidden>Gone</p><p title=\'x>"y\'>Kept</p><p style="display: none">Gone', "Kept"),
        ('<div class="a>Text goes on', "Text goes on"),
        ("<p>1 < 2 and <3 </> <!doctype x>5", "1 < 2 and <3 </> 5"),
        ("<p>Text<script>never ended <p>more", "Text"),
        ("<div role=main>Text<div role=alert>Notice</div></div><div>Rest</div>", "Text"),
        ("<a href=1>Only</a> <a href=2>links</a><p>Text with <a href=3>a link</a>", "Text with a link"),
        ("  \n\t ", ""),
        ("plain words\n only", "plain words only"),
        ("<article></article><p>Text outside", "Text outside"),
        ("<b>bold<p>one</b> more<p>two", "bold\none more\ntwo"),
    ],
)
def test_page(page, text):
    assert Page(page).kept() == text


def test_awkward(spark):
    """Nulls in any column, repeated rows, columns of clashing names, very long and deep pages."""
    deep = "<div>" * 60_000 + "deep" + "</div>" * 60_000
    long = "<p>" + "word &amp; more " * 50_000
    rows = [(1, None, "<p>A"), (1, None, "<p>A"), (None, "http://x.example/", "<p>B"), (2, "no scheme", None), (None, None, None), (3, "http://x.example/", ""), (4, "http://x.example/", deep), (5, "http://x.example/", long)]
    extra = ["text", "n_chars", "host", "node", "_html_noisy", "parent"]
    frame = spark.createDataFrame([(*r, *("x" for _ in extra)) for r in rows], PAGE + "".join(f", {c} string" for c in extra))
    out = html_text.extract(frame)
    assert sorted(out.columns) == sorted(["page_id", "url", "html", *extra])
    got = [(r["page_id"], r["text"], r["n_chars"], r["_html_noisy"]) for r in out.collect()]
    assert sorted(got, key=repr)[:0] == [] and len(got) == len(rows)
    by_id = {r[0]: r for r in got}
    assert [r for r in got if r[0] == 1] == [(1, "A", 1, "x")] * 2
    assert by_id[2][1:3] == ("", 0) and by_id[3][1:3] == ("", 0) and by_id[4][1:3] == ("deep", 4)
    assert by_id[5][2] == len(("word & more " * 50_000).strip())
    assert html_text.extract(frame.limit(0)).count() == 0


def test_time_of_hostile_pages():
    """Unended quotes, tags and elements cost no more than their length."""
    for page in ('<a "' * 100_000, "<" * 300_000, "<p><button>" + "<div>" * 100_000, "<li><div>" * 60_000, "<b>" * 100_000 + "</i>" * 100_000, "<!--" * 100_000, "&" * 300_000):
        began = time.perf_counter()
        Page(page).kept()
        assert time.perf_counter() - began < 5


def test_salted_join(spark, monkeypatch):
    """Beyond the bound of what is sent, noise is joined by host and salt, with the same result."""
    rows = [(i, f"https://{'ab'[i % 2]}.example/{i}", f"<div>Menu</div><div><p>Text {i}</div>") for i in range(40)]
    want = run(spark, rows)
    monkeypatch.setattr(html_text, "SENT", 0)
    assert run(spark, rows) == want and want[3][0] == "Text 3"
