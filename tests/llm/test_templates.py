"""Main texts of pages against articles whose text is known."""

import html
import re

import pytest

from cadenza.llm import common, templates


def known_text(page):
    """The article of the test tables' pages: a heading and paragraphs, some of them not closed."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"<(?:/?p|/?h1)>", article)
    texts = [" ".join(html.unescape(re.sub(r"<(?:b|br)>", " ", b)).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def site(name, n):
    """Pages without landmarks: what is repeated is told by its repetition only."""
    head = "<div class='x1'><div>Home of things</div><ul><li><a href='/a'>One</a><li><a href='/b'>Two</a></ul></div>"
    for i in range(n):
        body = f"<div class=c><h2>Title {i} &amp; more</h2><p>First words of page {i}.<p>A second, longer block {i * 7}: it <i>is</i>\n   here<br>and here &lt;b&gt;.<ul><li>item {i}<li>Same item</ul></div>"
        text = f"Title {i} & more\n\nFirst words of page {i}.\n\nA second, longer block {i * 7}: it is here and here <b>.\n\nitem {i}"
        yield (f"https://{name}/p/{i}", f"<!doctype html><html><head><title>t</title></head><body>{head}{body}<div class='x2'>All rights <b>kept</b></div>", text)


def landmarks():
    """One page each of a host: only tags, roles, classes and the article tell."""
    yield "<article><h1>T</h1><p>Body</p><footer>by me</footer></article><section id='comments'><article class='comment'>Nice, a very long comment " + "x" * 400 + "</article></section>", "T\n\nBody"
    yield "<header>Site</header><main><article><header><h1>T</h1></header><p>a<script>var x='</p>'</script> b</article></main><aside>Side</aside>", "T\n\na b"
    yield "<div class='cookie-notice'>We use them</div><p>Only text &eacute;&#8212;&nbsp;end</p><form><label>Mail</label><input></form>", "Only text é— end"
    yield "<div class=adBanner>Buy</div><div role='main'><h1>x</h1>y<table><tr><td>1<td>2<tr><td>3</table></div><nav>menu<article>no</nav>", "x\n\ny\n\n1\n\n2\n\n3"
    yield "plain < text & 3 > 2 <3 </3> done<!-- no --", "plain < text & 3 > 2 <3 done"
    yield "<article><p title='a>b'>one<div style='display: none'>gone</div>two <span hidden>z</span><unfinished", "one\n\ntwo"
    yield "<nav><article><p>an unclosed menu around the article</p></article>", "an unclosed menu around the article"
    yield "<textarea>t</textarea><style>s</style><noscript>n</noscript>", ""
    yield None, ""
    yield "", ""


SCHEMA = "page_id long, url string, html string, host string, keys string"


@pytest.mark.parametrize("held", [templates.HELD_KEYS, -1])
def test_sites(spark, monkeypatch, held):
    monkeypatch.setattr(templates, "HELD_KEYS", held)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 20_000 if held > 0 else 0)
    rows = [(*r, "site") for r in site("h.example.org:8080", 7)] + [(*r, "few") for r in site("few.example.org", 4)]
    rows += [(f"https://one.example.org/{i}", h, t, "one") for i, (h, t) in enumerate(landmarks())] + [(None, "<p>no url", "no url", "one")]
    copies = "<div class=head>Top of copies</div><article><section class=s><p>The same article under many addresses.</p></section></article>"
    rows += [(f"https://copies.example.org/{i}", copies, "The same article under many addresses.", "copies") for i in range(9)]
    lines = [(f"https://lines.example.org/{i}", f"<article><p>Page {i}</p><p>A line of many pages</p><div class=more>Read on</div></article>", f"Page {i}\n\nA line of many pages", "lines") for i in range(9)]
    rows += lines
    table = spark.createDataFrame([(i, r[0], r[1], "a", "b") for i, r in enumerate(rows)], SCHEMA)
    found = {r.page_id: r for r in templates.main_texts(table.unionAll(table.where("page_id = 0"))).collect()}
    for i, (url, page, text, kind) in enumerate(rows):
        if kind == "few":  # four pages don't make a template
            assert found[i].text == "Home of things\n\nOne\n\nTwo\n\n" + text + "\n\nSame item\n\nAll rights kept"
        else:
            assert found[i].text == text, (url, page)
        assert found[i].n_chars == len(found[i].text)
    assert found[0].n_templates == 3 and all(found[i].n_templates == 1 for i, r in enumerate(rows) if r[3] == "lines")
    assert templates.main_texts(table.limit(0)).count() == 0


def test_tables_pages(spark, data):
    rows = spark.read.parquet(f"{data}/../sf0.01/pages.parquet")
    expected = {r.page_id: known_text(r.html) for r in rows.collect()}
    found = templates.main_texts(rows).collect()
    assert {r.page_id: r.text for r in found} == expected
    found = templates.main_texts(rows, many=2).collect()  # menus go round here: few pages of a host share one
    assert {r.page_id: r.text for r in found} == expected and sum(r.n_templates for r in found) >= 29


def test_long_and_broken_pages(spark):
    many = "<div>" * 200_000 + "deep" + "</div>" * 100_000
    tags = "<a <a <a " * 200_000
    spans = "<p>" + "<span>" * 100_000 + "x" + "</b>" * 100_000 + "</p>y"
    quotes = "<a '>" * 100_001 + "t"
    lone = "< " * 600_000
    items = "<ul>" + "<li><div>i" * 60_000 + "</ul>"
    long = "<article>" + "<p>some words of a long page</p>" * 50_000 + "</article>"
    table = spark.createDataFrame([(i, "http://a/", t) for i, t in enumerate((many, tags, spans, quotes, lone, items, long))], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in templates.main_texts(table).collect()}
    assert found[0] == "deep" and found[1] == "" and found[2] == "x\n\ny" and found[3][-1] == "t"
    assert found[4] == ("< " * 600_000).strip() and found[5].count("i") == 60_000 and found[6] == "\n\n".join(["some words of a long page"] * 50_000)
