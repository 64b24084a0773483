from __future__ import annotations

import pytest

from loamdex.functions.html import Page, attributes, block_texts, compile_selector, fold, select
from loamdex.operators.crawl import page_links
from loamdex.operators.scrape import scrape_page

DOC = """<html><head><title>T</title><style>.x{}</style></head><body class="a b"><nav class=related role="navigation"><a href="/x">Up</a> <a>Two</a></nav>
<main role="main"><h1> Head <b>line</b></h1><p>One&nbsp;two<br>three<p>Four <code>five()</code><div class="highlight"><pre>a = 1
b</pre></div></main><footer id=f>Bye</footer></body></html>"""


def texts(html):
    return [fold(t) for _, _, t in Page(html).blocks()]


def test_blocks_follow_the_tags():
    assert texts(DOC) == ["Up Two", "Head line", "One two three", "Four five()", "a = 1 b", "Bye"]
    assert [fold(t) for t in block_texts(DOC)] == texts(DOC)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []), ("   ", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<p>cut <a hre", ["cut"]),
        ("<p>x<!-- <p>no</p> -->y</p>", ["xy"]), ("<script>a<b</script>ok", ["ok"]), ("a</i>b</nope>c", ["ab", "c"]), ("&lt;p&gt;", ["<p>"]),
        ("<p title='a>b'>t</p>", ["t"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("1 < 2", ["1 < 2"]), ("<TITLE>no</TITLE>y", ["y"]),
    ],
)
def test_broken_markup(html, want):
    assert texts(html) == want
    assert [fold(t) for t in block_texts(html)] == want


def test_selectors():
    page = Page(DOC)
    tag = lambda s: [page.tags[e] for e in select(page, s)]
    assert tag("main h1") == ["h1"] and tag('[role="main"]') == ["main"] and tag('main[role="main"] pre') == ["pre"]
    assert tag(".related[role='navigation'] a") == ["a", "a"] and tag("div.highlight pre") == ["pre"] and tag("#f") == ["footer"] and tag("body.b") == ["body"]
    assert tag("nav h1") == [] and tag("[href]") == ["a"] and tag("*")[0] == "html"
    assert tag("main > h1") == ["h1"] and tag("body > h1") == [] and tag("body > main > h1 b") == ["b"]
    assert tag("h1, footer") == ["h1", "footer"] and tag('a[href^="/"]') == ["a"] and tag("[class~=highlight]") == ["div"] and tag("[role$='tion']") == ["nav"]
    assert tag('[class*="igh"]') == ["div"] and tag('nav[ role = "navigation" ]') == ["nav"]
    for bad in ("> b", "a >", "a:first-child", "", "a,,b"):
        with pytest.raises(ValueError):
            compile_selector(bad)


def test_attributes():
    assert attributes(' class="a b" id=x checked data-n=\'1\' id=y') == {"class": "a b", "id": "x", "checked": "", "data-n": "1"}


def test_links_are_resolved():
    html = '<a href="b?q#f">x</a><a>no</a><a href="/c">y</a><A HREF=../d>z</A><a href="http://[bad">w</a><a href="b">again</a>'
    base = "https://x.example/a/e/"
    assert page_links(html, base) == ["https://x.example/a/e/b", "https://x.example/c", "https://x.example/a/d", "https://x.example/a/e/b"]
    assert page_links(None, base) == [] and page_links("<a href=x>", None) == []


def test_scrape():
    got = scrape_page(DOC, ["article", "main"], ["h1"], [".related a", "h1"], ["pre", "code"], [])
    assert got == ("Head line", "Head line One\xa0two three Four five() a = 1\nb", "Up > Two", ["a = 1\nb", "five()"])
    # exclusion comes before everything else
    assert scrape_page(DOC, ["main"], ["h1"], [".related a", "h1"], [], [".related"])[2] == "Head line"
    # the first selector that matches decides, even if it is empty
    assert scrape_page("<h1></h1><title>t</title><h2>b</h2><p>c</p>", ["p"], ["h1", "h2"], [], [], []) is None
    assert scrape_page("<h2>b</h2>", ["p"], ["h2"], [], [], []) is None
    assert scrape_page("<title>T &amp; U</title><p>c</p>", ["p"], ["h1", "title"], [], [], [])[0] == "T & U"
    assert scrape_page(None, ["p"], ["h2"], [], [], []) is None
    assert scrape_page("<h2>b</h2><p>x</p><pre>y</pre><pre>y</pre>", ["p"], ["h2"], [], ["pre", "pre"], [])[3] == ["y"]
