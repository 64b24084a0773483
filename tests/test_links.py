from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from loamdex.operators import crawl, scrape
from loamdex.schemas import SOURCE


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href") is not None:
            self.found.append(dict(attrs)["href"])


def test_links_as_the_standard_parser_finds_them(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/crawled_pages.parquet").select("page_id", "url", "html")
    got = {r["page_id"]: r["links"] for r in crawl.extract_links(pages).collect()}
    seen = 0
    for r in pages.collect():
        parser = Anchors()
        parser.feed(r["html"] or "")
        parser.close()
        want = [urlsplit(urljoin(r["url"], h))._replace(query="", fragment="").geturl() for h in parser.found]
        assert got[r["page_id"]] == want, r["page_id"]
        seen += len(want)
    assert seen > 100


def test_scraped_documents_by_hand(spark):
    page = (
        "<html><body><nav class='crumbs'><a>Home</a><a> Docs </a><a></a></nav><h1> The <b>title</b> </h1><main><p>First  part.</p>"
        "<div class='ad'>Buy</div><pre>x = 1</pre><pre>x = 1</pre><code>y</code></main></body></html>"
    )
    rule = (["article", "main"], ["h1"], [".crumbs a"], ["pre", "code"], [".ad", "p:has(a)"])
    sources = spark.createDataFrame([("s", "S", "b", ["x"], [], [], [], 1, False, [], rule), ("t", "T", "b", ["x"], [], [], [], 1, False, [], (["main"], ["h2"], [], [], []))], SOURCE)
    pages = spark.createDataFrame([("s", "u1", page), ("s", "u2", None), ("t", "u3", page), ("s", "u4", "<h1>only a title</h1>")], "source_id string, url string, html string")
    got = {r["url"]: r for r in scrape.scrape(pages, sources).collect()}
    assert set(got) == {"u1"}
    r = got["u1"]
    assert (r["title"], r["content"], r["breadcrumb"], r["code_blocks"]) == ("The title", "First  part. x = 1 x = 1 y", "Home > Docs", ["x = 1", "y"])
    both = {r["url"]: r["title"] for r in scrape.scrape(pages, sources, keep_rejected=True).collect()}
    assert both == {"u1": "The title", "u2": None, "u3": None, "u4": None}
