"""From pages to documents: title, content, breadcrumb and code blocks by selectors."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.functions.html import Page, select_known as select
from loamdex.runtime import join_bounded
from loamdex.schemas import SCRAPED

class Extractor:
    """Reads one page after the elements of the exclude selectors are taken out."""

    def __init__(self, html: str, exclude: list[str]):
        self.page = Page(html)
        gone = {e for s in exclude for e in select(self.page, s)}
        self.gone = [False] * len(self.page.tags)
        for e in range(1, len(self.page.tags)):
            self.gone[e] = e in gone or self.gone[self.page.parent[e]]
        # text pieces of each element, in order
        self.texts: list[tuple[int, str]] = [(e, t) for e, _, text in self.page.pieces if not self.gone[e] and (t := unescape(text).strip())]

    def find(self, selector: str) -> list[int]:
        return [e for e in select(self.page, selector) if not self.gone[e]]

    def text(self, element: int) -> str:
        """All text below an element: stripped pieces joined by one blank."""
        end = element + 1
        while end < len(self.page.tags) and element in self.page.path(end):
            end += 1
        return " ".join(t for e, t in self.texts if element <= e < end)

    def first_text(self, selectors: list[str]) -> str:
        """Text of the first element that the first matching selector finds, even if that text is empty."""
        for s in selectors:
            if found := self.find(s):
                return self.text(found[0])
        return ""

    def breadcrumb(self, selectors: list[str]) -> str:
        """Non-empty texts of the first matching selector, joined by ' > '."""
        for s in selectors:
            if found := self.find(s):
                return " > ".join(t for e in found if (t := self.text(e)))
        return ""

    def code_blocks(self, selectors: list[str]) -> list[str]:
        """Different non-empty texts over all selectors, in order of first sight."""
        return list(dict.fromkeys(t for s in selectors for e in self.find(s) if (t := self.text(e))))


def scrape_page(html: str | None, main: list[str], title: list[str], crumbs: list[str], code: list[str], exclude: list[str]) -> tuple | None:
    """(title, content, breadcrumb, code_blocks), or None without a title or content."""
    if not html:
        return None
    page = Extractor(html, exclude)
    head, body = page.first_text(title).strip(), page.first_text(main).strip()
    if not head or not body:
        return None
    return head, body, page.breadcrumb(crumbs), page.code_blocks(code)


@F.pandas_udf(SCRAPED)
def _scrape(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [scrape_page(html, *(list(x) if x is not None else [] for x in rest)) for html, *rest in zip(*batch)]
        yield pd.DataFrame([r or (None, None, None, None) for r in rows], columns=["title", "content", "breadcrumb", "code_blocks"])


def scrape(pages: DataFrame, sources: DataFrame, keep_rejected: bool = False) -> DataFrame:
    """(source_id, url, title, content, breadcrumb, code_blocks) of pages whose source is known.

    Pages without html, title or content are rejected; with ``keep_rejected``
    they stay with null columns, so that rejects can be counted.
    """
    rules = sources.select("source_id", "scraper").dropDuplicates(["source_id"])
    n = rules.count()
    s = F.col("scraper")
    columns = [F.col("html"), *(s[c] for c in ("main_content_selectors", "title_selectors", "breadcrumb_selectors", "code_block_selectors", "exclude_selectors"))]
    out = join_bounded(pages, rules, "source_id", n).withColumn("_doc", _scrape(*columns))
    out = out.select("source_id", "url", "_doc.*")
    return out if keep_rejected else out.where(F.col("title").isNotNull())
