"""Pages fetched over HTTP, as a Python data source.

``spark.dataSource.register(WebPages)``, then
``spark.read.format("web_pages").option("urls", json.dumps(urls)).load()``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, html string, status_code int, fetched_at timestamp"

#: Urls of one task.
TOGETHER = 32


class WebPages(DataSource):
    """One row for each url that answers with status 200, redirects followed, under the url that was asked for.

    Options: ``urls`` (a JSON list), ``timeout`` in seconds (15), ``agent``.
    Errors, other answers and bodies that are not text give no row; a url that
    is listed twice is fetched once.
    """

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(list(dict.fromkeys(json.loads(self.options.get("urls", "[]")))), float(self.options.get("timeout", "15")), self.options.get("agent", "loamdex"))


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], timeout: float, agent: str):
        self.urls, self.timeout, self.agent = urls, timeout, agent

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.urls[at : at + TOGETHER]) for at in range(0, len(self.urls), TOGETHER)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in partition.value:
            got = fetch(url, self.timeout, self.agent)
            if got is not None:
                yield url, got, 200, datetime.now(UTC)


def fetch(url: str, timeout: float, agent: str = "loamdex") -> str | None:
    """The text behind a url, or None if it does not answer with status 200."""
    from http.client import HTTPException
    from urllib.request import Request, urlopen

    if not url.lower().startswith(("http://", "https://")):
        return None
    try:
        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
            if answer.status != 200:
                return None
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except (OSError, ValueError, LookupError, HTTPException):
        return None


def fetch_pages(spark: SparkSession, urls: list[str], timeout: float = 15.0) -> DataFrame:
    """(page_id, url, html, status_code, fetched_at) of the urls that answer, as :func:`loamdex.operators.crawl.crawl` reads pages."""
    spark.dataSource.register(WebPages)
    pages = spark.read.format("web_pages").option("urls", json.dumps(urls)).option("timeout", str(timeout)).load()
    return pages.select(F.xxhash64("url").alias("page_id"), "*")
