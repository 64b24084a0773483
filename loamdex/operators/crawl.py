"""Links, and a breadth-first crawl over a table of pages."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loamdex.functions.html import Page
from loamdex.functions.text import normal_url, url_allowed
from loamdex.runtime import counted, join_bounded, materialize


def page_links(html: str | None, base: str | None) -> list[str]:
    """Targets of all a[href], resolved against the page, without query and fragment, in order and with repeats."""
    if not html or base is None:
        return []
    page = Page(html)
    out = []
    for element in range(1, len(page.tags)):
        if page.tags[element] == "a" and (href := page.attributes(element).get("href")) is not None:
            try:
                parts = urlsplit(urljoin(base, href))
            except ValueError:
                continue
            out.append(parts._replace(query="", fragment="").geturl())
    return out


@F.pandas_udf(ArrayType(StringType()))
def _links(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for html, url in batches:
        yield pd.Series([page_links(h, u) for h, u in zip(html, url)], dtype=object)


def extract_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with their links as an array column; null pages have none."""
    return pages.withColumn("links", _links(F.col(html), F.col(url)))


def fetched(pages: DataFrame) -> DataFrame:
    """The answer of the page table to requests: one page a normalised url, status 200 only, the latest fetch."""
    ok = pages.where("status_code = 200 and html is not null").withColumn("node", normal_url(F.col("url")))
    latest = ok.groupBy("node").agg(F.max(F.struct("fetched_at", "page_id")).alias("_l"))
    return ok.join(latest, "node").where((F.col("fetched_at") == F.col("_l.fetched_at")) & (F.col("page_id") == F.col("_l.page_id"))).drop("_l")


def reach(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): nodes within ``max_depth`` steps of a seed, each at its smallest depth.

    One join a level; a level is written to the shared folder, so the plan does
    not grow and a lost executor costs that level at most.  Stops when a level
    finds nothing new.
    """
    level = materialize(seeds.select(F.col("node")).where("node is not null").distinct(), "level")
    visited = level.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        ahead = level.join(edges, level["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        level = materialize(ahead.join(visited.select("node"), "node", "left_anti"), "level")
        if level.isEmpty():
            break
        visited = visited.unionByName(level.withColumn("depth", F.lit(depth)))
    return visited


def crawl(sources: DataFrame, pages: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(source_id, url, html, status_code, depth): pages a crawl of each source finds, at their smallest depth.

    Seeds, the sources' own or given as (source_id, seed), and links are
    normalised and admitted by the source's rules; a page at the source's
    max_depth is emitted but its links are not followed.  Only pages of the
    sources' domains are kept, and only those that a level reaches are parsed.
    The catalog of sources is small and counted before it is broadcast.
    """
    rule = sources.select("source_id", "allowed_domains", "allowed_path_prefixes", "blocked_path_patterns", "max_depth")
    rule, n_rules = counted(rule, "rules")
    given = sources.select("source_id", F.explode("seed_urls").alias("seed")) if seeds is None else seeds.select("source_id", "seed")
    site = join_bounded(given, rule, "source_id", n_rules)
    ok = url_allowed(F.col("node"), F.col("allowed_domains"), F.col("allowed_path_prefixes"), F.col("blocked_path_patterns"))
    start = site.withColumn("node", normal_url(F.col("seed"))).where(ok).select("source_id", "node").distinct()
    # no page of another domain can be admitted
    domains, n_domains = counted(rule.select(F.explode("allowed_domains").alias("_domain")).distinct(), "domains")
    near = join_bounded(pages.withColumn("_domain", F.try_parse_url(normal_url(F.col("url")), F.lit("AUTHORITY"))), domains, "_domain", n_domains, "left_semi")
    known = materialize(fetched(near.drop("_domain")).select("node", "url", "html", "status_code"), "fetched")
    level = materialize(start, "frontier")
    visited = level.withColumn("depth", F.lit(0))
    deepest = sources.agg(F.max("max_depth")).first()[0] or 0
    for depth in range(1, deepest + 1):
        open_ = join_bounded(level, rule, "source_id", n_rules).where(F.col("max_depth") >= depth)
        # only the frontier's pages are parsed, each once
        links = extract_links(known.select("node", "url", "html").join(open_.select("node").distinct(), "node", "left_semi"))
        links = links.select(F.col("node").alias("src"), F.explode("links").alias("dst")).distinct()
        ahead = open_.join(links, F.col("node") == F.col("src")).drop("node", "src").withColumnRenamed("dst", "node").where(ok)
        ahead = ahead.select("source_id", "node").distinct().join(visited.select("source_id", "node"), ["source_id", "node"], "left_anti")
        level = materialize(ahead, "frontier")
        if level.isEmpty():
            break
        visited = visited.unionByName(level.withColumn("depth", F.lit(depth)))
    return visited.join(known, "node").select("source_id", F.col("node").alias("url"), "html", "status_code", "depth")
