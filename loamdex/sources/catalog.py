"""The catalog of crawl sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamdex.schemas import SOURCE


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a JSON array file with strict fields: malformed records fail the read.

    A repeated source_id keeps its last record in file order.
    """
    raw = spark.read.schema(SOURCE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return last_wins(raw.withColumn("_at", F.monotonically_increasing_id())).drop("_at")


def last_wins(rows: DataFrame, key: str = "source_id", order: str = "_at") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def get_source(catalog: DataFrame, source_id: str) -> DataFrame:
    """The one source of that id; an error if there is none."""
    found = catalog.where(F.col("source_id") == source_id)
    if found.isEmpty():
        raise KeyError(f"unknown source {source_id!r}")
    return found


def exists(catalog: DataFrame, source_id: str) -> bool:
    return not catalog.where(F.col("source_id") == source_id).isEmpty()


def field_of(catalog: DataFrame, source_id: str, name: str) -> DataFrame:
    """One field of one source (seed_urls, allowed_domains, max_depth, use_browser_fallback, scraper)."""
    return get_source(catalog, source_id).select("source_id", name)
