"""Joins and writes between new rows, stored rows and ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.runtime import counted, join_bounded


def enrich(hits: DataFrame, chunks: DataFrame, hit_id: str = "doc_id", chunk_id: str = "chunk_id", n_hits: int | None = None) -> DataFrame:
    """Hits with the columns of their chunks; hits without a chunk drop out, ranks stay.

    Ranked hits are the small side: with a known number they are broadcast, so
    the chunk table is scanned once and not shuffled.
    """
    key = "_hit"
    small = hits.withColumnRenamed(hit_id, key)
    big = chunks.withColumnRenamed(chunk_id, key)
    joined = small.join(big, key) if n_hits is None else join_bounded(big, small, key, n_hits)
    return joined.withColumnRenamed(key, hit_id)


def existing(ids: DataFrame, stored: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The given ids that are stored."""
    return ids.select(key).distinct().join(stored.select(key), key, "left_semi")


def new_only(rows: DataFrame, stored: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose id is not stored."""
    return rows.join(stored.select(key), key, "left_anti")


def first_of(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def insert_ignore(rows: DataFrame, stored: DataFrame, key: str = "chunk_id", order: list | None = None) -> DataFrame:
    """What an insert adds that ignores stored ids: the first row of each new id (first write wins).

    An empty input adds nothing.  Without an ``order`` equal ids are told apart
    by all their columns, so that the choice does not depend on partitioning.
    """
    return first_of(new_only(rows, stored, key), key, order or [F.col(c) for c in rows.columns if c != key])


def upsert(rows: DataFrame, stored: DataFrame, key: str, version: str) -> DataFrame:
    """Stored and new rows with one row for each key: that of the highest version (last write wins)."""
    return first_of(stored.unionByName(rows), key, [F.desc(version)])


def by_ids(chunks: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Batch lookup: one row for each known id asked for."""
    asked, n = counted(ids.select(key).distinct(), "asked")
    return join_bounded(chunks, asked, key, n, "left_semi")


def without_segments(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows of the segments that stay."""
    return rows.join(segments.select("segment_id"), "segment_id", "left_anti")
