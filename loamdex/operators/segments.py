"""Segments of the lexical index: building, merging and their invariants."""

from __future__ import annotations

from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segment_name(at: datetime | None = None) -> str:
    """A sortable name: UTC time to the microsecond and eight random hex digits."""
    return f"{(at or datetime.now(UTC)):%Y%m%dT%H%M%S%f}-{uuid4().hex[:8]}"


def assign_segments(docs: DataFrame, buffer: int, order: str = "doc_id", prefix: str = "seg") -> DataFrame:
    """``docs`` with the segment each falls into when a buffer of ``buffer`` documents is flushed whenever full."""
    from loamdex.operators.dense import positions

    ranked = positions(docs.select(F.col(order).alias("doc_id")))
    names = ranked.select(F.col("doc_id").alias(order), F.format_string(f"{prefix}-%09d", F.floor(F.col("position") / buffer).cast("long")).alias("segment_id"))
    return docs.join(names, order)


def segment_stats(lengths: DataFrame) -> DataFrame:
    """(segment_id, total_documents, total_terms, avg_doc_length)."""
    total = F.sum(F.col("doc_length").cast("long"))
    return lengths.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("total_documents"), total.alias("total_terms"), (total / F.count(F.lit(1))).alias("avg_doc_length")
    )


def segment_terms(postings: DataFrame) -> DataFrame:
    """(segment_id, term, doc_freq)."""
    return postings.groupBy("segment_id", "term").agg(F.count(F.lit(1)).alias("doc_freq"))


def oldest(names: list[str], most: int) -> list[str]:
    """Of segments, oldest first, the oldest max(2, count - most + 1) if there are more than ``most``; else none."""
    if most < 2:
        raise ValueError("at least two segments must be allowed")
    return names[: max(2, len(names) - most + 1)] if len(names) > most else []


def merge_candidates(segments: DataFrame, most: int) -> DataFrame:
    """(segment_id): the oldest max(2, count - most + 1) segments by name if there are more than ``most``; else none.

    Names are ranked by range, so no task sorts all of them.
    """
    if most < 2:
        raise ValueError("at least two segments must be allowed")
    from loamdex.operators.dense import positions

    ranked = positions(segments.select(F.col("segment_id").alias("doc_id")).distinct())
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))  # one row
    kept = ranked.crossJoin(F.broadcast(n)).where((F.col("_n") > most) & (F.col("position") < F.greatest(F.lit(2), F.col("_n") - most + 1)))
    return kept.select(F.col("doc_id").alias("segment_id"))


def merge(postings: DataFrame, lengths: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of one segment made of several; a document in two of them is an error."""
    twice = lengths.groupBy("doc_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"document {twice[0]['doc_id']!r} is in more than one segment")
    return postings.withColumn("segment_id", F.lit(target)), lengths.withColumn("segment_id", F.lit(target))


def top_terms(postings: DataFrame, n: int) -> DataFrame:
    """(term, doc_freq, doc_id, tf): the postings of the n terms with most of them; flat rows, since a common term has as many as there are documents."""
    freq = postings.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq")).orderBy(F.desc("doc_freq"), "term").limit(n)
    return postings.join(F.broadcast(freq), "term").select("term", "doc_freq", "doc_id", "tf")
