"""Overlapping word windows over documents (the chunker)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.functions.text import chunk_id, words
from loamdex.runtime import computed_once


def chunk_documents(df: DataFrame, size: int = 256, overlap: int = 32, source: str = "source_id", url: str = "url", text: str = "content") -> DataFrame:
    """``df`` with one row a window: adds chunk_id, chunk_index and the window's text as ``chunk_text``.

    Windows start at every ``size - overlap`` words below the word count, so the
    last may be short or lie inside the one before.  Null and blank texts give
    no rows.  A narrow plan: split, sequence, slice, all in the JVM.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    step = size - overlap
    w = computed_once(df, "_w", words(F.col(text))).where(F.size("_w") > 0)
    rows = w.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), (F.ceil(F.size("_w") / step) - 1).cast("int"))))
    out = F.array_join(F.slice("_w", F.col("chunk_index") * step + 1, size), " ")
    return rows.withColumn("chunk_text", out).withColumn("chunk_id", chunk_id(F.col(source), F.col(url), F.col("chunk_index"))).drop("_w")


def window_counts(df: DataFrame, size: int, overlap: int, n_words: str = "n_words") -> DataFrame:
    """Number of windows for given word counts: ceil(n / step)."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    return df.withColumn("expected_chunks", F.ceil(F.col(n_words) / (size - overlap)).cast("long"))
