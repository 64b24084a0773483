"""Weighted reciprocal rank fusion and hybrid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.operators import dense, lexical
from loamdex.runtime import blank


def ranked_lists(lists: list[DataFrame]) -> DataFrame:
    """One table (query_id, list_id, doc_id, rank) of several rankings."""
    tagged = [r.select("query_id", F.lit(i).alias("list_id"), "doc_id", "rank") for i, r in enumerate(lists)]
    return reduce(DataFrame.unionByName, tagged)


def fuse(ranked: DataFrame, k: int = 60, weights: list[float] | None = None, n_lists: int | None = None, top: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) by the sum of weight / (k + rank) over all lists.

    Weights default to 1; with ``n_lists`` their number is checked.  A document
    that a list repeats counts each time.  Ties keep the order of first
    appearance: smaller list, then smaller rank, then doc_id.
    """
    if weights is not None and n_lists is not None and len(weights) != n_lists:
        raise ValueError("one weight is needed for each list")
    if weights is not None and not weights:
        raise ValueError("weights must not be empty")
    weight = F.lit(1.0) if weights is None else F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("list_id") + 1)
    share = weight / (F.lit(float(k)) + F.col("rank"))
    first = F.min(F.struct("list_id", "rank")).alias("_first")
    # the sum runs over shares sorted by list and rank, so that it does not depend on the order of rows
    parts = F.array_sort(F.collect_list(F.struct("list_id", "rank", share.alias("s"))))
    fused = ranked.groupBy("query_id", "doc_id").agg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["s"]).alias("score"), first)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_first", "doc_id")
    out = fused.withColumn("rank", F.row_number().over(order))
    return (out if top is None else out.where(F.col("rank") <= top)).select("query_id", "doc_id", "score", "rank")


def require_text(queries: DataFrame, column: str = "query") -> DataFrame:
    """``queries``, or an error for a blank query."""
    if queries.where(blank(F.col(column))).limit(1).count():
        raise ValueError("query must not be blank")
    return queries


def hybrid_search(
    index: lexical.Index,
    vectors: DataFrame | None,
    queries: DataFrame,
    k: int = 10,
    fetch_k: int = 50,
    rrf_k: int = 60,
    bm25_weight: float = 0.3,
    vector_weight: float = 0.7,
    stem: bool = True,
    digits: int | None = None,
    n_queries: int | None = None,
    near: DataFrame | None = None,
) -> DataFrame:
    """Fused top k of the lexical and the dense ranking; queries: (query_id, query, query_vector).

    A query without usable tokens is ranked by its vector alone.  ``near`` is
    the dense ranking if there is one already, as of an approximate search.
    """
    words = lexical.search(index, queries.select("query_id", "query"), fetch_k, stem=stem, digits=digits)
    near = near if near is not None else dense.exact_top_k(vectors, queries.select("query_id", "query_vector"), fetch_k, digits=digits, n_queries=n_queries)
    return fuse(ranked_lists([words, near]), rrf_k, [bm25_weight, vector_weight], 2, k)
