"""The inverted index and BM25 as DataFrames.

An index is three flat tables: postings (term, doc_id, tf), lengths (doc_id,
doc_length) and one row of statistics.  Document frequency is the number of a
term's postings.  Queries are batches: (query_id, query).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions.text import analyse, stemmed, tokens
from loamdex.runtime import computed_once, counted, join_bounded, materialize


@dataclass
class Index:
    """Postings, document lengths and statistics of a set of documents."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame

    def cache(self) -> "Index":
        for table in (self.postings, self.lengths):
            table.cache()
        return self


def tokenized(df: DataFrame, doc: str, text: str, stem: bool = True) -> DataFrame:
    """(doc_id, tokens) of documents that have tokens; the others are in no lexical index."""
    # rows are dropped before the stemmer, which never empties a list; a filter on its result would run it twice
    named = df.select(F.col(doc).alias("doc_id"), F.col(text).alias("_text"))
    raw = computed_once(named, "tokens", tokens(F.col("_text"))).select("doc_id", "tokens").where(F.size("tokens") > 0)
    return raw.withColumn("tokens", stemmed(F.col("tokens"))) if stem else raw


def term_counts(tokens_df: DataFrame, stem: bool = False) -> DataFrame:
    """(doc_id, term, tf), of stems if ``stem`` is set and the tokens are not stemmed yet.

    Rows of a document lie together, so the count combines on the map side and
    the shuffle carries one row for each document and term.  The stemmer sees
    each different term once; terms that share a stem are added up again.
    """
    counts = tokens_df.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    if not stem:
        return counts
    kept = materialize(counts, "raw-counts")
    # a stated number of partitions, since few bytes of terms are much work and would be put into one
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stems, n = counted(kept.select("term").distinct().repartition(parts).withColumn("stem", F.element_at(stemmed(F.array("term")), 1)), "stems")
    return join_bounded(kept, stems, "term", n).groupBy("doc_id", F.col("stem").alias("term")).agg(F.sum("tf").cast("int").alias("tf"))


def doc_lengths(tokens_df: DataFrame) -> DataFrame:
    """(doc_id, doc_length): tokens left after stop words."""
    return tokens_df.select("doc_id", F.size("tokens").alias("doc_length"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: total_documents, total_terms, average_document_length (0 for no documents)."""
    n, total = F.count(F.lit(1)), F.coalesce(F.sum(F.col("doc_length").cast("long")), F.lit(0))
    return lengths.agg(n.alias("total_documents"), total.alias("total_terms"), F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("average_document_length"))


def doc_freq(postings: DataFrame) -> DataFrame:
    """(term, doc_freq)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))


def duplicate_documents(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Ids that occur more than once: (doc_id, n)."""
    return df.groupBy(F.col(doc).alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``df``, or an error that names a document that is in it twice."""
    twice = duplicate_documents(df, doc).limit(1).collect()
    if twice:
        raise ValueError(f"document {twice[0]['doc_id']!r} is already in the index")
    return df


def build_index(df: DataFrame, doc: str = "doc_id", text: str = "text", stem: bool = True) -> Index:
    """The index of a table of documents; texts without tokens are left out."""
    toks = tokenized(df, doc, text, stem=False)
    lengths = doc_lengths(toks)
    return Index(term_counts(toks, stem), lengths, corpus_stats(lengths))


def idf(df: Column, n: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5) + 1), always positive."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25(tf: Column, length: Column, avgdl: Column, df: Column, n: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """Score of one term in one document; 0 if tf, df or N is not positive; avgdl counts as 1 if not positive."""
    mean = F.when(avgdl > 0, avgdl).otherwise(1.0)
    score = idf(df, n) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / mean))
    return F.when((tf > 0) & (df > 0) & (n > 0), score).otherwise(0.0)


#: Query terms up to which they are pushed down to the scan of the postings.
FEW_TERMS = 100


def query_terms(queries: DataFrame, stem: bool = True) -> DataFrame:
    """(query_id, term, qtf) of a batch of (query_id, query)."""
    found = analyse(F.col("query")) if stem else tokens(F.col("query"))
    return queries.select("query_id", F.explode(found).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def score_terms(index: Index, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of every document with a query term.

    The batch's terms are counted; few are broadcast, and the semi-join prunes
    the postings below their own aggregation.  The pruned postings are kept,
    as document frequencies and scores both read them.  The statistics are one
    row.
    """
    terms, n = counted(terms, "query-terms")
    few = [r[0] for r in terms.select("term").distinct().collect()] if n <= FEW_TERMS else None
    # a list of literals reaches the scan, where postings that lie sorted by term are skipped by row group
    pruned = index.postings.where(F.col("term").isin(few)) if few is not None else join_bounded(index.postings, terms.select("term").distinct(), "term", n, "left_semi")
    hit = materialize(pruned.select("term", "doc_id", "tf"), "pruned-postings")
    weighted = terms.join(doc_freq(hit), "term")
    rows = join_bounded(hit, weighted, "term", n).join(index.lengths.select("doc_id", "doc_length"), "doc_id").crossJoin(F.broadcast(index.stats))
    score = bm25(F.col("tf"), F.col("doc_length"), F.col("average_document_length"), F.col("doc_freq"), F.col("total_documents"), k1, b)
    return rows.groupBy("query_id", "doc_id").agg(F.sum(score * F.col("qtf")).alias("score"))


def top_k(scored: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The k best rows of each query with their rank; ties go to the smaller doc_id.

    Catalyst puts a partial group limit before the shuffle.  With ``digits``
    the rounded score ranks, so that sums of another order rank alike.
    """
    s = scored.withColumn("score", F.round("score", digits)) if digits is not None else scored
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def search(index: Index, queries: DataFrame, k: int = 20, k1: float = 1.5, b: float = 0.75, stem: bool = True, digits: int | None = None) -> DataFrame:
    """The k best documents of each query: (query_id, doc_id, score, rank).

    A query term counts as often as the query repeats it.  Unknown terms and
    postings of documents without a length add nothing; a query without tokens
    has no rows.
    """
    return top_k(score_terms(index, query_terms(queries, stem), k1, b), k, digits)


def running_stats(lengths: DataFrame, buckets: int | None = None) -> DataFrame:
    """Statistics after each document in doc_id order: running count, sum and mean.

    Two levels, so that no single task holds all documents: ranges of doc_id
    are summed first, the sums of what lies before each range are added to the
    running sums within it.
    """
    buckets = buckets or int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(lengths.repartitionByRange(buckets, "doc_id").withColumn("_p", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_p").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("n", F.count(F.lit(1)).over(inside)).withColumn("total", F.sum(F.col("doc_length").cast("long")).over(inside))
    ends = local.groupBy("_p").agg(F.max("n").alias("pn"), F.max("total").alias("pt"))  # one row a range
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("_p", F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("pt").over(before), F.lit(0)).alias("t0"))
    joined = join_bounded(local, offsets, "_p", buckets)
    return joined.select("doc_id", (F.col("n") + F.col("n0")).alias("total_documents"), (F.col("total") + F.col("t0")).alias("total_terms"))
