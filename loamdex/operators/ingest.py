"""From pages or files to stored chunks and both indexes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.config import Settings
from loamdex.operators import chunking, crawl, dense, fusion, lexical, relational, rerank, scrape
from loamdex.runtime import blank, materialize
from loamdex.sources.catalog import get_source
from loamdex.sources.files import file_texts
from loamdex.sources.store import Store


@dataclass(frozen=True)
class Report:
    """Counts of one ingest."""

    source_id: str
    pages: int
    documents: int
    chunks: int
    new_chunks: int
    lexical: int
    vectors: int


def _index(store: Store, fresh: DataFrame, load_encoder, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Index new chunks in both indexes with one commit each; chunks without tokens stay out of the lexical one.  The doc_id of each that was added."""
    texts = fresh.where(~blank(F.col("text"))).select(F.col("chunk_id").alias("doc_id"), "text")
    toks = materialize(lexical.tokenized(texts, "doc_id", "text", stem=False), "tokens")
    if toks.count():
        store.write_segment(lexical.term_counts(toks, stem=True), lexical.doc_lengths(toks))
        store.merge_segments(settings.max_segments)
    new_vectors = texts.join(store.vectors().select("doc_id"), "doc_id", "left_anti")
    encoded = materialize(dense.encode(new_vectors, "text", load_encoder, settings.dimension, batch=settings.vector_batch).select("doc_id", "embedding"), "encoded")
    if encoded.count():
        store.save_vectors(encoded)
        store.save_metadata(model=settings.model, dimension=settings.dimension, vector_count=store.vectors().count())
    return toks.select("doc_id"), encoded.select("doc_id")


def _save_new(store: Store, chunks: DataFrame) -> tuple[DataFrame, int]:
    """The chunks whose id was not stored, once each, after they are stored."""
    fresh = materialize(relational.insert_ignore(chunks, store.chunks()), "new-chunks")
    n = fresh.count()
    if n:
        store.save_chunks(fresh)
    return fresh, n


def _by_source(rows: DataFrame) -> dict[str, int]:
    """Rows of each source; there are as many as sources in the catalog."""
    return {r["source_id"]: r["count"] for r in rows.groupBy("source_id").count().collect()}


def ingest_sources(
    store: Store, sources: DataFrame, pages: DataFrame, load_encoder: Callable, settings: Settings | None = None, seeds: DataFrame | None = None
) -> list[Report]:
    """Crawl, scrape, chunk, store and index all given sources in one batch: a report for each, in order of source_id.

    Crawls start at ``seeds`` (source_id, seed) if given, else at the sources'
    own.  Chunks already stored are left alone, so a second run adds nothing.
    """
    settings = (settings or Settings()).check()
    found = materialize(crawl.crawl(sources, pages, seeds), "crawled")
    docs = materialize(scrape.scrape(found, sources), "scraped")
    windows = chunking.chunk_documents(docs, settings.chunk_words, settings.overlap_words)
    chunks = materialize(windows.select("chunk_id", "source_id", "url", "title", "breadcrumb", "chunk_index", F.col("chunk_text").alias("text")), "chunks")
    fresh, n = _save_new(store, chunks)
    counts = [_by_source(rows) for rows in (found, docs, chunks, fresh)]
    owner = fresh.select("source_id", F.col("chunk_id").alias("doc_id"))
    counts += [_by_source(owner.join(added, "doc_id")) for added in _index(store, fresh, load_encoder, settings)] if n else [{}, {}]
    names = sorted(r["source_id"] for r in sources.select("source_id").distinct().collect())
    return [Report(name, *(c.get(name, 0) for c in counts)) for name in names]


def ingest_source(
    store: Store,
    sources: DataFrame,
    pages: DataFrame,
    source_id: str,
    load_encoder: Callable,
    settings: Settings | None = None,
    seeds: DataFrame | None = None,
) -> Report:
    """:func:`ingest_sources` for one source of the catalog."""
    return ingest_sources(store, get_source(sources, source_id), pages, load_encoder, settings, seeds)[0]


def upload(store: Store, files: DataFrame, source_id: str, load_encoder: Callable, settings: Settings | None = None) -> Report:
    """Store and index uploaded files, given as (path, content); blank files are an error."""
    settings = (settings or Settings()).check()
    docs = materialize(file_texts(files), "uploads")
    empty = docs.where(blank(F.col("text"))).limit(1).collect()
    if empty:
        raise ValueError(f"no text in {empty[0]['path']}")
    rows = docs.select(F.lit(source_id).alias("source_id"), "url", "title", F.lit("").alias("breadcrumb"), F.col("text").alias("content"))
    windows = chunking.chunk_documents(rows, settings.chunk_words, settings.overlap_words)
    chunks = materialize(windows.select("chunk_id", "source_id", "url", "title", "breadcrumb", "chunk_index", F.col("chunk_text").alias("text")), "chunks")
    fresh, n = _save_new(store, chunks)
    indexed, vectors = (added.count() for added in _index(store, fresh, load_encoder, settings)) if n else (0, 0)
    return Report(source_id, docs.count(), docs.count(), chunks.count(), n, indexed, vectors)


def search_store(store: Store, queries: DataFrame, load_encoder: Callable, k: int = 10, settings: Settings | None = None) -> DataFrame:
    """Hybrid hits of (query_id, query) over a store, with their chunks; blank queries are an error."""
    settings = (settings or Settings()).check()
    asked = dense.encode(fusion.require_text(queries), "query", load_encoder, settings.dimension, "query_vector")
    near = store.search_vectors(asked.select("query_id", "query_vector"), settings.fetch_k)
    hits = fusion.hybrid_search(
        store.load_index(), None, asked, k, settings.fetch_k, settings.rrf_k, settings.bm25_weight, settings.vector_weight, near=near
    )
    return relational.enrich(hits, store.chunks())


def ask(store: Store, queries: DataFrame, load_encoder: Callable, chat: Callable, settings: Settings | None = None, scorer: Callable | None = None) -> DataFrame:
    """Answers with their sources: hybrid candidates, re-ranked if set so, a prompt of the best, one chat call a query.

    ``scorer`` makes a column of a query and a text column, such as :func:`rerank.model_score`; without one the shared words count.
    """
    settings = (settings or Settings()).check()
    width = settings.rerank_candidates if settings.use_reranker else settings.context_chunks
    hits = search_store(store, queries, load_encoder, width, settings).join(queries, "query_id")
    best = rerank.rerank(hits, settings.context_chunks, scorer or rerank.overlap_score) if settings.use_reranker else hits.where(F.col("rank") <= settings.context_chunks)
    best = materialize(best.select("query_id", "query", "rank", "doc_id", "title", "url", "text", "score"), "passages")
    answers = rerank.answer(rerank.prompts(best), chat)
    sources = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "title", "url", "score"))).alias("sources"))
    return answers.join(sources, "query_id")
