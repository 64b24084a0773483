"""Named queries of the core: each takes (spark, directory) and returns a DataFrame.

They run over whole tables.  Search batches take the held-out items as text
queries and every vector whose id is divisible by 100 as vector queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.config import Settings
from loamdex.functions import text as tx
from loamdex.operators import chunking, crawl, dense, fusion, ingest, lexical, relational, rerank, scrape, segments
from loamdex.runtime import counted, join_bounded, materialize, read, shared_dir
from loamdex.sources.store import Store
from loamdex.streaming import index_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Digits to which scores are compared.
DIGITS = 6


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as stored: the first record of each chunk_id."""
    return relational.first_of(read(spark, d, "chunks"), "chunk_id", [F.col("id")])


def _items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "test_items").where(F.col("text").isNotNull()).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Usable stored vectors of chunks, the first of each doc_id: (doc_id, embedding, id)."""
    v = read(spark, d, "vector_documents")
    e = F.col("embedding")
    good = v.where(F.size(e) == 384).where(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(e, lambda x: x != 0))
    return relational.first_of(good.select("doc_id", "embedding", "id"), "doc_id", [F.col("id")])


def _vector_queries(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    return counted(_vectors(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")), "vector-queries")


# text --------------------------------------------------------------------
@query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """White space collapsed and trimmed."""
    return _docs(spark, d).select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words of every scraped text."""
    return read(spark, d, "scraped_documents").select("scraped_id", F.size(tx.words(F.col("content"))).cast("long").alias("n_words"))


@query
def tokens_raw(spark: SparkSession, d: str) -> DataFrame:
    """Tokens without stop words, before stemming."""
    return _docs(spark, d).select("doc_id", F.array_join(tx.tokens(F.col("text")), " ").alias("tokens"))


@query
def stem_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Every different token with its stem."""
    words = _docs(spark, d).select(F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    return words.select("term", F.element_at(tx.stemmed(F.array("term")), 1).alias("stem"))


@query
def url_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hash and chunk id from source, url and position, beside the stored id."""
    c = read(spark, d, "chunks")
    made = tx.chunk_id(F.col("source_id"), F.col("url"), F.col("chunk_index"))
    return c.select("id", tx.url_hash(F.col("url")).alias("url_hash"), made.alias("made_id"), (made == F.col("chunk_id")).alias("as_stored"))


@query
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Urls without query and fragment."""
    return read(spark, d, "crawled_pages").select("page_id", tx.normal_url(F.col("url")).alias("url"))


@query
def url_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Whether each page's source admits its url."""
    s, n = counted(read(spark, d, "source_configs").select("source_id", "allowed_domains", "allowed_path_prefixes", "blocked_path_patterns"), "rules")
    ok = tx.url_allowed(tx.normal_url(F.col("url")), F.col("allowed_domains"), F.col("allowed_path_prefixes"), F.col("blocked_path_patterns"))
    return join_bounded(read(spark, d, "crawled_pages"), s, "source_id", n).select("page_id", ok.alias("allowed"))


@query
def upload_names(spark: SparkSession, d: str) -> DataFrame:
    """Title and url of an upload whose file is named like the page."""
    path = F.concat(F.lit("/in/"), F.regexp_extract("url", "([^/]*)/?$", 1), F.lit(".md"))
    return read(spark, d, "crawled_pages").select("page_id", tx.upload_title(path).alias("title"), tx.upload_url(path).alias("upload_url"))


# chunks ------------------------------------------------------------------
@query
def chunks_256_32(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 256 words, 32 shared, of every scraped text."""
    got = chunking.chunk_documents(read(spark, d, "scraped_documents").select("scraped_id", "source_id", "url", "content"))
    return got.select("scraped_id", "chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text")


@query
def chunk_counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Number and mean length of windows for each source."""
    got = chunking.chunk_documents(read(spark, d, "scraped_documents").select("source_id", "url", "content"))
    return got.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(F.length("chunk_text")), 4).alias("mean_chars"))


@query
def window_edges(spark: SparkSession, d: str) -> DataFrame:
    """Window count by the closed form, for the word count of every document chunk."""
    n = read(spark, d, "document_chunks").select("piece_id", F.size(tx.words(F.col("text"))).cast("long").alias("n_words"))
    return chunking.window_counts(n, 50, 10)


# index -------------------------------------------------------------------
def _tokenized(spark: SparkSession, d: str) -> DataFrame:
    return lexical.tokenized(_docs(spark, d), "doc_id", "text", stem=False)


@query
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    """Postings."""
    return lexical.term_counts(_tokenized(spark, d)).select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


@query
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length of each document that has tokens."""
    return lexical.doc_lengths(_tokenized(spark, d)).select("doc_id", F.col("doc_length").cast("long").alias("doc_length"))


@query
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """I4: documents, terms and mean length."""
    got = lexical.corpus_stats(lexical.doc_lengths(_tokenized(spark, d)))
    return got.withColumn("average_document_length", F.round("average_document_length", DIGITS))


@query
def running_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """I4: statistics after each document."""
    return lexical.running_stats(lexical.doc_lengths(_tokenized(spark, d)))


@query
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency of every term."""
    return lexical.doc_freq(lexical.term_counts(_tokenized(spark, d)))


@query
def inverted_index_top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The postings of the 50 most frequent terms."""
    return segments.top_terms(lexical.term_counts(_tokenized(spark, d)), 50)


@query
def duplicate_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunk ids that occur more than once."""
    return lexical.duplicate_documents(read(spark, d, "chunks"), "chunk_id")


# lexical search ----------------------------------------------------------
def _index(spark: SparkSession, d: str, stem: bool = False) -> lexical.Index:
    toks = materialize(lexical.tokenized(_docs(spark, d), "doc_id", "text", stem=False), "tokens")
    lengths = lexical.doc_lengths(toks)
    return lexical.Index(lexical.term_counts(toks, stem), lengths, lexical.corpus_stats(lengths))


@query
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    """L2: inverse document frequency of every term."""
    index = _index(spark, d)
    got = lexical.doc_freq(index.postings).crossJoin(F.broadcast(index.stats))
    return got.select("term", F.round(lexical.idf(F.col("doc_freq"), F.col("total_documents")), DIGITS).alias("idf"))


@query
def bm25_single(spark: SparkSession, d: str) -> DataFrame:
    """L3: the 20 best documents for one query that repeats a word."""
    one = spark.createDataFrame([(1, "set the default timeout of the cache when the default lock fails")], "query_id long, query string")
    return lexical.search(_index(spark, d), one, 20, stem=False, digits=DIGITS)


@query
def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best documents for every held-out item."""
    return lexical.search(_index(spark, d), _items(spark, d), 20, stem=False, digits=DIGITS)


@query
def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """L3 with T8: the same with stems on both sides."""
    return lexical.search(_index(spark, d, stem=True), _items(spark, d), 20)


@query
def bm25_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Hits with title and url of their documents."""
    hits, n = counted(bm25_batch(spark, d), "hits")
    got = relational.enrich(hits, _docs(spark, d), chunk_id="doc_id", n_hits=n)
    return got.select("query_id", "doc_id", "rank", "title", "url")


# dense -------------------------------------------------------------------
@query
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    """V2: squared length after normalisation and the largest component."""
    e = F.col("embedding")
    good = read(spark, d, "vector_documents").where(F.size(e) == 384).where(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(e, lambda x: x != 0))
    got = dense.normalize(good)
    squares = F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)
    return got.select("id", F.round(squares, DIGITS).alias("squared_length"), F.round(F.array_max(e), DIGITS).alias("largest"))


@query
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """V8: the ten vectors with the largest inner product for each vector query."""
    queries, n = _vector_queries(spark, d)
    return dense.exact_top_k(_vectors(spark, d), queries, 10, DIGITS, n)


@query
def dense_self_knn(spark: SparkSession, d: str) -> DataFrame:
    """V8 on the small table: cosine neighbours of every hundredth vector."""
    v = dense.normalize(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"))
    queries, n = counted(v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector")), "queries")
    return dense.exact_top_k(v, queries, 11, DIGITS, n)


@query
def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    """V5, V7: dense_cosine over inverted lists."""
    v, queries = _unit_vectors(spark, d)
    lists = dense.InvertedLists.fit(v, 64)
    return lists.search(lists.index(v), queries, 10, 12, DIGITS)


def _unit_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = materialize(dense.normalize(_vectors(spark, d)), "unit")
    return v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query
def dense_cosine(spark: SparkSession, d: str) -> DataFrame:
    """V2, V8: the ten vectors most similar to each vector query by cosine."""
    v, queries = _unit_vectors(spark, d)
    return dense.exact_top_k(v, queries, 10, DIGITS)


@query
def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """V7: whether inverted lists find nine in ten of what the exact search finds, by rank 10."""
    both = ivf_topk(spark, d).select("query_id", "doc_id", F.lit(1).alias("found")).join(dense_cosine(spark, d).select("query_id", "doc_id"), ["query_id", "doc_id"], "right")
    return both.agg((F.sum(F.coalesce("found", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("nine_in_ten"))


@query
def vector_positions(spark: SparkSession, d: str) -> DataFrame:
    """Sequential positions in insertion order."""
    v = read(spark, d, "vector_documents").select(F.col("id").alias("doc_id"))
    return dense.positions(v)


@query
def encoded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """V1, V3: chunks encoded by a pluggable encoder."""
    rows = _chunks(spark, d).where(F.length(F.regexp_replace("text", tx.WHITE, "")) > 0)
    return dense.encode(rows.select("chunk_id", "text"), "text", dense.hashing_encoder(64), 64).select("chunk_id", "embedding")


@query
def vector_index_stored(spark: SparkSession, d: str) -> DataFrame:
    """V4, V5, V7, K5: whether a stored index, half of whose vectors came after its lists, finds nine in ten of dense_cosine."""
    v, queries = _unit_vectors(spark, d)
    store = _fresh_store(spark)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    store.save_vectors(v.where(half == 0).select("doc_id", F.col("embedding").cast("array<float>").alias("embedding")))
    store.index_vectors(32)
    store.save_vectors(v.where(half == 1).select("doc_id", F.col("embedding").cast("array<float>").alias("embedding")))
    got = store.search_vectors(queries, 10, 8).select("query_id", "doc_id", F.lit(1).alias("found"))
    both = got.join(dense_cosine(spark, d).select("query_id", "doc_id"), ["query_id", "doc_id"], "right")
    return both.agg((F.sum(F.coalesce("found", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("nine_in_ten"))


# fusion ------------------------------------------------------------------
def _two_lists(spark: SparkSession, d: str) -> list[DataFrame]:
    items = _items(spark, d)
    text = lexical.search(_index(spark, d), items, 20, stem=False, digits=DIGITS)
    titles = lexical.build_index(_docs(spark, d), "doc_id", "title", stem=False)
    return [text, lexical.search(titles, items, 20, stem=False, digits=DIGITS)]


@query
def rrf_two_lists(spark: SparkSession, d: str) -> DataFrame:
    """text and title rankings fused with equal weights."""
    return fusion.fuse(fusion.ranked_lists(_two_lists(spark, d)), 60, None, 2, 20).withColumn("score", F.round("score", 9))


@query
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The same with weights 0.3 and 0.7."""
    return fusion.fuse(fusion.ranked_lists(_two_lists(spark, d)), 60, [0.3, 0.7], 2, 20).withColumn("score", F.round("score", 9))


def hybrid_over_chunks(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    chunks = materialize(_chunks(spark, d).where(F.col("text").isNotNull()).select("chunk_id", "title", "text"), "chunks")
    toks = materialize(lexical.tokenized(chunks, "chunk_id", "text", stem=False), "tokens")
    lengths = lexical.doc_lengths(toks)
    index = lexical.Index(lexical.term_counts(toks), lengths, lexical.corpus_stats(lengths))
    vectors = materialize(_vectors(spark, d), "chunk-vectors")
    asked = vectors.where("id % 100 = 0").join(chunks, F.col("doc_id") == F.col("chunk_id"))
    asked = asked.where(F.col("title").isNotNull()).select(F.col("id").alias("query_id"), F.col("title").alias("query"), F.col("embedding").alias("query_vector"))
    queries, n = counted(asked, "hybrid-queries")
    return fusion.hybrid_search(index, vectors, queries, k, stem=False, digits=DIGITS, n_queries=n)


@query
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over chunk texts and inner product over chunk vectors, fused; the query is a chunk's title and vector."""
    return hybrid_over_chunks(spark, d).withColumn("score", F.round("score", 9))


# relational --------------------------------------------------------------
@query
def dedup_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Earlier pieces whose chunk id is not stored."""
    return relational.new_only(read(spark, d, "document_chunks").select("piece_id", "chunk_id"), read(spark, d, "chunks"))


@query
def existing_semijoin(spark: SparkSession, d: str) -> DataFrame:
    """Chunk ids of vectors that are stored."""
    return relational.existing(read(spark, d, "vector_documents").select(F.col("doc_id").alias("chunk_id")), read(spark, d, "chunks"))


@query
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """K1: what an insert of the earlier pieces adds to the stored chunks; the first piece of an id wins."""
    new = read(spark, d, "document_chunks").select("piece_id", "chunk_id", "text")
    return relational.insert_ignore(new, read(spark, d, "chunks").select("chunk_id"), order=[F.col("piece_id")])


@query
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """K6: chunks by id, the record with the highest id wins over two halves."""
    c = read(spark, d, "chunks").select("chunk_id", "id", "text")
    return relational.upsert(c.where("id % 2 = 1"), c.where("id % 2 = 0"), "chunk_id", "id").select("chunk_id", "id")


@query
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    """K5: vector ids that break uniqueness."""
    return lexical.duplicate_documents(read(spark, d, "vector_documents"), "doc_id")


@query
def lookup_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of all vectors by id, once each."""
    ids = read(spark, d, "vector_documents").select(F.col("doc_id").alias("chunk_id")).distinct()
    return _chunks(spark, d).join(ids, "chunk_id", "left_semi").select("chunk_id", "id", "title")


@query
def store_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, vectors, indexed documents and different terms."""
    toks = _tokenized(spark, d)
    one = read(spark, d, "chunks").agg(F.countDistinct("chunk_id").alias("chunks"))
    two = read(spark, d, "vector_documents").agg(F.countDistinct("doc_id").alias("vectors"))
    three = toks.agg(F.count(F.lit(1)).alias("documents"))
    four = toks.select(F.explode("tokens").alias("t")).agg(F.countDistinct("t").alias("terms"))
    return one.crossJoin(two).crossJoin(three).crossJoin(four)  # one row each


# segments ----------------------------------------------------------------
def _segmented(spark: SparkSession, d: str, buffer: int = 64) -> tuple[DataFrame, DataFrame]:
    toks = segments.assign_segments(_tokenized(spark, d), buffer)
    toks = materialize(toks, "segmented")
    counts = toks.select("segment_id", "doc_id", F.explode("tokens").alias("term")).groupBy("segment_id", "doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return counts, toks.select("segment_id", "doc_id", F.size("tokens").alias("doc_length"))


@query
def segments_build(spark: SparkSession, d: str) -> DataFrame:
    """Segments of 64 documents with their statistics."""
    got = segments.segment_stats(_segmented(spark, d)[1])
    return got.withColumn("avg_doc_length", F.round("avg_doc_length", DIGITS))


@query
def segment_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each segment with their document frequency."""
    return segments.segment_terms(_segmented(spark, d)[0])


@query
def segment_merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The oldest segments beyond five."""
    return segments.merge_candidates(_segmented(spark, d)[1].select("segment_id"), 5)


@query
def segment_merge_stats(spark: SparkSession, d: str) -> DataFrame:
    """Segments after one merge, with recomputed statistics."""
    postings, lengths = _segmented(spark, d)
    lengths = materialize(lengths, "lengths")
    postings = materialize(postings, "postings")
    old = materialize(segments.merge_candidates(lengths.select("segment_id"), 5), "old")
    chosen = [rows.join(old, "segment_id", "left_semi") for rows in (postings, lengths)]
    merged = segments.merge(*chosen, "merged")
    kept = [relational.without_segments(rows, old).unionByName(new) for rows, new in zip((postings, lengths), merged)]
    got = segments.segment_stats(kept[1]).withColumn("avg_doc_length", F.round("avg_doc_length", DIGITS))
    counts = kept[0].groupBy("segment_id").agg(F.count(F.lit(1)).alias("postings"), F.sum(F.col("tf").cast("long")).alias("tf_sum"))
    return got.join(counts, "segment_id")


def _stored_segments(spark: SparkSession, d: str, parts: int = 8) -> tuple[Store, list[str]]:
    """A store with the documents in ``parts`` segments, by order of doc_id."""
    toks = _tokenized(spark, d)
    named = materialize(segments.assign_segments(toks, max(1, -(-toks.count() // parts))), "segmented")
    store = _fresh_store(spark)
    names = sorted(r[0] for r in named.select("segment_id").distinct().collect())  # ``parts`` names
    each = [named.where(F.col("segment_id") == n) for n in names]
    store.write_segments([(lexical.term_counts(p), lexical.doc_lengths(p)) for p in each], names)
    return store, names


@query
def store_merge(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies and counts of an index that was stored in eight segments and merged to five."""
    store, _ = _stored_segments(spark, d)
    store.merge_segments(5)
    index = store.load_index()
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum(F.col("tf").cast("long")).alias("tf_sum")).crossJoin(
        F.broadcast(spark.createDataFrame([(len(store.list_segments()),)], "segments long"))
    )


@query
def store_delete(spark: SparkSession, d: str) -> DataFrame:
    """Postings of the second stored segment, read by itself after the first was deleted, with the documents left in the index."""
    store, names = _stored_segments(spark, d)
    store.delete_segment(names[0])
    left = store.load_index().stats.select(F.col("total_documents").alias("documents_left"))
    return store.read_segment(names[1])[0].select(F.col("doc_id").cast("long").alias("doc_id"), "term", F.col("tf").cast("long").alias("tf")).crossJoin(F.broadcast(left))


@query
def bm25_stored(spark: SparkSession, d: str) -> DataFrame:
    """L1, L3: bm25_batch from a stored index."""
    hits = lexical.search(_stored_segments(spark, d)[0].load_index(), _items(spark, d), 50, stem=False, digits=DIGITS)
    return lexical.top_k(hits.select("query_id", F.col("doc_id").cast("long").alias("doc_id"), "score"), 20)


# crawl and scrape --------------------------------------------------------
@query
def list_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources with their single fields."""
    s = read(spark, d, "source_configs")
    return s.select("source_id", "source_name", F.col("max_depth").cast("long").alias("max_depth"), "use_browser_fallback", F.array_join("seed_urls", " ").alias("seeds"))


@query
def crawl_reach(spark: SparkSession, d: str) -> DataFrame:
    """S3: breadth-first depth over a graph on the document ids: n leads to 2n, 2n + 1 and n // 3."""
    ids = _docs(spark, d).select(F.col("doc_id").alias("src"))
    steps = F.array(F.col("src") * 2, F.col("src") * 2 + 1, F.floor(F.col("src") / 3))
    edges = ids.select("src", F.explode(steps).alias("dst")).join(ids.select(F.col("src").alias("dst")), "dst", "left_semi")
    seeds = ids.where("src in (5, 7)").select(F.col("src").alias("node"))
    return crawl.reach(seeds, edges.select("src", "dst"), 6).select("node", F.col("depth").cast("long").alias("depth"))


def _first_pages(pages: DataFrame) -> DataFrame:
    return pages.where("crawl_depth = 0").select("source_id", F.col("url").alias("seed"))


@query
def crawl_pages(spark: SparkSession, d: str) -> DataFrame:
    """A crawl of every source over the page table, from the pages that an earlier crawl found first."""
    pages = read(spark, d, "crawled_pages")
    return crawl.crawl(read(spark, d, "source_configs"), pages, _first_pages(pages)).select("source_id", "url", "depth")


@query
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of every page, resolved."""
    got = crawl.extract_links(read(spark, d, "crawled_pages").select("page_id", "url", "html"))
    return got.select("page_id", F.size("links").cast("long").alias("n_links"), F.array_join("links", " ").alias("links"))


@query
def scrape_pages(spark: SparkSession, d: str) -> DataFrame:
    """H1-H5: documents of all fetched pages by their source's selectors."""
    pages = read(spark, d, "crawled_pages").where("status_code = 200")
    return scrape.scrape(pages.select("source_id", "url", "html"), read(spark, d, "source_configs"))


@query
def scrape_rejects(spark: SparkSession, d: str) -> DataFrame:
    """H5: pages with and without a document for each source."""
    pages = read(spark, d, "crawled_pages").where("status_code = 200")
    got = scrape.scrape(pages.select("source_id", "url", "html"), read(spark, d, "source_configs"), keep_rejected=True)
    return got.groupBy("source_id").agg(F.count("title").alias("documents"), F.count(F.lit(1)).alias("pages"))


# re-ranking and prompts --------------------------------------------------
def _passages(spark: SparkSession, d: str) -> DataFrame:
    hits, n = counted(bm25_batch(spark, d), "hits")
    docs = _docs(spark, d).select("doc_id", "title", "url", "text")
    return relational.enrich(hits, docs, chunk_id="doc_id", n_hits=n).join(_items(spark, d), "query_id")


@query
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Hits re-ranked by the share of query tokens they hold."""
    return rerank.rerank(_passages(spark, d), 5, digits=DIGITS).select("query_id", "doc_id", "score", "rank")


@query
def prompt_messages(spark: SparkSession, d: str) -> DataFrame:
    """The user message for every held-out item from its three best documents."""
    best = _passages(spark, d).where("rank <= 3")
    got = rerank.prompts(best.select("query_id", "query", "rank", "title", "url", "text"))
    return got.select("query_id", F.element_at("messages", 2)["content"].alias("content"))


def _echo(messages: list[dict]) -> dict:
    return {"answer": messages[-1]["content"].rsplit("\n", 1)[-1], "model": "echo", "prompt_tokens": sum(len(m["content"].split()) for m in messages)}


@query
def rag_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk title of hybrid_search asked: hybrid hits, re-ranked, the three best in a prompt, one call of a stub model."""
    hits, n = counted(hybrid_over_chunks(spark, d, 30), "hits")
    chunks = _chunks(spark, d).where(F.col("text").isNotNull()).select("chunk_id", "title", "url", "text")
    asked = _vectors(spark, d).where("id % 100 = 0").join(chunks, F.col("doc_id") == F.col("chunk_id")).select(F.col("id").alias("query_id"), F.col("title").alias("query"))
    best = rerank.rerank(relational.enrich(hits, chunks, n_hits=n).join(asked, "query_id"), 3)
    return rerank.answer(rerank.prompts(best.select("query_id", "query", "rank", "title", "url", "text")), _echo)


# pipelines ---------------------------------------------------------------
def _fresh_store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/loamdex-stores/{uuid.uuid4().hex}")


@query
def ingest_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Every source from pages to both indexes, crawled as in crawl_pages; the counts of the run and of a second one."""
    store, settings = _fresh_store(spark), Settings(dimension=64)
    sources, pages = read(spark, d, "source_configs"), read(spark, d, "crawled_pages")
    made = [ingest.ingest_sources(store, sources, pages, dense.hashing_encoder(64), settings, _first_pages(pages)) for _ in range(2)]
    rows = [(i, r.source_id, r.pages, r.documents, r.chunks, r.new_chunks, r.lexical, r.vectors) for i, run in enumerate(made, 1) for r in run]
    return spark.createDataFrame(rows, "run int, source_id string, pages long, documents long, chunks long, new_chunks long, lexical long, vectors long")


@query
def stream_index(spark: SparkSession, d: str) -> DataFrame:
    """Documents streamed into a store until drained; its statistics."""
    store, at = _fresh_store(spark), f"{shared_dir(spark)}/loamdex-stores/stream-{uuid.uuid4().hex}"
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    docs.repartition(4).write.parquet(f"{at}/in")
    stream = index_stream.read_stream(spark, f"{at}/in", docs.schema, 2)
    running = index_stream.index_stream(store, stream, f"{at}/checkpoint", Settings(), drain=True)
    running.awaitTermination()
    got = store.load_index().stats
    return got.withColumn("average_document_length", F.round("average_document_length", DIGITS))


@query
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals by hour and kind, as the streaming window counts."""
    got = index_stream.windowed_counts(read(spark, d, "events"), "ts", "event_type")
    return got.withColumn("window_start", F.col("window_start").cast("string"))
