"""DuckDB statements that give the results of the core's queries on the same tables."""

from __future__ import annotations

from loamdex.functions.text import STOP_WORDS

#: White space as the engine defines it, in RE2 syntax.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _clean(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'), ' ')"


def _words(c: str) -> str:
    return f"list_filter(string_split({_clean(c)}, ' '), lambda w: w <> '')"


def _tokens(c: str) -> str:
    return f"coalesce(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) > 1 and not list_contains({_STOP}, t)), [])"


_TOKS = f"toks AS (SELECT doc_id, {_tokens('text')} AS tokens FROM documents), lens AS (SELECT doc_id, len(tokens) AS doc_length FROM toks WHERE len(tokens) > 0)"
_POST = "post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM toks) GROUP BY doc_id, term)"
_STATS = "stats AS (SELECT count(*) AS n, sum(doc_length) AS total, sum(doc_length) / count(*) AS avgdl FROM lens)"
_FREQ = "freq AS (SELECT term, count(*) AS df FROM post GROUP BY term)"
_INDEX = f"{_TOKS}, {_POST}, {_STATS}, {_FREQ}"
_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"
_BM25 = f"({_IDF} * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * doc_length / avgdl)) * qtf)"
_QUERIES = "q AS (SELECT item_id AS query_id, text AS query FROM test_items WHERE text IS NOT NULL)"


def _terms(name: str = "q") -> str:
    return f"qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens('query')}) AS term FROM {name}) GROUP BY query_id, term)"


def _scored(suffix: str = "") -> str:
    return (
        f"scored{suffix} AS (SELECT query_id, doc_id, round(sum({_BM25}), 6) AS score FROM qt JOIN post{suffix} USING (term) JOIN freq{suffix} USING (term) "
        f"JOIN lens{suffix} USING (doc_id), stats{suffix} GROUP BY query_id, doc_id)"
    )


def _ranked(name: str, source: str, k: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k})"


_HITS = f"{_INDEX}, {_QUERIES}, {_terms()}, {_scored()}, {_ranked('hits', 'scored', 20)}"
_URL_PATH = r"coalesce(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '')"
_GOOD = "len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_VECS = (
    f"vecs AS (SELECT doc_id, embedding::DOUBLE[] AS e, id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS r FROM vector_documents WHERE {_GOOD}) WHERE r = 1)"
)
_PRODUCT = "round(list_inner_product(v.e, w.e), 6)"
_SEG = (
    f"WITH {_TOKS}, seg AS (SELECT doc_id, tokens, 'seg-' || lpad(((row_number() OVER (ORDER BY doc_id) - 1) // 64)::VARCHAR, 9, '0') AS segment_id FROM toks WHERE len(tokens) > 0), "
    "slens AS (SELECT segment_id, doc_id, len(tokens) AS doc_length FROM seg)"
)
_SEG_STATS = "SELECT segment_id, count(*) AS total_documents, sum(doc_length)::BIGINT AS total_terms, round(sum(doc_length) / count(*), 6) AS avg_doc_length"
_OLD = (
    "names AS (SELECT segment_id, row_number() OVER (ORDER BY segment_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT segment_id FROM slens)), "
    "old AS (SELECT segment_id FROM names WHERE n > 5 AND r <= greatest(2, n - 5 + 1))"
)


def _two_lists(weights: tuple[float, float]) -> str:
    a, b = weights
    return f"""WITH {_HITS},
      toks2 AS (SELECT doc_id, {_tokens('title')} AS tokens FROM documents),
      lens2 AS (SELECT doc_id, len(tokens) AS doc_length FROM toks2 WHERE len(tokens) > 0),
      post2 AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM toks2) GROUP BY doc_id, term),
      stats2 AS (SELECT count(*) AS n, sum(doc_length) / count(*) AS avgdl FROM lens2),
      freq2 AS (SELECT term, count(*) AS df FROM post2 GROUP BY term),
      {_scored('2')}, {_ranked('hits2', 'scored2', 20)},
      ranked AS (SELECT query_id, 0 AS list_id, doc_id, rank FROM hits UNION ALL SELECT query_id, 1, doc_id, rank FROM hits2),
      fused AS (SELECT query_id, doc_id, sum(CASE WHEN list_id = 0 THEN {a} ELSE {b} END::DOUBLE / (60.0::DOUBLE + rank) ORDER BY list_id, rank) AS s,
                min(list_id * 1000 + rank) AS first FROM ranked GROUP BY query_id, doc_id),
      cut AS (SELECT query_id, doc_id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first, doc_id) AS rank FROM fused)
      SELECT * FROM cut WHERE rank <= 20"""


ORACLES: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
    "word_counts": f"SELECT scraped_id, coalesce(len({_words('content')}), 0)::BIGINT AS n_words FROM scraped_documents",
    "tokens_raw": f"SELECT doc_id, array_to_string({_tokens('text')}, ' ') AS tokens FROM documents",
    "url_hashes": """SELECT id, substr(sha1(url), 1, 12) AS url_hash, source_id || ':' || substr(sha1(url), 1, 12) || ':' || chunk_index AS made_id,
        (source_id || ':' || substr(sha1(url), 1, 12) || ':' || chunk_index) = chunk_id AS as_stored FROM chunks""",
    "url_normalize": "SELECT page_id, regexp_extract(url, '^[^?#]*') AS url FROM crawled_pages",
    "url_allowed": rf"""WITH p AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS u, s.* FROM crawled_pages JOIN source_configs s USING (source_id)),
        x AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority, {_URL_PATH} AS path FROM p)
        SELECT page_id, scheme IN ('http', 'https') AND coalesce(list_contains(allowed_domains, authority), false)
          AND (coalesce(len(allowed_path_prefixes), 0) = 0 OR len(list_filter(allowed_path_prefixes, lambda a: starts_with(path, a))) > 0)
          AND len(list_filter(coalesce(blocked_path_patterns, []), lambda b: contains(path, b))) = 0 AS allowed FROM x""",
    "upload_names": r"""WITH n AS (SELECT page_id, regexp_extract(url, '([^/]*)/?$', 1) || '.md' AS name FROM crawled_pages)
        SELECT page_id, CASE WHEN regexp_matches(name, '^[^.].*\.') THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END AS title, 'upload://' || name AS upload_url FROM n""",
    "chunks_256_32": f"""WITH w AS (SELECT scraped_id, source_id, url, {_words('content')} AS w FROM scraped_documents),
        x AS (SELECT *, unnest(range(0, ceil(len(w) / 224)::BIGINT)) AS chunk_index FROM w WHERE len(w) > 0)
        SELECT scraped_id, source_id || ':' || substr(sha1(url), 1, 12) || ':' || chunk_index AS chunk_id, chunk_index,
          array_to_string(w[chunk_index * 224 + 1 : chunk_index * 224 + 256], ' ') AS chunk_text FROM x""",
    "chunk_counts_by_source": f"""WITH w AS (SELECT source_id, {_words('content')} AS w FROM scraped_documents),
        x AS (SELECT *, unnest(range(0, ceil(len(w) / 224)::BIGINT)) AS i FROM w WHERE len(w) > 0)
        SELECT source_id, count(*) AS n_chunks, round(avg(length(array_to_string(w[i * 224 + 1 : i * 224 + 256], ' '))), 4) AS mean_chars FROM x GROUP BY source_id""",
    "window_edges": f"SELECT piece_id, n AS n_words, ceil(n / 40)::BIGINT AS expected_chunks FROM (SELECT piece_id, coalesce(len({_words('text')}), 0)::BIGINT AS n FROM document_chunks)",
    "term_counts": f"WITH {_TOKS}, {_POST} SELECT doc_id, term, tf FROM post",
    "doc_lengths": f"WITH {_TOKS} SELECT doc_id, doc_length FROM lens",
    "corpus_stats": f"WITH {_TOKS}, {_STATS} SELECT n AS total_documents, total::BIGINT AS total_terms, round(avgdl, 6) AS average_document_length FROM stats",
    "running_corpus_stats": f"""WITH {_TOKS} SELECT doc_id, count(*) OVER w AS total_documents, (sum(doc_length) OVER w)::BIGINT AS total_terms FROM lens
        WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)""",
    "doc_freq": f"WITH {_TOKS}, {_POST} SELECT term, count(*) AS doc_freq FROM post GROUP BY term",
    "inverted_index_top_terms": f"""WITH {_TOKS}, {_POST}, {_FREQ}, top AS (SELECT * FROM freq ORDER BY df DESC, term LIMIT 50)
        SELECT term, df AS doc_freq, doc_id, tf FROM top JOIN post USING (term)""",
    "duplicate_documents": "SELECT chunk_id AS doc_id, count(*) AS n FROM chunks GROUP BY chunk_id HAVING count(*) > 1",
    "bm25_idf": f"WITH {_INDEX} SELECT term, round({_IDF}, 6) AS idf FROM freq, stats",
    "bm25_single": f"""WITH {_INDEX}, q AS (SELECT 1::BIGINT AS query_id, 'set the default timeout of the cache when the default lock fails' AS query), {_terms()},
        {_scored()}, {_ranked('hits', 'scored', 20)} SELECT * FROM hits""",
    "bm25_batch": f"WITH {_HITS} SELECT * FROM hits",
    "bm25_enriched": f"WITH {_HITS} SELECT query_id, doc_id, rank, title, url FROM hits JOIN documents USING (doc_id)",
    "l2_normalize": f"""WITH g AS (SELECT id, embedding::DOUBLE[] AS e FROM vector_documents WHERE {_GOOD}),
        u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM g)
        SELECT id, round(list_inner_product(e, e), 6) AS squared_length, round(list_max(e), 6) AS largest FROM u""",
    "dense_topk": f"""WITH {_VECS}, s AS (SELECT w.id AS query_id, v.doc_id, {_PRODUCT} AS score FROM vecs v, vecs w WHERE w.id % 100 = 0), {_ranked('hits', 's', 10)} SELECT * FROM hits""",
    "dense_self_knn": f"""WITH n AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e FROM embeddings),
        u AS (SELECT doc_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM n),
        s AS (SELECT w.doc_id AS query_id, v.doc_id, {_PRODUCT} AS score FROM u v, u w WHERE w.doc_id % 100 = 0), {_ranked('hits', 's', 11)} SELECT * FROM hits""",
    "dense_cosine": f"""WITH {_VECS}, u AS (SELECT doc_id, id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM vecs),
        s AS (SELECT w.id AS query_id, v.doc_id, {_PRODUCT} AS score FROM u v, u w WHERE w.id % 100 = 0), {_ranked('hits', 's', 10)} SELECT * FROM hits""",
    "vector_index_stored": "SELECT true AS nine_in_ten",
    "ivf_recall": "SELECT true AS nine_in_ten",
    "vector_positions": "SELECT row_number() OVER (ORDER BY id) - 1 AS position, id AS doc_id FROM vector_documents",
    "rrf_two_lists": _two_lists((1.0, 1.0)),
    "rrf_weighted": _two_lists((0.3, 0.7)),
    "hybrid_search": f"""WITH c AS (SELECT chunk_id AS doc_id, title, text FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY id) AS r FROM chunks) WHERE r = 1 AND text IS NOT NULL),
        toks AS (SELECT doc_id, {_tokens('text')} AS tokens FROM c), lens AS (SELECT doc_id, len(tokens) AS doc_length FROM toks WHERE len(tokens) > 0), {_POST}, {_STATS}, {_FREQ}, {_VECS},
        q AS (SELECT id AS query_id, title AS query FROM vecs JOIN c USING (doc_id) WHERE id % 100 = 0 AND title IS NOT NULL), {_terms()}, {_scored()}, {_ranked('hits', 'scored', 50)},
        s AS (SELECT w.id AS query_id, v.doc_id, {_PRODUCT} AS score FROM vecs v, vecs w WHERE w.id IN (SELECT query_id FROM q)), {_ranked('hits2', 's', 50)},
        ranked AS (SELECT query_id, 0 AS list_id, doc_id, rank FROM hits UNION ALL SELECT query_id, 1, doc_id, rank FROM hits2),
        fused AS (SELECT query_id, doc_id, sum(CASE WHEN list_id = 0 THEN 0.3 ELSE 0.7 END::DOUBLE / (60.0::DOUBLE + rank) ORDER BY list_id, rank) AS s, min(list_id * 1000 + rank) AS first FROM ranked GROUP BY query_id, doc_id),
        cut AS (SELECT query_id, doc_id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first, doc_id) AS rank FROM fused)
        SELECT * FROM cut WHERE rank <= 10""",
    "dedup_antijoin": "SELECT piece_id, chunk_id FROM document_chunks d WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = d.chunk_id)",
    "existing_semijoin": "SELECT DISTINCT doc_id AS chunk_id FROM vector_documents v WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = v.doc_id)",
    "insert_ignore": """SELECT piece_id, chunk_id, text FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY piece_id) AS r FROM document_chunks d
        WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = d.chunk_id)) WHERE r = 1""",
    "upsert_last_wins": "SELECT chunk_id, max(id) AS id FROM chunks GROUP BY chunk_id",
    "unique_violations": "SELECT doc_id, count(*) AS n FROM vector_documents GROUP BY doc_id HAVING count(*) > 1",
    "lookup_chunks": """SELECT chunk_id, id, title FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY id) AS r FROM chunks) c
        WHERE r = 1 AND EXISTS (SELECT 1 FROM vector_documents v WHERE v.doc_id = c.chunk_id)""",
    "store_metrics": f"""WITH {_TOKS} SELECT (SELECT count(DISTINCT chunk_id) FROM chunks) AS chunks, (SELECT count(DISTINCT doc_id) FROM vector_documents) AS vectors,
        (SELECT count(*) FROM lens) AS documents, (SELECT count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM toks)) AS terms""",
    "segments_build": f"{_SEG} {_SEG_STATS} FROM slens GROUP BY segment_id",
    "segment_terms": f"{_SEG} SELECT segment_id, term, count(DISTINCT doc_id) AS doc_freq FROM (SELECT segment_id, doc_id, unnest(tokens) AS term FROM seg) GROUP BY segment_id, term",
    "segment_merge_candidates": f"{_SEG}, {_OLD} SELECT segment_id FROM old",
    "segment_merge_stats": f"""{_SEG}, {_OLD}, moved AS (SELECT CASE WHEN segment_id IN (SELECT segment_id FROM old) THEN 'merged' ELSE segment_id END AS segment_id, doc_id, doc_length FROM slens),
        t AS (SELECT doc_id, unnest(tokens) AS term FROM seg), c AS (SELECT m.segment_id, count(DISTINCT (t.doc_id, t.term)) AS postings, count(*)::BIGINT AS tf_sum FROM t JOIN moved m USING (doc_id) GROUP BY m.segment_id)
        SELECT s.*, postings, tf_sum FROM ({_SEG_STATS} FROM moved GROUP BY segment_id) s JOIN c USING (segment_id)""",
    "store_merge": f"WITH {_TOKS}, {_POST} SELECT term, count(*) AS doc_freq, sum(tf)::BIGINT AS tf_sum, 5::BIGINT AS segments FROM post GROUP BY term",
    "store_delete": f"""WITH {_TOKS}, {_POST}, placed AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // greatest(1, ceil(count(*) OVER () / 8)::BIGINT) AS s FROM lens)
        SELECT doc_id, term, tf, (SELECT count(*) FROM placed WHERE s > 0) AS documents_left FROM post JOIN placed USING (doc_id) WHERE s = 1""",
    "bm25_stored": f"WITH {_HITS} SELECT * FROM hits",
    "list_sources": "SELECT source_id, source_name, max_depth::BIGINT AS max_depth, use_browser_fallback, array_to_string(seed_urls, ' ') AS seeds FROM source_configs",
    "crawl_reach": """WITH RECURSIVE edges AS (SELECT src, dst FROM (SELECT doc_id AS src, unnest([doc_id * 2, doc_id * 2 + 1, doc_id // 3]) AS dst FROM documents) WHERE dst IN (SELECT doc_id FROM documents)),
        r AS (SELECT doc_id AS node, 0 AS depth FROM documents WHERE doc_id IN (5, 7) UNION SELECT dst, depth + 1 FROM r JOIN edges ON node = src WHERE depth < 6)
        SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY node""",
    "rerank_overlap": f"""WITH {_HITS}, s AS (SELECT h.query_id, h.doc_id, list_distinct({_tokens('q.query')}) AS a, {_tokens('d.text')} AS b FROM hits h JOIN q USING (query_id) JOIN documents d USING (doc_id)),
        o AS (SELECT query_id, doc_id, CASE WHEN len(a) > 0 THEN round(len(list_filter(a, lambda x: list_contains(b, x))) / len(a), 6) ELSE 0.0 END AS score FROM s), {_ranked('r', 'o', 5)} SELECT * FROM r""",
    "prompt_messages": f"""WITH {_HITS}, b AS (SELECT h.query_id, h.rank, title, url, d.text, query,
          row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS i FROM hits h JOIN documents d USING (doc_id) JOIN q USING (query_id) WHERE h.rank <= 3)
        SELECT query_id, E'Contexto de la documentación:\\n\\n' || string_agg('[' || i || '] ' || coalesce(title, '') || E'\\nSource: ' || coalesce(url, '') || E'\\n\\n' || coalesce(text, ''), E'\\n\\n---\\n\\n' ORDER BY rank)
          || E'\\n\\n---\\n\\nPregunta: ' || any_value(query) AS content FROM b GROUP BY query_id""",
    "stream_index": f"WITH {_TOKS}, {_STATS} SELECT n AS total_documents, total::BIGINT AS total_terms, round(avgdl, 6) AS average_document_length FROM stats",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
