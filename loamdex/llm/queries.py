"""The queries of this package, by name; each takes (spark, directory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.runtime import read

from . import boilerplate, contamination, garbled, near_duplicates, neighbours, repeated_lines, splitting, tokenize


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of chunks to take out: same letters, 12 or more urls of the source."""
    return repeated_lines.repeated_lines(read(spark, d, "chunks")).where("exact").select("id", "line_no")


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's own lines, without any repeated line or near-duplicate of one."""
    chunks = read(spark, d, "chunks").select("id", "source_id", "url", "text")
    return repeated_lines.without_lines(chunks, repeated_lines.repeated_lines(chunks)).select("id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of which one is among the other's ten nearest."""
    return neighbours.neighbour_pairs(neighbours.nearest(read(spark, d, "vector_documents")))


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest rows of each vector, with similarity and rank."""
    return neighbours.nearest(read(spark, d, "vector_documents"))


def _article(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_blocks(read(spark, d, "crawled_pages"), read(spark, d, "scraped_documents"), read(spark, d, "source_configs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the article's blocks of pages and scraped texts."""
    return boilerplate.block_shas(_article(spark, d))


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The article's blocks of pages and scraped texts, with their order."""
    return _article(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks whose sets of three consecutive words are similar to 0.6 or more."""
    members, links = near_duplicates.duplicate_groups(read(spark, d, "chunks"), threshold=0.6, width=3)
    return near_duplicates.pairs_of(members, links)


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's class of equal texts and the number of linked classes, at five words and 0.8."""
    members, links = near_duplicates.duplicate_groups(read(spark, d, "chunks"))
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(ends, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_items(read(spark, d, "scraped_documents"), read(spark, d, "document_chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Items over 256 words or 2,048 characters, as split."""
    return _pieces(spark, d).where("piece_no = 0").select("rec_kind", "rec_id")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all oversized items."""
    return _pieces(spark, d)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of each document by byte_bpe_50k."""
    return tokenize.token_ids(read(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items of which they hold 12 consecutive words, or a short item whole."""
    return contamination.leaks(read(spark, d, "documents"), read(spark, d, "test_items")).select("doc_id", "item_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """As p7_found, with up to one word edited."""
    return contamination.leaks(read(spark, d, "documents"), read(spark, d, "test_items"), edits=1)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold wrongly decoded characters."""
    return garbled.garbled_texts(read(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """The same documents with their text restored where possible."""
    return garbled.garbled_texts(read(spark, d, "documents")).select("doc_id", F.col("restored").alias("text"), "whole")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_cleaned, p2_found, p2_nearest, p3_found, p3_blocks, p4_found, p4_links, p5_found, p5_pieces, p6_ids, p7_found, p7_near, p8_found, p8_restored)
}

_RUNS = "regexp_extract_all(lower(line), '\\p{L}+')"
_WORDS = "coalesce(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), [])"
_SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+"


def _over(text: str) -> str:
    return f"(len(list_filter(string_split_regex({text}, '{_SPACE}'), lambda w: w <> '')) > 256 OR length({text}) > 2048)"


#: SQL for the queries that SQL can state over whole tables.
ORACLES: dict[str, str] = {
    "p1_found": f"""WITH l AS (SELECT id, source_id, url, unnest(string_split(text, E'\\n')) AS line, unnest(range(1, len(string_split(text, E'\\n')) + 1)) AS line_no FROM chunks WHERE text IS NOT NULL AND text <> ''),
        k AS (SELECT id, line_no::INT AS line_no, source_id, url, {_RUNS} AS runs FROM l), c AS (SELECT source_id, runs FROM k WHERE len(runs) >= 3 GROUP BY source_id, runs HAVING count(DISTINCT url) >= 12)
        SELECT DISTINCT id, line_no FROM k JOIN c USING (source_id, runs)""",
    "p2_found": """WITH v AS (SELECT id, embedding::DOUBLE[] AS e FROM vector_documents WHERE len(embedding) = 384
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.id) AS r FROM v a, v b WHERE a.id <> b.id)
        SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM s WHERE r <= 10""",
    "p4_found": f"""WITH w AS (SELECT id, {_WORDS} AS w FROM chunks), s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2])) AS g FROM w WHERE len(w) >= 10),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id), p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id)
        SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE o >= 0.6 * (x.n + y.n - o) - 1e-9""",
    "p5_found": f"""SELECT 'scraped' AS rec_kind, scraped_id AS rec_id FROM scraped_documents WHERE {_over('content')}
        UNION ALL SELECT 'chunk', piece_id FROM document_chunks WHERE {_over('text')}""",
    "p7_found": f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM test_items), q AS (SELECT item_id, least(12, len(w)) AS m, w FROM i WHERE len(w) > 0),
        g AS (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda k: w[k : k + m - 1])) AS g FROM q),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents), m AS (SELECT DISTINCT m FROM g),
        x AS (SELECT DISTINCT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda k: w[k : k + m - 1])) AS g FROM d, m WHERE len(w) >= m)
        SELECT DISTINCT doc_id, item_id FROM x JOIN g USING (m, g)""",
}
