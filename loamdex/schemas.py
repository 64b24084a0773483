"""Schemas of the stored tables and of what passes between operators."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


STRINGS = ArrayType(StringType())
SCRAPER = _struct(
    main_content_selectors=STRINGS, title_selectors=STRINGS, breadcrumb_selectors=STRINGS, code_block_selectors=STRINGS, exclude_selectors=STRINGS
)
SOURCE = _struct(
    source_id=StringType(), source_name=StringType(), base_url=StringType(), allowed_domains=STRINGS, seed_urls=STRINGS,
    allowed_path_prefixes=STRINGS, blocked_path_patterns=STRINGS, max_depth=IntegerType(), use_browser_fallback=BooleanType(),
    technology=STRINGS, scraper=SCRAPER,
)
CHUNK = _struct(
    chunk_id=StringType(), source_id=StringType(), url=StringType(), title=StringType(), breadcrumb=StringType(),
    chunk_index=IntegerType(), text=StringType(), created_at=TimestampType(),
)
POSTING = _struct(segment_id=StringType(), term=StringType(), doc_id=StringType(), tf=IntegerType())
DOC_LENGTH = _struct(segment_id=StringType(), doc_id=StringType(), doc_length=IntegerType())
SEGMENT = _struct(segment_id=StringType(), created_at=TimestampType(), total_documents=LongType(), total_terms=LongType(), avg_doc_length=DoubleType())
VECTOR = _struct(doc_id=StringType(), embedding=ArrayType(FloatType()), indexed_at=TimestampType())
SCRAPED = _struct(title=StringType(), content=StringType(), breadcrumb=StringType(), code_blocks=STRINGS)
HIT = _struct(query_id=LongType(), doc_id=StringType(), score=DoubleType(), rank=IntegerType())
