"""The engine's public operations over one store, with the checks of a service.

Errors: ``ValueError`` for a bad argument, ``KeyError`` for an unknown source.
Searches take one query or many and return DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.config import Settings, load_settings, save_settings
from loamdex.operators import dense, fusion, ingest, lexical, relational
from loamdex.sources.files import SUFFIXES
from loamdex.sources.store import Store

_QUERY = "query_id long, query string"


def _between(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}")
    return value


class Engine:
    """A store with its sources, pages, encoder, chat function and scorer for re-ranking."""

    def __init__(
        self,
        store: Store,
        sources: DataFrame,
        pages: DataFrame,
        load_encoder: Callable,
        chat: Callable | None = None,
        settings: Settings | None = None,
        settings_path: str | Path | None = None,
        scorer: Callable | None = None,
    ):
        self.store, self.sources, self.pages, self.load_encoder, self.chat, self.scorer, self.path = store, sources, pages, load_encoder, chat, scorer, settings_path
        kept = load_settings(settings_path) if settings_path else {}
        self.settings = (settings or Settings()).update(**kept)

    def _queries(self, queries: str | list[str] | DataFrame) -> DataFrame:
        if isinstance(queries, DataFrame):
            return fusion.require_text(queries)
        rows = list(enumerate([queries] if isinstance(queries, str) else queries, 1))
        return fusion.require_text(self.store.spark.createDataFrame(rows, _QUERY))

    # searches -------------------------------------------------------------
    def search(self, queries: str | list[str] | DataFrame, top_k: int = 10) -> DataFrame:
        """Hybrid hits with their chunks."""
        return ingest.search_store(self.store, self._queries(queries), self.load_encoder, _between("top_k", top_k, 1, 50), self.settings)

    def search_bm25(self, queries: str | list[str] | DataFrame, top_k: int = 20) -> DataFrame:
        """Lexical hits with their chunks; a query without usable tokens has none."""
        hits = lexical.search(self.store.load_index(), self._queries(queries), _between("top_k", top_k, 1, 100), self.settings.bm25_k1, self.settings.bm25_b)
        return relational.enrich(hits, self.store.chunks())

    def search_vector(self, queries: str | list[str] | DataFrame, top_k: int = 10) -> DataFrame:
        """Dense hits with their chunks; approximate once :meth:`rebuild_vectors` has stored lists."""
        asked = dense.encode(self._queries(queries), "query", self.load_encoder, self.settings.dimension, "query_vector")
        hits = self.store.search_vectors(asked.select("query_id", "query_vector"), _between("top_k", top_k, 1, 100))
        return relational.enrich(hits, self.store.chunks())

    def ask(self, queries: str | list[str] | DataFrame) -> DataFrame:
        """Answers with their sources."""
        if self.chat is None:
            raise ValueError("no chat function was given")
        return ingest.ask(self.store, self._queries(queries), self.load_encoder, self.chat, self.settings, self.scorer)

    # writes ---------------------------------------------------------------
    def index_document(self, doc_id: str, tokens: list[str]) -> str:
        """Add one tokenised document to the lexical index; the name of its segment."""
        if not tokens:
            raise ValueError("tokens must not be empty")
        rows = self.store.spark.createDataFrame([(doc_id, tokens)], "doc_id string, tokens array<string>")
        known = self.store.load_index().lengths.select("doc_id")
        lexical.require_unique(rows.select("doc_id").unionByName(known.where(F.col("doc_id") == doc_id)))
        name = self.store.write_segment(lexical.term_counts(rows), lexical.doc_lengths(rows))
        self.store.merge_segments(self.settings.max_segments)
        return name

    def index_vector(self, doc_id: str, text: str) -> None:
        """Encode and add one text; a stored id is an error."""
        if not text.strip():
            raise ValueError("text must not be blank")
        rows = self.store.spark.createDataFrame([(doc_id, text)], "doc_id string, text string")
        self.store.save_vectors(dense.encode(rows, "text", self.load_encoder, self.settings.dimension).select("doc_id", "embedding"))

    def rebuild_vectors(self, lists: int = 64) -> str:
        """Fit and store the lists of the dense index anew; its name."""
        return self.store.index_vectors(_between("lists", lists, 1, 65_536))

    def merge(self) -> list[str]:
        """Merge segments beyond the limit; names of the new ones."""
        return self.store.merge_segments(self.settings.max_segments)

    def ingest(self, source_id: str) -> ingest.Report:
        return ingest.ingest_source(self.store, self.sources, self.pages, source_id, self.load_encoder, self.settings)

    def upload(self, path: str, source_id: str) -> ingest.Report:
        """Read, store and index the files of a path pattern; an unknown suffix or an empty text is an error."""
        files = self.store.spark.read.format("binaryFile").load(path).select("path", "content")
        bad = files.where(~F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(*SUFFIXES)).limit(1).collect()
        if bad:
            raise ValueError(f"unsupported file type: {bad[0]['path']}")
        return ingest.upload(self.store, files, source_id, self.load_encoder, self.settings)

    # state ----------------------------------------------------------------
    def list_sources(self) -> DataFrame:
        return self.sources.select("source_id", "source_name", "base_url")

    def metrics(self) -> DataFrame:
        return self.store.metrics()

    def update_settings(self, **changes) -> Settings:
        """Check, apply and, if there is a path, keep changed settings."""
        self.settings = self.settings.update(**changes)
        if self.path:
            save_settings(self.settings, self.path)
        return self.settings

    def health(self) -> dict[str, str]:
        return {"status": "ok"}
