"""Settings with the same defaults and checks for every component."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """All parameters of the engine; :meth:`check` rejects what cannot work."""

    chunk_words: int = 256
    overlap_words: int = 32
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_k: int = 60
    bm25_weight: float = 0.3
    vector_weight: float = 0.7
    fetch_k: int = 50
    dimension: int = 384
    buffer_docs: int = 10_000
    max_segments: int = 5
    flush_seconds: int = 30
    vector_batch: int = 128
    rerank_candidates: int = 30
    context_chunks: int = 15
    temperature: float = 0.2
    model: str = "default"
    use_reranker: bool = True

    def check(self) -> "Settings":
        for name in ("chunk_words", "rrf_k", "fetch_k", "dimension", "buffer_docs", "flush_seconds", "vector_batch", "rerank_candidates", "context_chunks"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not 0 <= self.overlap_words < self.chunk_words:
            raise ValueError("overlap_words must be at least 0 and less than chunk_words")
        if self.bm25_k1 < 0 or not 0 <= self.bm25_b <= 1:
            raise ValueError("bm25_k1 must not be negative and bm25_b lie between 0 and 1")
        if self.max_segments < 2:
            raise ValueError("max_segments must be 2 or more")
        for name in ("bm25_weight", "vector_weight"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if abs(self.bm25_weight + self.vector_weight - 1) > 1e-6:
            raise ValueError("the weights must sum to 1")
        if not 0 <= self.temperature <= 2:
            raise ValueError("temperature must lie between 0 and 2")
        if not self.model.strip():
            raise ValueError("model must not be empty")
        return self

    def update(self, **changes) -> "Settings":
        """A checked copy with some values replaced; unknown names are an error."""
        return replace(self, **changes).check()

    @classmethod
    def from_environment(cls, prefix: str = "LOAMDEX_") -> "Settings":
        """Defaults overridden by variables such as ``LOAMDEX_BM25_K1``."""
        found = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(f.default)
                try:
                    found[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
                except ValueError as e:
                    raise ValueError(f"{prefix}{f.name.upper()} must be a {kind.__name__}") from e
        return cls(**found).check()


def load_settings(path: str | Path) -> dict:
    """The stored settings; an empty dict if the file is missing or broken."""
    try:
        got = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return got if isinstance(got, dict) else {}


def save_settings(settings: Settings, path: str | Path) -> bool:
    """Write the settings; False instead of an error if that fails."""
    try:
        Path(path).write_text(json.dumps(asdict(settings), indent=2), encoding="utf-8")
    except OSError:
        return False
    return True
