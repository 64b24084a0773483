from __future__ import annotations

import pytest
from test_store import pages, source

from loamdex.api import Engine
from loamdex.config import Settings
from loamdex.operators.dense import hashing_encoder
from loamdex.sources.store import Store


def test_engine(spark, tmp_path):
    settings = Settings(chunk_words=20, overlap_words=4, dimension=16, max_segments=2)
    store = Store(spark, f"file://{tmp_path}/store")
    engine = Engine(store, source(spark), pages(spark), hashing_encoder(16), lambda m: {"answer": "yes"}, settings, tmp_path / "settings.json")
    assert engine.health() == {"status": "ok"}
    assert engine.ingest("s").new_chunks == 9
    assert engine.metrics().first()["chunks"] == 9
    assert engine.search("word7x2", 3).orderBy("rank").first()["url"] == "https://x/docs/p2"
    assert engine.search_bm25(["word7x2", "the of"]).count() == 1
    assert engine.search_vector("word7x2 word8x2", 2).count() == 2
    assert engine.ask("word7x2").first()["answer"] == "yes"
    for n in range(3):
        engine.index_document(f"extra{n}", ["token", "other"])
    assert len(store.list_segments()) <= 2 and engine.merge() == []
    with pytest.raises(ValueError):
        engine.index_document("extra1", ["token"])
    with pytest.raises(ValueError):
        engine.index_document("x", [])
    engine.index_vector("extra0", "some text")
    for call in (lambda: engine.index_vector("extra0", "some text"), lambda: engine.index_vector("y", " "), lambda: engine.search("a", 51), lambda: engine.search(" "), lambda: engine.search_bm25("a", 0)):
        with pytest.raises(ValueError):
            call()
    (tmp_path / "a.txt").write_text("uploaded words")
    (tmp_path / "a.exe").write_text("x")
    assert engine.upload(f"file://{tmp_path}/a.txt", "up").new_chunks == 1
    with pytest.raises(ValueError):
        engine.upload(f"file://{tmp_path}/a.exe", "up")
    with pytest.raises(KeyError):
        engine.ingest("nope")
    engine.update_settings(bm25_weight=0.5, vector_weight=0.5)
    with pytest.raises(ValueError):
        engine.update_settings(bm25_weight=0.9)
    again = Engine(store, source(spark), pages(spark), hashing_encoder(16), None, Settings(), tmp_path / "settings.json")
    assert again.settings.bm25_weight == 0.5
    with pytest.raises(ValueError):
        again.ask("x")
