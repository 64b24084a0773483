from __future__ import annotations

import json
import shutil

import pytest
from pyspark.sql import functions as F

from loamdex.config import Settings, load_settings, save_settings
from loamdex.operators import dense, ingest, lexical
from loamdex.sources import catalog, files
from loamdex.sources.store import Store
from loamdex.streaming import index_stream


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def add(spark, store, rows, name=None):
    toks = lexical.tokenized(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id", "text")
    return store.write_segment(lexical.term_counts(toks), lexical.doc_lengths(toks), name)


def test_segments_are_published_merged_and_deleted(spark, store):
    assert store.list_segments() == [] and store.load_index().postings.count() == 0
    names = [add(spark, store, [(f"d{i}", f"word{i} shared")]) for i in range(4)]
    assert store.list_segments() == names
    index = store.load_index()
    assert index.stats.first()["total_documents"] == 4
    assert store.read_segment(names[0])[1].count() == 1
    made = store.merge_segments(2)
    assert len(made) == 1 and len(store.list_segments()) == 2
    after = store.load_index()
    assert after.stats.first() == index.stats.first()
    q = spark.createDataFrame([(1, "shared word3")], "query_id long, query string")
    assert lexical.search(after, q, 1).first()["doc_id"] == "d3"
    store.delete_segment(store.list_segments()[0])
    assert len(store.list_segments()) == 1
    assert store.manifest()["segments"][0]["total_terms"] > 0


def test_chunks_and_vectors(spark, store):
    c = spark.createDataFrame([("a", "t1"), ("a", "t0"), ("b", "t2")], "chunk_id string, text string")
    store.save_chunks(c)
    store.save_chunks(spark.createDataFrame([("a", "later"), ("c", "t3")], c.schema))
    assert {r["chunk_id"]: r["text"] for r in store.chunks().collect()} == {"a": "t0", "b": "t2", "c": "t3"}
    assert store.get_chunk("b").first()["text"] == "t2" and store.get_chunk("zz").count() == 0
    v = spark.createDataFrame([("a", [1.0, 0.0])], "doc_id string, embedding array<float>")
    store.save_vectors(v)
    with pytest.raises(ValueError):
        store.save_vectors(v)
    assert store.load_metadata() is None
    store.save_metadata(model="m", dimension=2)
    store.save_metadata(model="n", dimension=2)
    assert store.load_metadata() == {"model": "n", "dimension": 2}
    assert store.metrics().first().asDict() == {"chunks": 3, "vectors": 1, "documents": 0, "terms": 0}


def source(spark):
    return spark.createDataFrame(
        [("s", ["x"], ["https://x/docs/"], [], [], 3, (["main"], ["h1"], ["nav a"], ["pre"], ["footer"]))],
        "source_id string, allowed_domains array<string>, seed_urls array<string>, allowed_path_prefixes array<string>, blocked_path_patterns array<string>, max_depth int, "
        "scraper struct<main_content_selectors:array<string>,title_selectors:array<string>,breadcrumb_selectors:array<string>,code_block_selectors:array<string>,exclude_selectors:array<string>>",
    )


def pages(spark, n=3):
    html = lambda i: f"<nav><a href='p{i + 1}'>Up</a></nav><main><h1>Page {i}</h1><p>{' '.join(f'word{k}x{i}' for k in range(40))}</p></main>"
    rows = [(i, "https://x/docs/" if i == 0 else f"https://x/docs/p{i}", html(i), 200, i) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, status_code int, fetched_at int")


def test_ingest_twice_then_search_and_ask(spark, store):
    settings, load = Settings(chunk_words=20, overlap_words=4, dimension=16), dense.hashing_encoder(16)
    one = ingest.ingest_source(store, source(spark), pages(spark), "s", load, settings)
    assert (one.pages, one.documents, one.chunks, one.new_chunks, one.lexical, one.vectors) == (3, 3, 9, 9, 9, 9)
    two = ingest.ingest_source(store, source(spark), pages(spark), "s", load, settings)
    assert (two.chunks, two.new_chunks, two.lexical, two.vectors) == (9, 0, 0, 0)
    three = ingest.ingest_source(store, source(spark), pages(spark, 4), "s", load, settings)
    assert three.new_chunks == 3
    assert store.load_index().lengths.count() == store.vectors().count() == 12
    q = spark.createDataFrame([(1, "word7x2")], "query_id long, query string")
    best = ingest.search_store(store, q, load, 3, settings).orderBy("rank").first()
    assert best["url"] == "https://x/docs/p2"
    got = ingest.ask(store, q, load, lambda m: {"answer": "yes", "model": "stub"}, settings).first()
    assert got["answer"] == "yes" and got["sources"][0]["url"] == "https://x/docs/p2"
    with pytest.raises(KeyError):
        ingest.ingest_source(store, source(spark), pages(spark), "unknown", load, settings)
    with pytest.raises(ValueError):
        ingest.search_store(store, spark.createDataFrame([(1, " ")], q.schema), load, 3, settings)


def test_uploads(spark, store, tmp_path):
    (tmp_path / "note.md").write_bytes(b"hello \xff\xe2\x28 world")
    (tmp_path / "odd.exe").write_bytes(b"x")
    got = files.read_files(spark, f"file://{tmp_path}/note.md").first()
    assert got["text"] == b"hello \xff\xe2\x28 world".decode("utf-8", "replace") and got["title"] == "note" and got["url"] == "upload://note.md"
    with pytest.raises(Exception, match="unsupported"):
        files.read_files(spark, f"file://{tmp_path}/odd.exe").collect()
    assert files.read_files(spark, f"file://{tmp_path}/odd.exe", strict=False).first()["text"] is None
    raw = spark.createDataFrame([("/up/note.txt", bytearray(b"some words to index"))], "path string, content binary")
    report = ingest.upload(store, raw, "up", dense.hashing_encoder(8), Settings(dimension=8))
    assert report.new_chunks == 1 and store.chunks().first()["url"] == "upload://note.txt"
    with pytest.raises(ValueError):
        ingest.upload(store, spark.createDataFrame([("/up/e.txt", bytearray(b"  "))], raw.schema), "up", dense.hashing_encoder(8), Settings(dimension=8))


def test_docx():
    from io import BytesIO
    from zipfile import ZipFile

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    buffer = BytesIO()
    with ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/></w:body></w:document>")
    assert files.docx_text(buffer.getvalue()) == "One\ttwo\n"


def test_catalog(spark, tmp_path):
    scraper = {k: [] for k in ("main_content_selectors", "title_selectors", "breadcrumb_selectors", "code_block_selectors", "exclude_selectors")}
    one = {"source_id": "a", "source_name": "A", "base_url": "u", "allowed_domains": [], "seed_urls": ["s"], "allowed_path_prefixes": [], "blocked_path_patterns": [], "max_depth": 1, "use_browser_fallback": False, "technology": [], "scraper": scraper}
    path = tmp_path / "sources.json"
    path.write_text(json.dumps([one, one | {"source_id": "b"}, one | {"max_depth": 5}]))
    got = catalog.load_catalog(spark, f"file://{path}")
    assert {r["source_id"]: r["max_depth"] for r in got.collect()} == {"a": 5, "b": 1}
    assert catalog.exists(got, "a") and not catalog.exists(got, "z")
    assert catalog.field_of(got, "a", "max_depth").first()["max_depth"] == 5
    with pytest.raises(KeyError):
        catalog.get_source(got, "z")


def test_stream_equals_batch_and_a_replay_changes_nothing(spark, store, tmp_path):
    rows = [(f"d{i}", f"some words number{i} shared") for i in range(30)] + [("d1", "again"), ("blank", " ")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    df.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = index_stream.read_stream(spark, f"file://{tmp_path}/in", df.schema)
    settings = Settings(dimension=8)
    index_stream.index_stream(store, stream, f"file://{tmp_path}/cp", settings, dense.hashing_encoder(8), drain=True).awaitTermination()
    assert store.load_index().lengths.count() == 30 and store.vectors().count() == 30
    before = store.load_index().stats.first()
    index_stream.index_batch(store, df, 0, index_stream.stream_id(store, f"file://{tmp_path}/cp"), settings, dense.hashing_encoder(8))
    index_stream.index_batch(store, df, 9, "another", settings, dense.hashing_encoder(8))
    assert store.load_index().stats.first()["total_documents"] == before["total_documents"]
    assert store.load_index().postings.groupBy("term", "doc_id").count().where("count > 1").count() == 0


def test_windowed_counts(spark):
    from datetime import datetime

    df = spark.createDataFrame([(datetime(2024, 1, 1, 5, 3), "a"), (datetime(2024, 1, 1, 5, 59), "a"), (datetime(2024, 1, 1, 6, 0), "b")], "ts timestamp, kind string")
    got = index_stream.windowed_counts(df, "ts", "kind").select(F.hour("window_start"), "kind", "n").collect()
    assert sorted(tuple(r) for r in got) == [(5, "a", 2), (6, "b", 1)]


def test_settings(tmp_path, monkeypatch):
    assert Settings().check().update(bm25_weight=0.5, vector_weight=0.5).rrf_k == 60
    for bad in ({"bm25_weight": 0.5}, {"temperature": 2.5}, {"model": " "}, {"overlap_words": 256}, {"max_segments": 1}, {"bm25_b": 1.5}, {"fetch_k": 0}, {"bm25_weight": -0.1, "vector_weight": 1.1}):
        with pytest.raises(ValueError):
            Settings().update(**bad)
    with pytest.raises(TypeError):
        Settings().update(nope=1)
    path = tmp_path / "c.json"
    assert load_settings(path) == {}
    assert save_settings(Settings(), path) and Settings(**load_settings(path)) == Settings()
    path.write_text("{broken")
    assert load_settings(path) == {}
    assert not save_settings(Settings(), tmp_path / "no" / "c.json")
    monkeypatch.setenv("LOAMDEX_RRF_K", "10")
    assert Settings.from_environment().rrf_k == 10
    monkeypatch.setenv("LOAMDEX_RRF_K", "x")
    with pytest.raises(ValueError):
        Settings.from_environment()


def test_pipeline_fills_both_indexes_from_all_sources_and_a_second_run_adds_nothing(spark, tiny):
    from loamdex.plans.queries import crawl_pages, ingest_pipeline

    rows = ingest_pipeline(spark, tiny).collect()
    first, second = ([r for r in rows if r["run"] == n] for n in (1, 2))
    sources = {r["source_id"] for r in spark.read.parquet(f"{tiny}/source_configs.parquet").collect()}
    assert [{r["source_id"] for r in run} for run in (first, second)] == [sources, sources]
    reached = {r["source_id"]: r["count"] for r in crawl_pages(spark, tiny).groupBy("source_id").count().collect()}
    assert {r["source_id"]: r["pages"] for r in first if r["pages"]} == reached
    for name in ("pages", "documents", "chunks", "new_chunks", "lexical", "vectors"):
        assert sum(r[name] for r in first) > 0
    assert all(r["lexical"] <= r["new_chunks"] == r["vectors"] for r in first)
    for a, b in zip(first, second):
        assert (b["pages"], b["documents"], b["chunks"]) == (a["pages"], a["documents"], a["chunks"])
        assert (b["new_chunks"], b["lexical"], b["vectors"]) == (0, 0, 0)


def drain(spark, store, folder, checkpoint, settings=None):
    stream = index_stream.read_stream(spark, folder, spark.read.parquet(folder).schema)
    index_stream.index_stream(store, stream, checkpoint, settings, drain=True).awaitTermination()


def test_two_streams_and_a_lost_checkpoint_keep_all_documents(spark, store, tmp_path):
    for n in range(2):
        rows = [(f"s{n}d{i}", f"words of stream {n} number{i}") for i in range(10)]
        spark.createDataFrame(rows, "doc_id string, text string").write.parquet(f"file://{tmp_path}/in{n}")
        drain(spark, store, f"file://{tmp_path}/in{n}", f"file://{tmp_path}/cp{n}")
    assert store.load_index().lengths.count() == 20
    shutil.rmtree(tmp_path / "cp0")
    more = spark.createDataFrame([(f"late{i}", f"later words {i}") for i in range(5)], "doc_id string, text string")
    more.write.mode("append").parquet(f"file://{tmp_path}/in0")
    drain(spark, store, f"file://{tmp_path}/in0", f"file://{tmp_path}/cp0")
    index = store.load_index()
    assert index.lengths.count() == 25 and index.lengths.select("doc_id").distinct().count() == 25


def test_a_stream_flushes_by_count_and_merges(spark, store, tmp_path):
    rows = [(f"d{i:02d}", f"word{i} shared") for i in range(23)]
    spark.createDataFrame(rows, "doc_id string, text string").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    drain(spark, store, f"file://{tmp_path}/in", f"file://{tmp_path}/cp", Settings(buffer_docs=5, max_segments=50))
    assert [s["total_documents"] for s in store.manifest()["segments"]] == [5, 5, 5, 5, 3]
    spark.createDataFrame([("x", "one more")], "doc_id string, text string").write.mode("append").parquet(f"file://{tmp_path}/in")
    drain(spark, store, f"file://{tmp_path}/in", f"file://{tmp_path}/cp", Settings(buffer_docs=5, max_segments=3))
    assert len(store.list_segments()) <= 3 and store.load_index().stats.first()["total_documents"] == 24


def test_two_writers_lose_no_update_and_a_failed_publish_shows_nothing(spark, store, monkeypatch):
    add(spark, store, [("a", "first words")], "one")
    other = Store(spark, store.root)
    number = store._latest()
    create, calls = Store._create, []

    def slow(self, n, manifest):  # another writer publishes between reading and creating
        if not calls:
            calls.append(n)
            add(spark, other, [("b", "second words")], "two")
        return create(self, n, manifest)

    monkeypatch.setattr(Store, "_create", slow)
    add(spark, store, [("c", "third words")], "three")
    monkeypatch.undo()
    assert sorted(store.list_segments()) == ["one", "three", "two"] and store._latest() == number + 2

    def broken(self, n, manifest):
        raise OSError("disk")

    monkeypatch.setattr(Store, "_create", broken)
    with pytest.raises(OSError):
        store.delete_segment("one")
    monkeypatch.undo()
    assert len(Store(spark, store.root).list_segments()) == 3
    assert not store._create(number, {})  # a taken number
    assert store.load_index().stats.first()["total_documents"] == 3


def test_a_merge_of_segments_that_are_gone_is_an_error(spark, store):
    for name in ("one", "two"):
        add(spark, store, [(name, "some words")], name)
    postings, lengths = store.read_segment("one")
    store.delete_segment("two")
    with pytest.raises(ValueError):
        store.write_segment(postings, lengths, "merged", ["one", "two"])
    with pytest.raises(ValueError):
        store.write_segment(postings, lengths, "one")
    assert store.list_segments() == ["one"]


def test_vectors_that_another_writer_added_meanwhile_are_seen(spark, store, monkeypatch):
    v = lambda i: spark.createDataFrame([(i, [1.0, 0.0])], "doc_id string, embedding array<float>")
    commit, calls = Store._commit, []

    def slow(self, change):
        if not calls:
            calls.append(1)
            Store(spark, store.root).save_vectors(v("b"))
        return commit(self, change)

    monkeypatch.setattr(Store, "_commit", slow)
    store.save_vectors(v("a"))
    assert store.doc_exists("a") and store.doc_exists("b") and not store.doc_exists("c")
    calls.clear()
    with pytest.raises(ValueError):
        store.save_vectors(v("b"))


def test_stored_lists_and_later_vectors_are_searched_together(spark, store):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(10, 16))[np.arange(300) % 10] + 0.3 * rng.normal(size=(300, 16))
    rows = [(f"v{i:03d}", (r / np.linalg.norm(r)).tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id string, embedding array<float>")
    q = df.where("doc_id < 'v020'").select(F.substring("doc_id", 2, 3).cast("long").alias("query_id"), F.col("embedding").alias("query_vector"))
    store.save_vectors(df.where("doc_id < 'v200'"))
    store.index_vectors(8)
    store.save_vectors(df.where("doc_id >= 'v200'"))
    want = {tuple(r)[:2] for r in dense.exact_top_k(df, q, 10).collect()}
    got = store.search_vectors(q, 10, 4).collect()
    assert len(got) == 200 and len({tuple(r)[:2] for r in got} & want) >= 180
    assert any(d < "v200" for _, d in want) and any(r["doc_id"] >= "v200" for r in got)
    store.index_vectors(8)
    assert len({tuple(r)[:2] for r in store.search_vectors(q, 10, 4).collect()} & want) >= 180
