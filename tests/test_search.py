from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamdex.operators import chunking, crawl, dense, fusion, relational, rerank


def test_windows(spark):
    df = spark.createDataFrame([("s", "u", " ".join(f"w{i}" for i in range(12)), 1), ("s", "v", " \n", 1), ("s", "w", None, 1)], "source_id string, url string, content string, n int")
    got = chunking.chunk_documents(df, 5, 1).orderBy("chunk_index").collect()
    assert [r["chunk_text"] for r in got] == ["w0 w1 w2 w3 w4", "w4 w5 w6 w7 w8", "w8 w9 w10 w11"]
    assert got[1]["chunk_id"].endswith(":1")
    with pytest.raises(ValueError):
        chunking.chunk_documents(df, 5, 5)


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (4, 1), (5, 2), (8, 2), (9, 3), (10, 3)])
def test_window_edges(spark, n, want):
    df = spark.createDataFrame([("s", "u", " ".join("x" * n))], "source_id string, url string, content string")
    assert chunking.chunk_documents(df, 5, 1).count() == want
    assert chunking.window_counts(spark.createDataFrame([(n,)], "n_words int"), 5, 1).first()["expected_chunks"] == want


def lists(spark, *ranked):
    return fusion.ranked_lists([spark.createDataFrame([(1, x, i) for i, x in enumerate(r, 1)], "query_id long, doc_id string, rank int") for r in ranked])


def test_fusion(spark):
    got = fusion.fuse(lists(spark, ["a", "b"], ["b", "c"])).collect()
    assert [r["doc_id"] for r in got] == ["b", "a", "c"]
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-12)
    assert [r["doc_id"] for r in fusion.fuse(lists(spark, ["a"], ["b"]), weights=[0.3, 0.7], n_lists=2).collect()] == ["b", "a"]
    # ties keep the order of first appearance; repeats count each time; empty lists are fine
    assert [r["doc_id"] for r in fusion.fuse(lists(spark, ["z"], ["a"])).collect()] == ["z", "a"]
    assert fusion.fuse(lists(spark, ["a", "a"], [])).first()["score"] == pytest.approx(1 / 61 + 1 / 62)
    assert fusion.fuse(lists(spark, [], [])).count() == 0
    assert fusion.fuse(lists(spark, ["a"], []), k=10).first()["score"] == pytest.approx(1 / 11)
    with pytest.raises(ValueError):
        fusion.fuse(lists(spark, ["a"]), weights=[1.0], n_lists=2)


def test_blank_queries(spark):
    for text in ("", " \u3000", None):
        with pytest.raises(ValueError):
            fusion.require_text(spark.createDataFrame([(1, text)], "query_id long, query string"))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, embedding array<float>")


def test_exact_search_ties_dimension_and_zero(spark):
    v = vectors(spark, [("b", [1.0, 0.0, 0.0, 0.0]), ("a", [1.0, 0.0, 0.0, 0.0]), ("z", [0.0] * 4), ("short", [1.0])])
    q = spark.createDataFrame([(1, [2.0, 0.0, 0.0, 0.0])], "query_id long, query_vector array<float>")
    got = dense.exact_top_k(v, q, 3).collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [("a", 2.0), ("b", 2.0), ("z", 0.0)]
    with pytest.raises(Exception, match="expected dimension 4"):
        dense.check_dimension(v, "embedding", 4).collect()


def test_exact_search_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 3)), 0)  # many ties
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:40])], "query_id long, query_vector array<float>")
    want = {i: [int(j) for j in np.lexsort((np.arange(300), -(x @ x[i])))[:7]] for i in range(40)}
    for block in (40, 6):
        got: dict[int, list[int]] = {}
        for r in dense.exact_top_k(v, q, 7, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == want
    assert dense.exact_top_k(v, q.limit(0), 7).count() == 0 and dense.exact_top_k(v.limit(0), q, 7).count() == 0


def test_inverted_lists_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 16))[np.arange(600) % 12] + 0.3 * rng.normal(size=(600, 16))
    v = dense.normalize(vectors(spark, [(f"{i:03d}", r.tolist()) for i, r in enumerate(x)]))
    q = v.where("doc_id < '030'").select(F.col("doc_id").cast("long").alias("query_id"), F.col("embedding").alias("query_vector"))
    lists_ = dense.InvertedLists.fit(v, 12)
    found = {tuple(r)[:2] for r in lists_.search(lists_.index(v), q, 10, 4).select("query_id", "doc_id").collect()}
    want = {tuple(r)[:2] for r in dense.exact_top_k(v, q, 10).select("query_id", "doc_id").collect()}
    assert len(found & want) >= 0.9 * len(want)
    with pytest.raises(ValueError):
        dense.InvertedLists.fit(v.limit(0))


def test_positions(spark):
    got = dense.positions(spark.createDataFrame([(f"d{i:03d}",) for i in range(100)], "doc_id string"), buckets=4).collect()
    assert sorted((r["position"], r["doc_id"]) for r in got) == [(i, f"d{i:03d}") for i in range(100)]


def test_encoder(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b a")], "id long, text string")
    got = dense.encode(df, "text", dense.hashing_encoder(8), 8).collect()
    assert got[0]["embedding"] == got[1]["embedding"] and np.linalg.norm(got[0]["embedding"]) == pytest.approx(1)
    with pytest.raises(Exception, match="blank"):
        dense.encode(spark.createDataFrame([(1, " ")], df.schema), "text", dense.hashing_encoder(8), 8).collect()
    with pytest.raises(Exception, match="expected dimension"):
        dense.encode(df, "text", dense.hashing_encoder(8), 9).collect()


def test_relational(spark):
    stored = spark.createDataFrame([("a", 1, "old")], "chunk_id string, v int, text string")
    new = spark.createDataFrame([("a", 2, "new"), ("b", 3, "x"), ("b", 2, "w")], stored.schema)
    ids = lambda df: sorted(tuple(r) for r in df.collect())
    assert ids(relational.insert_ignore(new, stored, order=[F.col("v")])) == [("b", 2, "w")]
    assert ids(relational.insert_ignore(new.limit(0), stored)) == []
    assert ids(relational.upsert(new, stored, "chunk_id", "v")) == [("a", 2, "new"), ("b", 3, "x")]
    assert ids(relational.existing(new, stored)) == [("a",)] and ids(relational.by_ids(stored, new)) == [("a", 1, "old")]
    hits = spark.createDataFrame([(1, "a", 1), (1, "gone", 2)], "query_id long, doc_id string, rank int")
    assert [r["text"] for r in relational.enrich(hits, stored).collect()] == ["old"]
    assert [r["text"] for r in relational.enrich(hits, stored, n_hits=2).collect()] == ["old"]


def test_rerank_and_prompt(spark):
    c = spark.createDataFrame(
        [(1, "q lock cache", "a", "A", "ua", "nothing", 0.9, 1), (1, "q lock cache", "b", "B", "ub", "a cache lock", 0.1, 2)],
        "query_id long, query string, doc_id string, title string, url string, text string, score double, rank int",
    )
    best = rerank.rerank(c, 2)
    assert [(r["doc_id"], r["rank"]) for r in best.collect()] == [("b", 1), ("a", 2)]
    assert rerank.rerank(c.limit(0), 2).count() == 0
    scored = rerank.rerank(c, 1, rerank.model_score(lambda: lambda q, t: [float(len(x)) for x in t]))
    assert [r["doc_id"] for r in scored.collect()] == ["b"]
    messages = rerank.prompts(best).first()["messages"]
    assert messages[0]["role"] == "system"
    assert messages[1]["content"].startswith("Contexto de la documentación:\n\n[1] B\nSource: ub\n\na cache lock\n\n---\n\n[2] A\n")
    assert messages[1]["content"].endswith("\n\n---\n\nPregunta: q lock cache")
    gaps = spark.createDataFrame([(1, "q", 1, None, "u", "text"), (1, "q", 2, "T", None, None)], "query_id long, query string, rank int, title string, url string, text string")
    said = rerank.prompts(gaps).first()["messages"][1]["content"]
    assert "[1] \nSource: u\n\ntext\n\n---\n\n[2] T\nSource: \n\n\n\n---\n\nPregunta: q" in said
    got = rerank.answer(rerank.prompts(best), lambda m: {"answer": str(len(m)), "model": "stub"}).first()
    assert (got["answer"], got["prompt_tokens"]) == ("2", 0)


def test_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "node string")
    assert {r["node"]: r["depth"] for r in crawl.reach(seeds, edges, 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r["node"] for r in crawl.reach(seeds, edges, 0).collect()} == {"a"}


def test_crawl(spark):
    page = lambda *links: "".join(f'<a href="{x}">x</a>' for x in links)
    pages = [
        (1, "https://x/docs/", page("a", "/private", "https://y/", "b?q"), 200), (2, "https://x/docs/a", page("c"), 200), (3, "https://x/docs/b", page(), 404),
        (4, "https://x/docs/c", page("d"), 200), (5, "https://x/docs/d", page(), 200), (6, "https://x/private", page(), 200), (7, "https://x/docs/a#z", page("c"), 200),
    ]
    p = spark.createDataFrame([(*r, i) for i, r in enumerate(pages)], "page_id long, url string, html string, status_code int, fetched_at int")
    s = spark.createDataFrame(
        [("s", ["x"], ["https://x/docs/", "https://y/no"], ["/docs"], [], 2)],
        "source_id string, allowed_domains array<string>, seed_urls array<string>, allowed_path_prefixes array<string>, blocked_path_patterns array<string>, max_depth int",
    )
    got = {r["url"]: r["depth"] for r in crawl.crawl(s, p).collect()}
    assert got == {"https://x/docs/": 0, "https://x/docs/a": 1, "https://x/docs/c": 2}
