from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from loamdex.operators import lexical, segments

DOCS = [("a", "cache lock cache"), ("b", "lock index"), ("c", "the of and"), ("d", None), ("e", "cache lock index buffer buffer")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(*r, "t") for r in rows], "doc_id string, text string, term string")


def score(tf, length, avgdl, df, n, k1=1.5, b=0.75):
    return math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


def test_index_of_a_few_documents(spark):
    index = lexical.build_index(docs(spark), stem=False)
    assert {(r["doc_id"], r["term"]): r["tf"] for r in index.postings.collect()} == {
        ("a", "cache"): 2, ("a", "lock"): 1, ("b", "lock"): 1, ("b", "index"): 1, ("e", "cache"): 1, ("e", "lock"): 1, ("e", "index"): 1, ("e", "buffer"): 2,
    }
    assert index.stats.first().asDict() == {"total_documents": 3, "total_terms": 10, "average_document_length": pytest.approx(10 / 3)}
    sums = index.postings.groupBy("doc_id").agg(F.sum("tf").alias("s")).join(index.lengths, "doc_id")
    assert sums.where("s <> doc_length").count() == 0
    assert lexical.build_index(docs(spark, [("x", None)])).stats.first()["average_document_length"] == 0


def test_search_scores_by_the_formula(spark):
    index = lexical.build_index(docs(spark), stem=False)
    q = spark.createDataFrame([(1, "cache Cache lock unknown"), (2, "of the"), (3, None)], "query_id long, query string")
    got = lexical.search(index, q, 2, stem=False).collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in got] == [(1, "a", 1), (1, "e", 2)]
    want = 2 * score(2, 3, 10 / 3, 2, 3) + score(1, 3, 10 / 3, 3, 3)
    assert got[0]["score"] == pytest.approx(want, abs=1e-10)


def test_ties_go_to_the_smaller_id_and_lengths_may_miss(spark):
    index = lexical.build_index(docs(spark, [("b", "word"), ("a", "word"), ("c", "word")]), stem=False)
    q = spark.createDataFrame([(1, "word")], "query_id long, query string")
    assert [r["doc_id"] for r in lexical.search(index, q, 3, stem=False).collect()] == ["a", "b", "c"]
    cut = lexical.Index(index.postings, index.lengths.where("doc_id <> 'a'"), index.stats)
    assert [r["doc_id"] for r in lexical.search(cut, q, 3, stem=False).collect()] == ["b", "c"]


def test_stems_meet(spark):
    index = lexical.build_index(docs(spark, [("a", "decorators are running"), ("b", "nothing")]))
    q = spark.createDataFrame([(1, "decorated runs")], "query_id long, query string")
    assert [r["doc_id"] for r in lexical.search(index, q, 3).collect()] == ["a"]


@pytest.mark.parametrize(("tf", "df", "n"), [(0, 1, 1), (1, 0, 1), (1, 1, 0)])
def test_guards_of_the_score(spark, tf, df, n):
    row = spark.createDataFrame([(tf, df, n)], "tf int, df int, n int").select(lexical.bm25(F.col("tf"), F.lit(5), F.lit(5.0), F.col("df"), F.col("n"))).first()
    assert row[0] == 0


def test_properties_of_the_score(spark):
    one = lambda tf, dl, avg, df, n: spark.range(1).select(lexical.bm25(*(F.lit(x) for x in (tf, dl, avg, df, n)))).first()[0]
    base = one(1, 100, 100.0, 10, 1000)
    assert one(2, 100, 100.0, 10, 1000) > base > one(1, 200, 100.0, 10, 1000) > 0
    assert one(1, 100, 100.0, 100, 1000) < base
    assert one(1, 1, 0.0, 1, 10) == pytest.approx(score(1, 1, 1, 1, 10))


def test_uniqueness(spark):
    with pytest.raises(ValueError):
        lexical.require_unique(docs(spark, [("a", "x"), ("a", "y")]))
    assert lexical.require_unique(docs(spark)).count() == 5


def test_running_statistics(spark):
    rows = [(i, i % 7 + 1) for i in range(500)]
    got = lexical.running_stats(spark.createDataFrame(rows, "doc_id long, doc_length int"), 5).orderBy("doc_id").collect()
    total = 0
    for (i, n), r in zip(rows, got):
        total += n
        assert (r["doc_id"], r["total_documents"], r["total_terms"]) == (i, i + 1, total)


def test_segments(spark):
    toks = spark.createDataFrame([(f"d{i:02d}", ["w", f"x{i % 3}"]) for i in range(23)], "doc_id string, tokens array<string>")
    got = segments.assign_segments(toks, 5)
    assert {r["segment_id"]: r["count"] for r in got.groupBy("segment_id").count().collect()} == {f"seg-{k:09d}": 5 if k < 4 else 3 for k in range(5)}


@pytest.mark.parametrize(("n", "most", "want"), [(5, 3, 3), (3, 3, 0), (4, 3, 2), (9, 2, 8), (0, 2, 0)])
def test_merge_policy(spark, n, most, want):
    df = spark.createDataFrame([(f"s{i}",) for i in range(n)], "segment_id string")
    assert sorted(r[0] for r in segments.merge_candidates(df, most).collect()) == [f"s{i}" for i in range(want)]
    with pytest.raises(ValueError):
        segments.merge_candidates(df, 1)


def test_merge(spark):
    post = spark.createDataFrame([("s1", "t", "a", 1), ("s2", "t", "b", 2), ("s3", "t", "c", 1)], "segment_id string, term string, doc_id string, tf int")
    lens = spark.createDataFrame([("s1", "a", 1), ("s2", "b", 2), ("s3", "c", 1)], "segment_id string, doc_id string, doc_length int")
    two = F.col("segment_id").isin("s1", "s2")
    p, n = segments.merge(post.where(two), lens.where(two), "m")
    assert sorted((r["doc_id"], r["segment_id"]) for r in p.collect()) == [("a", "m"), ("b", "m")] and n.count() == 2
    assert segments.oldest(list("abcde"), 3) == list("abc") and segments.oldest(list("abc"), 3) == [] and segments.oldest(list("abcd"), 3) == ["a", "b"]
    with pytest.raises(ValueError):
        segments.merge(post, lens.unionByName(spark.createDataFrame([("s2", "a", 1)], lens.schema)), "m")
    assert segments.segment_name() < segments.segment_name()[:22] + "z"


def test_top_terms(spark):
    post = spark.createDataFrame([("t", "b", 2), ("t", "a", 1), ("u", "a", 5)], "term string, doc_id string, tf int")
    assert sorted(tuple(r) for r in segments.top_terms(post, 1).collect()) == [("t", 2, "a", 1), ("t", 2, "b", 2)]
