from __future__ import annotations

import random

import numpy as np
import pytest

from loamdex.llm.contamination import edit_distance, embed, leaks
from loamdex.llm.hashing import words_of

ITEM = " ".join(f"item{i}" for i in range(30))


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int, edits string")
    i = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    return {(r["doc_id"], r["item_id"]): r["edits"] for r in leaks(d, i, **kw).collect()}


def brute(docs, items, n=12):
    out = set()
    for d, text in docs:
        w = words_of(text)
        for i, item in items:
            q = words_of(item)
            m = min(n, len(q))
            grams = {tuple(q[k : k + m]) for k in range(len(q) - m + 1)} if m else set()
            if any(tuple(w[k : k + m]) in grams for k in range(len(w) - m + 1)):
                out.add((d, i))
    return out


def test_twelve_words_leak_and_eleven_do_not(spark):
    w = ITEM.split()
    docs = [(1, "before " + " ".join(w[5:17]) + " after", 0, ""), (2, " ".join(w[5:16]), 0, ""), (3, ITEM.upper().replace(" ", " ** "), 0, "")]
    assert run(spark, docs, [(7, ITEM, 0)]) == {(1, 7): 0, (3, 7): 0}


def test_short_items_need_all_words_without_a_gap(spark):
    docs = [(1, "so how does it end here", 0, ""), (2, "how does that it end", 0, ""), (3, "how does it", 0, "")]
    assert run(spark, docs, [(1, "How does it end?", 0), (2, "...", 0), (3, None, 0), (4, "", 0)]) == {(1, 1): 0}


def test_nulls_ties_repeats_empty_and_very_long(spark):
    long = "filler " * 100_000 + ITEM
    docs = [(1, None, 0, ""), (2, "", 0, ""), (3, long, 0, ""), (4, ITEM + " " + ITEM, 0, ""), (4, ITEM, 0, "")]
    assert run(spark, docs, [(1, ITEM, 0), (2, ITEM, 0)]) == {(d, i): 0 for d in (3, 4) for i in (1, 2)}
    assert run(spark, [], [(1, ITEM, 0)]) == {} and run(spark, docs, []) == {}


def test_edits_are_found_and_counted(spark):
    w = ITEM.split()
    variants = [w[:6] + ["x"] + w[7:13], w[:5] + ["x"] + w[5:12], w[:4] + w[5:13]]
    docs = [(i, "start " + " ".join(v) + " stop", 0, "") for i, v in enumerate(variants)]
    assert run(spark, docs, [(1, " ".join(w[:13]), 0)]) == {}
    assert set(run(spark, docs, [(1, " ".join(w[:13]), 0)], edits=1)) == {(0, 1), (1, 1), (2, 1)}


def test_recall_of_edited_passages(spark):
    rng = random.Random(5)
    items, docs = [], []
    for i in range(60):
        w = [f"q{rng.randrange(10**6)}" for _ in range(12)]
        items.append((i, " ".join(w), 0))
        k = rng.randrange(1, 11)
        docs.append((i, " ".join(f"f{rng.randrange(10**6)}" for _ in range(20)) + " " + " ".join(w[:k] + ["edit"] + w[k + 1 :]), 0, ""))
    got = run(spark, docs, items, edits=1)
    assert sum((i, i) in got for i in range(60)) >= 54


def test_embedding_is_the_same_for_equal_windows_and_many_items_come_in_blocks(spark, monkeypatch):
    h = np.arange(1, 30, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    twice = np.concatenate([h, h])
    out = embed(twice, np.array([0, 29]), 12, np.array([0, 3, 9]), 5)
    assert (out[:, 0] == out[:, 1]).all() and out[0, 0] == h[0]
    monkeypatch.setattr("loamdex.llm.contamination.MOST_ITEMS", 1)
    docs = [(1, "one two three", 0, ""), (2, "three", 0, "")]
    items = [(i, w, 0) for i, w in enumerate(("one", "two", "three", "four"))]
    assert run(spark, docs, items) == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (2, 2): 0}


def test_edit_distance():
    a = list("kitten")
    assert edit_distance(a, list("sitting"), 3) == 3 and edit_distance(a, list("sitting"), 2) == 3 and edit_distance(a, a, 0) == 0


def test_edit_distance_against_the_plain_recursion():
    from functools import lru_cache

    def plain(a, b):
        @lru_cache(None)
        def d(i, j):
            if not i or not j:
                return i + j
            return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

        return d(len(a), len(b))

    rng = random.Random(8)
    for _ in range(400):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        for most in range(4):
            assert edit_distance(a, b, most) == min(plain(tuple(a), tuple(b)), most + 1)


def test_same_as_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    items = spark.read.parquet(f"{tiny}/test_items.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()}
    pairs = lambda df, k: [(r[k], r["text"]) for r in df.select(k, "text").collect()]
    assert got == brute(pairs(docs, "doc_id"), pairs(items, "item_id"))


def test_edits_of_the_ends_and_of_short_items_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: f"q{rng.randrange(10**6)}"
    items, docs, ends = [], [], set()
    lengths = (4, 5, 7, 9, 11, 12, 13, 20, 40)
    for length in lengths:
        for at in range(length):
            for kind in ("replaced", "deleted", "inserted"):
                for before, after in ((0, 0), (0, 5), (5, 0), (5, 5)):
                    w, n = [word() for _ in range(length)], len(items)
                    change = {"replaced": ["edit"], "deleted": [], "inserted": ["edit", w[at]]}[kind]
                    text = [word() for _ in range(before)] + w[:at] + change + w[at + 1 :] + [word() for _ in range(after)]
                    items.append((n, " ".join(w), 0))
                    docs.append((n, " ".join(text), 0, ""))
                    if at == 0:
                        ends.add((n, n))
    got = run(spark, docs, items, edits=1)
    assert set(got) <= {(n, n) for n in range(len(items))}
    for (n, _), d in got.items():  # each is there, with as few edits as brute force over all stretches finds
        if n % 7 == 0:
            text, item = docs[n][1].split(), items[n][1].split()
            size = min(12, len(item))
            cost = lambda k: min(edit_distance(text[a:b], item[k : k + size], 1) for a in range(len(text)) for b in range(a + size - 1, min(len(text), a + size + 1) + 1))
            assert d == min(cost(k) for k in range(len(item) - size + 1))
    assert ends <= set(got)
    by_length = {m: [(n, n) in got for n, item, _ in items if len(item.split()) == m] for m in lengths}
    assert all(sum(hit) >= 0.95 * len(hit) for hit in by_length.values()), {m: sum(hit) / len(hit) for m, hit in by_length.items()}
    few = run(spark, [(1, "one two four", 0, ""), (2, "one two three", 0, "")], [(1, "one two three", 0)], edits=1)
    assert few == {(2, 1): 0}
