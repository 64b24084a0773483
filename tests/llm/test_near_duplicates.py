from __future__ import annotations

import random

import numpy as np
import pytest

from loamdex.llm.hashing import WordHashes, flat_words, pieces, ramp, shingles, words_of
from loamdex.llm.near_duplicates import budget_for, duplicate_groups, pairs_of


def _sets(texts: dict[int, str], width: int):
    out = {}
    for i, t in texts.items():
        w = words_of(t)
        if len(w) >= 10:
            out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    return out


def brute(texts: dict[int, str], threshold: float, width: int):
    s = _sets(texts, width)
    ids = sorted(s)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(s[a] & s[b]) >= threshold * len(s[a] | s[b])}


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id long, text string, n int, key string")
    members, links = duplicate_groups(df, **kw)
    return {(r["id_a"], r["id_b"]) for r in pairs_of(members, links).collect()}


def edited(rng: random.Random, words: list[str], edits: int) -> list[str]:
    w = list(words)
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k : k + rng.randrange(2)] = [f"new{rng.randrange(9999)}"]
    return w


def test_edited_copies_are_found_as_by_brute_force(spark):
    rng = random.Random(4)
    texts, n = {}, 0
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(80)]
        for edits in (0, 0, 1, 3, 6, 9):
            texts[n] = " ".join(edited(rng, base, edits))
            n += 1
    want = brute(texts, 0.6, 3)
    got = run(spark, [(i, t, 1, "k") for i, t in texts.items()], threshold=0.6, width=3)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_copies_stay_one_group_and_order_of_words_counts(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(i, text.upper() if i % 2 else text, 1, "k") for i in range(50)]
    rows.append((99, " ".join(f"word{i}" for i in reversed(range(30))), 1, "k"))
    members, links = duplicate_groups(spark.createDataFrame(rows, "id long, text string, n int, key string"))
    assert {r["rep"] for r in members.where("id < 50").collect()} == {0}
    assert links.count() == 0
    assert len(run(spark, rows)) == 50 * 49 // 2


def test_blocks_of_a_hot_value_lose_no_pair(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"end{i}"]), 1, "k") for i in range(60)]
    assert len(run(spark, rows, threshold=0.6, width=3, block=8)) == 60 * 59 // 2


def test_null_empty_short_and_very_long_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(120_000))
    rows = [(1, None, 1, "k"), (2, "", 1, "k"), (3, "only nine words are in this text I say", 1, "k"), (4, long, 1, "k"), (5, long + " more", 1, "k")]
    assert run(spark, rows) == {(4, 5)}
    assert run(spark, []) == set()


def test_parameters_are_checked(spark):
    with pytest.raises(ValueError):
        duplicate_groups(spark.createDataFrame([], "id long, text string"), chain=20)
    assert budget_for(0.6, 60, 0.0) == pytest.approx(24)


def test_words_and_shingles():
    assert words_of("Ab_c-1 É²!") == ["ab", "c", "1", "é²"]
    h, o = flat_words(["a b c d", None, "a b", "x a b c"], WordHashes())
    s, so = shingles(h, o, 3)
    assert so.tolist() == [0, 2, 2, 2, 4] and s[0] == s[3] and s[0] != s[1]
    assert ramp(np.array([2, 0, 3])).tolist() == [0, 1, 0, 1, 2]


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    texts = ["x" * 10, None, "y" * 95, "", "z" * 200, "w"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["i", "t"])
    got = [b.column(1).to_pylist() for b in pieces([batch], 1, 100)]
    assert [t for b in got for t in b] == texts and len(got) == 3
    assert all(sum(len(t or "") for t in b[1:]) < 100 for b in got)
    assert list(pieces([batch.slice(0, 0)], 1)) == []


def test_vocabulary_is_forgotten_when_full():
    cache = WordHashes(3)
    values = [cache[w] for w in "abcdef"]
    assert len(cache) <= 4 and [cache[w] for w in "abcdef"] == values


def test_same_as_brute_force_on_the_small_table(spark, tiny):
    df = spark.read.parquet(f"{tiny}/chunks.parquet")
    texts = {r["id"]: r["text"] for r in df.select("id", "text").collect()}
    members, links = duplicate_groups(df, threshold=0.6, width=3)
    got = {(r["id_a"], r["id_b"]) for r in pairs_of(members, links).collect()}
    want = brute(texts, 0.6, 3)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_within_the_budget_some_chain_stays_below_its_units():
    from loamdex.llm.near_duplicates import units_of

    rng = random.Random(8)
    for budget, segments, span in ((35.4, 20, 3), (21.3, 20, 3), (7, 5, 2), (3, 6, 3)):
        units = units_of(budget, segments, span)
        assert sum(units) == int(budget) + 1
        for _ in range(300):
            wrong = rng.sample(range(segments * span), rng.randrange(int(budget) + 1))
            spent = [sum(w // span == s for w in wrong) for s in range(segments)]
            begins = [s for s in range(segments) if all(sum(spent[(s + k) % segments] - units[(s + k) % segments] for k in range(n)) < 0 for n in range(1, segments + 1))]
            assert begins and all(spent[s] < units[s] for s in begins)


def test_a_hot_class_is_cut_into_cells_and_keeps_all_pairs(spark):
    members = spark.createDataFrame([(i, 0) for i in range(50)] + [(60 + i, 60) for i in range(3)] + [(70, 70)], "id long, rep long")
    links = spark.createDataFrame([(0, 60, 1, 1), (60, 70, 1, 1)], "rep_a long, rep_b long, shared int, total int")
    want = {(a, b) for a in range(50) for b in range(a + 1, 50)} | {(60, 61), (60, 62), (61, 62)}
    want |= {(a, 60 + b) for a in range(50) for b in range(3)} | {(60 + b, 70) for b in range(3)}
    for block in (7, 2048):
        got = [(r["id_a"], r["id_b"]) for r in pairs_of(members, links, block).collect()]
        assert len(got) == len(want) and set(got) == want
