from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamdex.llm.tokenize import VOCABULARIES, encode_text, join_all, join_encodings, parts_of, token_ids, tree_encode, vocabulary

try:
    VOCAB = vocabulary("byte_bpe_50k", VOCABULARIES)
except OSError:  # pragma: no cover
    pytest.skip("no vocabulary files here", allow_module_level=True)


def plain(text):
    return VOCAB.encode_ordinary(text) if text else []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcXYZ019 \n\té漢字🙂'-_", max_size=300))
def test_encoding_equals_the_library(text):
    assert encode_text(text, VOCAB, long_piece=16, leaf=8) == plain(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdefgh", min_size=1, max_size=200), st.integers(1, 20))
def test_tree_of_parts_equals_one_piece(text, leaf):
    data = text.encode()
    assert tree_encode(data, VOCAB._encode_single_piece, VOCAB.decode_single_token_bytes, leaf) == VOCAB._encode_single_piece(data)


def test_join_of_halves():
    data = ("international" * 40).encode()
    for cut in (1, 100, 255, len(data) - 1):
        left, right = VOCAB._encode_single_piece(data[:cut]), VOCAB._encode_single_piece(data[cut:])
        assert join_encodings(left, right, VOCAB._encode_single_piece, VOCAB.decode_single_token_bytes) == VOCAB._encode_single_piece(data)


def test_very_long_runs():
    rng = random.Random(2)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(60_000))
    for text in (letters, "a" * 50_000, " " * 30_000, "漢" * 9_000, "=" * 20_000 + " end", "x " + "7" * 20_000, "a\n\n" + letters, "a \n \t" + letters + "\n\n" + letters, "\n" * 5 + " " + letters):
        assert encode_text(text, VOCAB) == plain(text)


def test_table_with_null_empty_special_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "<|endoftext|> hi", "x"), (4, "same", "x"), (4, "same", "x")]
    got = token_ids(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    out = sorted((r["doc_id"], tuple(r["ids"])) for r in got)
    assert out[:2] == [(1, ()), (2, ())] and len(out) == 5
    assert VOCAB.decode(list(out[2][1])) == "<|endoftext|> hi" and 50256 not in out[2][1]
    assert token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_same_as_the_other_library(spark, tiny):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    df = spark.read.parquet(f"{tiny}/documents.parquet")
    want = {r["doc_id"]: other.encode(r["text"] or "", add_special_tokens=False).ids for r in df.select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["ids"] for r in token_ids(df).collect()} == want


def test_texts_that_are_spread_over_tasks(spark):
    rng = random.Random(4)
    run = "".join(rng.choice("etaoinshrdlu") for _ in range(30_000))
    words = " ".join(run[i : i + rng.randrange(1, 9)] for i in range(0, 9000, 4))
    texts = [run, words, "x\n\n" + run + "  \n" + words + " " * 5000, run, "漢字" * 4000 + words]
    df = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)] + [(0, run), (7, "short"), (8, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["ids"]) for r in token_ids(df, spread=5000, part=700).collect())
    assert got == sorted([(i % 3, plain(t)) for i, t in enumerate(texts)] + [(0, plain(run)), (7, plain("short")), (8, [])])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcXYZ019 \n\té漢字🙂'-_", max_size=400), st.integers(1, 40))
def test_parts_join_to_the_whole(text, part):
    runs: dict[int, list] = {}
    for run, _, whole, data in parts_of(text, 16, part):
        runs.setdefault(run, []).append(VOCAB._encode_single_piece(data) if whole else VOCAB.encode_ordinary(data.decode()))
    assert [t for p in runs.values() for t in join_all(p, VOCAB._encode_single_piece, VOCAB.decode_single_token_bytes)] == plain(text)
