from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamdex.llm.splitting import oversized_items, oversized_pieces, split_text


def check(text: str, pieces, max_words: int, max_chars: int, overlap: int) -> None:
    """Pieces keep the limits, leave nothing out but white space, and overlap as said."""
    at = 0
    for n, (start, new, stop) in enumerate(pieces):
        body = text[start:stop]
        assert len(body) <= max_chars and len(body.split()) <= max_words
        assert start <= new < stop and not text[at:new].strip()
        if n:
            assert not start > new
        at = stop
    assert not text[at:].strip()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab.。\n é漢", max_size=60), max_size=30).map(" ".join), st.integers(4, 40), st.integers(16, 200))
def test_any_text_is_covered_within_the_limits(text, max_words, max_chars):
    check(text, split_text(text, max_words, max_chars, 3), max_words, max_chars, 3)


def test_whole_words_overlap_by_the_number_asked_for():
    words = [f"w{i:04d}" for i in range(1000)]
    pieces = split_text(" ".join(words), 256, 2048, 32)
    check(" ".join(words), pieces, 256, 2048, 32)
    text = " ".join(words)
    for start, new, _ in pieces[1:]:
        assert len(text[start:new].split()) == 32
    sizes = [stop - new for _, new, stop in pieces]
    assert max(sizes) < 1.6 * min(sizes)


def test_strongest_boundary_near_the_target_is_taken():
    para = ("word " * 40).strip() + "."
    text = "\n\n".join([para] * 10)
    for _, new, _ in split_text(text, 100, 5000, 8)[1:]:
        assert text[new - 2 : new] == "\n\n"


def test_sentence_ends_inside_a_run_without_blanks():
    text = "这是一个句子没有空格。" * 300
    pieces = split_text(text, 256, 2048, 32)
    check(text, pieces, 256, 2048, 32)
    assert all(text[stop - 1] == "。" for _, _, stop in pieces)


def test_very_long_word_and_very_long_text():
    check("x" * 50_000, split_text("x" * 50_000), 256, 2048, 32)
    text = ("lorem ipsum dolor. " * 60_000).strip()
    check(text, split_text(text), 256, 2048, 32)


def test_tables_nulls_blanks_ties_and_clashing_columns(spark):
    big = "word " * 257
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "x" * 2048, "a", 1), (4, "x" * 2049, "a", 1), (5, "word " * 256, "a", 1), (6, big, "a", 1), (6, big, "a", 1), (7, " " * 3000, "a", 1)]
    df = spark.createDataFrame(rows, "rec_id long, text string, rec_kind string, start int")
    got = oversized_pieces(df, "chunk", "rec_id", "text").collect()
    assert {r["rec_id"] for r in got} == {4, 6, 7}
    assert [r["text"] for r in got if r["rec_id"] == 7] == [""]
    assert len([r for r in got if r["rec_id"] == 6]) == 4
    assert {r["rec_kind"] for r in got} == {"chunk"}
    all_of = oversized_pieces(df, "chunk", "rec_id", "text", only_oversized=False).collect()
    assert {r["rec_id"] for r in all_of} == {3, 4, 5, 6, 7}
    assert oversized_pieces(df.limit(0), "chunk", "rec_id", "text").count() == 0


def test_parameters():
    with pytest.raises(ValueError):
        oversized_pieces(None, "x", "i", "t", overlap=256)
    with pytest.raises(ValueError):
        oversized_pieces(None, "x", "i", "t", max_chars=4)


def test_items_are_those_over_a_limit(spark, tiny):
    scraped, chunks = spark.read.parquet(f"{tiny}/scraped_documents.parquet"), spark.read.parquet(f"{tiny}/document_chunks.parquet")
    over = lambda t: bool(t) and (len(t.split()) > 256 or len(t) > 2048)
    want = {("scraped", r["scraped_id"]) for r in scraped.collect() if over(r["content"])} | {("chunk", r["piece_id"]) for r in chunks.collect() if over(r["text"])}
    got = oversized_items(scraped, chunks).collect()
    assert {(r["rec_kind"], r["rec_id"]) for r in got} == want
    texts = {("scraped", r["scraped_id"]): r["content"] for r in scraped.collect()} | {("chunk", r["piece_id"]): r["text"] for r in chunks.collect()}
    for key in want:
        mine = sorted((r["piece_no"], r["start"], r["new_start"], r["stop"]) for r in got if (r["rec_kind"], r["rec_id"]) == key)
        check(texts[key], [m[1:] for m in mine], 256, 2048, 32)


def test_one_piece_less_does_not_fit():
    import random

    from loamdex.llm.splitting import Units, _check, _place, split_text

    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["w" * rng.randrange(1, 30), "w" * rng.randrange(1, 9)]) + rng.choice([" ", " ", " ", ". ", "\n", "\n\n"]) for _ in range(rng.randrange(100, 900)))
        got = split_text(text, 40, 300, 8)
        units = Units(text, 75)
        length = units.end[-1] - units.start[0]
        assert len(got) > 2 and _check(units, _place(units, len(got) - 1, length, 0.25), 40, 300, 8) is None or len(got) <= max(2, -(-length // 300), -(-(len(units.start) - 8) // 32))
