from __future__ import annotations

import pytest

from loamdex.llm.garbled import ALWAYS, Model, align, align_lost, become, explain, forms_of, garbled_texts, learn, readings, skeleton, write

CLEAN = [
    "Die Größe der Übersicht muss vor dem Start geprüft werden, für jede Lösung.",
    "La sesión pública también está lista después de la configuración única.",
    "Пользователь может открыть файл, пока сессия открыта на сервере.",
    "如果文档已经存在，请使用新的缓存来检查它。",
    "It’s the “default” that matters… naïve but fine.",
]


def corpus(spark, extra):
    rows = [(i, f"{CLEAN[i % len(CLEAN)]} number {i}", "gain", 1.0) for i in range(400)]
    return spark.createDataFrame(rows + extra, "doc_id long, text string, restored string, gain double")


def garble(text: str, writer: str, reader: str) -> str:
    return text.encode(writer).decode(reader)


@pytest.fixture(scope="module")
def found(spark):
    extra = [(1000 + i, garble(CLEAN[i % 3], "utf-8", "latin-1"), None, None) for i in range(9)]
    extra += [(1100 + i, garble(CLEAN[2], "cp1251", "latin-1"), None, None) for i in range(3)]
    extra += [
        (1200, garble(garble(CLEAN[0], "utf-8", "latin-1"), "utf-8", "latin-1"), None, None),
        (1201, garble(CLEAN[3], "utf-8", "latin-1"), None, None),
        (1202, "Clean line first.\n" + garble(CLEAN[1], "utf-8", "latin-1"), None, None),
        (1203, "It&#226;&#128;&#153;s the same", None, None),
        (1204, "Caf� au lait", None, None),
        (1205, "It\x92s a control", None, None),
        (2000, "A reader may meet the sequence “Ã©” where “é” was meant.", None, None),
        (2001, "Reset `â€™` to ’ before the import.", None, None),
        (2002, "ATENÇÃO: NÃO HÁ CONFIGURAÇÃO", None, None),
        (2003, "It&#x27;s fine &amp; good", None, None),
        (2004, None, None, None),
        (2005, "", None, None),
        (2006, "plain ascii", None, None),
        (2007, "naïve œuvre Ångström ±5 µm", None, None),
    ]
    return {r["doc_id"]: r for r in garbled_texts(corpus(spark, extra)).collect()}


def test_garbled_are_found_and_the_others_are_not(found):
    assert set(found) == {*range(1000, 1009), *range(1100, 1103), *range(1200, 1206)}


def test_texts_are_restored(found):
    for i in range(9):
        assert found[1000 + i]["restored"] == CLEAN[i % 3] and found[1000 + i]["whole"]
    assert found[1100]["restored"] == CLEAN[2]
    assert found[1200]["restored"] == CLEAN[0]
    assert found[1201]["restored"] == CLEAN[3]
    assert found[1202]["restored"] == "Clean line first.\n" + CLEAN[1]
    assert found[1203]["restored"] == "It’s the same"
    assert not found[1204]["whole"]


def test_empty_table_repeats_and_very_long_text(spark):
    assert garbled_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    bad = garble(CLEAN[1], "utf-8", "latin-1")
    got = garbled_texts(corpus(spark, [(1, bad * 2000, None, None), (5000, bad, None, None), (5000, bad, None, None)])).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 5000, 5000]


def test_sequences_that_lost_bytes_are_restored_by_alignment(spark):
    lose = lambda t: t.encode().decode("cp1252", "ignore")
    text = "A “quoted” word and a naïve “second” one with the “third” end"
    rows = [(i, f"{text} number {i}") for i in range(60)] + [(100 + i, lose(text)) for i in range(3)]
    got = {r["doc_id"]: r["restored"] for r in garbled_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {100 + i: text for i in range(3)}


def test_helpers():
    assert skeleton("fÃ¼r") == "fr"
    assert write("“\x81", "cp1252") == b"\x93\x81" and write("Ж", "latin-1") is None
    assert ("utf-8", "latin-1", "für") in list(readings("fÃ¼r", {"latin-1": ("utf-8",)}))
    assert align("a“b", "aâ€œb") == {("â€œ", "“")} and align("жук", "Ð¶ÑƒÐº") == {("Ð¶", "ж"), ("Ñƒ", "у"), ("Ðº", "к")}
    assert align("aü”", "aÃ¼â€\x9d") == set()  # five characters for two: no even cut
    import numpy as np

    assert Model(frozenset(), np.zeros(1 << 18, np.float32)).by_reader["cp1252"] == ()


def test_forms_meet_their_garbled_twins():
    keys = lambda t: {(k, s) for k, _, s in forms_of(t)}
    clean = keys("сессия открыта на сервере")
    twice = keys(garble("сессия открыта на сервере", "utf-8", "cp1251"))
    assert {k for k, s in clean if s == 1} & {k for k, s in twice if s == 2}
    assert {k for k, _ in keys("naïve")} & {k for k, _ in keys(garble("naïve", "utf-8", "cp1252"))}
    assert forms_of("ascii only. 'ü' – «") == set()


def test_pairs_are_inferred_from_mappings():
    table = {become(c, "koi8-r", "cp1251"): c for c in "привет"} | {become(c, "utf-8", "cp850"): c for c in "äöü"}
    assert explain(table, 2) == {("koi8-r", "cp1251"), ("utf-8", "cp850")}
    assert explain(table | {"ą": "ę"}, 2) == {("koi8-r", "cp1251"), ("utf-8", "cp850")}
    assert explain({}, 2) == set()
    assert align_lost("a“ü”", "aâ€œÃ¼â€", "cp1252") == {"â€œ": "“", "Ã¼": "ü", "â€": "”"} and align_lost("a”", "ax", "cp1252") == {}


def test_a_pair_without_twins_is_not_learned_and_one_with_twins_is(spark):
    rows = [(f"{CLEAN[i % 3]} number {i}",) for i in range(90)]
    assert learn(spark.createDataFrame(rows, "text string")).pairs == ALWAYS
    rows += [(garble(CLEAN[i % 2], "utf-8", "mac_roman"),) for i in range(6)]
    assert ("utf-8", "mac_roman") in learn(spark.createDataFrame(rows, "text string")).pairs


def test_references_by_name_and_beyond_one_byte(spark):
    rows = [(1, "caf&Atilde;&copy; au lait"), (2, "It&#226;&#8364;&#8482;s"), (3, "a&nbsp;&copy; b"), (4, "&eacute;&eacute; &lt;&gt;"), (5, "&#xC3;&#xA9;")]
    got = {r["doc_id"]: r["restored"] for r in garbled_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "café au lait", 2: "It’s", 5: "é"}
