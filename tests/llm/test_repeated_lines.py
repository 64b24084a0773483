from __future__ import annotations

from loamdex.llm.repeated_lines import repeated_lines, without_lines

SCHEMA = "id long, source_id string, url string, text string, title string, key string, line_no int"


def _rows(n: int, text, source: str = "s", start: int = 0):
    return [(start + i, source, f"u{start + i}", text(i), "t", "k", 1) for i in range(n)]


def found(spark, rows, **kw):
    got = repeated_lines(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return {(r["id"], r["line_no"]): r["exact"] for r in got}


def test_line_on_twelve_urls_is_found_and_on_eleven_is_not(spark):
    rows = _rows(12, lambda i: f"Own line number x{'abcdefghijkl'[i]}\n\nAll rights reserved {i} !")
    got = found(spark, rows)
    assert {k for k, exact in got.items() if exact} == {(i, 3) for i in range(12)}
    assert not [k for k, exact in found(spark, rows[:11]).items() if exact]


def test_case_digits_and_signs_do_not_matter_but_source_does(spark):
    forms = ["Was this page useful?", "WAS THIS PAGE USEFUL", "was  this 12 page-useful"]
    rows = _rows(12, lambda i: forms[i % 3])
    assert sum(found(spark, rows).values()) == 12
    split = _rows(6, lambda i: forms[0]) + _rows(6, lambda i: forms[0], "other", 6)
    assert not any(found(spark, split).values())


def test_one_url_counts_once_and_short_lines_never(spark):
    rows = [(i, "s", "same", "These are four words", "t", "k", 1) for i in range(30)]
    assert found(spark, rows) == {}
    assert found(spark, _rows(20, lambda i: "two words")) == {}


def test_near_duplicates_by_name_meet_without_being_exact(spark):
    rows = _rows(26, lambda i: f"Reviewed by {chr(65 + i)}{chr(97 + i)}xo on 2023-05-{i:02d} for the manual")
    got = found(spark, rows)
    assert len(got) == 26 and not any(got.values())


def test_nulls_blanks_empty_table_and_very_long_text(spark):
    rows = [(1, None, "u", "a b c d", None, None, None), (2, "s", None, "a b c d", None, None, None), (3, "s", "u", None, None, None, None), (4, "s", "u", "", None, None, None)]
    rows.append((5, "s", "long", "word " * 200_000, None, None, None))
    assert found(spark, rows) == {}
    assert found(spark, []) == {}


def test_repeated_rows_and_hot_source(spark):
    rows = _rows(400, lambda i: f"Line of its own {'x' * (i % 7)}{i} q{chr(97 + i % 26)}z\nThe same footer everywhere here", "hot")
    got = found(spark, rows + rows[:50])
    assert {k for k, exact in got.items() if exact} >= {(i, 2) for i in range(400)}


def test_lines_are_taken_out_of_the_text(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\nc", "x"), (2, None, "x"), (3, "only", "x")], "id long, text string, _gone string")
    lines = spark.createDataFrame([(1, 2), (1, 4), (3, 1)], "id long, line_no int")
    got = {r["id"]: r["text"] for r in without_lines(docs.drop("_gone"), lines).collect()}
    assert got == {1: "a\n", 2: None, 3: ""}


def test_same_as_brute_force(spark, tiny):
    import re
    from collections import defaultdict

    df = spark.read.parquet(f"{tiny}/chunks.parquet")
    urls, at = defaultdict(set), defaultdict(list)
    for r in df.select("id", "source_id", "url", "text").collect():
        for n, line in enumerate((r["text"] or "").split("\n"), 1):
            key = (r["source_id"], tuple(re.findall(r"[^\W\d_]+", line.lower())))
            if len(key[1]) >= 3:
                urls[key].add(r["url"])
                at[key].append((r["id"], n))
    want = {p for k, u in urls.items() if len(u) >= 12 for p in at[k]}
    got = {(r["id"], r["line_no"]) for r in repeated_lines(df).where("exact").collect()}
    assert got == want


def test_own_lines_stay_and_near_duplicates_go_as_by_brute_force(spark):
    import random

    from loamdex.llm.contamination import edit_distance

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    notice = "this page was written by the people of the project and may be copied under its terms by all who read it".split()
    rows = []
    for i in range(60):
        edited = list(notice)
        if 6 <= i < 30:
            edited[rng.choice([3, 9])] = word()
        elif i >= 30:
            edited = [word() for _ in notice]
        own = f"this {word()} is {word()} it {word()} {word()} and never {word()} the {word()} mount"
        heading = f"{word().title()} {word().title()} {word().title()} {word().title()}"
        rows.append((i, "s", f"u{i}", "\n".join([" ".join(edited), own, heading]), "t", "k", 1))
    lines = {(r[0], n): line.split() for r in rows for n, line in enumerate(r[3].split("\n")[:2], 1)}
    near = lambda a, b: edit_distance(a, b, m := max(len(a), len(b)) // 20) <= m
    want = {p for p, a in lines.items() if len({q[0] for q, b in lines.items() if near(a, b)}) >= 12}
    got = found(spark, rows)
    assert len(want) >= 10 and set(got) == want and not any(got.values())


def test_furthest_reach_and_stretches_against_plain_edit_distance():
    import random

    from loamdex.llm.contamination import edit_distance
    from loamdex.llm.repeated_lines import near_pairs, within

    rng = random.Random(6)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        for most in range(4):
            assert within(a, b, most) == (edit_distance(a, b, most) <= most)
    base, forms = {n: [rng.randrange(5) for _ in range(n)] for n in (10, 19, 21, 33, 45)}, []
    for _ in range(200):
        form = list(base[rng.choice(list(base))])
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(form))
            form[at : at + rng.randrange(2)] = [rng.randrange(5)] * rng.randrange(2)
        forms.append(form)
    got = {(i, j) for i, near in near_pairs(forms, 0.9) for j in near}
    most = lambda a, b: max(len(a), len(b)) // 10
    assert got == {(i, j) for i, a in enumerate(forms) for j, b in enumerate(forms) if i != j and edit_distance(a, b, most(a, b)) <= most(a, b)}
