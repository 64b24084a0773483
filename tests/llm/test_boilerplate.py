from __future__ import annotations

import numpy as np

from loamdex.llm.boilerplate import Places, as_lines, block_shas, label_page, main_blocks, page_blocks
from loamdex.llm.crf import Chain, Sequences

MENU = "<nav><ul><li><a href='/a'>Docs</a></li><li><a href='/b'>Blog</a></li></ul></nav>"
FOOT = "<footer><p>Terms of use</p><p>All rights reserved by the site.</p></footer>"
WORDS = "cache lock index value server query token buffer shard replica session driver".split()


def body(i: int) -> str:
    w = [WORDS[(i * 7 + k * 5 + k * k) % len(WORDS)] + str(i * k % 97) for k in range(40)]
    return (
        f"<main><h1>About the {w[0]} of {w[1]}</h1><p>The {w[2]} keeps each {w[3]} until {w[4]} is closed by {w[5]} or {w[6]}.</p>"
        f"<ul><li>Set {w[7]} to {w[8]} before {w[9]} starts.</li><li>Use {w[10]} when {w[11]} fails.</li></ul>"
        f"<p>After {w[12]} ends, the {w[13]} opens <b>{w[14]}</b> again for all {w[15]}.</p><div>Was this page helpful?</div></main>"
    )


def html(i: int) -> str:
    return f"<html><head><title>t</title><script>x('<p>no</p>')</script></head><body>{MENU}{body(i)}{FOOT}</body></html>"


def tables(spark, extra=(), texts=()):
    pages = [(i, f"s{i % 2}", f"https://s{i % 2}/{i}", html(i), 200, "x") for i in range(80)] + list(extra)
    p = spark.createDataFrame(pages, "page_id long, source_id string, url string, html string, status_code int, text string")
    scraper = (["main"], ["h1"], [], [], ["script"])
    s = spark.createDataFrame(
        [(f"s{k}", scraper) for k in range(2)],
        "source_id string, scraper struct<main_content_selectors:array<string>,title_selectors:array<string>,breadcrumb_selectors:array<string>,code_block_selectors:array<string>,exclude_selectors:array<string>>",
    )
    c = spark.createDataFrame(list(texts), "scraped_id long, source_id string, url string, title string, content string, text string")
    return p, c, s


def run(spark, **kw):
    out: dict[tuple[str, int], list[str]] = {}
    for r in sorted(main_blocks(*tables(spark, **kw), sample=60).collect(), key=lambda r: (r["rec_kind"], r["rec_id"], r["block_no"])):
        out.setdefault((r["rec_kind"], r["rec_id"]), []).append(r["text"])
    return out


def test_article_is_kept_and_furniture_is_not(spark):
    lines = "Docs\nBlog\nAbout the lock of rain\nThe lock keeps each value until the server is closed by someone.\nUse the index when the query fails.\nTerms of use\nAll rights reserved by the site."
    extra = [
        (900, "s0", "https://s0/new", html(555), 200, "x"),
        (901, "s0", "https://s0/bad", html(556), 404, "x"),
        (902, "s0", "https://s0/null", None, 200, "x"),
        (903, "s0", "https://s0/blank", "  ", 200, "x"),
        (904, None, None, html(557), 200, "x"),
        (905, "s1", "https://s1/cut", html(558)[:-60], 200, "x"),
        (900, "s0", "https://s0/new", html(555), 200, "x"),
    ]
    got = run(spark, extra=extra, texts=[(1, "s0", "https://s0/t", "About the lock of rain", lines, "x"), (2, "s0", "u", "t", None, "x"), (3, "s0", "u", "t", " \n", "x")])
    assert got["page", 900][0].startswith("About the") and len(got["page", 900]) == 2 * 5
    assert len(got["page", 904]) == 5 and len(got["page", 905]) == 5
    assert not {("page", 901), ("page", 902), ("page", 903), ("scraped", 2), ("scraped", 3)} & set(got)
    assert got["scraped", 1] == lines.split("\n")[2:5]


def test_groups_of_sources_give_the_same(spark):
    whole = {tuple(r) for r in main_blocks(*tables(spark), sample=60).collect()}
    assert whole and {tuple(r) for r in main_blocks(*tables(spark), sample=60, limit=2).collect()} == whole


def test_hashes_are_one_row_each(spark):
    import hashlib

    df = spark.createDataFrame([("page", 1, 0, "é a"), ("page", 1, 5, "é a"), ("page", 2, 0, "b")], "rec_kind string, rec_id long, block_no int, text string")
    got = {tuple(r) for r in block_shas(df).collect()}
    assert got == {("page", 1, hashlib.sha1("é a".encode()).hexdigest()[:12]), ("page", 2, hashlib.sha1(b"b").hexdigest()[:12])}
    assert block_shas(df).count() == 2


def test_nothing_to_learn_from(spark):
    p, c, s = tables(spark)
    assert main_blocks(p.limit(0), c, s).count() == 0
    assert main_blocks(p, c, s.limit(0)).count() == 0


def test_labels_by_selectors():
    blocks, title, page = page_blocks(html(3), Places())
    labels = label_page(blocks, page, ["main"], ["script"], [0] * 7 + [9] + [0] * 2)
    assert title.startswith("About the") and [b for b in labels] == [False, False, True, True, True, True, True, False, False, False]
    assert label_page(blocks, page, ["article"], [], [0] * len(blocks)) is None
    lines, truth = as_lines(blocks, labels, [0] * len(blocks), np.random.default_rng(1))
    assert sum(truth) == 5 and len(lines) == len(truth)
    mixed = [as_lines(blocks, labels, [3] * len(blocks), np.random.default_rng(k))[1] for k in range(40)]
    assert all(sum(t) == 5 for t in mixed) and any(len(t) > len(blocks) for t in mixed)


def test_field_learns_a_chain_and_decodes_it():
    rng = np.random.default_rng(0)
    ids, ends, truth = [], [0], []
    for _ in range(200):
        state = 0
        for _ in range(rng.integers(3, 12)):
            state = state if rng.random() < 0.8 else 1 - state
            truth.append(state)
            ids.append(state if rng.random() < 0.85 else 1 - state)
        ends.append(len(truth))
    n = len(ids)
    data = Sequences(np.array(ids), np.arange(n + 1), np.zeros(0, int), np.zeros(n + 1, int), np.zeros(n), np.array(ends))
    chain = Chain(2).fit(data, np.array(truth), rounds=150)
    got = chain.decode(data)
    assert (got == np.array(truth)).mean() > (np.array(ids) == np.array(truth)).mean()
    # Viterbi against all paths of one sequence
    from itertools import product

    a, b = ends[0], ends[1]
    score = data.scores(chain.w)[a:b]
    value = lambda s: chain.start[s[0]] + chain.end[s[-1]] + sum(x for x, k in zip(score, s) if k) + sum(chain.trans[p, q] for p, q in zip(s, s[1:]))
    best = max(product((0, 1), repeat=b - a), key=value)
    assert got[a:b].astype(int).tolist() == list(best)
