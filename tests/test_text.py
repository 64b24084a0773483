from __future__ import annotations

import hashlib
import re

import pytest

from loamdex.functions import text as tx
from loamdex.functions.porter2 import stem

# Words with their stems from the published description of the algorithm.
STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consistency": "consist",
    "consolation": "consol", "console": "consol", "consolidate": "consolid", "consolingly": "consol", "conspicuous": "conspicu",
    "conspiracy": "conspiraci", "constancy": "constanc", "knack": "knack", "knackeries": "knackeri", "knavish": "knavish", "kneaded": "knead",
    "kneel": "kneel", "knightly": "knight", "knotty": "knotti", "knots": "knot", "caresses": "caress", "ties": "tie", "cries": "cri",
    "gaps": "gap", "gas": "gas", "kiwis": "kiwi", "hopping": "hop", "hoped": "hope", "luxuriated": "luxuri", "feed": "feed", "agreed": "agre",
    "happy": "happi", "say": "say", "by": "by", "skies": "sky", "dying": "die", "news": "news", "herring": "herring", "proceed": "proceed",
    "generate": "generat", "generously": "generous", "communism": "communism", "relational": "relat", "conditional": "condit", "rationalize": "ration",
    "adjustable": "adjust", "controll": "control", "bed": "bed", "sensational": "sensat", "decorators": "decor", "decorated": "decor", "yes": "yes",
}


@pytest.mark.parametrize("word", STEMS)
def test_stems(word):
    assert stem(word) == STEMS[word]


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_clean_and_words_treat_white_space_as_python_does(spark):
    odd = "".join(chr(c) for c in (*range(9, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
    texts = ["", " ", odd, f"a{odd}b", "  x  y ", "no\u200bbreak", None]
    rows = [(t,) for t in texts]
    from pyspark.sql import functions as F

    assert one(spark, rows, "t string", tx.clean(F.col("t"))) == [None if t is None else " ".join(t.split()) for t in texts]
    assert one(spark, rows, "t string", tx.words(F.col("t"))) == [(t or "").split() for t in texts]


def test_tokens(spark):
    from pyspark.sql import functions as F

    texts = ["The Decorator and a x9 été I/O", None, "", "...", "A" * 100_000, "snake_case don't"]
    want = [[w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 1 and w not in tx.STOP_WORDS] for t in texts]
    assert one(spark, [(t,) for t in texts], "t string", tx.tokens(F.col("t"))) == want
    assert one(spark, [(t,) for t in texts], "t string", tx.analyse(F.col("t"))) == [[stem(w) for w in ws] for ws in want]


def test_ids(spark):
    from pyspark.sql import functions as F

    got = one(spark, [("src", "https://x/é", 3)], "s string, u string, i int", tx.chunk_id(F.col("s"), F.col("u"), F.col("i")))
    assert got == [f"src:{hashlib.sha1('https://x/é'.encode()).hexdigest()[:12]}:3"]


@pytest.mark.parametrize(
    ("url", "allowed"),
    [
        ("https://a.example/docs/x", True), ("HTTPS://a.example/docs/x", True), ("http://a.example:81/docs/x", False), ("https://a.example/other", False),
        ("https://b.example/docs/x", False), ("mailto:x@a.example", False), ("https://a.example/docs/private/x", False), ("ftp://a.example/docs/", False),
        ("https://a.example", False), ("not a url", False), (None, False), ("https://a.exa mple/docs", False),
    ],
)
def test_admission(spark, url, allowed):
    from pyspark.sql import functions as F

    row = [(url, ["a.example"], ["/docs"], ["private"], [])]
    schema = "u string, d array<string>, p array<string>, b array<string>, none array<string>"
    ok = tx.url_allowed(F.col("u"), F.col("d"), F.col("p"), F.col("b"))
    assert one(spark, row, schema, ok) == [allowed]
    free = tx.url_allowed(F.col("u"), F.col("d"), F.col("none"), F.col("none"))
    assert one(spark, row, schema, free) == [(url or "").lower().startswith("https://a.example") and " " not in url]


def test_urls_and_uploads(spark):
    from pyspark.sql import functions as F

    urls = ["https://x/a?b#c", "https://x/A/#c", "x?y?z", ""]
    assert one(spark, [(u,) for u in urls], "u string", tx.normal_url(F.col("u"))) == ["https://x/a", "https://x/A/", "x", ""]
    paths = ["/in/guide.v2.md", "readme", "/in/.hidden"]
    assert one(spark, [(p,) for p in paths], "p string", tx.upload_title(F.col("p"))) == ["guide.v2", "readme", ".hidden"]
    assert one(spark, [("/a/b.txt",)], "p string", tx.upload_url(F.col("p"))) == ["upload://b.txt"]


def test_vectors(spark):
    from pyspark.sql import functions as F

    got = one(spark, [([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>", tx.unit_vector(F.col("v")))
    assert got == [[0.6, 0.8], [0.0, 0.0]]
    assert one(spark, [([1.0, 2.0], [3.0, 0.5])], "a array<float>, b array<float>", tx.inner_product(F.col("a"), F.col("b"))) == [4.0]
