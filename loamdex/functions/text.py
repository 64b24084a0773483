"""Text and url functions as Column builders; everything but the stemmer stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loamdex.functions.porter2 import stem
from loamdex.runtime import WHITE

# The stop words, removed before stemming.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did "
    "will would could should may might shall can not no nor so yet both either neither as if then than that this "
    "these those it its i we you he she they what which who how when where why"
).split()

TOKEN = "[a-z0-9]+"


def clean(text: Column) -> Column:
    """Runs of white space (as Python defines it) as one blank, trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def words(text: Column) -> Column:
    """The words of a text between white space; none for blank and null."""
    return F.coalesce(F.filter(F.split(clean(text), " "), lambda w: w != ""), F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs of two or more characters without stop words; none for null.

    Accented letters split a token, as they are not in the pattern.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))
    return F.coalesce(F.filter(runs, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS)), F.array().cast("array<string>"))


@F.pandas_udf(ArrayType(StringType()))
def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda words: [stem(w) for w in words])


def stemmed(token_array: Column) -> Column:
    """Each token's stem.  Stems are kept per worker, so that no vocabulary has to be shuffled and joined."""
    return _stems(token_array)


def analyse(text: Column) -> Column:
    """Tokens without stop words, stemmed: what both the index and its queries use."""
    return stemmed(tokens(text))


def url_hash(url: Column) -> Column:
    """First 12 hex digits of the url's SHA-1."""
    return F.substring(F.sha1(url.cast("binary")), 1, 12)


def chunk_id(source_id: Column, url: Column, index: Column) -> Column:
    """source, url hash and zero-based position, joined by ':'; position decides, not content."""
    return F.concat_ws(":", source_id, url_hash(url), index.cast("string"))


def normal_url(url: Column) -> Column:
    """The url without query and fragment; case and trailing slash stay."""
    return F.regexp_extract(url, r"^[^?#]*", 0)


def url_allowed(url: Column, domains: Column, prefixes: Column, blocked: Column) -> Column:
    """Whether a source admits a url.

    The scheme is http or https, the authority (with port) is one of the
    domains, the path starts with one of the prefixes if there are any, and
    contains none of the blocked patterns.  False for null and malformed urls.
    """
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    none = F.array().cast("array<string>")
    starts, holds = F.coalesce(prefixes, none), F.coalesce(blocked, none)
    ok = (
        F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https")
        & F.array_contains(F.coalesce(domains, none), F.try_parse_url(url, F.lit("AUTHORITY")))
        & ((F.size(starts) == 0) | F.exists(starts, lambda p: F.startswith(path, p)))
        & ~F.exists(holds, lambda b: F.contains(path, b))
    )
    return F.coalesce(ok, F.lit(False))


def upload_title(path: Column) -> Column:
    """The file name without folders and suffix."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(name.rlike(r"^[^.].*\."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def upload_url(path: Column) -> Column:
    return F.concat(F.lit("upload://"), F.regexp_extract(path, r"([^/\\]*)$", 1))


def unit_vector(v: Column) -> Column:
    """The vector scaled to length 1, in double precision; a zero vector stays as it is.

    The length is bound by an outer lambda, so it is computed once a vector and not once an element.
    """
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    scaled = F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d))
    return F.element_at(scaled, 1)


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision, from the first element on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
