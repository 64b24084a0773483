"""Lines repeated over many documents of one source.

*Masks.*  Digits and signs vanish.  What stands between a day and a year, or
before both, is a date, and capitalised words inside a mixed-case line are
names (not identifiers in capitals or camel case, and not where a line has
more than two such places, as where nouns are capitalised).  Neither needs a
list of words of some language.

*Bands.*  Every line has a *plain* band, a combined hash of three min-hashes of
its letter runs, case folded.  Lines with ``least_runs`` words outside of the
masks also have a band of their whole masked sequence, and those long enough
for an edit have ``bands`` bands of three min-hashes of it.  Lines that share a
band within their source form a cluster; a cluster under fewer than
``min_urls`` urls is dropped.

*Checks.*  Bands only nominate.  Within the clusters of the plain bands, lines
of the same letter sequence are counted by url: those are the exact cases.
All their lines share their band, so none is lost.  Within the other clusters
a line is a near-duplicate of another if their masked sequences are an edit
distance of at most a twentieth of the longer one apart (``similarity`` 0.95);
it is repeated if the lines so near to it, its own included, are found under
``min_urls`` or more urls of the source.

Plan: one scan writes the band hashes as a narrow table; band values are
counted with map-side combining; only values with enough rows reach the
distinct count over urls, which first groups by (value, url) so that a line
found in a third of all documents is spread over all tasks; the surviving
values, one per cluster, are joined back by a broadcast when their count
allows, else by a shuffled join.  The members of a surviving min-hash band are
reduced to its different sequences, with fewer than ``min_urls`` urls each or a
mark, before they are compared.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamdex.runtime import counted, frequent_keys, join_bounded, materialize

from .hashing import minimum_by, mix, pieces, ramp, signed

#: What a line is read as: letter runs and numbers.
TOKENS = re.compile(r"[^\W\d_]+|\d+")

_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("url", T.LongType()),
        T.StructField("letters", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType(), False)),
        T.StructField("tokens", T.ArrayType(T.LongType(), False)),
    ]
)

#: Kinds of tokens: words, words with one capital at their beginning, numbers of a day, a year and others.
WORD, CAPITAL, DAY, YEAR, NUMBER = range(5)
DATE, NAME = np.uint64(1), np.uint64(2)


class Tokens(dict):
    """Token to (hash of its folded form, kind) packed in one integer; forgets when it holds ``most`` of them."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        if token[0].isdigit():
            kind = YEAR if len(token) == 4 and token[:2] in ("19", "20") else DAY if len(token) < 3 else NUMBER
        else:
            kind = CAPITAL if token[0].isupper() and (len(token) == 1 or token[1:].islower()) else WORD
        value = self[token] = (xxhash.xxh3_64_intdigest(token.lower()) & ~7) | kind
        return value


def masked(flat: np.ndarray, kinds: np.ndarray, owner: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """The hashes of all tokens with dates and names masked; ``owner`` is each token's line, ``mixed`` tells which lines have small letters."""
    n = len(flat)
    letters = kinds <= CAPITAL
    out = flat.copy()
    same = lambda i, k: owner[i] == owner[np.minimum(i + k, n - 1)]
    for gap in (1, 2, 3):  # a day, words, a year
        at = np.flatnonzero(kinds[: max(0, n - gap - 1)] == DAY)
        at = at[(kinds[at + gap + 1] == YEAR) & same(at, gap + 1)]
        for k in range(1, gap + 1):
            at = at[letters[at + k]]
        for k in range(1, gap + 1):
            out[at + k] = DATE
    at = np.flatnonzero(letters[: max(0, n - 2)])  # a word, a day, a year
    at = at[(kinds[at + 1] == DAY) & (kinds[at + 2] == YEAR) & same(at, 2)]
    out[at] = DATE
    first = np.ones(n, bool)
    words = np.flatnonzero(letters)
    first[words[1:]] = owner[words[1:]] != owner[words[:-1]]
    capital = (kinds == CAPITAL) & ~first & mixed[owner] & (out != DATE)
    begins = capital & ~np.concatenate([[False], capital[:-1]])
    few = np.bincount(owner[begins], minlength=len(mixed)) <= 2
    out[capital & few[owner]] = NAME
    return out


def _sequence(values: np.ndarray, offsets: np.ndarray, sources: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each line's sequence of tokens within its source; no line is empty."""
    place = ramp(np.diff(offsets)).astype(np.uint64)
    return mix(np.add.reduceat(mix(values + mix(place + np.uint64(salt))), offsets[:-1]) ^ mix(sources + np.uint64(salt)))


def _bands(values: np.ndarray, offsets: np.ndarray, sources: np.ndarray, mult: np.ndarray, salt: int) -> np.ndarray:
    """One combined hash of min-hashes for each line."""
    key = sources + np.uint64(salt)
    for m in mult:
        key = mix(key) ^ minimum_by(mix(values * m), offsets)
    return mix(key)


def _most_edits(length: int, similarity: float) -> int:
    """Edits that leave masked sequences of at most ``length`` tokens near-duplicates."""
    return int(length * (1 - similarity) + 1e-9)


def _band_rows(bands: int, rows: int, least_runs: int, similarity: float):
    """The mapper from (id, source, url, text) batches to band rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Tokens()
        rng = np.random.default_rng(20_240_501)
        mult = rng.integers(1, 2**63, size=(bands + 1, rows), dtype=np.uint64) | np.uint64(1)
        for batch in pieces(batches, 3):
            ids, nos, urls, srcs, codes, sizes, mixed = [], [], [], [], [], [], []
            for rid, source, url, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not text or source is None or url is None:
                    continue
                src, where = xxhash.xxh3_64_intdigest(source), xxhash.xxh3_64_intdigest(url)
                for no, line in enumerate(text.split("\n"), 1):
                    found = TOKENS.findall(line)
                    if len(found) < least_runs:
                        continue
                    codes += map(cache.__getitem__, found)
                    ids.append(rid), nos.append(no), urls.append(where), srcs.append(src)
                    sizes.append(len(found)), mixed.append(not line.isupper())
            if not ids:
                continue
            flat = np.array(codes, np.uint64)
            kinds, owner = (flat & np.uint64(7)).astype(np.int8), np.repeat(np.arange(len(ids)), sizes)
            flat &= ~np.uint64(7)
            veiled = masked(flat, kinds, owner, np.array(mixed))
            letters = kinds <= CAPITAL
            owner, flat, veiled = owner[letters], flat[letters], veiled[letters]
            count = np.bincount(owner, minlength=len(ids))
            long_enough = count >= least_runs
            inside = long_enough[owner]
            owner, flat, veiled = owner[inside], flat[inside], veiled[inside]
            lines = np.flatnonzero(long_enough)
            if not len(lines):
                continue
            count, sources = count[lines], np.array(srcs, np.uint64)[lines]
            offsets = np.concatenate([[0], np.cumsum(count)])
            exact, plain = _sequence(flat, offsets, sources, 1), _bands(flat, offsets, sources, mult[0], 2)
            said = np.add.reduceat((veiled > NAME).astype(np.int64), offsets[:-1]) >= least_runs
            whole = _sequence(veiled, offsets, sources, 3)
            edits = said & ((count * (1 - similarity) + 1e-9).astype(np.int64) > 0)
            kept = np.repeat(edits, count)
            toks, ends = veiled[kept], np.concatenate([[0], np.cumsum(count[edits])])
            keys = [plain[:, None], whole[:, None]]
            near = np.zeros((len(lines), bands), np.uint64)
            if len(toks):
                for b in range(bands):
                    near[edits, b] = _bands(toks, ends, sources[edits], mult[b + 1], 4 + b)
            keys = np.concatenate([*keys, near], axis=1)
            there = np.concatenate([np.ones((len(lines), 1), bool), said[:, None], np.repeat(edits[:, None], bands, 1)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()).take(pa.array(lines)),
                    pa.array(nos, pa.int32()).take(pa.array(lines)),
                    pa.array(signed(np.array(urls, np.uint64)[lines])),
                    pa.array(signed(exact)),
                    _lists(keys[there], there.sum(1)),
                    _lists(toks, np.where(edits, count, 0)),
                ],
                names=_SCHEMA.names,
            )

    return run


def _lists(values: np.ndarray, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(signed(values)))


def within(a: list, b: list, most: int) -> bool:
    """Whether a and b are at most ``most`` insertions, deletions or replacements apart (furthest reach on each diagonal)."""
    n, m = len(a), len(b)
    reach: dict[int, int] = {}
    for edits in range(most + 1):
        ahead = {}
        for d in range(-edits, edits + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1) if edits else 0
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            ahead[d] = i
        if ahead.get(m - n, -1) >= n:
            return True
        reach = ahead
    return False


#: Edits up to which shared stretches of words select what is compared in a band.
STRETCHES = 3


def near_pairs(forms: list[list[int]], similarity: float) -> Iterator[tuple[int, Iterator[int]]]:
    """For each sequence, the numbers of the others that are near-duplicates of it, lazily.

    Of two sequences ``most`` edits apart, cut the longer one into ``most`` + 1
    stretches: one of them stands in the other, shifted by ``most`` at most.
    """
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, form in enumerate(forms):
        by_length[len(form)].append(i)
    cuts = {n: [n * p // (k + 1) for p in range(k + 2)] for n in by_length if (k := _most_edits(n, similarity)) <= STRETCHES}
    whole, shifted = defaultdict(list), defaultdict(list)

    def stretches(n: int, form: list[int], shift: int) -> Iterator[tuple]:
        for p, (a, b) in enumerate(zip(cuts[n], cuts[n][1:])):
            for s in range(-shift, shift + 1):
                if a + s >= 0 and b + s <= len(form):
                    yield n, p, tuple(form[a + s : b + s])

    for n in cuts:
        k = _most_edits(n, similarity)
        for i in by_length[n]:
            for key in stretches(n, forms[i], 0):
                whole[key].append(i)
        for length in range(n - k, n + 1):
            for i in by_length.get(length, ()):
                for key in set(stretches(n, forms[i], k)):
                    shifted[key].append(i)

    def partners(i: int) -> Iterator[int]:
        mine, size, seen = forms[i], len(forms[i]), {i}
        pools = []
        if size in cuts:  # the longer one, or of the same length
            pools += [shifted[key] for key in stretches(size, mine, 0)]
        for n in by_length:
            k = _most_edits(max(n, size), similarity)
            if abs(n - size) > k:
                continue
            if max(n, size) not in cuts:
                pools.append(by_length[n])
            elif n >= size:
                pools += [whole.get(key, []) for key in set(stretches(n, mine, k))]
        for pool in pools:
            for j in pool:
                if j not in seen:
                    seen.add(j)
                    if within(mine, forms[j], _most_edits(max(size, len(forms[j])), similarity)):
                        yield j

    for i in range(len(forms)):
        yield i, partners(i)


def _verified(min_urls: int, similarity: float):
    """From the different sequences of one band to (form, url) of their near-duplicates, each form's own urls included.

    A sequence stops once it has ``min_urls`` urls; a repeated near-duplicate, whose urls were left out, gives as many numbers instead.
    """

    def run(table: pa.Table) -> pa.Table:
        form, tokens, urls = (table.column(c).to_pylist() for c in ("form", "tokens", "urls"))
        out_form, out_url = [], []
        if not all(u is None for u in urls):
            for i, near in near_pairs(tokens, similarity):
                if urls[i] is None:
                    continue
                got = set(urls[i])
                for j in near:
                    got.update(range(min_urls) if urls[j] is None else urls[j])
                    if len(got) >= min_urls:
                        break
                if len(got) > len(urls[i]):
                    out_form += [form[i]] * len(got)
                    out_url += got
        return pa.table({"form": pa.array(out_form, pa.int64()), "url": pa.array(out_url, pa.int64())})

    return run


def repeated_lines(
    df: DataFrame,
    id_col: str = "id",
    source_col: str = "source_id",
    url_col: str = "url",
    text_col: str = "text",
    min_urls: int = 12,
    least_runs: int = 3,
    bands: int = 6,
    rows: int = 3,
    similarity: float = 0.95,
) -> DataFrame:
    """Lines that belong to a cluster found under ``min_urls`` urls of a source: (id, line_no, exact).

    ``exact`` tells whether the line's own letter sequence reaches the count;
    else it only does together with verified near-duplicates.  Lines are separated by
    ``\\n`` and counted from 1, blank ones included.

    Null or empty text, and rows whose source or url is null, have no lines to
    take out.  A line stored repeatedly under one url counts once.  Lines with
    fewer than ``least_runs`` letter runs are never cases.  Rows that repeat an
    id are each judged alike and give one row per (id, line_no).  Other columns
    of ``df`` are ignored, whatever their names.  Hashes have 64 bits; two
    different lines of one source collide with probability n^2 / 2^65.
    """
    narrow = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.col(url_col).alias("url"), F.col(text_col).alias("text")
    )
    lines = materialize(narrow.mapInArrow(_band_rows(bands, rows, least_runs, similarity), _SCHEMA), "lines")
    exploded = lines.select("url", F.explode("bands").alias("key"))
    hot, n = counted(frequent_keys(exploded, "key", "url", min_urls).select("key"), "clusters")
    # exact cases: the lines of plain clusters, counted by their letters
    plain = join_bounded(lines.select("id", "line_no", "url", "letters", F.element_at("bands", 1).alias("key")), hot, "key", n, "left_semi")
    plain = materialize(plain.drop("key"), "nominated")
    cases, n_cases = counted(frequent_keys(plain, "letters", "url", min_urls).select("letters"), "repeated")
    exact = join_bounded(plain, cases, "letters", n_cases, "left_semi").select("id", "line_no", F.lit(True).alias("exact"))
    form = F.element_at("bands", 2)
    alike = lines.where(F.size("bands") > 1).select("id", "line_no", form.alias("key"))
    same = exact.unionByName(join_bounded(alike, hot, "key", n, "left_semi").select("id", "line_no", F.lit(False).alias("exact")))
    members = lines.where(F.size("tokens") > 0).select(form.alias("form"), "url", "tokens", F.explode(F.slice("bands", 3, bands)).alias("key"))
    members = join_bounded(members, hot, "key", n, "left_semi")
    members = join_bounded(members, hot.select(F.col("key").alias("form"), F.lit(True).alias("settled")), "form", n, "left")
    # a settled form needs no urls; the others have fewer than min_urls, so their sets are small
    members = members.groupBy("key", "form").agg(
        F.first("tokens").alias("tokens"), F.max("settled").alias("settled"), F.collect_set(F.when(F.col("settled").isNull(), F.col("url"))).alias("urls")
    )
    members = members.select("key", "form", "tokens", F.when(F.col("settled").isNull(), F.col("urls")).alias("urls"))
    pairs = members.groupBy("key").applyInArrow(_verified(min_urls, similarity), "form long, url long").distinct()
    near, n_near = counted(pairs.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_urls).select("form"), "near")
    close = join_bounded(lines.where(F.size("bands") > 1).select("id", "line_no", form.alias("form")), near, "form", n_near, "left_semi")
    found = same.unionByName(close.select("id", "line_no", F.lit(False).alias("exact")))
    return found.groupBy("id", "line_no").agg(F.max("exact").alias("exact"))


def without_lines(df: DataFrame, lines: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``df`` with the given (id, line_no) taken out of its texts.

    A text all of whose lines go becomes empty, null stays null; line breaks
    between the lines that stay are kept as they are.
    """
    gone = lines.groupBy(F.col("id").alias("_id")).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda _, i: ~F.array_contains(F.col("_gone"), (i + 1).cast("int"))), "\n")
    )
    joined = df.join(gone, F.col(id_col).cast("long") == F.col("_id"), "left")
    return joined.withColumn(text_col, kept).drop("_id", "_gone")
