"""Splitting oversized items at natural boundaries, with balanced targets.

An item over ``max_words`` words or ``max_chars`` characters is cut into the
smallest number of pieces that can hold it.  Equal-length targets are placed,
each is moved to the strongest boundary near it (paragraph, line, sentence,
word end, then anywhere inside an overlong word), and if a piece with its
overlap breaks a limit, pieces are added and the targets are placed anew; the
number of pieces is the smallest for which one less does not fit.

An item is handled by one task, whole; its cost is linear in its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import pieces

_WORD = re.compile(r"\S+")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*$|[。！？；][」』”’）]*$")
_INNER = re.compile(r"[^。！？；]+[。！？；」』”’）]*|[。！？；」』”’）]+")

#: Boundary strengths: inside a word, word, sentence, line and paragraph end.
INSIDE, WORD, SENTENCE, LINE, PARAGRAPH = range(5)


class Units:
    """The words of a text with the strength of the boundary after each; overlong words are cut into parts."""

    def __init__(self, text: str, longest: int):
        self.start: list[int] = []
        self.end: list[int] = []
        self.strength: list[int] = []
        self.whole: list[bool] = []
        last = 0
        for m in _WORD.finditer(text):
            a, b = m.span()
            if self.end:
                breaks = text.count("\n", last, a)
                if breaks:
                    self.strength[-1] = PARAGRAPH if breaks > 1 else LINE
            last = b
            if b - a <= longest:
                self._add(a, b, SENTENCE if _SENTENCE.search(m.group()) else WORD, True)
                continue
            for part in _INNER.finditer(m.group()):
                for at in range(part.start(), part.end(), longest):
                    stop = min(at + longest, part.end())
                    self._add(a + at, a + stop, SENTENCE if stop == part.end() else INSIDE, False)
        if self.strength:
            self.strength[-1] = PARAGRAPH

    def _add(self, a: int, b: int, strength: int, whole: bool) -> None:
        self.start.append(a), self.end.append(b), self.strength.append(strength), self.whole.append(whole)


def _overlap(units: Units, cut: int, words: int, max_chars: int) -> int:
    """First unit of the piece whose new text begins at unit ``cut``: ``words`` units earlier if they fit.

    The units before must leave room for the next one; parts of an overlong
    word may only take half of the limit.
    """
    first = cut
    while first > 0 and cut - first < words:
        room = max_chars if units.whole[first - 1] else max_chars // 2
        if units.end[cut] - units.start[first - 1] > room:
            break
        first -= 1
    return first


def _fits(units: Units, first: int, stop: int, max_words: int, max_chars: int) -> bool:
    return stop - first <= max_words and units.end[stop - 1] - units.start[first] <= max_chars


def split_text(text: str, max_words: int = 256, max_chars: int = 2048, overlap: int = 32, reach: float = 0.25) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start, new_start, end): text[start:new_start] repeats the piece before."""
    units = Units(text, max_chars // 4)
    n = len(units.start)
    if not n:
        return []
    if _fits(units, 0, n, max_words, max_chars):
        return [(units.start[0], units.start[0], units.end[-1])]
    length = units.end[-1] - units.start[0]
    least = max(2, -(-(n - overlap) // max(1, max_words - overlap)), -(-length // max_chars))
    attempt = lambda pieces: _check(units, _place(units, pieces, length, reach), max_words, max_chars, overlap)
    # counts are tried upwards in growing steps; then the last step is halved down to the first count that fits
    below, pieces, step, got = least - 1, least, 1, None
    while pieces < n and (got := attempt(pieces)) is None:
        below, pieces, step = pieces, pieces + step, 2 * step
    if got is None and below < n - 1:  # the last step went beyond all counts
        pieces, got = n - 1, attempt(n - 1)
    if got is None:
        return _greedy(units, max_words, max_chars, overlap)
    while pieces - below > 1:
        middle = (below + pieces) // 2
        if (better := attempt(middle)) is None:
            below = middle
        else:
            pieces, got = middle, better
    return got


def _place(units: Units, pieces: int, length: int, reach: float) -> list[int]:
    """Unit numbers at which pieces 2, 3, ... begin."""
    cuts, size, origin = [], length / pieces, units.start[0]
    last = 0
    for k in range(1, pieces):
        goal = origin + size * k
        low = bisect_left(units.end, goal - reach * size)
        high = bisect_left(units.end, goal + reach * size)
        best = None
        for i in range(max(low, last), min(max(high, low + 1), len(units.end) - 1)):
            rank = (units.strength[i], -abs(units.end[i] - goal))
            if best is None or rank > best[0]:
                best = (rank, i + 1)
        if best is not None and best[1] > last:
            last = best[1]
            cuts.append(last)
    return cuts


def _check(units: Units, cuts: list[int], max_words: int, max_chars: int, overlap: int) -> list[tuple[int, int, int]] | None:
    out, bounds = [], [0, *cuts, len(units.start)]
    for a, b in zip(bounds, bounds[1:]):
        first = _overlap(units, a, overlap, max_chars) if a else 0
        if not _fits(units, first, b, max_words, max_chars):
            return None
        out.append((units.start[first], units.start[a], units.end[b - 1]))
    return out


def _greedy(units: Units, max_words: int, max_chars: int, overlap: int) -> list[tuple[int, int, int]]:
    """Fill each piece to its limits; only for items that no balanced placement fits."""
    out, at, n = [], 0, len(units.start)
    while at < n:
        first = _overlap(units, at, overlap, max_chars) if at else 0
        stop = at + 1
        while stop < n and _fits(units, first, stop + 1, max_words, max_chars):
            stop += 1
        out.append((units.start[first], units.start[at], units.end[stop - 1]))
        at = stop
    return out


_OUT = T.StructType(
    [
        T.StructField("rec_kind", T.StringType()),
        T.StructField("rec_id", T.LongType()),
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("pieces", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("new_start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)


def oversized_pieces(
    df: DataFrame,
    kind: str,
    id_col: str,
    text_col: str,
    max_words: int = 256,
    max_chars: int = 2048,
    overlap: int = 32,
    only_oversized: bool = True,
) -> DataFrame:
    """Pieces of the items over a limit: (rec_kind, rec_id, piece_no, pieces, start, new_start, stop, text).

    An item is oversized with more than ``max_words`` words (separated by any
    white space) or more than ``max_chars`` characters as stored.  ``text`` is
    the item's text from ``start`` to ``stop``; up to ``new_start`` it repeats
    the end of the piece before, 32 words where that many fit beside the next
    word.  Piece numbers count from 0.  Each piece keeps both limits.

    Null texts and items within the limits give no rows (with
    ``only_oversized`` = False they give one piece, blank ones none).  An item
    that is oversized by white space alone gives one empty piece, one that is
    oversized by surrounding white space one piece.  Repeated rows are split
    each.  Other columns are ignored.  No shuffle.
    """
    if not 0 <= overlap < max_words:
        raise ValueError("overlap must be smaller than the word limit")
    if max_chars < 8:
        raise ValueError("a piece must hold eight characters or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            rows: list[tuple] = []
            for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                over = len(text) > max_chars or (len(text) > 2 * max_words and len(text.split()) > max_words)
                if not over and only_oversized:
                    continue
                got = split_text(text, max_words, max_chars, overlap) or ([(0, 0, 0)] if over else [])
                rows += [(kind, rec, k, len(got), a, m, b, text[a:b]) for k, (a, m, b) in enumerate(got)]
            if rows:
                types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_OUT.names)

    long = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    if only_oversized:  # more than n words take more than 2 n characters
        long = long.where(F.length("text") > min(max_chars, 2 * max_words))
    return long.mapInArrow(run, _OUT)


def oversized_items(scraped: DataFrame, chunks: DataFrame, **limits: int) -> DataFrame:
    """The pieces of both tables' oversized items; rec_kind is 'scraped' or 'chunk'."""
    return oversized_pieces(scraped, "scraped", "scraped_id", "content", **limits).unionByName(
        oversized_pieces(chunks, "chunk", "piece_id", "text", **limits)
    )
