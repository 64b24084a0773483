"""Passages of held-out items inside a corpus.

Items are a small set that is fixed beside the corpus; the corpus is scanned
once and never shuffled.  Every window of words of an item (``passage`` words,
or the whole item if it has fewer) is embedded by a *CGK random walk*: the
output reads the current word at every step, and a random bit of that word and
step says whether the walk moves on.  Windows at a small edit distance stay
aligned after an edit with good chance, so edit distance becomes Hamming
distance.  Each of ``tables`` repetitions samples ``samples`` output positions;
their combined hash is looked up in a table of the items' values.  Windows
without an edit always meet; the number of repetitions sets the recall for
windows with up to ``edits`` edits.

The first word is always sampled, so that few windows of the corpus need a
walk.  Passages whose first words are edited are found by what follows: each
window is also indexed without its first 1 .. ``edits`` words, with as many
edits fewer left for the rest.  At the end of a text windows may be shorter by
the number of edits.

A hit is compared by the hashes of its words first, from both ends towards the
edit, and then verified on the words themselves by edit distance; with
``edits`` = 0 that is equality of the words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import WordHashes, flat_words, mix, pieces, ramp, words_of

_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType())])

#: Items that workers hold at a time; more are looked for in blocks, each with a scan of its own.
MOST_ITEMS = 100_000


def embed(hashes: np.ndarray, starts: np.ndarray, length: int | np.ndarray, positions: np.ndarray, seed: int) -> np.ndarray:
    """CGK outputs at the given (sorted) positions of the windows that begin at ``starts``: (positions, windows).

    The step bit of a word comes from its seeded hash, so equal words walk
    alike; past its last word a window reads zeros.
    """
    padded = np.concatenate([hashes, np.zeros(1, np.uint64)])
    walk = mix(padded ^ np.uint64(seed))
    walk[-1] = 0
    stop = starts + length
    at = starts.copy()
    out = np.empty((len(positions), len(starts)), np.uint64)
    want = 0
    for step in range(int(positions[-1]) + 1 if len(positions) else 0):
        here = np.where(at < stop, at, len(hashes))
        if positions[want] == step:
            out[want] = padded[here]
            want += 1
        at = at + ((walk[here] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
    return out


def _positions(length: int, samples: int, table: int) -> np.ndarray:
    """Sampled output positions of one repetition; the first output is always among them."""
    rng = np.random.default_rng(1_000 * length + table)
    more = rng.choice(np.arange(1, min(3 * length, 60)), size=min(samples, 3 * length) - 1, replace=False)
    return np.sort(np.concatenate([[0], more]))


#: Repetitions that sample the same walk.
SHARED = 4


def _keys(hashes: np.ndarray, starts: np.ndarray, length: int, samples: int, tables: int, sizes: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The combined hash of each repetition's sampled outputs, for all windows; ``sizes`` are the words of shorter ones."""
    for first in range(0, tables, SHARED):
        wanted = {t: _positions(length, samples, t) for t in range(first, min(first + SHARED, tables))}
        every = np.unique(np.concatenate(list(wanted.values())))
        outputs = embed(hashes, starts, length if sizes is None else sizes, every, 0x9E37_79B9 + first)
        for t, positions in wanted.items():
            key = np.full(len(starts), length * 64 + t, np.uint64)
            for row in np.searchsorted(every, positions):
                key = mix(key) ^ outputs[row]
            yield mix(key)


def edit_distance(a: list[str], b: list[str], most: int) -> int:
    """Word edit distance of a to b, or ``most`` + 1 if it is larger."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    head = 0
    while head < n and head < m and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and tail < m - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    a, b = a[head : n - tail], b[head : m - tail]
    if len(a) <= 1 and len(b) <= 1 or not a or not b:
        return min(max(len(a), len(b)), most + 1)
    if most < 2:  # both ends of what is left differ
        return most + 1
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
        last = row
    return min(last[-1], most + 1)


#: Words from which on an item shorter than a passage is also looked for with edits.
LEAST_EDITED = 4


@dataclass(frozen=True)
class Part:
    """The windows of one length without their first ``cut`` words, of which ``edits`` may be edited; ``least`` edits at least are found by it."""

    length: int
    cut: int
    edits: int
    least: int
    samples: int
    windows: list[tuple[int, int]]
    words: np.ndarray
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    firsts: np.ndarray


class ItemIndex:
    """The windows of all items and, for each repetition, the sorted keys that point to them."""

    def __init__(self, items: list[tuple[int, str | None]], passage: int, samples: int, tables: int, edits: int = 0):
        self.words = {i: w for i, text in items if (w := words_of(text))}
        by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, words in sorted(self.words.items()):
            length = min(passage, len(words))
            by_length[length] += [(item, k) for k in range(len(words) - length + 1)]
        cache = WordHashes()
        self.parts: list[Part] = []
        for whole, windows in sorted(by_length.items()):
            most = min(edits, whole - 1) if whole == passage or whole >= LEAST_EDITED else 0
            # what is held as it is comes first: then nothing better is left to be found for it
            for cut, left in [(0, 0), *((cut, most - cut) for cut in range(most + 1) if most)]:
                length = whole - cut
                flat, starts = [], []
                for item, k in windows:
                    starts.append(len(flat))
                    flat += [cache[w] for w in self.words[item][k + cut : k + whole]]
                hashes, first = np.array(flat, np.uint64), np.array(starts, np.int64)
                # in few words an edit meets most of many samples; without edits one repetition finds all
                drawn = min(samples, max(3, length // 2)) if left else samples
                found = []
                for keys in _keys(hashes, first, length, drawn, tables if left else 1):
                    order = np.argsort(keys, kind="stable")
                    found.append((keys[order], order, _bitmap(keys)))
                least = max(1, cut) if left or cut else 0
                self.parts.append(Part(length, cut, left, least, drawn, windows, hashes.reshape(-1, length), found, np.unique(hashes[first])))
        self.parts.sort(key=lambda part: part.least)
        self.firsts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(part.firsts for part in self.parts)]))

    def begins(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that begin a window of any part, and the ends of their texts."""
        starts = np.flatnonzero(_member(hashes, self.firsts)) if len(self.firsts) else np.zeros(0, np.int64)
        return starts, offsets[np.searchsorted(offsets, starts, "right")] if len(starts) else starts

    def hits(self, hashes: np.ndarray, part: Part, begins: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(word positions, window numbers), each once, where the texts' windows meet the items' in some repetition."""
        starts, ends = begins
        # the first output of every walk is the window's first word
        kept = _member(hashes[starts], part.firsts) & (ends - starts >= part.length - part.edits)
        starts, sizes = starts[kept], np.minimum(part.length, (ends - starts)[kept]) if part.edits else None
        got = [np.zeros(0, np.int64)]
        for (keys, order, bitmap), mine in zip(part.found, _keys(hashes, starts, part.length, part.samples, len(part.found), sizes)):
            near = np.flatnonzero(bitmap[(mine >> np.uint64(64 - BITS)).astype(np.int64)])
            first = np.searchsorted(keys, mine[near], "left")
            times = np.searchsorted(keys, mine[near], "right") - first
            windows = order[np.repeat(first, times) + ramp(times)]
            got.append(np.repeat(starts[near], times) * len(part.windows) + windows)
        met = np.unique(np.concatenate(got))
        return met // len(part.windows), met % len(part.windows)


def alike(hashes: np.ndarray, ends: np.ndarray, at: np.ndarray, want: np.ndarray, edits: int) -> np.ndarray:
    """Which of the windows that begin at ``at`` can be within ``edits`` (0 or 1) words of those wanted, by their hashes; ``ends`` are the ends of their texts."""
    length = want.shape[1]
    padded = np.concatenate([hashes, np.zeros(1, np.uint64)])

    def words(shift: int) -> np.ndarray:
        place = at[:, None] + np.arange(length)[None, :] + shift
        return padded[np.where(place < ends[:, None], place, len(hashes))]

    same = words(0) == want
    if edits == 0:
        return same.all(1)
    head = np.where(same.all(1), length, (~same).argmax(1))
    out = np.zeros(len(at), bool)
    for stretch, need in ((0, length - 1), (1, length), (-1, length - 1)):  # a word replaced, inserted or deleted
        back = (same if stretch == 0 else words(stretch) == want)[:, ::-1]
        tail = np.where(back.all(1), length, (~back).argmax(1))
        out |= head + tail >= need
    return out


#: Leading bits of a key that a first look at a table compares.
BITS = 20


def _bitmap(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITS, bool)
    out[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return out


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Membership in a small sorted set, by a bitmap first."""
    small = np.zeros(1 << 16, bool)
    small[(of >> np.uint64(48)).astype(np.int64)] = True
    out = small[(values >> np.uint64(48)).astype(np.int64)]
    at = np.flatnonzero(out)
    pos = np.minimum(np.searchsorted(of, values[at]), len(of) - 1)
    out[at] = of[pos] == values[at]
    return out


def leaks(
    corpus: DataFrame,
    items: DataFrame,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    passage: int = 12,
    edits: int = 0,
    samples: int = 6,
    tables: int | None = None,
) -> DataFrame:
    """(doc_id, item_id, edits): each text and item of which it holds a passage.

    A passage is ``passage`` consecutive words of the item, or all its words if
    it has fewer, with at most ``edits`` words inserted, deleted or replaced in
    the text; items of fewer than ``LEAST_EDITED`` words (and than ``passage``)
    are only looked for as they are, since so few words say too little with
    one of them edited.  ``edits`` in the result is the smallest number found.

    Null, empty and wordless texts hold nothing, and wordless items are in
    nothing.  An item stored under two ids leaks under both, a text stored
    under two ids holds the same items under both; a passage that occurs
    repeatedly gives one row.  Other columns are ignored.  The items are the
    query set: the corpus is scanned once for each ``MOST_ITEMS`` of them.
    """
    tables = tables or (1 if edits == 0 else 12 * edits)
    asked = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i is not null")
    blocks = max(1, -(-asked.count() // MOST_ITEMS))
    scanned = corpus.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    parts = []
    for block in range(blocks):
        held = [(r[0], r[1]) for r in (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block)).collect()]
        parts.append(scanned.mapInArrow(_scan(held, passage, samples, tables, edits), _OUT))
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def _scan(held: list[tuple[int, str | None]], passage: int, samples: int, tables: int, edits: int):
    """The mapper from (doc_id, text) to what each text holds of the given items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, cache = ItemIndex(held, passage, samples, tables, edits), WordHashes()
        for batch in pieces(batches, 1):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hashes, offsets = flat_words(texts, cache)
            best: dict[tuple[int, int], int] = {}
            split: dict[int, list[str]] = {}
            begins = index.begins(hashes, offsets)
            for part in index.parts:
                places, numbers = index.hits(hashes, part, begins)
                owner = np.searchsorted(offsets, places, "right") - 1
                if part.edits <= 1:  # most of what meets by chance goes here
                    kept = [np.zeros(0, np.int64)]
                    for at in range(0, len(places), 50_000):
                        some = slice(at, at + 50_000)
                        kept.append(at + np.flatnonzero(alike(hashes, offsets[owner[some] + 1], places[some], part.words[numbers[some]], part.edits)))
                    kept = np.concatenate(kept)
                    places, numbers, owner = places[kept], numbers[kept], owner[kept]
                for text, at, number in zip(owner.tolist(), (places - offsets[owner]).tolist(), numbers.tolist()):
                    item, k = part.windows[number]
                    pair = (text, item)
                    if best.get(pair, edits + 1) <= part.least:
                        continue
                    if text not in split:
                        split[text] = words_of(texts[text])
                    want = index.words[item][k + part.cut : k + part.cut + part.length]
                    for stretch in range(-part.edits, part.edits + 1):
                        d = edit_distance(split[text][at : at + part.length + stretch], want, part.edits)
                        if d <= part.edits and d + part.cut < best.get(pair, edits + 1):
                            best[pair] = d + part.cut
            if best:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[t] for t, _ in best], pa.int64()), pa.array([i for _, i in best], pa.int64()), pa.array(list(best.values()), pa.int32())],
                    names=["doc_id", "item_id", "edits"],
                )

    return run
