"""Word hashing and segment arithmetic on flat numpy arrays.

Texts of one Arrow batch are kept as one flat array of 64-bit word hashes plus
offsets, so that shingles, min-hashes and windows are computed for the whole
batch by a few vector operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Maximal runs of letters or digits of any script; the underscore is neither.
WORD = re.compile(r"[^\W_]+")

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def pieces(batches: Iterable[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a text column has fewer than ``most`` bytes in each after its first row.

    Arrays derived from words take many times the bytes of the text, so this bounds a worker's memory.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class WordHashes(dict):
    """Word to signed-free 64-bit hash; forgets its words when it holds ``most`` of them."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix); ``x`` is uint64."""
    x = (x ^ (x >> _S30)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S31)


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case; none for null."""
    return WORD.findall(text.lower()) if text else []


def flat_words(texts: list[str | None], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets): words of text i are ``hashes[offsets[i]:offsets[i + 1]]``."""
    out: list[int] = []
    ends = [0]
    for text in texts:
        if text:
            out.extend(map(cache.__getitem__, WORD.findall(text.lower())))
        ends.append(len(out))
    return np.array(out, dtype=np.uint64), np.array(ends, dtype=np.int64)


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` consecutive words, with their offsets; order counts."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    n = len(hashes) - size + 1
    acc = hashes[:n].copy()
    for j in range(1, size):
        acc = mix(acc) + hashes[j : n + j]
    acc = mix(acc)
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    keep = np.repeat(offsets[:-1], counts) + ramp(counts)
    return acc[keep], np.concatenate([[0], np.cumsum(counts)])


def ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    starts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(starts, counts)


def minimum_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum of each non-empty segment; empty segments must be left out by the caller."""
    return np.minimum.reduceat(values, offsets[:-1])


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as a signed integer, as Spark's BIGINT has no unsigned form."""
    return x.view(np.int64)
