"""Groups of records that differ by small edits, by pigeonring filtering.

A text is the set of its shingles (``width`` consecutive words).  The set is
mapped to a Hamming space: ``segments * span`` min-hashes, laid out on a ring
of ``segments`` segments of ``span`` positions.  Two sets of similarity J
differ in each position with probability 1 - J, so that similarity >= t means
a Hamming distance of at most ``budget`` (the expectation plus ``slack``
standard deviations).

*Budgets.*  The budget plus one is dealt out to the segments in whole units,
so that it is overdrawn exactly if all segments use up theirs.  If the
differences of a pair sum up to no more than ``budget``, there is a segment
from which on the ring every chain of consecutive segments has fewer
differences than the units of its segments together.

*Candidates.*  A pair is considered from each segment in which it does not
differ at all.  A chain may also begin with a segment of u units that holds up
to u - 1 differences; indexing each choice of positions to leave out finds
those, and was given up: two min-hashes that are left select so little that
the shuffle grew to 33 times the input at 30 GB.  With ``segments`` short
segments a pair at the threshold 0.6 has a chain from a segment without
differences with a chance of 99.5 %, at 0.65 of 99.93 %.

*Pigeonring.*  Each index row carries, beside the hash of the positions that
are left, four bits of each position of the ``chain`` segments from its own on;
the join condition walks the chain and drops a pair at the first length at
which it overdraws.  Four bits can only hide a difference, so no such chain is
lost to them.

*Check.*  What is left gets the full Hamming check on the shingle sets of the
whole texts: their symmetric difference against the exact threshold.

Texts with the same word sequence are collapsed before the index is built,
and the pairs between representatives are expanded only at the end.  Index
values shared by very many representatives are joined in blocks of bounded
size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamdex.runtime import counted, join_bounded, materialize

from .hashing import WordHashes, flat_words, minimum_by, mix, pieces, shingles, signed

_DOCS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("same", T.LongType()),
        T.StructField("same2", T.LongType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("ring", T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("tail", T.LongType())]), False)),
    ]
)
#: Low bits of an index value that hold the number of its segment.
SEGMENT_BITS = 5

_SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("set", T.ArrayType(T.LongType(), False))])


def units_of(budget: float, segments: int, span: int) -> list[int]:
    """The units of each segment; together one more than the whole differences of the budget, and ``span`` each at most."""
    total = min(int(budget) + 1, segments * span)
    return [total // segments + (i < total % segments) for i in range(segments)]


def _ring(segments: int, span: int, chain: int, width: int, least: int):
    """The mapper from (id, text) to ring rows: per segment its hash, which ends in the segment's number, and the low bits of its chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        k = segments * span
        rng = np.random.default_rng(7_919)
        mult = rng.integers(1, 2**32, size=k, dtype=np.uint32) | np.uint32(1)
        add = rng.integers(0, 2**32, size=k, dtype=np.uint32)
        for batch in pieces(batches, 1):
            ids = batch.column(0).to_numpy()
            hashes, offsets = flat_words(batch.column(1).to_pylist(), cache)
            long = np.diff(offsets) >= max(least, width)
            use = np.flatnonzero(long)
            if not len(use):
                continue
            hashes = hashes[np.repeat(long, np.diff(offsets))]
            offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[use])])
            same = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            same = np.frombuffer(b"".join(same), dtype=np.int64).reshape(-1, 2)
            sh, bounds = shingles(hashes, offsets, width)
            counts = np.array([len(np.unique(sh[a:b])) for a, b in zip(bounds[:-1], bounds[1:])])
            small = (sh >> np.uint64(32)).astype(np.uint32)
            sig = np.empty((len(use), k), np.uint32)
            for j in range(k):
                x = small * mult[j] + add[j]
                x ^= x >> np.uint32(15)
                sig[:, j] = minimum_by(x * np.uint32(0x9E3779B1), bounds)
            low = (sig & np.uint32(15)).astype(np.uint64)
            walks = np.zeros((len(use), segments), np.uint64)
            for s in range(segments):
                for p in range(chain * span):
                    walks[:, s] |= low[:, (s * span + p) % k] << np.uint64(4 * p)
            keys = np.empty((len(use), segments), np.uint64)
            for s in range(segments):
                acc = np.full(len(use), s + 1, np.uint64)
                for p in range(span):
                    acc = mix(acc) ^ sig[:, s * span + p].astype(np.uint64)
                keys[:, s] = mix(acc) << np.uint64(SEGMENT_BITS) | np.uint64(s)
            ring = pa.StructArray.from_arrays([pa.array(signed(keys.ravel())), pa.array(signed(walks.ravel()))], names=["key", "tail"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[use]),
                    pa.array(same[:, 0].copy()),
                    pa.array(same[:, 1].copy()),
                    pa.array(counts.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(use) * segments + 1, segments, dtype=np.int32)), ring),
                ],
                names=["id", "same", "same2", "n", "ring"],
            )

    return run


def _sets(width: int):
    """The mapper from (id, text) to sorted sets of shingle hashes of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in pieces(batches, 1):
            hashes, offsets = flat_words(batch.column(1).to_pylist(), cache)
            sh, so = shingles(hashes, offsets, width)
            sets = [np.unique(sh[so[i] : so[i + 1]]) for i in range(batch.num_rows)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "set"])

    return run


def _spent(x: Column, y: Column, start: int, stop: int) -> Column:
    """Number of four-bit fields from ``start`` to ``stop`` in which the two words differ."""
    z = x.bitwiseXOR(y)
    z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
    z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
    fields = reduce(lambda a, p: a | (1 << (4 * p)), range(start, stop), 0)
    return F.bit_count(z.bitwiseAND(F.lit(fields - (1 << 64) if fields >= 1 << 63 else fields)))


def budget_for(threshold: float, positions: int, slack: float) -> float:
    """The Hamming distance that pairs at the threshold exceed with the chance of ``slack`` standard deviations."""
    return positions * (1 - threshold) + slack * math.sqrt(positions * threshold * (1 - threshold))


def duplicate_groups(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    threshold: float = 0.8,
    width: int = 5,
    least_words: int = 10,
    segments: int = 30,
    span: int = 3,
    chain: int = 5,
    slack: float = 3.0,
    block: int = 4096,
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of all records whose shingle sets have a similarity of ``threshold`` or more.

    members(id, rep): each record with ``least_words`` or more words and the
    smallest id with the same word sequence.  links(rep_a, rep_b, shared,
    total): pairs of different representatives, rep_a < rep_b, with the number
    of shingles in both and in either.

    Null, empty and short texts have no members row.  Records whose words are
    equal share a representative, so ties and repeated rows make no links among
    themselves.  Ids must be unique.  Other columns are ignored.

    Recall: a pair of similarity J is missed if no chain within its budget
    begins with a segment without differences (0.5 % at J = 0.6, 0.07 % at
    0.65 and 0.001 % at 0.8 with the threshold 0.8), or if its Hamming distance
    exceeds the budget, ``slack`` standard deviations above its mean (0.2 %).
    """
    if chain * span > 16 or segments > 1 << SEGMENT_BITS:
        raise ValueError(f"a chain may cover 16 positions, and there may be {1 << SEGMENT_BITS} segments")
    units = units_of(budget_for(threshold, segments * span, slack), segments, span)
    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    docs = materialize(narrow.mapInArrow(_ring(segments, span, chain, width, least_words), _DOCS), "ring")
    # exact copies: only hashes and ids are shuffled, combined on the map side
    reps = docs.groupBy("same", "same2").agg(F.min("id").alias("rep"))
    members = materialize(docs.select("id", "same", "same2").join(reps, ["same", "same2"]).select("id", "rep"), "members")
    copies, n_copies = counted(members.where("id <> rep").select("id"), "copies")
    index = join_bounded(docs, copies, "id", n_copies, "left_anti").select("id", "n", F.inline("ring"))
    links = _candidates(index, threshold, units, span, chain, block)
    cand, n_cand = counted(links, "candidates")
    ends = cand.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ends, n_ends = counted(ends, "ends")
    texts = join_bounded(narrow, ends, "id", n_ends, "left_semi")
    sets = materialize(texts.mapInArrow(_sets(width), _SETS), "sets")
    left = cand.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    sized = both.select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b")).alias("both"))
    out = sized.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), "shared", (F.col("both") - F.col("shared")).alias("total"))
    return members, out.where(F.col("shared") >= F.lit(threshold) * F.col("total") - 1e-9)


def _candidates(index: DataFrame, threshold: float, units: list[int], span: int, chain: int, block: int) -> DataFrame:
    """Pairs (a, b), a < b, that begin a chain within its budget at some segment."""
    # values of one record cannot meet anything: drop them before the self-join
    groups, n_groups = counted(index.groupBy("key").agg(F.count(F.lit(1)).alias("g")).where("g > 1"), "shared-keys")
    rows = join_bounded(index, groups, "key", n_groups)
    # a value with many records is cut into blocks; a record meets the blocks up to its own
    blocks = F.ceil(F.col("g") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    rows = rows.withColumn("own", own)
    right = rows.select("key", F.col("own").alias("cell"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tail").alias("tb"))
    left = rows.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("cell"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("tail").alias("ta"))
    pairs = left.join(right, ["key", "cell"]).where("a < b")
    pairs = pairs.where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9)
    segment = F.col("key").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int") + 1
    for length in range(1, chain + 1):
        most = [sum(units[(s + k) % len(units)] for k in range(length)) - 1 for s in range(len(units))]
        allowed = F.lit(most[0]) if len(set(most)) == 1 else F.element_at(F.array(*map(F.lit, most)), segment)
        pairs = pairs.where(_spent(F.col("ta"), F.col("tb"), 0, length * span) <= allowed)
    return pairs.select("a", "b").distinct()


def pairs_of(members: DataFrame, links: DataFrame, block: int = 2048) -> DataFrame:
    """All pairs of records (id_a < id_b) behind representatives and links.

    Its size is that of the result.  A class of more than ``block`` copies is
    cut into cells by a hash of the id, and each pairing of a cell with a record
    or a link is a key of its own, so that no task holds a whole hot class.
    """
    hot, n_hot = counted(members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cells")).where("cells > 1"), "hot-classes")

    def spread(rows: DataFrame, rep: str, cell: str) -> DataFrame:
        """One row for each cell of the class."""
        tagged = join_bounded(rows, hot.select(F.col("rep").alias(rep), F.col("cells").alias("_c")), rep, n_hot, "left")
        return tagged.withColumn(cell, F.explode(F.sequence(F.lit(0), F.coalesce("_c", F.lit(1)) - 1))).drop("_c")

    def placed(name: str, rep: str, cell: str) -> DataFrame:
        """Each record in its own cell."""
        tagged = join_bounded(members.select(F.col("rep").alias(rep), F.col("id").alias(name)), hot.select(F.col("rep").alias(rep), F.col("cells").alias("_c")), rep, n_hot, "left")
        return tagged.select(rep, name, F.pmod(F.xxhash64(name), F.coalesce("_c", F.lit(1))).cast("int").alias(cell))

    a, b = placed("x", "rep_a", "cell_a"), placed("y", "rep_b", "cell_b")
    half = spread(links.select("rep_a", "rep_b"), "rep_a", "cell_a").join(a, ["rep_a", "cell_a"]).select("rep_b", "x")
    across = spread(half, "rep_b", "cell_b").join(b, ["rep_b", "cell_b"]).select("x", "y")
    copies = members.where("id <> rep").select("rep").distinct()
    same = members.join(copies, "rep", "left_semi").select(F.col("rep").alias("rep_b"), F.col("id").alias("x"))
    within = spread(same, "rep_b", "cell_b").join(b, ["rep_b", "cell_b"]).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
