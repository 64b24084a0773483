"""Encoding of a corpus with a public byte-level BPE vocabulary.

The vocabulary's splitting pattern cuts a text into pieces that never share a
token.  A piece of ``long_piece`` characters or more (a run that the pattern
cannot split) is encoded by *tree concatenation*: its bytes are cut into
leaves, which are encoded by themselves, and neighbours are joined pairwise,
level by level, by re-encoding a window of tokens around the join, which grows
until the window agrees with both sides.

A text of ``spread`` characters or more is cut into parts, of whole pieces or
of leaves, that are shuffled apart; all tasks encode them, and the encodings
meet again, already a few per part, to be joined in order.  So one very long
run keeps all cores busy.  Shorter texts are encoded where they are read,
without a shuffle.

Agreement is exact: a token sequence is the encoding of its bytes if and only
if every two neighbouring tokens are the encoding of their own concatenation.
Within either side and within the window that holds already, so only the two
seams of the window have to be tested.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamdex.runtime import data_path

from .hashing import pieces

#: Directory of the public vocabulary files; never copied into the repository.
VOCABULARIES = data_path("LOAMDEX_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the splitting pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes up to which a leaf is encoded at once.
LEAF = 512

Encode = Callable[[bytes], list[int]]


@lru_cache(maxsize=2)
def vocabulary(name: str, directory: str):
    """The tiktoken encoding of ``<directory>/<name>.tiktoken``, loaded once a worker; without special tokens."""
    import tiktoken

    with open(f"{directory}/{name}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def join_encodings(left: list[int], right: list[int], encode: Encode, token_bytes: Callable[[int], bytes]) -> list[int]:
    """The encoding of the concatenation of two encoded byte strings."""
    if not left or not right:
        return left + right

    def agree(a: int, b: int) -> bool:
        return encode(token_bytes(a) + token_bytes(b)) == [a, b]

    reach = 4
    while True:
        near, far = left[max(0, len(left) - reach) :], right[:reach]
        window = encode(b"".join(map(token_bytes, near + far)))
        before, after = left[: len(left) - len(near)], right[len(far) :]
        if (not before or agree(before[-1], window[0])) and (not after or agree(window[-1], after[0])):
            return before + window + after
        reach *= 2


def join_all(level: list[list[int]], encode: Encode, token_bytes: Callable[[int], bytes]) -> list[int]:
    """The encoding of a run from those of its consecutive parts; joined pairwise, level by level."""
    while len(level) > 1:
        level = [join_encodings(*level[i : i + 2], encode, token_bytes) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else []


def tree_encode(data: bytes, encode: Encode, token_bytes: Callable[[int], bytes], leaf: int = LEAF) -> list[int]:
    """The encoding of one unsplit run of bytes."""
    parts = max(1, -(-len(data) // leaf))
    cuts = [len(data) * i // parts for i in range(parts + 1)]
    return join_all([encode(data[a:b]) for a, b in zip(cuts, cuts[1:])], encode, token_bytes)


def stretches(text: str, long_piece: int) -> Iterator[tuple[bool, str]]:
    """The text in order as (whether it is one long piece, stretch); other stretches end where a piece ends.

    White space before a long piece stands in stretches of its own, one for
    each piece, as the pattern looks ahead there: put together they would be
    split otherwise.
    """
    if not _unsplit(long_piece).search(text):
        yield False, text
        return
    import regex

    start = solid = 0
    blanks: list[str] = []
    for piece in regex.finditer(PATTERN, text):
        if piece.end() - piece.start() >= long_piece:
            if solid > start:
                yield False, text[start:solid]
            for blank in blanks:
                yield False, blank
            yield True, piece.group()
            start = solid = piece.end()
            blanks = []
        elif piece.group().isspace():
            blanks.append(piece.group())
        else:
            solid, blanks = piece.end(), []
    if start < len(text):
        yield False, text[start:]


def encode_text(text: str | None, vocab, long_piece: int = 1024, leaf: int = LEAF) -> list[int]:
    """Token ids of one text; none for null and for the empty text."""
    out: list[int] = []
    for whole, stretch in stretches(text, long_piece) if text else ():
        if whole:
            out += tree_encode(stretch.encode("utf-8", "replace"), vocab._encode_single_piece, vocab.decode_single_token_bytes, leaf)
        else:
            out += vocab.encode_ordinary(stretch)
    return out


@lru_cache(maxsize=4)
def _unsplit(long_piece: int) -> re.Pattern:
    """Runs of one class that the pattern may leave unsplit; a superset of its long pieces."""
    n = long_piece - 1
    return re.compile(rf"[^\W\d_]{{{n}}}|[\d]{{{n}}}|\s{{{n}}}|[^\s]{{{n}}}")


_PART = T.StructType(
    [T.StructField("run", T.IntegerType()), T.StructField("no", T.IntegerType()), T.StructField("whole", T.BooleanType()), T.StructField("data", T.BinaryType())]
)


def parts_of(text: str, long_piece: int, part: int) -> Iterator[tuple[int, int, bool, bytes]]:
    """(run, no, whether of a long piece, bytes) of a text: parts of one run are to be joined, runs to be put one after the other."""
    run = 0
    for whole, stretch in stretches(text, long_piece):
        if whole:
            data = stretch.encode("utf-8", "replace")
            for no, at in enumerate(range(0, len(data), part)):
                yield run, no, True, data[at : at + part]
            run += 1
            continue
        import regex

        start = 0  # cut after a piece that is not white space
        for piece in regex.finditer(PATTERN, stretch) if len(stretch) > part else ():
            if piece.end() - start >= part and not piece.group().isspace():
                yield run, 0, False, stretch[start : piece.end()].encode("utf-8", "replace")
                run, start = run + 1, piece.end()
        if start < len(stretch):
            yield run, 0, False, stretch[start:].encode("utf-8", "replace")
            run += 1


def token_ids(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    name: str = "byte_bpe_50k",
    directory: str = VOCABULARIES,
    long_piece: int = 1024,
    leaf: int = LEAF,
    spread: int = 1 << 20,
    part: int = 1 << 16,
) -> DataFrame:
    """(id, ids): the token ids of each text, in text order, without special tokens.

    Null and empty texts give an empty list; texts that spell a special token
    are ordinary text.  Rows that repeat are encoded each.  Other columns are
    ignored.  One row in gives one row out; only texts of ``spread`` characters
    or more are shuffled, in parts of ``part`` bytes.  The vocabulary file must
    be in ``directory`` on every worker; it is never copied.
    """
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def batch_of(keys: pa.Array, ids: list[list[int]]) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array([t for x in ids for t in x], pa.int32()))
        return pa.RecordBatch.from_arrays([keys, lists.cast(pa.list_(pa.field("element", pa.int32(), False)))], names=[id_col, "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(name, directory)
        for batch in pieces(batches, 1):
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                yield batch_of(some.column(0), [encode_text(text, vocab, long_piece, leaf) for text in some.column(1).to_pylist()])

    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    long = F.coalesce(F.length("_text") >= spread, F.lit(False))
    short = rows.where(~long).mapInArrow(run, schema)
    # rows that repeat are encoded once and given out as often as they stand there
    key = [F.xxhash64("_text").alias("_h"), F.crc32(F.encode("_text", "utf-8")).alias("_c")]
    huge = rows.where(long).groupBy(F.col(id_col), *key).agg(F.count(F.lit(1)).alias("_times"), F.first("_text").alias("_text"))
    named = huge.select(F.col(id_col).alias("_id"), "_h", "_c", "_times", "_text")
    cut_schema = T.StructType([T.StructField("_id", kind), *(T.StructField(c, T.LongType()) for c in ("_h", "_c", "_times")), *_PART.fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                got = list(parts_of(one.column(4)[0].as_py(), long_piece, part))
                head = [one.column(c).take(pa.array([0] * len(got))) for c in range(4)]
                types = [pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(c, t) for c, t in zip(zip(*got), types))], names=cut_schema.names)

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(name, directory)
        for batch in batches:
            out = []
            for whole, data in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist()):
                out.append(tree_encode(data, vocab._encode_single_piece, vocab.decode_single_token_bytes, leaf) if whole else vocab.encode_ordinary(data.decode("utf-8")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(6)), pa.array(out, pa.list_(pa.int32()))], names=[*cut_schema.names[:6], "ids"])

    def put_together(table: pa.Table) -> pa.Table:
        vocab = vocabulary(name, directory)
        table = table.sort_by([("run", "ascending"), ("no", "ascending")])
        runs: dict[int, list[list[int]]] = {}
        for number, ids in zip(table.column("run").to_pylist(), table.column("ids").to_pylist()):
            runs.setdefault(number, []).append(ids)
        ids = [t for parts in runs.values() for t in join_all(parts, vocab._encode_single_piece, vocab.decode_single_token_bytes)]
        times = table.column("_times")[0].as_py()
        return pa.Table.from_batches([batch_of(table.column("_id").combine_chunks().take(pa.array([0] * times)), [ids] * times)])

    parts = named.mapInArrow(cut, cut_schema).repartition(F.col("_h"), F.col("_c"), F.col("run"), F.col("no"))
    encoded = parts.mapInArrow(encode_parts, T.StructType([*cut_schema.fields[:6], T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    joined = encoded.groupBy("_id", "_h", "_c").applyInArrow(put_together, schema)
    return short.unionByName(joined)
