"""The most similar vectors of every vector: inverted lists with product-quantised residuals.

*Training.*  The centroids of the lists are fitted on two levels: tops by
k-means on a sample of at most ``sample`` vectors, chosen by a hash of the id,
and each top's lists by k-means on the sample's vectors of that top, so that a
crowded place gets many tops and thus many lists.  The codebooks of the
residuals are fitted on at most ``book_sample`` of them.  Everything else
covers all vectors.

*Index.*  The number of lists grows with the number of vectors, so that a list
holds ``TARGET`` vectors on average and a query meets a constant number of
codes.  One scan gives each vector its list, a code of ``parts`` bytes for its
residual, and its numbers in half precision.

*Search.*  All vectors are queries.  The lists of a top are packed into *units*
of work of up to ``BLOCK`` queries; a unit gets its queries in half precision
and, once each, the codes of the lists around its own: 2 ``probes`` for each
of them.  Of these every query visits the ``probes`` lists nearest to itself.
Its distances come from asymmetric distance tables (query part against
codebook), laid out by code so that a code adds one contiguous row for a whole
block of queries.  A query
keeps what may still be among its k best, if scores are wrong by up to two
standard deviations of the tables' error as seen on the sample, and ``rerank``
at most.  Residuals are coded by the size usual in their list, so that a crowded
place is resolved as finely as a wide one.

*Rerank.*  The full vectors of a unit's queries and distinct candidates are
joined once a unit and compared exactly.

A crowded list is cut into several units, and the codes of a unit into slices
of bounded size; a query that meets several slices keeps candidates of each.
Equal vectors are collapsed first, so that a vector stored very often does not
fill a list, and expanded at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamdex.runtime import counted, join_bounded, materialize

#: Vectors of a list on average; queries and codes of a unit of work; queries that share one pass over the codes.
TARGET, BLOCK, SLICE, TOGETHER = 256, 2048, 100_000, 256


def vectors_of(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of a list column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def list_array(rows: np.ndarray) -> pa.ListArray:
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(rows.ravel()))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm; empty clusters are placed on random points."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        size = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        full = size > 0
        centres[full] = np.add.reduceat(x[order], starts[full], axis=0) / size[full, None]
        centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    out = np.empty(len(x), np.int32)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (x[at : at + 4096] @ centres.T - half).argmax(1)
    return out


@dataclass
class Index:
    """Tops, centroids and residual sizes of all lists in order of their top, codebooks of residuals of size one (parts, codes, width), each list's nearest lists, and the tables' error at size one."""

    tops: np.ndarray
    first: np.ndarray
    centres: np.ndarray
    scale: np.ndarray
    books: np.ndarray
    probes: np.ndarray
    error: float = 0.0

    #: Tops in which a vector's nearest list is looked for.
    NEAR = 4

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int, probes: int, rounds: int = 8, book_sample: int = 16_384, seed: int = 11) -> "Index":
        rng = np.random.default_rng(seed)
        lists = max(1, min(lists, len(x)))
        n_tops = min(lists, 2 * math.isqrt(lists - 1) + 2) if lists > 3 else lists
        tops = _kmeans(x, n_tops, rounds, rng)
        near = _nearest(x, tops)
        below = []
        for t in range(n_tops):
            mine = x[near == t]
            # a top's share of the lists goes by its share of the sample
            below.append(_kmeans(mine, max(1, min(len(mine), round(lists * len(mine) / len(x)))), 4, rng) if len(mine) else tops[t : t + 1])
        out = cls(tops, np.concatenate([[0], np.cumsum([len(b) for b in below])]), np.concatenate(below), np.zeros(0, np.float32), np.zeros((parts, 1, x.shape[1] // parts), np.float32), np.zeros((0, 0)))
        home = out.home(x)
        rest = x - out.centres[home]
        out.scale = out._scale(rest, home)
        rest = (rest / out.scale[home, None]).reshape(len(x), parts, -1)
        taken = rest if len(rest) <= book_sample else rest[rng.choice(len(rest), book_sample, replace=False)]
        out.books = np.stack([_kmeans(np.ascontiguousarray(taken[:, p]), min(256, len(taken)), 5, rng) for p in range(parts)])
        out.probes = out._probes(min(probes, len(out.centres)))
        out.error = out._error(x, home, rng)
        return out

    def _scale(self, rest: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Root mean square of the residuals of each list, as if it held four more of the size usual in its top."""
        lists = len(self.centres)
        top = np.repeat(np.arange(len(self.tops)), np.diff(self.first))
        square, n = np.bincount(home, (rest * rest).sum(1), lists), np.bincount(home, minlength=lists)
        usual = np.bincount(top, square) / np.maximum(1, np.bincount(top, n))
        usual = np.where(usual > 0, usual, max(square.sum() / max(1, n.sum()), 1e-12))
        return np.sqrt((square + 4 * usual[top]) / (n + 4)).astype(np.float32)

    def _probes(self, count: int) -> np.ndarray:
        """The nearest lists of each list, from the tops that are nearest to it and hold enough lists."""
        sizes, out = np.diff(self.first), np.empty((len(self.centres), count), np.int32)
        for t in range(len(self.tops)):
            mine = self.centres[self.first[t] : self.first[t + 1]]
            order = np.argsort(((self.tops - mine.mean(0)) ** 2).sum(1), kind="stable")
            enough = max(2 * self.NEAR, int(np.searchsorted(np.cumsum(sizes[order]), 2 * count)) + 1)
            pool = np.concatenate([np.arange(self.first[o], self.first[o + 1]) for o in order[:enough]])
            c = self.centres[pool]
            apart = (c * c).sum(1) - 2 * mine @ c.T
            apart[pool[None, :] == np.arange(self.first[t], self.first[t + 1])[:, None]] = -np.inf  # its own list first
            out[self.first[t] : self.first[t + 1]] = pool[np.argsort(apart, axis=1, kind="stable")[:, :count]]
        return out

    def _error(self, x: np.ndarray, home: np.ndarray, rng: np.random.Generator) -> float:
        """Standard deviation of table look-ups between vectors of one list."""
        order = np.argsort(home, kind="stable")
        left, right = order[:-1], order[1:]
        same = np.flatnonzero(home[left] == home[right])
        if len(same) < 2:
            return 0.0
        if len(same) > 4096:
            same = rng.choice(same, 4096, replace=False)
        a, b = x[left[same]], x[right[same]]
        where, codes = self.encode(b)
        return float((((self.decode(where, codes) - b) * a).sum(1) / self.scale[where]).std())

    def decode(self, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        rest = np.stack([self.books[p][codes[:, p]] for p in range(len(self.books))], axis=1).reshape(len(codes), -1)
        return self.centres[home] + self.scale[home, None] * rest

    def home(self, x: np.ndarray) -> np.ndarray:
        """The nearest list of each vector, looked for in its nearest tops."""
        near = min(self.NEAR, len(self.tops))
        half = (self.tops * self.tops).sum(1) / 2
        below = (self.centres * self.centres).sum(1) / 2
        out = np.zeros(len(x), np.int32)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            score = part @ self.tops.T - half
            tops = np.argpartition(-score, near - 1, axis=1)[:, :near]
            best = np.full(len(part), -np.inf, np.float32)
            order = np.argsort(tops.ravel(), kind="stable")
            bounds = np.searchsorted(tops.ravel()[order], np.arange(len(self.tops) + 1))
            for t in np.flatnonzero(np.diff(bounds)):
                rows = order[bounds[t] : bounds[t + 1]] // near
                a, b = self.first[t], self.first[t + 1]
                here = part[rows] @ self.centres[a:b].T - below[a:b]
                top = here.argmax(1)
                value = here[np.arange(len(rows)), top]
                won = value > best[rows]
                best[rows[won]] = value[won]
                out[at + rows[won]] = a + top[won]
        return out

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of each vector."""
        home = self.home(x)
        rest = ((x - self.centres[home]) / self.scale[home, None]).reshape(len(x), len(self.books), -1)
        return home, np.stack([_nearest(np.ascontiguousarray(rest[:, p]), b) for p, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Inner product of each part of each query with each code: (parts, codes, queries)."""
        parts, _, width = self.books.shape
        return np.stack([self.books[p] @ x[:, p * width : (p + 1) * width].T for p in range(parts)])

    def scores(self, x: np.ndarray, table: np.ndarray, codes: np.ndarray, which: int) -> np.ndarray:
        """Approximate inner products of queries with the coded vectors of one list: (codes, queries)."""
        out = np.zeros((len(codes), len(x)), np.float32)
        for p in range(len(table)):
            out += table[p][codes[:, p]]
        out *= self.scale[which]
        out += self.centres[which] @ x.T
        return out

    def best(self, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, where: np.ndarray, probes: int, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, id) of what may be among the k + 1 best of each query, sorted by query.

        Each query looks at the ``probes`` lists, of those given, whose
        centroids are nearest to it; ``where`` is the sorted list of each code.
        A score may be wrong by two standard deviations either way, which are
        those of its list.
        """
        have, starts = np.unique(where, return_index=True)
        stops = np.append(starts[1:], len(where))
        near = x @ self.centres[have].T - (self.centres[have] ** 2).sum(1) / 2
        probes = min(probes, len(have))
        asked = np.zeros(near.shape, bool)
        np.put_along_axis(asked, np.argpartition(-near, probes - 1, axis=1)[:, :probes], True, axis=1)
        table = self.tables(x)
        top = np.full((len(x), k + 1), -np.inf, np.float32)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for j in np.argsort(-near.max(0), kind="stable"):
            mine = np.flatnonzero(asked[:, j])
            if not len(mine):
                continue
            part = codes[starts[j] : stops[j]]
            if 2 * len(mine) > len(x):
                score = self.scores(x, table, part, have[j])[:, mine].T
            else:
                score = self.scores(x[mine], np.ascontiguousarray(table[:, :, mine]), part, have[j]).T
            wrong = 2 * self.error * self.scale[have[j]]
            full = np.concatenate([top[mine], score - wrong], axis=1)
            top[mine] = -np.partition(-full, k, axis=1)[:, : k + 1]
            q, c = np.nonzero(score + wrong >= top[mine].min(1)[:, None])
            got.append((mine[q], ids[starts[j] + c], score[q, c] + wrong))
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, c, score = (np.concatenate(z) for z in zip(*got))
        kept = score >= top.min(1)[q]  # the bounds rose while lists were read
        q, c, score = q[kept], c[kept], score[kept]
        order = np.lexsort((-score, q))
        q, c = q[order], c[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) <= rerank
        return q[kept], c[kept]


def usable(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, vec): vectors of ``dim`` finite numbers that are not all zero, scaled to unit length."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = df.where(F.col(id_col).isNotNull() & (F.size(v) == dim)).where(finite & F.exists(v, lambda x: x != 0))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType(), False))])

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors_of(batch.column(1), dim).astype(np.float64)
            x /= np.abs(x).max(1, keepdims=True)  # so that the squares neither vanish nor overflow
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(x.astype(np.float32))], names=["id", "vec"])

    return good.select(F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("vec")).mapInArrow(unit, schema)


def nearest(
    df: DataFrame,
    id_col: str = "id",
    vector_col: str = "embedding",
    dim: int = 384,
    k: int = 10,
    lists: int | None = None,
    probes: int = 20,
    parts: int = 48,
    rerank: int = 100,
    sample: int = 196_608,
    book_sample: int = 16_384,
    most_lists: int = 65_536,
) -> DataFrame:
    """(id, other, similarity, rank): the ``k`` rows most similar to each row by cosine, itself left out.

    Takes part: vectors of ``dim`` finite numbers that are not all zero; null,
    shorter, NaN-holding and zero ones have no neighbours and are nobody's.
    Equal similarities go to the smaller id.  A vector stored under several
    ids has its copies as neighbours first.  With fewer than k + 1 vectors each
    gets all others; an empty table gives no rows.  Other columns are ignored.
    Ids must be unique.

    ``lists`` is the number of rows over ``TARGET`` if not given, and
    ``most_lists`` at most: their centroids, 1.5 KB each at 384 numbers, are
    held by every worker.  Beyond 16 million vectors lists grow longer unless
    that bound is raised; no vector is left out.
    """
    spark = df.sparkSession
    n = df.count()
    lists = lists or max(8, min(most_lists, -(-n // TARGET)))
    want = min(sample, max(16_384, 48 * lists))
    chosen = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(5)), F.lit(1 << 20)) < int(min(1.0, want / max(1, n)) * (1 << 20))
    taken = usable(df if n <= want else df.where(chosen), id_col, vector_col, dim).select("vec").toArrow()  # at most about ``sample`` rows
    if not taken.num_rows and n > want:
        taken = usable(df, id_col, vector_col, dim).select("vec").limit(want).toArrow()
    if not taken.num_rows:
        return spark.createDataFrame([], "id long, other long, similarity double, rank int")
    index = Index.fit(np.unique(vectors_of(taken.column(0), dim), axis=0), lists, parts, 2 * probes, book_sample=book_sample)
    del taken
    clean = usable(df, id_col, vector_col, dim)
    stored = materialize(clean.mapInArrow(_encoder(index, dim), _STORED), "codes")
    keyed = stored.select("id", "h1", "h2")
    members = materialize(keyed.join(keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep")), ["h1", "h2"]).select("id", "rep"), "members")
    copies, n_copies = counted(members.where("id <> rep"), "copies")
    reps = join_bounded(stored.drop("h1", "h2"), copies.select("id"), "id", n_copies, "left_anti")
    found = _search(reps, clean, index, dim, k, probes, rerank)
    return _expand(found, members, copies, n_copies, k)


_STORED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("h1", T.LongType()),
        T.StructField("h2", T.LongType()),
        T.StructField("list", T.IntegerType()),
        T.StructField("code", T.BinaryType()),
        T.StructField("half", T.BinaryType()),
    ]
)


def _encoder(index: Index, dim: int):
    """The mapper from (id, vec) to the vector's hash, list, code and half-precision form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors_of(batch.column(1), dim)
            home, codes = index.encode(x)
            same = np.frombuffer(b"".join(xxhash.xxh3_128_digest(row.tobytes()) for row in x + np.float32(0)), np.int64).reshape(-1, 2)
            columns = [batch.column(0), pa.array(same[:, 0].copy()), pa.array(same[:, 1].copy()), pa.array(home)]
            yield pa.RecordBatch.from_arrays([*columns, _binary(codes), _binary(x.astype(np.float16))], names=_STORED.names)

    return run


def _binary(rows: np.ndarray) -> pa.BinaryArray:
    """Each row's bytes."""
    data = np.ascontiguousarray(rows)
    ends = np.arange(len(data) + 1, dtype=np.int32) * (data.itemsize * data.shape[1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _rows(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """The matrix behind a column made by :func:`_binary`."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


@dataclass
class Plan:
    """Which unit each list's queries go to, and which units need a list's codes."""

    homes: list[tuple[int, int, int, int]]
    visits: list[tuple[int, int, int]]
    slices: int


def _plan(index: Index, sizes: np.ndarray) -> Plan:
    """Packs the lists of each top into units; ``sizes`` are the vectors of each list.

    homes: (list, first unit, units, slices); visits: (list, unit, slices).
    """
    homes, visits, unit, most = [], [], 0, 1
    for t in range(len(index.tops)):
        here = [a for a in range(index.first[t], index.first[t + 1]) if sizes[a]]
        at = 0
        while at < len(here):
            stop, load = at + 1, sizes[here[at]]
            while stop < len(here) and load + sizes[here[stop]] <= BLOCK:
                load += sizes[here[stop]]
                stop += 1
            probed = np.unique(index.probes[here[at:stop]])
            probed = probed[sizes[probed] > 0]
            slices = max(1, -(-int(sizes[probed].sum()) // SLICE))
            blocks = max(1, -(-int(load) // BLOCK))
            homes += [(a, unit, blocks, slices) for a in here[at:stop]]
            visits += [(int(b), u, slices) for b in probed for u in range(unit, unit + blocks)]
            most, unit, at = max(most, slices), unit + blocks, stop
    return Plan(homes, visits, most)


_FOUND = T.StructType([T.StructField("unit", T.IntegerType()), T.StructField("q", T.LongType()), T.StructField("cands", T.ArrayType(T.LongType(), False))])


def _search(reps: DataFrame, clean: DataFrame, index: Index, dim: int, k: int, probes: int, rerank: int) -> DataFrame:
    """(q, c, similarity): the k best candidates of each representative."""
    spark = reps.sparkSession
    sizes = np.zeros(len(index.centres), np.int64)
    for row in reps.groupBy("list").count().collect():  # one row for each list
        sizes[row[0]] = row[1]
    plan = _plan(index, sizes)
    home = spark.createDataFrame(plan.homes, "list int, first int, blocks int, slices int")
    visits = spark.createDataFrame(plan.visits, "list int, unit int, slices int")
    queries = join_bounded(reps.drop("code"), home, "list", len(plan.homes)).select(
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int").alias("unit"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
        F.col("id").alias("q"),
        F.col("list").alias("q_list"),
        "half",
    )
    codes = join_bounded(reps.select("id", "list", "code"), visits, "list", len(plan.visits)).select(
        "unit", F.pmod(F.xxhash64("id", F.lit(1)), F.col("slices")).cast("int").alias("slice"), "id", "list", "code"
    )

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """Asymmetric distances of a unit's queries to the codes of their lists' probes."""
        if not left.num_rows or not right.num_rows:
            return cand_schema.empty_table()
        right = right.sort_by([("list", "ascending"), ("id", "ascending")])
        ids, where = right.column("id").to_numpy(), right.column("list").to_numpy()
        codes = _rows(right.column("code"), np.uint8, len(index.books))
        left = left.sort_by("q_list")
        x = _rows(left.column("half"), np.float16, dim).astype(np.float32)
        sizes, cands = np.zeros(len(x), np.int64), []
        for at, stop in _stretches(left.column("q_list").to_numpy(), TOGETHER):
            q, c = index.best(x[at:stop], ids, codes, where, probes, k, rerank)
            sizes[at:stop] = np.bincount(q, minlength=stop - at)
            cands.append(c)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        unit = np.full(left.num_rows, left.column("unit")[0].as_py(), np.int32)
        flat = pa.array(np.concatenate(cands))
        return pa.table([pa.array(unit), left.column("q").combine_chunks(), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat).cast(cand_schema.field("cands").type)], schema=cand_schema)

    cand_schema = pa.schema([("unit", pa.int32()), ("q", pa.int64()), ("cands", pa.list_(pa.field("element", pa.int64(), False)))])
    cands = materialize(queries.groupBy("unit", "slice").cogroup(codes.groupBy("unit", "slice")).applyInArrow(look_up, _FOUND), "candidates")
    wanted = cands.select("unit", F.explode("cands").alias("id")).unionByName(cands.select("unit", F.col("q").alias("id"))).distinct()
    need, n_need = counted(wanted, "wanted")
    vectors = join_bounded(clean, need, "id", n_need).select("unit", "id", "vec")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """Exact similarities of a unit's queries to their candidates."""
        if not left.num_rows or not right.num_rows:
            return out_schema.empty_table()
        order = np.argsort(right.column("id").to_numpy(), kind="stable")
        known, y = right.column("id").to_numpy()[order], vectors_of(right.column("vec"), dim)[order]
        lists = left.column("cands").combine_chunks()
        bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        place = np.searchsorted(known, flat)
        asked = left.column("q").to_numpy()
        own = np.searchsorted(known, asked)
        q, c, sim = [], [], []
        for i in range(len(asked)):
            at = place[bounds[i] : bounds[i + 1]]
            at = at[at != own[i]]
            s = y[at].astype(np.float64) @ y[own[i]].astype(np.float64)
            top = np.lexsort((known[at], -s))[:k]
            q.append(np.full(len(top), asked[i])), c.append(known[at[top]]), sim.append(s[top])
        return pa.table([np.concatenate(q), np.concatenate(c), np.concatenate(sim)], schema=out_schema)

    out_schema = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("similarity", pa.float64())])
    out_type = T.StructType([T.StructField("q", T.LongType()), T.StructField("c", T.LongType()), T.StructField("similarity", T.DoubleType())])
    got = cands.groupBy("unit").cogroup(vectors.groupBy("unit")).applyInArrow(compare, out_type)
    if plan.slices == 1:
        return got
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "c")
    return got.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def _stretches(values: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of equal values, of ``most`` at most."""
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    for a, b in zip(cuts, cuts[1:]):
        for at in range(a, b, most):
            yield at, min(b, at + most)


def _expand(found: DataFrame, members: DataFrame, copies: DataFrame, n_copies: int, k: int) -> DataFrame:
    """From neighbours of representatives to neighbours of rows: copies first, then by similarity and id."""
    if n_copies == 0:
        order = Window.partitionBy("q").orderBy(F.desc("similarity"), "c")
        return found.select(F.col("q").alias("id"), F.col("c").alias("other"), "similarity", F.row_number().over(order).alias("rank"))
    # no row needs more than k + 1 members of any group
    first = Window.partitionBy("rep").orderBy("id")
    some = copies.unionByName(copies.select("rep").distinct().select(F.col("rep").alias("id"), "rep"))
    some = some.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).drop("_n")
    heads, n_heads = counted(some, "heads")
    single = join_bounded(found, heads.select(F.col("rep").alias("c")).distinct(), "c", n_heads, "left_anti").select("q", F.col("c").alias("other"), "similarity", F.lit(0).alias("own"))
    grouped = join_bounded(found, heads.select(F.col("rep").alias("c"), F.col("id").alias("other")), "c", n_heads).select("q", "other", "similarity", F.lit(0).alias("own"))
    own = heads.select(F.col("rep").alias("q"), F.col("id").alias("other"), F.lit(1.0).alias("similarity"), F.lit(1).alias("own"))
    ranked = Window.partitionBy("q").orderBy(F.desc("own"), F.desc("similarity"), "other")
    lists = single.unionByName(grouped).unionByName(own).withColumn("at", F.row_number().over(ranked)).where(F.col("at") <= k + 1)
    rows = lists.join(members.select("id", F.col("rep").alias("q")), "q").where("id <> other")
    final = Window.partitionBy("id").orderBy("at")
    return rows.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("id", "other", "similarity", "rank")


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of rows of which one is among the other's nearest."""
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
