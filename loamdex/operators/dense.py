"""Dense vectors: normalisation, encoding, exact and approximate search."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from loamdex.functions.text import unit_vector
from loamdex.runtime import blank, counted, join_bounded, materialize, shared_dir

Encoder = Callable[[list[str]], np.ndarray]


def check_dimension(df: DataFrame, column: str, dimension: int) -> DataFrame:
    """``df``, with an error at run time for a vector that does not have ``dimension`` numbers."""
    wrong = F.raise_error(F.concat(F.lit(f"expected dimension {dimension}, got "), F.coalesce(F.size(column), F.lit(-1)).cast("string")))
    return df.withColumn(column, F.when(F.size(column) == dimension, F.col(column)).otherwise(wrong))


def encode(df: DataFrame, text: str, load: Callable[[], Encoder], dimension: int, out: str = "embedding", batch: int = 128) -> DataFrame:
    """Add unit vectors of a text column; the encoder is loaded once a worker and called on ``batch`` texts at most.

    Blank texts are an error.  ``load`` is any function that returns an encoder,
    so a model can be plugged in; see :func:`hashing_encoder` for one without.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for some in batches:
            texts = some.tolist()
            parts = [np.asarray(model(texts[at : at + batch]), np.float32) for at in range(0, len(texts), batch)]
            x = np.concatenate(parts) if parts else np.zeros((0, dimension), np.float32)
            if x.shape[1] != dimension:
                raise ValueError(f"expected dimension {dimension}, got {x.shape[1]}")
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.Series(list(x / np.where(norm > 0, norm, 1)))

    checked = F.when(blank(F.col(text)), F.raise_error(F.lit("text must not be blank"))).otherwise(F.col(text))
    return df.withColumn(out, vectors(checked))


def hashing_encoder(dimension: int) -> Callable[[], Encoder]:
    """A deterministic stand-in for a model: signed feature hashing of words."""

    def load() -> Encoder:
        import zlib

        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension), np.float32)
            for i, t in enumerate(texts):
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % dimension] += 1 if h >> 31 else -1
            return out

        return run

    return load


def normalize(df: DataFrame, column: str = "embedding") -> DataFrame:
    """The column as unit vectors in double precision."""
    return df.withColumn(column, unit_vector(F.col(column)))


#: Vector queries that one scan serves; more are served block by block.
QUERY_BLOCK = 20_000


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


class _Best:
    """The k best (score, doc_id) of each query so far; ties go to the smaller doc_id."""

    def __init__(self, queries: np.ndarray, k: int, digits: int | None):
        self.queries, self.k, self.digits = queries, k, digits
        self.q, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.least = np.full(len(queries), -np.inf)

    def add(self, docs: np.ndarray, vectors: np.ndarray) -> None:
        scores = vectors @ self.queries.T
        if self.digits is not None:
            scores = np.round(scores, self.digits)
        row, q = np.nonzero(scores >= self.least)  # soon few: what cannot enter a query's best is left out
        if not len(row):
            return
        q, score, doc = np.concatenate([self.q, q]), np.concatenate([self.score, scores[row, q]]), np.concatenate([self.doc, docs[row]])
        order = np.lexsort((np.unique(doc, return_inverse=True)[1], -score, q))
        q, score, doc = q[order], score[order], doc[order]
        first = np.searchsorted(q, q, "left")
        kept = np.arange(len(q)) - first < self.k
        self.q, self.score, self.doc = q[kept], score[kept], doc[kept]
        full = np.flatnonzero(np.bincount(self.q, minlength=len(self.queries)) == self.k)
        self.least[full] = self.score[np.searchsorted(self.q, full, "right") - 1]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int | None = None, n_queries: int | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """The k vectors with the largest inner product for each query: (query_id, doc_id, score, rank).

    ``vectors`` has (doc_id, embedding), ``queries`` (query_id, query_vector).
    The queries are a stated set: a block of at most ``block`` of them goes to
    the workers as one matrix, each Arrow batch of vectors is multiplied with
    it, and a task keeps the k best of each query, so that the shuffle carries
    k rows for each query and task however many vectors there are.  Only
    vectors of a query's dimension are scored.
    """
    q, n = (queries, n_queries) if n_queries is not None else counted(queries, "queries")
    blocks = max(1, -(-n // block))
    doc_type = vectors.schema["doc_id"].dataType
    schema = StructType([StructField("query_id", LongType()), StructField("doc_id", doc_type), StructField("score", DoubleType())])
    arrow_doc = to_arrow_type(doc_type)
    parts = []
    for number in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)
        table = part.select(F.col("query_id").cast("long"), F.col("query_vector").cast("array<double>"), F.size("query_vector").alias("d")).where("d > 0").toArrow()
        dims = table.column("d").to_numpy()
        held = {}
        for dim in np.unique(dims):
            mine = table.filter(pa.array(dims == dim))
            held[int(dim)] = (mine.column("query_id").to_numpy(), _matrix(mine.column("query_vector"), int(dim)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best = {dim: _Best(x, k, digits) for dim, (_, x) in held.items()}
            for batch in batches:
                sizes = batch.column(2).to_numpy()
                for dim, b in best.items():
                    mine = batch.filter(pa.array(sizes == dim))
                    docs = np.array(mine.column(0).to_pylist(), object)
                    x = _matrix(mine.column(1), dim)
                    step = max(64, 4_000_000 // max(1, len(b.queries)))
                    for at in range(0, len(docs), step):
                        b.add(docs[at : at + step], x[at : at + step])
            for dim, b in best.items():
                ids = held[dim][0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[b.q], pa.int64()), pa.array(b.doc.tolist(), arrow_doc), pa.array(b.score)], names=["query_id", "doc_id", "score"])

        rows = vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("d"))
        parts.append(rows.where(F.col("d").isin(list(held))).mapInArrow(run, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


class InvertedLists:
    """Approximate search by inner product: vectors in the lists of their nearest centroids.

    Centroids are fitted on a bounded sample; every vector is indexed, in a
    table that is partitioned by list.  A query visits its ``probes`` nearest
    lists; a search reads only the lists that some query visits.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    @classmethod
    def fit(cls, vectors: DataFrame, lists: int = 64, sample: int = 20_000, rounds: int = 8, seed: int = 1) -> "InvertedLists":
        rows = vectors.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).select("embedding").toPandas()
        x = np.array(rows["embedding"].tolist(), np.float32)
        if not len(x):
            raise ValueError("no vectors to fit the lists on")
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(seed)
        centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
        for _ in range(rounds):
            near = (x @ centres.T).argmax(1)
            for c in range(len(centres)):
                if (near == c).any():
                    centres[c] = x[near == c].mean(0)
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        return cls(centres)

    def _nearest(self, column: str, count: int) -> Column:
        centres = self.centroids

        @F.pandas_udf("array<int>")
        def near(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype=object)
            x = np.array(batch.tolist(), np.float32)
            scores = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) @ centres.T
            return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :count].astype(np.int32)))

        return near(F.col(column))

    def index(self, vectors: DataFrame, path: str | None = None) -> DataFrame:
        """``vectors`` with its list number as ``list_id``, written once, a folder for each list."""
        at = path or f"{shared_dir(vectors.sparkSession)}/loamdex/lists-{uuid.uuid4().hex}"
        listed = vectors.withColumn("list_id", F.element_at(self._nearest("embedding", 1), 1))
        # the number is computed below the exchange; a crowded list is written by several tasks
        listed.repartition("list_id", F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.partitionBy("list_id").option("compression", "zstd").parquet(at)
        return vectors.sparkSession.read.parquet(at)

    def search(self, indexed: DataFrame, queries: DataFrame, k: int = 10, probes: int = 8, digits: int | None = None) -> DataFrame:
        """As :func:`exact_top_k`, over the probed lists only.

        The queries of a list come to its vectors: they are a stated set that is
        small beside the vectors, and each list's are multiplied as one matrix.
        """
        q, _ = counted(queries, "queries")
        visits = materialize(q.withColumn("list_id", F.explode(self._nearest("query_vector", probes))).select("query_id", "list_id", F.col("query_vector").cast("array<float>").alias("query_vector")), "visits")
        visited = [r[0] for r in visits.select("list_id").distinct().collect()]  # at most one row for each centroid
        doc_type = indexed.schema["doc_id"].dataType
        schema = StructType([StructField("query_id", LongType()), StructField("doc_id", doc_type), StructField("score", DoubleType())])
        arrow_doc = to_arrow_type(doc_type)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            empty = pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], arrow_doc), "score": pa.array([], pa.float64())})
            if not left.num_rows or not right.num_rows:
                return empty
            dim = len(left.column("query_vector")[0].as_py())
            best = _Best(_matrix(left.column("query_vector"), dim), k, digits)
            best.add(np.array(right.column("doc_id").to_pylist(), object), _matrix(right.column("embedding"), dim))
            return pa.table({"query_id": pa.array(left.column("query_id").to_numpy()[best.q], pa.int64()), "doc_id": pa.array(best.doc.tolist(), arrow_doc), "score": pa.array(best.score)})

        # a crowded list is cut into cells by a hash of its ids, to each of which its queries come
        sizes = indexed.where(F.col("list_id").isin(visited)).groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / LIST_CELL).cast("int").alias("cells"))
        sizes = F.broadcast(sizes)  # one row for each centroid at most
        asked = visits.join(sizes, "list_id").select("list_id", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "query_id", "query_vector")
        held = indexed.where(F.col("list_id").isin(visited)).join(sizes, "list_id").select(
            F.col("list_id").alias("list"), F.pmod(F.xxhash64("doc_id"), F.col("cells")).cast("int").alias("part"), "doc_id", F.col("embedding").cast("array<float>").alias("embedding")
        )
        rows = asked.groupBy("list_id", "cell").cogroup(held.groupBy("list", "part")).applyInArrow(run, schema)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


#: Vectors of a list that one task compares with the list's queries.
LIST_CELL = 50_000


def positions(vectors: DataFrame, order: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """(position, doc_id): dense sequential positions from 0 in the given order, without a global sort in one task.

    There are as many ranges as the session has shuffle partitions, if ``buckets`` does not say otherwise.
    """
    buckets = buckets or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = vectors.select("doc_id", F.col(order).alias("_o")).repartitionByRange(buckets, "_o", "doc_id")
    ranged = materialize(ranged.withColumn("_p", F.spark_partition_id()), "ranges")
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_o", "doc_id")))
    sizes = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(offsets), "_p").select((F.col("_before") + F.col("_r") - 1).alias("position"), "doc_id")
