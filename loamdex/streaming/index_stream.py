"""Micro-batch ingestion of documents into a store.

The time trigger of a buffered index becomes a processing-time trigger, the
count trigger a cut of each micro-batch into segments of ``buffer_docs``
documents; segments beyond ``max_segments`` are merged after each flush.  A
stream has an id, kept beside its checkpoint, and a commit of segments records
the batch they came from, so that a replay after a failure adds nothing and
streams do not meet in names.  Documents that are stored already are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loamdex.config import Settings
from loamdex.operators import dense, lexical, segments
from loamdex.runtime import blank, counted, materialize
from loamdex.sources.store import Store


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream over parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_id(store: Store, checkpoint: str) -> str:
    """The id of the stream with that checkpoint folder, made when the folder is new."""
    jvm = store.spark.sparkContext._jvm
    path = store._path(f"{checkpoint.rstrip('/')}-stream-id")
    fs = path.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration())
    started = fs.exists(store._path(f"{checkpoint.rstrip('/')}/metadata"))
    if not (fs.exists(path) and started):  # a lost checkpoint starts its batches anew, so it must not keep the id
        out = fs.create(path, True)
        out.write(bytearray(uuid.uuid4().hex.encode()))
        out.close()
    stream = fs.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def index_batch(store: Store, batch: DataFrame, batch_id: int, stream: str, settings: Settings, load_encoder: Callable | None = None) -> None:
    """Add one micro-batch of (doc_id, text): segments, and vectors if there is an encoder."""
    name = f"{stream}-{batch_id:012d}"
    if store.manifest().get("streams", {}).get(stream, -1) < batch_id:
        known = store.load_index().lengths.select("doc_id")
        rows = batch.select(F.col("doc_id").cast("string"), "text").where(~blank(F.col("text"))).dropDuplicates(["doc_id"])
        toks, n = counted(lexical.tokenized(rows.join(known, "doc_id", "left_anti"), "doc_id", "text", stem=False), "tokens")
        cuts = -(-n // settings.buffer_docs)
        if cuts > 1:
            toks = materialize(segments.assign_segments(toks, settings.buffer_docs), "flushed")
            parts = [toks.where(F.col("segment_id") == F.format_string("seg-%09d", F.lit(i))) for i in range(cuts)]
        else:
            parts = [toks] if n else []
        if parts:
            pairs = [(lexical.term_counts(p, stem=True), lexical.doc_lengths(p)) for p in parts]
            store.write_segments(pairs, [f"{name}-{i:06d}" for i in range(cuts)], mark=(stream, batch_id))
    store.merge_segments(settings.max_segments)
    if load_encoder is not None and name not in store.manifest()["batches"]["vectors"]:
        rows = batch.select(F.col("doc_id").cast("string"), "text").where(~blank(F.col("text"))).dropDuplicates(["doc_id"])
        new = rows.join(store.vectors().select("doc_id"), "doc_id", "left_anti")
        fresh = materialize(dense.encode(new, "text", load_encoder, settings.dimension, batch=settings.vector_batch).select("doc_id", "embedding"), "encoded")
        if not fresh.isEmpty():
            store.save_vectors(fresh, name)


def index_stream(
    store: Store,
    stream: DataFrame,
    checkpoint: str,
    settings: Settings | None = None,
    load_encoder: Callable | None = None,
    drain: bool = False,
) -> StreamingQuery:
    """Run the stream into the store: every ``flush_seconds``, or all that is there and stop with ``drain``."""
    settings = (settings or Settings()).check()
    own = stream_id(store, checkpoint)
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: index_batch(store, batch, batch_id, own, settings, load_encoder)).option("checkpointLocation", checkpoint)
    trigger = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=f"{settings.flush_seconds} seconds")
    return trigger.start()


def first_arrivals(stream: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark; state older than ``delay`` is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Arrivals by tumbling window and key; late rows beyond the watermark are left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), by, "n"
    )
