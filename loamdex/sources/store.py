"""Stored tables: parquet partitions that a numbered JSON manifest publishes.

A write puts its files under a fresh name first; the next manifest, created
under a number that must not exist yet, makes them visible.  Readers take the
highest number, so that they see one state or the next and never none, and a
failed write leaves nothing behind that a reader could see.  Of two writers
that create the same number one fails, reads what the other published and
applies its change to that, so that no update is lost; a change that no longer
fits is an error and publishes nothing.  The root must be a file system that
all executors share.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex import schemas
from loamdex.operators import dense, lexical, relational, segments

TABLES = {"postings": schemas.POSTING, "lengths": schemas.DOC_LENGTH, "chunks": schemas.CHUNK, "vectors": schemas.VECTOR}


class Store:
    """The engine's tables under one root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifest ------------------------------------------------------------
    def _latest(self) -> int:
        """Number of the newest manifest; 0 before the first write."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _at(self, number: int) -> dict:
        if number == 0:
            return {"segments": [], "batches": {"chunks": [], "vectors": []}, "streams": {}, "meta": {}}
        stream = self._fs.open(self._path(f"{self.root}/manifest/{number:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """{"segments": [{...}], "batches": {table: [names]}, "streams": {id: batch}, "meta": {...}}; empty before the first write."""
        return self._at(self._latest())

    def _create(self, number: int, manifest: dict) -> bool:
        """Write a manifest whole under its number; False if the number is taken."""
        folder = f"{self.root}/manifest"
        self._fs.mkdirs(self._path(folder))
        fresh, final = self._path(f"{folder}/.{segments.segment_name()}"), self._path(f"{folder}/{number:012d}.json")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a link fails if the name exists, in one step
                os.link(fresh.toUri().getPath(), final.toUri().getPath())
                return True
            jvm = self.spark.sparkContext._jvm
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(fresh, final, none)
            return True
        except Exception:
            if self._fs.exists(final):
                return False
            raise
        finally:
            self._fs.delete(fresh, False)

    def _commit(self, change: Callable[[dict], dict]) -> None:
        """Publish the newest manifest with a change; ``change`` raises if it does not fit what others published."""
        while True:
            number = self._latest()
            if self._create(number + 1, change(self._at(number))):
                return

    def _read(self, table: str, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*(f"{self.root}/{table}/{n}" for n in names))

    # segments ------------------------------------------------------------
    def _stage(self, postings: DataFrame, lengths: DataFrame, name: str) -> dict:
        """Write the files of a segment; its entry for the manifest.  Postings lie sorted by term, so that searches skip row groups."""
        tag = F.lit(name).alias("segment_id")
        rows = postings.select(tag, "term", F.col("doc_id").cast("string"), F.col("tf").cast("int"))
        rows.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{self.root}/postings/{name}")
        lengths.select(tag, F.col("doc_id").cast("string"), F.col("doc_length").cast("int")).write.mode("overwrite").parquet(f"{self.root}/lengths/{name}")
        stats = lexical.corpus_stats(self._read("lengths", [name])).first()
        return {
            "segment_id": name,
            "created_at": datetime.now(UTC).isoformat(),
            "total_documents": stats[0],
            "total_terms": stats[1],
            "avg_doc_length": stats[2],
        }

    def write_segment(self, postings: DataFrame, lengths: DataFrame, name: str | None = None, replaces: list[str] = ()) -> str:
        """Write postings (term, doc_id, tf) and lengths as one segment, in place of others if given.

        A name that is published already, and a replaced segment that is gone, are errors.
        """
        return self.write_segments([(postings, lengths)], [name or segments.segment_name()], replaces)[0]

    def write_segments(self, parts: list[tuple[DataFrame, DataFrame]], names: list[str], replaces: list[str] = (), mark: tuple[str, int] | None = None) -> list[str]:
        """Several segments in one commit; ``mark`` records the last batch of a stream with them, and a batch that is recorded already adds nothing."""

        def done(manifest: dict) -> bool:
            return mark is not None and manifest.get("streams", {}).get(mark[0], -1) >= mark[1]

        if done(self.manifest()):
            return []
        if set(names) & {s["segment_id"] for s in self.manifest()["segments"]}:
            raise ValueError("a segment of that name is published")
        entries = [self._stage(postings, lengths, name) for (postings, lengths), name in zip(parts, names)]

        def change(manifest: dict) -> dict:
            known = {s["segment_id"] for s in manifest["segments"]}
            if done(manifest):
                return manifest
            if set(replaces) - known or set(names) & known:
                raise ValueError("the segments were changed by another writer")
            manifest["segments"] = [s for s in manifest["segments"] if s["segment_id"] not in set(replaces)] + entries
            if mark is not None:
                manifest.setdefault("streams", {})[mark[0]] = mark[1]
            return manifest

        self._commit(change)
        return names

    def list_segments(self) -> list[str]:
        """Names of the segments, oldest first."""
        return [s["segment_id"] for s in sorted(self.manifest()["segments"], key=lambda s: s["created_at"])]

    def delete_segment(self, name: str) -> None:
        """Unpublish a segment; its postings and lengths go with it."""
        self._commit(lambda m: m | {"segments": [s for s in m["segments"] if s["segment_id"] != name]})

    def read_segment(self, name: str) -> tuple[DataFrame, DataFrame]:
        """(postings, lengths) of one segment: only its own files are read."""
        return self._read("postings", [name]), self._read("lengths", [name])

    def load_index(self) -> lexical.Index:
        """The whole index as published now; statistics are computed from the lengths."""
        names = self.list_segments()
        lengths = self._read("lengths", names)
        return lexical.Index(self._read("postings", names), lengths, lexical.corpus_stats(lengths))

    def merge_segments(self, most: int) -> list[str]:
        """Merge the oldest segments until no more than ``most`` are left; the names of the new ones."""
        made = []
        while True:
            names = segments.oldest(self.list_segments(), most)
            if len(names) < 2:
                return made
            target = segments.segment_name()
            postings, lengths = segments.merge(self._read("postings", names), self._read("lengths", names), target)
            made.append(self.write_segment(postings, lengths, target, names))

    # chunks and vectors ---------------------------------------------------
    def _append(self, table: str, make: Callable[[DataFrame], DataFrame], name: str) -> None:
        """Add what ``make`` makes of the stored rows; made anew if another writer added rows meanwhile."""

        class Moved(Exception):
            pass

        while True:
            seen = self.manifest()["batches"][table]
            if name in seen:  # a replay of what was published
                return
            make(self._read(table, seen)).write.mode("overwrite").parquet(f"{self.root}/{table}/{name}")

            def change(manifest: dict) -> dict:
                if manifest["batches"][table] != seen:
                    raise Moved
                manifest["batches"][table] = [*seen, name]
                return manifest

            try:
                return self._commit(change)
            except Moved:
                continue

    def chunks(self) -> DataFrame:
        return self._read("chunks", self.manifest()["batches"]["chunks"])

    def save_chunks(self, rows: DataFrame, name: str | None = None) -> None:
        """Add chunks whose id is not stored yet; the first of a repeated id wins."""
        full = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.CHUNK))
        self._append("chunks", lambda stored: relational.insert_ignore(full, stored).select(*(f.name for f in schemas.CHUNK)), name or segments.segment_name())

    def get_chunk(self, chunk_id: str) -> DataFrame:
        """The chunk of that id, or no row."""
        return self.chunks().where(F.col("chunk_id") == chunk_id).limit(1)

    def vectors(self) -> DataFrame:
        return self._read("vectors", self.manifest()["batches"]["vectors"])

    def save_vectors(self, rows: DataFrame, name: str | None = None) -> None:
        """Add vectors; an id that is repeated or stored already is an error."""

        def make(stored: DataFrame) -> DataFrame:
            lexical.require_unique(rows.select("doc_id").unionByName(stored.select("doc_id")))
            return rows.select("doc_id", "embedding", F.current_timestamp().alias("indexed_at"))

        self._append("vectors", make, name or segments.segment_name())

    def index_vectors(self, lists: int = 64) -> str:
        """Fit inverted lists and store all vectors by list; the name of the index, which replaces the one before."""
        batches, name = self.manifest()["batches"]["vectors"], segments.segment_name()
        held = self._read("vectors", batches).select("doc_id", "embedding")
        made = dense.InvertedLists.fit(held, lists)
        made.index(held, f"{self.root}/lists/{name}")
        rows = [(i, c.tolist()) for i, c in enumerate(made.centroids)]  # one row for each list
        self.spark.createDataFrame(rows, "list_id int, centroid array<float>").coalesce(1).write.parquet(f"{self.root}/centroids/{name}")
        self._commit(lambda m: m | {"lists": {"name": name, "batches": batches}})
        return name

    def search_vectors(self, queries: DataFrame, k: int = 10, probes: int = 8, digits: int | None = None) -> DataFrame:
        """The k vectors with the largest inner product for each (query_id, query_vector): (query_id, doc_id, score, rank).

        Vectors that are in the stored lists are searched there; those that came
        later, or all if there are no lists, are compared exactly.
        """
        manifest = self.manifest()
        lists, batches = manifest.get("lists"), manifest["batches"]["vectors"]
        late = [b for b in batches if lists is None or b not in lists["batches"]]
        parts = []
        if lists is not None:
            rows = self.spark.read.parquet(f"{self.root}/centroids/{lists['name']}").orderBy("list_id").collect()
            made = dense.InvertedLists(np.array([r["centroid"] for r in rows], np.float32))
            parts.append(made.search(self.spark.read.parquet(f"{self.root}/lists/{lists['name']}"), queries, k, probes, digits))
        if late or lists is None:
            parts.append(dense.exact_top_k(self._read("vectors", late), queries, k, digits))
        return parts[0] if len(parts) == 1 else lexical.top_k(parts[0].unionByName(parts[1]), k)

    def doc_exists(self, doc_id: str) -> bool:
        """Whether a vector of that id is stored."""
        return not self.vectors().where(F.col("doc_id") == doc_id).limit(1).isEmpty()

    def save_metadata(self, **values) -> None:
        """Replace the single metadata row; the last write wins."""
        self._commit(lambda m: m | {"meta": values})

    def load_metadata(self) -> dict | None:
        """The metadata row, or None."""
        return self.manifest()["meta"] or None

    def metrics(self) -> DataFrame:
        """One row: chunks, vectors, indexed documents and different terms."""
        index = self.load_index()
        counts = [
            self.chunks().agg(F.count(F.lit(1)).alias("chunks")),
            self.vectors().agg(F.count(F.lit(1)).alias("vectors")),
            index.lengths.agg(F.count(F.lit(1)).alias("documents")),
            index.postings.agg(F.countDistinct("term").alias("terms")),
        ]
        out = counts[0]
        for c in counts[1:]:
            out = out.crossJoin(c)  # one row each
        return out
