"""One index on disk: batches in, generations out, and views over any retained generation."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.functions.analysis import Registry
from lexmill.operators import indexing
from lexmill.plans.view import IndexView
from lexmill.schema import Schema
from lexmill.storage import commit as cm, manifest as mf, recovery as rc
from lexmill.storage.fs import Fs
from lexmill.storage.manifest import Manifest
from lexmill.storage.snapshot import Snapshot, SnapshotManager

#: A document's id is its generation, shifted by so many bits, plus its place in the segment.
SHIFT = 40
#: Fixed value: documents a segment may hold.
MAX_SEGMENT_DOCS = 1 << 31


class IndexBusyError(RuntimeError):
    """Another writer holds the index."""


class EmptyCommitError(ValueError):
    """Nothing to commit."""


class BufferFullError(ValueError):
    """A batch that does not fit into the next commit any more; commit first."""


@dataclass(frozen=True)
class PendingLimits:
    """How much may wait for a commit; a batch that goes beyond is refused, or with ``commit`` the waiting ones are committed first.

    A batch is counted by its documents and the bytes of its values; one batch may always wait alone.
    """

    docs: int = 10_000_000_000
    bytes: int = 1 << 46
    commit: bool = False


class Index:
    """Readers see committed generations only; one writer at a time adds batches and deletes.

    Re-adding an id replaces the older document; deletes and replacements are tombstones in the
    new segment and hide documents of older segments only.  With ``append`` an id may live in
    several segments.
    """

    def __init__(self, spark: SparkSession, root: str, registry: Registry | None = None, append: bool = False, verify: bool | str = "newest", pending: PendingLimits | None = None) -> None:
        self.limits = pending or PendingLimits()
        self.spark, self.fs, self.registry, self.append = spark, Fs(spark, root), registry or Registry(), append
        self.schema = Schema.from_json(self.fs.read(mf.SCHEMA).decode())
        self.recovery = rc.recover(self.fs, verify)
        self.manifest = self.recovery.manifest or Manifest(0)
        self.snapshots = SnapshotManager(self.manifest.generation, (s.id for s in self.manifest.segments))
        self._batches: list[DataFrame] = []
        self._deletes: list[DataFrame] = []
        self._counts, self._bytes = [0, 0], 0
        self._lock = threading.RLock()
        self._views: dict[int, IndexView] = {}

    @staticmethod
    def create(spark: SparkSession, root: str, schema: Schema, **options) -> Index:
        """Makes the folder of a new index; an existing one is an error."""
        fs = Fs(spark, root)
        if fs.exists(mf.SCHEMA):
            raise FileExistsError(f"there is an index in {root}")
        registry = options.get("registry") or Registry()
        text = schema.validate(analyzers=registry.names()).created().to_json()
        for name in (mf.MANIFESTS, mf.SEGMENTS, mf.TMP):
            fs.make(name)
        fs.write(mf.SCHEMA, text.encode())
        return Index(spark, root, **options)

    # --- writing ---------------------------------------------------------------------------

    @property
    def pending(self) -> dict[str, int]:
        return {"docs": self._counts[0], "deletes": self._counts[1]}

    def add(self, batch: DataFrame) -> int:
        """Takes a batch with ``id`` and the schema's columns into the next commit; a missing,
        empty or repeated id refuses the whole batch and leaves earlier ones.  Missing columns
        count as null, unknown ones are dropped."""
        wanted = self.schema.struct()
        have = set(batch.columns)
        cols = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
        batch = batch.select(*cols)
        n = indexing.check_batch(batch)
        if n > MAX_SEGMENT_DOCS:
            raise indexing.DocumentError(f"{n} documents are over {MAX_SEGMENT_DOCS}, the most of a segment")
        size = batch.agg(F.sum(reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in wanted))).cast("bigint")).first()[0] or 0
        with self._lock:
            full = self._batches and (self._counts[0] + n > self.limits.docs or self._bytes + size > self.limits.bytes)
            if full and not self.limits.commit:
                raise BufferFullError(f"{self._counts[0]} documents ({self._bytes} bytes) wait for a commit, {n} more ({size} bytes) do not fit")
            if full:
                self.commit()
            if self._batches:
                twice = reduce(DataFrame.unionByName, self._batches).select("id").join(batch.select("id"), "id", "left_semi").limit(1).collect()
                if twice:
                    raise indexing.DocumentError(f"document {twice[0]['id']!r} is already in the next commit")
            self._batches.append(batch)
            self._counts[0] += n
            self._bytes += size
        return n

    def delete(self, ids: DataFrame | Iterable[str]) -> int:
        """Marks ids of committed documents for the next commit; unknown ids do nothing."""
        df = ids.select(F.col("id").cast("string")) if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        df = df.where("id is not null").distinct()
        n = df.count()
        with self._lock:
            self._deletes.append(df)
            self._counts[1] += n
        return n

    def abort(self) -> None:
        with self._lock:
            self._batches, self._deletes, self._counts, self._bytes = [], [], [0, 0], 0

    def commit(self, source_batch: int = -1, after: Callable[[str], None] | None = None) -> cm.CommitResult:
        """Makes the pending documents and deletes the next generation."""
        with self._lock:
            if not any(self._counts):
                raise EmptyCommitError("nothing to commit")
            old = self.manifest
            generation = old.generation + 1
            empty = self.spark.createDataFrame([], self.schema.struct())
            docs = indexing.with_doc_ids(reduce(DataFrame.unionByName, self._batches, empty), start=generation << SHIFT)
            stones = self._tombstones(docs, generation)
            result = cm.commit(self.fs, old, self._tables(docs, stones), self._dead_counts, source_batch, after=after)
            self._activate(result.manifest)
            self.abort()
        return result

    def _tables(self, docs: DataFrame, stones: DataFrame) -> cm.SegmentTables:
        postings = indexing.refuse_long_terms(indexing.build_postings(docs, self.schema, registry=self.registry))
        lengths = indexing.doc_lengths(docs, self.schema, registry=self.registry)
        return self._segment(indexing.stored_fields(docs, self.schema), postings, lengths, stones)

    @staticmethod
    def _segment(docs: DataFrame, postings: DataFrame, lengths: DataFrame, stones: DataFrame) -> cm.SegmentTables:
        return cm.SegmentTables(
            docs, postings, lengths, stones,
            lambda read: indexing.dictionary(read("postings")).repartitionByRange("field", "term").sortWithinPartitions("field", "term"),
            lambda read: indexing.field_stats(read("terms"), read("lengths")).coalesce(1),
        )

    def _tombstones(self, docs: DataFrame, generation: int) -> DataFrame:
        """Ids of live documents that the commit deletes or replaces."""
        ids = reduce(DataFrame.unionByName, self._deletes, self.spark.createDataFrame([], "id string"))
        if not self.append:
            ids = ids.unionByName(docs.select("id"))
        if not self.manifest.segments:
            return ids.limit(0).withColumn("generation", F.lit(generation))
        live = self._live_docs(self.manifest).select("id")
        return live.join(ids.distinct(), "id", "left_semi").distinct().withColumn("generation", F.lit(generation))

    def _activate(self, m: Manifest) -> None:
        self.manifest = m
        free = self.snapshots.update_generation(m.generation, (s.id for s in m.segments))
        self._delete_segments(free)

    def _delete_segments(self, free: Iterable[str]) -> None:
        """Deletes segments that no retained manifest refers to; the rest waits for recovery."""
        held = set()
        for g in mf.generations(self.fs)[-(rc.RETENTION + 1) :]:
            held |= {s.id for s in mf.load(self.fs, g).segments}
        for s in free:
            if s not in held:
                self.fs.delete(f"{mf.SEGMENTS}/{s}")

    def merge(self, after: Callable[[str], None] | None = None) -> cm.CommitResult:
        """Rewrites all live documents as one segment and drops the tombstones."""
        with self._lock:
            old = self.manifest
            if not old.segments:
                raise EmptyCommitError("nothing to merge")
            view = self.view()
            none = self.spark.createDataFrame([], "id string, generation int")
            tables = self._segment(view.docs, view.postings, self._live(old, "lengths"), none)
            result = cm.commit(self.fs, old, tables, self._dead_counts, drop=frozenset(s.id for s in old.segments), after=after)
            self._activate(result.manifest)
        return result

    # --- reading ---------------------------------------------------------------------------

    def _read(self, m: Manifest, table: str, segments: Iterable | None = None) -> DataFrame:
        """One read over the segments' files of a table."""
        paths = [self.fs.full(f"{mf.SEGMENTS}/{s.id}/{table}") for s in (m.segments if segments is None else segments)]
        reader = self.spark.read
        if table == "postings":
            # the partition column comes from the folders, whose bases differ by segment
            frames = [reader.schema(indexing.POSTINGS).option("basePath", p).parquet(p) for p in paths]
            return reduce(DataFrame.unionByName, frames)
        return reader.parquet(*paths)

    def _stones(self, m: Manifest) -> DataFrame | None:
        """(id, generation): the last generation that deleted or replaced an id."""
        held = [s for s in m.segments if s.tombstones]
        return self._read(m, "tombstones", held).groupBy("id").agg(F.max("generation").alias("gone_at")) if held else None

    def _dead_docs(self, m: Manifest) -> DataFrame | None:
        """doc_ids of documents that a later segment deletes."""
        stones = self._stones(m)
        if stones is None:
            return None
        docs = reduce(DataFrame.unionByName, (self._read(m, "docs", [s]).select("doc_id", "id", F.lit(s.id).alias("segment")) for s in m.segments))
        return docs.join(stones, "id").where(F.shiftright("doc_id", SHIFT) < F.col("gone_at")).select("doc_id", "segment")

    def _live(self, m: Manifest, table: str) -> DataFrame:
        dead = self._dead_docs(m)
        rows = self._read(m, table)
        return rows if dead is None else rows.join(dead.select("doc_id"), "doc_id", "left_anti").select(*rows.columns)

    def _live_docs(self, m: Manifest) -> DataFrame:
        return self._live(m, "docs")

    def _dead_counts(self, m: Manifest) -> dict[str, int]:
        dead = self._dead_docs(m)
        if dead is None:
            return {}
        return {r["segment"]: r["n"] for r in dead.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}

    def view(self, generation: int | None = None) -> IndexView:
        """What a reader of a generation sees (the current one if none is named).

        Segments without deleted documents bring their own dictionary and statistics; only those
        with some are counted again, over their live documents.
        """
        with self._lock:
            m = self.manifest if generation in (None, self.manifest.generation) else mf.load(self.fs, generation)
            if m.generation not in self._views:
                self._views = {m.generation: self._view(m)}
            return self._views[m.generation]

    def _view(self, m: Manifest) -> IndexView:
        if not m.segments:
            none = self.spark.createDataFrame([], self.schema.struct()).withColumn("doc_id", F.lit(0).cast("bigint"))
            return IndexView.build(none, self.schema, self.registry, keep=False)
        postings, docs = self._live(m, "postings"), self._live_docs(m)
        clean, dirty = [s for s in m.segments if not s.del_count], [s for s in m.segments if s.del_count]
        if len(clean) == 1 and not dirty:
            return IndexView(postings, docs, self._read(m, "terms"), self._read(m, "stats"), m.total_docs_alive, self.schema)
        parts = [self._read(m, "terms", clean)] if clean else []
        if dirty:
            dead = self._dead_docs(m)
            parts.append(indexing.dictionary(self._read(m, "postings", dirty).join(dead.select("doc_id"), "doc_id", "left_anti")))
        terms = reduce(DataFrame.unionByName, parts).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        return IndexView(postings, docs, terms, indexing.field_stats(terms, self._live(m, "lengths")), m.total_docs_alive, self.schema)

    def snapshot(self) -> tuple[Snapshot, IndexView]:
        """A pinned generation and its view; the view is valid until the snapshot is released."""
        with self._lock:
            return self.snapshots.acquire(), self.view()

    def release(self, s: Snapshot) -> None:
        s.release()
        self._delete_segments(self.snapshots.reclaim())

    def info(self) -> dict:
        m = self.manifest
        return {
            "generation": m.generation, "segments": len(m.segments), "docs": m.total_docs, "docs_alive": m.total_docs_alive, "size_bytes": m.total_size_bytes,
            "pending": self.pending, "fields": [f.name for f in self.schema.fields], "active_snapshots": self.snapshots.active,
        }

    def manifest_json(self) -> dict:
        return json.loads(self.manifest.to_json())
