"""Atomic commits of several Parquet tables: everything is written aside, then one pointer is swapped."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from lexmill.operators.indexing import POSTINGS, clustered
from lexmill.storage import manifest as mf
from lexmill.storage.fs import Fs
from lexmill.storage.manifest import Manifest, Segment

# The phases, in order.
PHASES = ("prepare", "write", "verify", "install", "manifest", "activate", "cleanup")
TABLES = ("docs", "postings", "lengths", "terms", "stats", "tombstones")


#: Rows of a file at most; a file is read whole when its checksum is made.
FILE_ROWS = 4_000_000


class CommitError(RuntimeError):
    """A commit that could not be finished; the generation is unchanged."""


Reader = Callable[[str], DataFrame]


@dataclass(frozen=True)
class SegmentTables:
    """What a segment holds; ``tombstones`` (id, generation) deletes from older segments.

    ``terms`` and ``stats`` are made of the tables already written, so nothing is analyzed twice.
    """

    docs: DataFrame
    postings: DataFrame
    lengths: DataFrame
    tombstones: DataFrame
    terms: Callable[[Reader], DataFrame]
    stats: Callable[[Reader], DataFrame]


@dataclass(frozen=True)
class CommitResult:
    generation: int
    segment_id: str
    docs: int
    manifest: Manifest


def segment_name(generation: int) -> str:
    return f"seg_gen_{generation}_{secrets.token_hex(4)}"


def _write(fs: Fs, home: str, tables: SegmentTables) -> None:
    """Independent tables side by side, then those made of them."""

    def put(name: str, df: DataFrame) -> None:
        writer = df.write.partitionBy("field") if name == "postings" else df.write
        # files stay small enough to be hashed as one value
        writer.option("maxRecordsPerFile", FILE_ROWS).parquet(fs.full(f"{home}/{name}"))

    def read(name: str) -> DataFrame:
        reader = fs.spark.read.schema(POSTINGS) if name == "postings" else fs.spark.read
        return reader.parquet(fs.full(f"{home}/{name}"))

    def postings() -> None:
        # as they come first: the range partitioning samples its input, which should not be analyzed twice
        put("unordered", tables.postings)
        put("postings", clustered(fs.spark.read.schema(POSTINGS).parquet(fs.full(f"{home}/unordered"))))
        fs.delete(f"{home}/unordered")

    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(postings), *(pool.submit(put, n, getattr(tables, n)) for n in ("docs", "lengths", "tombstones"))]
        for job in jobs:
            job.result()
    for name in ("terms", "stats"):
        put(name, getattr(tables, name)(read))


def commit(
    fs: Fs,
    old: Manifest,
    tables: SegmentTables,
    dead: Callable[[Manifest], dict[str, int]] | None = None,
    source_batch: int = -1,
    drop: frozenset[str] = frozenset(),
    after: Callable[[str], None] | None = None,
) -> CommitResult:
    """Adds one segment as the next generation.

    ``dead`` gives, of the new manifest, the deleted documents of each segment; ``drop`` names
    old segments that the new one replaces; ``after`` is called behind every phase (a raised
    error there is a crash between phases).  Before the manifest is written a failure removes
    what was written; later, the segment stays as an orphan for the next recovery.
    """
    after = after or (lambda phase: None)
    generation = old.generation + 1
    seg = segment_name(generation)
    commit_id = secrets.token_hex(16)
    after("prepare")
    tmp, home = f"{mf.TMP}/{seg}", f"{mf.SEGMENTS}/{seg}"
    installed = False
    try:
        _write(fs, tmp, tables)
        after("write")
        files = fs.checksums(tmp)
        again = fs.spark.read.parquet(fs.full(f"{tmp}/docs"))
        ids = again.selectExpr("count(*) n", "min(doc_id) lo", "max(doc_id) hi").first()
        stones = fs.spark.read.parquet(fs.full(f"{tmp}/tombstones")).count()
        if {p.split("/")[0] for p in files} - set(TABLES):
            raise CommitError("unknown files in the segment")
        after("verify")
        fs.make(mf.SEGMENTS)
        fs.rename(tmp, home)
        installed = True
        after("install")
    except Exception as e:
        if not installed:
            fs.delete(tmp)
        raise e if isinstance(e, CommitError) else CommitError(f"commit of generation {generation}: {e}") from e
    low = (1 << 40) - 1
    new = Segment(seg, generation, ids["n"], ids["n"], 0, (ids["lo"] or 0) & low, (ids["hi"] or 0) & low, sum(f["size"] for f in files.values()), stones, files)
    m = Manifest(generation, (*(s for s in old.segments if s.id not in drop), new), mf.now(), commit_id, max(source_batch, old.source_batch))
    if dead:
        gone = dead(m)
        m = replace(m, segments=tuple(replace(s, del_count=gone.get(s.id, 0), doc_count_alive=s.doc_count - gone.get(s.id, 0)) for s in m.segments))
    fs.make(mf.MANIFESTS)
    fs.write(mf.manifest_path(generation), m.to_json().encode())
    after("manifest")
    mf.write_current(fs, generation)
    after("activate")
    try:
        fs.empty(mf.TMP)
    except OSError:
        pass
    after("cleanup")
    return CommitResult(generation, seg, ids["n"], m)
