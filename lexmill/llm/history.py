"""Checking new batches against everything accepted before, without going through the history again.

:class:`FingerprintStore` keeps its tables below one shared folder, one segment a batch:

* ``prints``: every distinct fingerprint of the batch with the first record that has it, laid out
  by fingerprint partition, and beside them the partition's Bloom filter;
* ``records``: what is needed to compare: normalised id, word hashes, pivot table, laid out by
  partitions of the position.

A segment counts from the moment its file in ``commits`` stands, so a store can be opened again
and a batch that failed half-way leaves nothing behind.

Fingerprints of a record are of four kinds: **winnowed** content fingerprints (of the hashes of all
runs of ``SHINGLE`` words the least of every ``WINDOW`` neighbours), the hash of its word set, its
normalised id, and MinHash keys.  Winnowed ones find copies with edits and moved passages; a
record whose words were all moved shares none of them, and the MinHash keys are there for such
records (recall of either alone: README).

A batch goes through these steps:

1. its distinct fingerprints, combined before the shuffle, stream past the Bloom filters of their
   partition, which come first in the same sorted stream and take up what is new;
2. only what some filter may hold is looked up, only in the partitions with such positives, and
   gives the first owner of the fingerprint; what stands twice in the batch is owned there;
3. a record and an owner meet if they share enough winnowed fingerprints (``COVERAGE`` of the
   record's) or one of another kind: at most one candidate a fingerprint, whatever repeats;
4. sizes and pivot tables discard candidates, ids and word hashes verify the rest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.functions.text import lower_simple, record_words
from lexmill.llm import near
from lexmill.llm.near import MIN_WORDS, TABLE, band_keys, distinct_sets, hashed, lists_of, pivot_table, set_keys
from lexmill.operators.skew import PIECE, spread_join
from lexmill.scratch import Scope, materialise, new_path
from lexmill.storage.fs import Fs

SHINGLE = 5
WINDOW = 4
#: Share of a record's winnowed fingerprints that an owner must have to be compared.
COVERAGE = 0.1
ROWS = 6
BANDS = 48
#: Kinds, in the two low bits of a fingerprint.
ID, SET, WINNOWED, MINHASH = range(4)
KINDS = (ID, SET, WINNOWED, MINHASH)
BITS_PER_KEY = 12
PROBES = 6
SHIFT = 40
#: Fingerprints a partition should hold when the store is made.
PART_KEYS = 500_000
#: Positives up to this number are sent to every executor (16 bytes each); more are shuffled.
SENT = 1_000_000
#: Full-width forms stand this far above their ASCII counterparts, from ``!`` to ``~``.
WIDE, FIRST, LAST = 0xFEE0, 0x21, 0x7E

_FULL = "".join(chr(c + WIDE) for c in range(FIRST, LAST + 1))
_HALF = "".join(chr(c) for c in range(FIRST, LAST + 1))
_SKETCH = "pos bigint, idk string, n int, nw int, hs array<bigint>, p0 bigint, p1 bigint, fs array<bigint>"
_SCREENED = "part int, kind int, f bigint, pos bigint, c bigint, old boolean, bits binary"
_PRINTS = "f bigint, pos bigint, c bigint, old boolean, bits binary, seg int, kind int, part int"
_RECORDS = "pos bigint, idk string, n int, hs array<bigint>, p0 bigint, p1 bigint, seg int, at int"


def id_key(c: Column) -> Column:
    """Series and number of an id: letter case, width, blanks, punctuation and leading zeros make no difference."""
    flat = F.regexp_replace(lower_simple(F.translate(c, _FULL, _HALF)), r"[^\p{L}\p{M}\p{N}]+", "")
    return F.regexp_replace(flat, r"(?<!\d)0+(?=\d)", "")


# --- fingerprints -------------------------------------------------------------------------


def winnow(words: np.ndarray, lens: np.ndarray, shingle: int = SHINGLE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(record, fingerprint) of word hashes in text order, each once a record: the least hash of each
    ``window`` successive runs of ``shingle`` words.  Records under ``shingle + window - 1`` words have none."""
    rec = np.repeat(np.arange(len(lens), dtype=np.int64), lens)
    size = len(words) - shingle + 1
    span = shingle + window - 2
    if size - window + 1 <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    a = np.zeros(size, np.uint64)
    for j in range(shingle):
        a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[j : j + size]
    a = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(32)
    count = size - window + 1
    low = a[:count]
    for j in range(1, window):
        low = np.minimum(low, a[j : j + count])
    inside = rec[:count] == rec[span : span + count]
    rec, low = rec[:count][inside], low[inside]
    order = np.lexsort((low, rec))
    rec, low = rec[order], low[order]
    new = np.r_[True, (rec[1:] != rec[:-1]) | (low[1:] != low[:-1])] if len(rec) else np.empty(0, bool)
    return rec[new], low[new]


def _kind(keys: np.ndarray, kind: int) -> np.ndarray:
    return (keys & ~np.uint64(3)) | np.uint64(kind)


def _sketcher(kinds: Sequence[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lens, codes, hashes = hashed(b.column(2))
            n, hs = distinct_sets(lens, codes, hashes)
            keep = n >= MIN_WORDS
            kept = np.flatnonzero(keep)
            hs, size = hs[np.repeat(keep, n)], np.where(keep, n, 0).astype(np.int32)
            rec, f = [], []
            ids = b.column(1).to_pylist()
            if ID in kinds:
                with_id = [i for i, x in enumerate(ids) if x]
                rec.append(np.array(with_id, np.int64))
                f.append(_kind(np.array([xxhash.xxh3_64_intdigest(ids[i]) for i in with_id], np.uint64), ID))
            table = np.zeros((b.num_rows, 2), np.int64)
            nw = np.zeros(b.num_rows, np.int32)
            if len(kept):
                m = n[kept]
                starts = np.cumsum(m) - m
                table[kept] = pivot_table(hs, m)
                if SET in kinds:
                    rec.append(kept)
                    f.append(_kind(set_keys(hs, starts)[0].view(np.uint64), SET))
                if WINNOWED in kinds:
                    r, w = winnow(hashes[codes], lens)
                    r, w = r[keep[r]], w[keep[r]]
                    nw = np.bincount(r, minlength=b.num_rows).astype(np.int32)
                    rec.append(r)
                    f.append(_kind(w, WINNOWED))
                if MINHASH in kinds:
                    for i in range(0, len(kept), 2000):
                        j = min(len(kept), i + 2000)
                        end = starts[j] if j < len(kept) else len(hs)
                        keys = band_keys(hs[starts[i] : end], starts[i:j] - starts[i], BANDS, ROWS)
                        rec.append(np.repeat(kept[i:j], BANDS))
                        f.append(_kind(keys.ravel(), MINHASH))
            rec_, f_ = (np.concatenate(rec), np.concatenate(f)) if rec else (np.empty(0, np.int64), np.empty(0, np.uint64))
            f_ = f_[np.argsort(rec_, kind="stable")].view(np.int64)
            ends = np.r_[0, np.cumsum(np.bincount(rec_, minlength=b.num_rows))].astype(np.int32)
            hs_ends = np.r_[0, np.cumsum(size)].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(e), pa.array(x)) for e, x in ((hs_ends, hs.view(np.int64)), (ends, f_))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size), pa.array(nw), lists[0], pa.array(table[:, 0].copy()), pa.array(table[:, 1].copy()), lists[1]],
                names=["pos", "idk", "n", "nw", "hs", *TABLE, "fs"],
            )

    return run


def _combined(parts: int):
    """(part, f, pos, c): an Arrow batch's distinct fingerprints, their least position and how often they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, starts = lists_of(b, "fs")
            if not len(f):
                continue
            pos = np.repeat(b.column(0).to_numpy(), np.diff(np.r_[starts, len(f)]))
            order = np.lexsort((pos, f))
            f, pos = f[order], pos[order]
            at = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
            c = np.diff(np.r_[at, len(f)])
            f = f[at]
            part = ((f >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(f.view(np.int64)), pa.array(pos[at]), pa.array(c)], names=["part", "f", "pos", "c"])

    return run


# --- Bloom filters ------------------------------------------------------------------------


def _probe(keys: np.ndarray, m: int) -> Iterator[np.ndarray]:
    k = keys.view(np.uint64)
    a = (k ^ (k >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    b = ((k ^ (k >> np.uint64(27))) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    for i in range(PROBES):
        yield (((a + np.uint64(i) * b) >> np.uint64(17)) % np.uint64(m)).astype(np.int64)


class Slices:
    """A Bloom filter that grows: slices of doubling capacity, all but the last of them full and never changed."""

    def __init__(self) -> None:
        self.count: list[int] = []
        self.bits: list[np.ndarray] = []
        self.changed: set[int] = set()

    def load(self, count: int, bits: bytes) -> None:
        self.count.append(count)
        self.bits.append(np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that were never added."""
        out = np.zeros(len(keys), bool)
        for bits in self.bits:
            ok = np.ones(len(keys), bool)
            for at in _probe(keys, len(bits)):
                ok &= bits[at]
            out |= ok
        return out

    def add(self, keys: np.ndarray) -> None:
        while len(keys):
            free = len(self.bits[-1]) // BITS_PER_KEY - self.count[-1] if self.bits else 0
            if free <= 0:
                self.bits.append(np.zeros(max(1024, 2 * len(keys), 2 * sum(self.count)) * BITS_PER_KEY, bool))
                self.count.append(0)
                continue
            take, keys = keys[:free], keys[free:]
            for at in _probe(take, len(self.bits[-1])):
                self.bits[-1][at] = True
            self.count[-1] += len(take)

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        for i, (n, bits) in enumerate(zip(self.count, self.bits)):
            yield i, n, np.packbits(bits).tobytes()


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream in order of (part, kind, f, pos), filters (kind 0) before fingerprints (kind 1): the
    distinct fingerprints with ``old`` if a filter may hold them, and behind each part its filter anew."""
    part: int | None = None
    known, new = Slices(), []
    held: tuple[int, int, int] | None = None  # the last fingerprint, which may go on in the next Arrow batch

    def prints(p: int, f: np.ndarray, pos: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        old = known.holds(f)
        new.append(f[~old])
        n = len(f)
        cols = [pa.array(np.full(n, p, np.int32)), pa.array(np.ones(n, np.int32)), pa.array(f), pa.array(pos), pa.array(c), pa.array(old), pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["part", "kind", "f", "pos", "c", "old", "bits"])

    def finish(p: int) -> Iterator[pa.RecordBatch]:
        nonlocal held, known, new
        if held:
            yield prints(p, *(np.array([x], np.int64) for x in held))
        held = None
        if new:
            known.add(np.concatenate(new))
            for i, n, bits in known.rows():
                one = [pa.array([p], pa.int32()), pa.array([0], pa.int32()), pa.array([i]), pa.array([n]), pa.array([0]), pa.array([None], pa.bool_()), pa.array([bits], pa.binary())]
                yield pa.RecordBatch.from_arrays(one, names=["part", "kind", "f", "pos", "c", "old", "bits"])
        known, new = Slices(), []

    for b in batches:
        if not b.num_rows:
            continue
        parts, kinds, fs, poss, cs = (b.column(i).to_numpy() for i in range(5))
        edge = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1], True])
        for i, j in zip(edge[:-1], edge[1:]):
            if parts[i] != part:
                if part is not None:
                    yield from finish(part)
                part = int(parts[i])
            cut = i + int(np.searchsorted(kinds[i:j], 1))
            for r in range(i, cut):
                known.load(int(poss[r]), b.column(6)[r].as_py())
            f, pos, c = fs[cut:j], poss[cut:j], cs[cut:j]
            if not len(f):
                continue
            if held:
                f, pos, c = np.r_[held[0], f], np.r_[held[1], pos], np.r_[held[2], c]
            at = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
            c = np.add.reduceat(c, at)
            f, pos = f[at], pos[at]
            held = int(f[-1]), int(pos[-1]), int(c[-1])
            if len(f) > 1:
                yield prints(part, f[:-1], pos[:-1], c[:-1])
    if part is not None:
        yield from finish(part)


# --- the store ----------------------------------------------------------------------------


class FingerprintStore:
    """Everything accepted so far; ``path`` must be readable by every executor.

    A path that holds a store is opened with all its committed segments.  ``parts`` fixes the
    number of partitions for the store's life; one batch at a time may be offered.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, parts: int = 64, kinds: Sequence[int] = KINDS) -> None:
        self.spark, self.path, self.kinds = spark, path or new_path(spark, "store"), tuple(kinds)
        self.fs = Fs(spark, self.path)
        if self.fs.exists("store.json"):
            self.parts = json.loads(self.fs.read("store.json"))["parts"]
        else:
            self.parts = parts
            self.fs.make("commits")
            self.fs.write("store.json", json.dumps({"parts": parts}).encode())
        self.segments = sorted(n for n in self.fs.names("commits") if n.isdecimal())
        #: Of each partition the segment with its newest filter.
        self.filters: dict[int, str] = {}
        for s in self.segments:
            self.filters |= dict.fromkeys(json.loads(self.fs.read(f"commits/{s}"))["parts"], s)
        #: Partitions of prints and of records that the last batch read.
        self.last_read: tuple[list[int], list[int]] = ([], [])

    def _home(self, table: str, segment: str) -> str:
        return self.fs.full(f"{table}/seg={segment}")

    def _read(self, table: str, segments: Sequence[str], kind: int | None = None) -> DataFrame:
        """Rows of the named segments only, whatever else lies in the folder; nothing else is listed."""
        schema = _PRINTS if table == "prints" else _RECORDS
        homes = [f"{table}/seg={s}" + ("" if kind is None else f"/kind={kind}") for s in segments]
        paths = [self.fs.full(h) for h in homes if self.fs.exists(h)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.fs.full(table)).parquet(*paths)

    def _known_filters(self) -> DataFrame | None:
        """The newest filter of every partition, as rows of kind 0."""
        if not self.filters:
            return None
        newest = None
        for s in sorted(set(self.filters.values())):
            mine = (F.col("seg") == int(s)) & F.col("part").isin([p for p, x in self.filters.items() if x == s])
            newest = mine if newest is None else newest | mine
        return self._read("prints", sorted(set(self.filters.values())), 0).where(newest).drop("old", "seg")

    def _at(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.parts)).cast("int")

    def offer(self, batch: DataFrame, check: bool = True) -> DataFrame | None:
        """Append a batch (pos BIGINT, id, title, body), whose positions are unique and above every
        stored one, and give the positions (pos) that an earlier row repeats by id or content;
        ``check=False`` only appends.

        Null or empty ids match nothing; null texts count as empty; records with fewer than
        ``near.MIN_WORDS`` distinct words match by id only; an empty batch gives no rows.
        """
        segment = f"{len(self.segments):06d}"
        for table in ("prints", "records"):
            self.fs.delete(f"{table}/seg={segment}")
        with Scope(self.spark) as scope:
            dealt = batch.select("pos", "id", "title", "body").repartition(self.parts, self._at("pos"))
            words = dealt.select("pos", id_key(F.col("id")).alias("idk"), record_words("title", "body").alias("w"))
            sketch = materialise(words.mapInArrow(_sketcher(self.kinds), _SKETCH), "sketch")
            rows = sketch.select("pos", "fs").mapInArrow(_combined(self.parts), "part int, f bigint, pos bigint, c bigint")
            rows = rows.select("part", F.lit(1).alias("kind"), "f", "pos", "c", F.lit(None).cast("binary").alias("bits"))
            known = self._known_filters()
            every = rows if known is None else rows.unionByName(known)
            every = every.select("part", "kind", "f", "pos", "c", F.lit(None).cast("boolean").alias("old"), "bits")
            screened = every.repartition(self.parts, "part").sortWithinPartitions("part", "kind", "f", "pos").mapInArrow(_screen, _SCREENED)
            screened.write.partitionBy("kind", "part").parquet(self._home("prints", segment))
            sketch.drop("fs", "nw").withColumn("at", self._at("pos")).write.partitionBy("at").parquet(self._home("records", segment))
            found = scope.keep(materialise(self._found(segment, sketch), "found")) if check else None
            touched = [p for p in range(self.parts) if self.fs.exists(f"prints/seg={segment}/kind=0/part={p}")]
        self.fs.write(f"commits/{segment}", json.dumps({"parts": touched}).encode())
        self.segments.append(segment)
        self.filters |= dict.fromkeys(touched, segment)
        return found

    def _found(self, segment: str, sketch: DataFrame) -> DataFrame:
        own = self._read("prints", [segment], 1).select("part", "f", "pos", "c", "old")
        stats = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("old").alias("old"), F.max("c").alias("top")).collect()
        parts = sorted(r["part"] for r in stats if r["old"])
        positives, total = sum(r["old"] for r in stats), sum(r["n"] for r in stats)
        hits = own.where("old or c > 1").select("f", "pos", "c")
        if parts and self.segments:
            store = self._read("prints", self.segments, 1).where(F.col("part").isin(parts)).select("f", F.col("pos").alias("first"))
            asked = own.where("old").select("f")
            met = store.join(F.broadcast(asked) if positives <= SENT else asked, "f", "left_semi")
            hits = hits.join(met.groupBy("f").agg(F.min("first").alias("first")), "f", "left")
            hits = hits.where("first is not null or c > 1").select("f", F.coalesce("first", "pos").alias("owner"), "c")
        else:
            hits = hits.where("c > 1").select("f", F.col("pos").alias("owner"), "c")
        rows = sketch.select("pos", "nw", F.explode("fs").alias("f"))
        # a fingerprint that fills the batch (fewer than 1000 can) goes to every executor, its rows stay where they are
        least = max(20_000, total // 1000)
        if max((r["top"] for r in stats), default=0) > least:
            hits = materialise(hits, "hits")
            hot = F.broadcast(hits.where(F.col("c") > least))
            owned = rows.join(hot, "f").unionByName(rows.join(hot.select("f"), "f", "left_anti").join(hits.where(F.col("c") <= least), "f"))
        else:
            owned = rows.join(hits, "f")
        kind = F.col("f").bitwiseAND(F.lit(3))
        met = owned.where("owner < pos").groupBy("pos", "owner").agg(F.count_if(kind == WINNOWED).alias("shared"), F.count_if(kind != WINNOWED).alias("other"), F.max("nw").alias("nw"))
        met = materialise(met.where((F.col("other") > 0) | (F.col("shared") >= F.lit(COVERAGE) * F.col("nw"))).select("pos", "owner"), "met")
        owners = met.groupBy("owner").agg(F.count(F.lit(1)).alias("c"))
        seen = owners.agg(F.collect_set(self._at("owner")).alias("ats"), F.coalesce(F.max("c"), F.lit(0)).alias("top")).first()
        self.last_read = (parts, sorted(seen["ats"]))
        records = self._read("records", [*self.segments, segment]).where(F.col("at").isin(seen["ats"]))
        side = lambda df, x: df.select(F.col("pos").alias(x), F.col("idk").alias(f"id{x}"), F.col("n").alias(f"n{x}"), F.col("hs").alias(f"h{x}"), *(F.col(c).alias(f"{x}{c}") for c in near.TABLE))
        asked = met.select(F.col("owner").alias("a"), F.col("pos").alias("b"))
        # an owner that many rows meet is sent to pieces of them
        pairs = spread_join(asked, side(records, "a"), "a") if seen["top"] > PIECE else asked.join(side(records, "a"), "a")
        pairs = pairs.join(side(sketch, "b"), "b")
        shared = F.size(F.array_intersect("ha", "hb"))
        alike = near._left() & (F.col("na") > 0) & (F.col("nb") > 0) & (shared >= F.lit(near.T) * (F.col("na") + F.col("nb") - shared) - F.lit(1e-9))
        return pairs.where(((F.col("ida") == F.col("idb")) & (F.col("ida") != "")) | alike).select(F.col("b").alias("pos")).distinct()


def repeated_rows(corpus: DataFrame, kinds: Sequence[int] = KINDS) -> DataFrame:
    """(row_no): rows of batches after the history that an earlier row repeats by id or content.

    The history (batch 0) fills a store; the later batches come one by one, each checked against
    the store and then part of it.  Rows without a batch or row number have no place in the
    order and take no part.
    """
    spark = corpus.sparkSession
    rows = corpus.where("batch is not null and row_no is not null").select(
        (F.shiftleft(F.col("batch").cast("bigint"), SHIFT) + F.col("row_no")).alias("pos"), "batch", "id", "title", "body"
    )
    sizes = {r["batch"]: r["count"] for r in rows.groupBy("batch").count().collect()}
    old, late = [b for b in sizes if b < 1], sorted(b for b in sizes if b >= 1)
    first = sum(sizes[b] for b in old) or sizes.get(late[0] if late else None, 0)
    with Scope(spark) as scope:
        store = FingerprintStore(spark, parts=max(8, -(-first * (BANDS + 26) // PART_KEYS)), kinds=kinds)
        if old:
            store.offer(rows.where(F.col("batch") < 1), check=False)
        found = [scope.keep(store.offer(rows.where(F.col("batch") == b))) for b in late]
    out = spark.createDataFrame([], "pos bigint")
    for f in found:
        out = out.unionByName(f)
    return out.select(F.col("pos").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("row_no"))
