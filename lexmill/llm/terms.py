"""Frequencies of all terms by a global integer dictionary and blockwise count arrays.

1. Every input task is a block: it numbers its terms in order of appearance, adds occurrences and
   record presence into two count arrays, and writes one row per term of the block, so a term
   that fills the collection leaves a block as one row.
2. The dictionary: the blocks' distinct terms get dense global integers.  They are numbered within
   their partition and moved by the sizes of the partitions before it (one number per partition
   reaches the driver).
3. Encoding: the blocks' rows meet the dictionary by term and go on as integers.
4. Every range of identifiers is one partition and one pair of arrays; the blocks' arrays are
   added into it.  Ranges are sized by the number of terms, so an array never exceeds ``RANGE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.scratch import Scope, materialise

#: A block emits and forgets its arrays when it holds this many terms, so its memory is bounded.
FLUSH = 400_000
#: Identifiers of a range at most.
RANGE = 1 << 20
_OUT = "term string, occ bigint, rec bigint"


class _Arrays:
    """Growing count arrays over a block's identifiers, given in order of appearance."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.occ = np.zeros(1024, np.int64)
        self.rec = np.zeros(1024, np.int64)

    def add(self, terms: list[str], occ: np.ndarray, rec: np.ndarray) -> None:
        """Adds counts of distinct terms."""
        ids = self.ids
        at = np.fromiter((ids.setdefault(t, len(ids)) for t in terms), np.int64, len(terms))
        while len(ids) > len(self.occ):
            self.occ, self.rec = (np.concatenate([x, np.zeros_like(x)]) for x in (self.occ, self.rec))
        self.occ[at] += occ
        self.rec[at] += rec

    def rows(self) -> Iterator[pa.RecordBatch]:
        n, names = len(self.ids), list(self.ids)
        for i in range(0, n, 50_000):
            j = min(n, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(names[i:j], pa.string()), pa.array(self.occ[i:j]), pa.array(self.rec[i:j])], names=["term", "occ", "rec"])


def _plain(c: pa.Array) -> pa.Array:
    return c.cast(pa.string()) if not pa.types.is_string(c.type) else c


def _count_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block counts of an array column: every element occurs once, a record counts once per term."""
    block = _Arrays()
    for b in batches:
        col = b.column(0)
        if not b.num_rows:
            continue
        lens = np.diff(col.offsets.to_numpy())
        enc = _plain(col.flatten()).dictionary_encode()
        codes, size = enc.indices.to_numpy().astype(np.int64), len(enc.dictionary)
        if not size:
            continue
        pairs = np.unique(np.repeat(np.arange(len(lens), dtype=np.int64), lens) * size + codes)
        block.add(enc.dictionary.to_pylist(), np.bincount(codes, minlength=size), np.bincount(pairs % size, minlength=size))
        if len(block.ids) > FLUSH:
            yield from block.rows()
            block = _Arrays()
    yield from block.rows()


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block counts of rows (term, occ), each a record of its own for its term."""
    block = _Arrays()
    for b in batches:
        enc = _plain(b.column(0)).dictionary_encode()
        codes, size = enc.indices.to_numpy(), len(enc.dictionary)
        if not size:
            continue
        occ = np.zeros(size, np.int64)
        np.add.at(occ, codes, b.column(1).to_numpy())
        block.add(enc.dictionary.to_pylist(), occ, np.bincount(codes, minlength=size))
        if len(block.ids) > FLUSH:
            yield from block.rows()
            block = _Arrays()
    yield from block.rows()


def _range_sums(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The one range of a task: its blocks' counts added into two arrays."""
        base: int | None = None
        occ = rec = np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            if base is None:
                base = int(ids[0]) // size * size
                occ, rec = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(occ, ids - base, b.column(1).to_numpy())
            np.add.at(rec, ids - base, b.column(2).to_numpy())
        if base is None:
            return
        at = np.flatnonzero(rec)
        for i in range(0, len(at), 100_000):
            x = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x + base), pa.array(occ[x]), pa.array(rec[x])], names=["term_id", "occ", "rec"])

    return run


def _dictionary(blocks: DataFrame) -> tuple[DataFrame, int]:
    """((term, term_id), number of terms): dense identifiers of the blocks' distinct terms."""
    local = F.monotonically_increasing_id()
    low = F.lit((1 << 33) - 1)
    kept = materialise(blocks.groupBy("term").agg(F.lit(0).alias("x")).select("term", F.shiftright(local, 33).cast("int").alias("part"), local.bitwiseAND(low).alias("local")), "dictionary")
    sizes = sorted((r["part"], r["n"]) for r in kept.groupBy("part").agg((F.max("local") + 1).alias("n")).collect())
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    base = kept.sparkSession.createDataFrame(starts, "part int, base bigint")
    return kept.join(F.broadcast(base), "part").select("term", (F.col("base") + F.col("local")).alias("term_id")), at


def _summed(blocks: DataFrame) -> DataFrame:
    spark = blocks.sparkSession
    with Scope(spark) as scope:
        blocks = materialise(blocks, "blocks")
        words, n = _dictionary(blocks)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE), 1)
        size = max(1, -(-n // parts))
        coded = blocks.join(words, "term").select("term_id", "occ", "rec")
        ranged = coded.repartitionById(parts, F.floor(F.col("term_id") / F.lit(size)).cast("int"))
        sums = ranged.mapInArrow(_range_sums(size), "term_id bigint, occ bigint, rec bigint")
        return scope.keep(materialise(sums.join(words, "term_id").select("term_id", "term", "occ", "rec"), "counted"))


def count_record_terms(records: DataFrame, terms: str) -> DataFrame:
    """(term_id, term, occ, rec) over an array column ``terms`` of one record per row.

    Null arrays and null elements count nothing; repeated rows are records of their own; an
    empty table gives no terms.  Identifiers are dense from 0.
    """
    clean = records.select(F.filter(F.col(terms), lambda t: t.isNotNull()).alias("t")).where(F.size("t") > 0)
    return _summed(clean.mapInArrow(_count_records, _OUT))


def count_term_rows(rows: DataFrame, term: str, occ: str) -> DataFrame:
    """The same over rows that each stand for one term in one record, with its occurrences there."""
    clean = rows.select(F.col(term).alias("t"), F.col(occ).cast("bigint").alias("o")).where("t is not null and o is not null")
    return _summed(clean.mapInArrow(_count_rows, _OUT))
