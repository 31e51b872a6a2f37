"""Near-duplicate search over sets of words: pivot distance tables in MinHash blocks.

A record is the set of its distinct words; two records are alike if the words in both make
up at least ``T`` of the words in either.  The set is a 0/1 fingerprint over all 64-bit word
hashes, so the Hamming distance of two fingerprints is the number of words in just one set,
and alike records are at most ``(1-T)/(1+T) (|x|+|y|)`` apart.

* **Pivots**: the hash space is cut into ``GROUPS`` disjoint groups; the reference
  fingerprints are all ``2 ** GROUPS`` unions of groups.  The distance of x to the union U is
  ``|U| + |x| - 2 |x and U|``, so the table of all of them follows from the words of x in each
  group, and the largest difference of two records' coordinates over all references is the
  sum over the groups of the differences of these counts (the union that gives it is that of
  the groups in which x has more words than y).  By the triangle inequality it is at most the
  distance: a pair with a larger one is discarded without losing any.  Counts are clamped to
  four bits, which only shrinks differences.
* **Blocks**: which pairs are looked at.  A key is made of the least words of seeded orders, as
  many as it takes until a record in about ``CROWD / records`` would have them all by the words'
  frequencies in a sample, each given the ones before it (:class:`Orders`), and ``MOST`` at most.
  So keys get longer as the table grows, and blocks don't; unusual words end a key at once.  Alike
  records draw the same words and so end their keys alike: a key of r words is shared with probability
  ``s**r``.  A record has keys until the chance that it shares none with one at similarity ``T``
  is about ``exp(-SURE)`` by its own words (measured in the README).  The keys are coarse on purpose; the tables discard nearly all
  they bring together (figures in the README).
* **Verification**: the survivors' word hashes are intersected exactly.

Equal sets are one class and searched once.  Keys that hold more than a share of the rows
are found before the shuffle and never go through it; a run of one key is never held by a
task beyond ``BLOCK`` rows: both take a salted join that applies the tables as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions.text import record_words
from lexmill.operators.skew import spread_join
from lexmill.scratch import Shared, materialise

T = 0.7
MIN_WORDS = 12
GROUPS = 32
BLOCK = 16_384
#: Words of a key at most; rows that a block is meant to have; -ln of the chance to miss a pair at ``T``.
MOST = 7
CROWD = 128
SURE = 7.5
#: Records and words of the sample for frequencies, records of it for those of pairs, words listed, and how often these occur at least.
SAMPLE, SAMPLE_WORDS, SAMPLE_PAIRS, LISTED, LEAST = 40_000, 4_000_000, 10_000, 2000, 8
#: Rows of the sample in which hot keys are counted.
HOT_SAMPLE = 50_000
#: A key is routed around the shuffle if it holds more than one in so many rows.
SHARE = 500
SEED = 20240607

_rng = np.random.default_rng(SEED)
_MOST = (64, 8)
_MUL = (_rng.integers(0, 1 << 32, size=_MOST, dtype=np.uint64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, size=_MOST, dtype=np.uint64).astype(np.uint32)
_MIX = (_rng.integers(0, 1 << 63, size=_MOST, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

#: The last bits of a word's hash give way to its place in the list; factors that end in 0...01 leave them as they are.
_PLACE = 12
_KEYS = int(np.ceil(SURE / -np.log1p(-(T**MOST))))
_ORDER = (_rng.integers(0, 1 << 52, size=(_KEYS, MOST), dtype=np.uint64) << np.uint64(_PLACE)) | np.uint64(1)
_FOLD = (_rng.integers(0, 1 << 63, size=MOST, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: Bits are held in quarters.
_PART = 4

KEY = ["key", "key2"]
TABLE = ["p0", "p1"]
#: Low bits of a block key that hold the record's size, so a sorted block is in order of sizes.
SIZE_BITS = 12
_SIZE = (1 << SIZE_BITS) - 1
_OUT = "a bigint, b bigint, k bigint"


def word_sets(df: DataFrame, row: str, *columns: str) -> DataFrame:
    """(row, n, key, key2, hs, p0, p1): distinct words of every record with at least ``MIN_WORDS``.

    ``hs`` are their 64-bit hashes, ``key`` and ``key2`` a 128-bit hash of the set, the rest is
    the pivot table.  Words are hashed once per Arrow batch, not once per record.
    """
    tokens = df.select(F.col(row).cast("bigint").alias("row"), record_words(*columns).alias("w")).where(F.size("w") >= MIN_WORDS)
    return tokens.mapInArrow(_sets, "row bigint, n int, key bigint, key2 bigint, hs array<bigint>, p0 bigint, p1 bigint")


def hashed(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column of words without nulls: lengths, the words' places in a dictionary, its hashes."""
    lens = np.diff(col.offsets.to_numpy())
    enc = col.flatten().dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in enc.dictionary.to_pylist()), np.uint64, len(enc.dictionary))
    return lens, enc.indices.to_numpy().astype(np.int64), hashes


def distinct_sets(lens: np.ndarray, codes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, flat hashes) of every record's distinct words."""
    size = max(1, len(hashes))
    pairs = np.unique(np.repeat(np.arange(len(lens), dtype=np.int64), lens) * size + codes)
    return np.bincount(pairs // size, minlength=len(lens)).astype(np.int32), hashes[pairs % size]


def set_keys(hs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of every set, the same in any order of its words."""
    k1 = np.add.reduceat((hs ^ (hs >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) ^ hs, starts)
    k2 = np.add.reduceat((hs ^ (hs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (hs << np.uint64(7)), starts)
    return k1.view(np.int64), k2.view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        lens, codes, hashes = hashed(b.column(1))
        n, hs = distinct_sets(lens, codes, hashes)
        keep = n >= MIN_WORDS
        hs, n = hs[np.repeat(keep, n)], n[keep]
        if not len(n):
            continue
        ends = np.cumsum(n)
        starts = ends - n
        k1, k2 = set_keys(hs, starts)
        d = pivot_table(hs, n)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(hs.view(np.int64)))
        rows = b.column(0).filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([rows, pa.array(n), pa.array(k1), pa.array(k2), lists, pa.array(d[:, 0]), pa.array(d[:, 1])], names=["row", "n", *KEY, "hs", *TABLE])


def lists_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and start offsets of a list column without nulls."""
    col = batch.column(batch.schema.get_field_index(name))
    offsets = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return flat.view(np.uint64), (offsets - offsets[0])[:-1]


def pivot_table(hs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Words per group, four bits a group, in two 64-bit integers: (records, 2)."""
    group = ((hs >> np.uint64(40)) % np.uint64(GROUPS)).astype(np.int64)
    c = np.bincount(np.repeat(np.arange(len(n), dtype=np.int64), n) * GROUPS + group, minlength=len(n) * GROUPS).reshape(-1, GROUPS)
    c = np.minimum(c, 15).astype(np.uint8)
    return np.ascontiguousarray(c[:, 0::2] | (c[:, 1::2] << 4)).view(np.int64)


def unpacked(p: np.ndarray) -> np.ndarray:
    """The counts of a packed table: (records, GROUPS)."""
    b = np.ascontiguousarray(p).view(np.uint8).reshape(len(p), -1)
    return np.concatenate([b & 15, b >> 4], axis=1).view(np.int8)


def table_distance(p: str = "a", q: str = "b") -> Column:
    """Largest difference over all pivots between the tables in columns ``ap0, ap1`` and ``bp0, bp1``."""
    total = None
    for c in TABLE:
        for i in range(0, 64, 4):
            bits = lambda x: F.shiftrightunsigned(F.col(f"{x}{c}"), i).bitwiseAND(F.lit(15))  # noqa: E731,B023
            d = F.abs(bits(p) - bits(q))
            total = d if total is None else total + d
    return total


def band_keys(hs: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys of all bands: (records, bands)."""
    h = (hs ^ (hs >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(starts), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(starts), b + 1, np.uint64)
        for r in range(rows):
            low = np.minimum.reduceat((h ^ _XOR[b, r]) * _MUL[b, r], starts)
            acc = (acc ^ (acc >> np.uint64(29))) * _MIX[b, r] + low
        out[:, b] = (acc ^ (acc >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return out


class Orders:
    """How many words a key needs: bits of the frequent words of a sample, alone and given another word."""

    def __init__(self, words: np.ndarray, bits: np.ndarray, given: np.ndarray) -> None:
        self.words, self.bits, self.given, self.need = words, bits, given, 0

    @classmethod
    def learn(cls, hs: np.ndarray, n: np.ndarray) -> Orders:
        """From the distinct words of records: flat hashes and sizes."""
        words, place, c = np.unique(hs, return_inverse=True, return_counts=True)
        top = np.argsort(-c, kind="stable")[:LISTED]
        top = np.sort(top[c[top] >= LEAST])
        m, rest = len(top), max(LEAST, c[top].min() if len(top) == LISTED else 0)
        parts = lambda share: np.clip(np.round(-_PART * np.log2(share)), 0, 255).astype(np.uint8)
        bits = parts(np.minimum(1, np.r_[c[top], rest] / len(n)))
        code = np.full(len(words), m)
        code[top] = np.arange(m)
        few = n[:SAMPLE_PAIRS]
        code = code[place[: few.sum()]]
        listed = code < m
        record = np.repeat(np.arange(len(few)), few)[listed]
        code, size = code[listed], np.bincount(record, minlength=len(few))
        first, both = np.cumsum(size) - size, np.zeros(m * m, np.int64)
        each = size[record]  # a word meets all of its record's
        for x, y in _ranges(first[record], each, 4_000_000):
            both += np.bincount(code[x] * m + code[y], minlength=m * m)
        both = both.reshape(m, m)
        own = np.diag(both)
        given = np.repeat(bits[None], m + 1, axis=0)
        known = np.flatnonzero(own >= LEAST)
        given[known, :m] = np.minimum(bits[:m], parts(np.minimum(1, (both[known] + 0.5) / (own[known, None] + 1))))
        return cls(words[top], bits, given)

    def for_rows(self, rows: int) -> Orders:
        self.need = max(1, int(_PART * np.log2(max(2, rows) / CROWD)))
        return self

    def keys(self, hs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the record, key) of all keys of all records, in order of the records."""
        m = len(self.words)
        code = np.full(len(hs), m, np.uint64)
        if m:
            at = np.minimum(np.searchsorted(self.words, hs), m - 1)
            code = np.where(self.words[at] == hs, at, m).astype(np.uint64)
        low = np.uint64((1 << _PLACE) - 1)
        h, lens, who = (hs & ~low) | code, np.diff(np.r_[starts, len(hs)]), np.arange(len(starts))
        sure, out, room = np.zeros(len(who)), [], np.empty_like(h)
        gain = -np.log1p(-(T ** np.arange(1, MOST + 1)))
        for b in range(_KEYS):
            key, used = self._key(h, lens, b, low, room)
            wants = sure < SURE
            out.append((who[wants], key[wants]))
            sure += gain[used - 1]
            go = sure < SURE
            if not go.any():
                break
            if go.mean() < 0.9:
                h, lens, who, sure = h[np.repeat(go, lens)], lens[go], who[go], sure[go]
        who, key = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(who, kind="stable")
        return who[order], key[order]

    def _key(self, h: np.ndarray, lens: np.ndarray, b: int, low: np.uint64, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, used = np.empty(len(lens), np.uint64), np.zeros(len(lens), np.int64)
        who, starts = np.arange(len(lens)), np.cumsum(lens) - lens
        acc, got, before = np.full(len(lens), b + 1, np.uint64), np.zeros(len(lens), np.int32), []
        for r in range(MOST):
            least = np.minimum.reduceat(np.multiply(h, _ORDER[b, r], out=room[: len(h)]), starts)
            word = (least & low).astype(np.int64)
            acc = (acc ^ (acc >> np.uint64(29))) * _FOLD[r] + least
            bits = self.bits[word]
            for w in before:
                bits = np.minimum(bits, self.given[w, word])
            open_ = got < self.need
            got = got + bits
            go = (got < self.need) & (r + 1 < MOST)
            end = open_ & ~go
            key[who[end]], used[who[end]] = acc[end], r + 1
            left = np.count_nonzero(go)
            if not left:
                break
            before.append(word)
            if left < 0.6 * len(go):
                h, lens, who, acc, got = h[np.repeat(go, lens)], lens[go], who[go], acc[go], got[go]
                starts, before = np.cumsum(lens) - lens, [w[go] for w in before]
        return (key ^ (key >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15), used


def _ranges(first: np.ndarray, length: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of every place i and its ``length[i]`` places from ``first[i]`` on, about ``most`` at a time."""
    ends = np.cumsum(length)
    a = 0
    while a < len(ends):
        done = ends[a] - length[a]
        b = max(a + 1, int(np.searchsorted(ends, done + most, side="right")))
        part = length[a:b]
        x = np.repeat(np.arange(a, b), part)
        yield x, np.arange(len(x)) + np.repeat(first[a:b] - (ends[a:b] - part - done), part)
        a = b


def orders_of(sets: DataFrame) -> Shared:
    """The :class:`Orders` of a written table of sets, from a sample drawn by hashes of the rows (one task, 4 MB at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, sizes, held = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        for b in batches:
            if held < SAMPLE_WORDS and b.num_rows:
                hs, starts = lists_of(b, "hs")
                n = np.diff(np.r_[starts, len(hs)])
                n = n[: max(1, int(np.searchsorted(np.cumsum(n), SAMPLE_WORDS - held)))]
                flat.append(hs[: n.sum()])
                sizes.append(n)
                held += int(n.sum())
        if held:
            o = Orders.learn(np.concatenate(flat), np.concatenate(sizes))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (o.words, o.bits, o.given)], names=["words", "bits", "given"])

    total = sets.count()
    found = _sample(sets, total, SAMPLE).select("row", "hs").repartition(1).sortWithinPartitions(F.xxhash64("row"), "row").mapInArrow(run, "words binary, bits binary, given binary").collect()
    words, bits, given = found[0] if found else (b"", b"\0", b"\0")
    bits = np.frombuffer(bits, np.uint8)
    orders = Orders(np.frombuffer(words, np.uint64), bits, np.frombuffer(given, np.uint8).reshape(len(bits), -1))
    return Shared(sets.sparkSession, orders.for_rows(total))


def _sample(sets: DataFrame, total: int, rows: int) -> DataFrame:
    return sets if total <= rows else sets.where(F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(1 << 30)) < F.lit((rows << 30) // total))


def _slices(batches: Iterable[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def bands(sets: DataFrame, orders: Shared, tag: str | None = None) -> DataFrame:
    """(k, row, p0, p1[, tag]): every record under each of its keys, with its size in the key's low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            who, keys = orders.get().keys(*lists_of(part, "hs"))
            size = np.minimum(part.column(1).to_numpy(), _SIZE).astype(np.uint64)
            keys = (keys & ~np.uint64(_SIZE)) | size[who]
            cols = [pa.array(part.column(i).to_numpy()[who]) for i in (0, *range(3, part.num_columns))]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *cols], names=["k", "row", *TABLE, *([tag] if tag else [])])

    cols = ["row", "n", "hs", *TABLE, *([tag] if tag else [])]
    return sets.select(*cols).mapInArrow(run, "k bigint, row bigint, p0 bigint, p1 bigint" + (f", {tag} bigint" if tag else ""))


def block_of(k: str = "k") -> Column:
    """The block of a key: the key without the size."""
    return F.shiftright(k, SIZE_BITS)


def hot_blocks(sets: DataFrame, orders: Shared | None = None) -> list[int]:
    """Blocks that hold more than about one in ``SHARE`` rows; at most ``2 * SHARE * _KEYS`` by construction.

    Counted in a sample, since only the way of a block depends on it: a hot one that is not seen
    here is met by the scan.  A key with such a share of all rows has it in some Arrow batch,
    so batches tell only their own frequent keys and these few are added up.
    """
    orders = orders or orders_of(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, keys = orders.get().keys(*lists_of(b, "hs"))
            h, c = np.unique(keys.view(np.int64) >> SIZE_BITS, return_counts=True)
            take = c > max(64, b.num_rows // SHARE)
            yield pa.RecordBatch.from_arrays([pa.array(h[take]), pa.array(c[take])], names=["h", "c"])

    total = sets.count()
    some = _sample(sets, total, HOT_SAMPLE).select("hs")
    if total > HOT_SAMPLE:
        some = some.repartition(5)
    found = some.mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    least = max(BLOCK, total // (2 * SHARE)) * min(1, HOT_SAMPLE / max(1, total))
    return [r["h"] for r in found.where(F.col("c") > least).select("h").collect()]


def _limit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.floor((x + y) * ((1 - T) / (1 + T)) + 1e-9)


def _marks(c: np.ndarray) -> np.ndarray:
    """Four bits a group, as many set as the count has up to four: bits that differ are the distance of clamped counts."""
    return np.packbits(np.concatenate([c > i for i in range(4)], axis=1), axis=1).view(np.uint64)


def _close(x: np.ndarray, y: np.ndarray, n: np.ndarray, c: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Of pairs of places: those that sizes and pivots leave."""
    nx, ny = n[x], n[y]
    top = np.where((nx == _SIZE) | (ny == _SIZE), 1 << 30, _limit(nx, ny))
    at = np.flatnonzero((np.abs(nx - ny) <= top) & (np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1, dtype=np.int32) <= top))
    x, y, top = x[at], y[at], top[at]
    return at[np.abs(c[x] - c[y]).sum(axis=1, dtype=np.int32) <= top]


def _pairs(k: np.ndarray, row: np.ndarray, c: np.ndarray, tag: np.ndarray | None, star: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs left in whole blocks: all of a block (of different tags), or with ``star`` those with its least row."""
    h, n = k >> SIZE_BITS, k & _SIZE
    marks = _marks(c)
    if star:
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
        start, length = edge[:-1], np.diff(edge)
        least = start + _first_least(row, start, length)
        x, y = np.repeat(least, length), np.arange(len(row))
        x, y = x[x != y], y[x != y]
        at = _close(x, y, n, c, marks)
        yield row[x[at]], row[y[at]]
        return
    # a block is in order of sizes: what follows a row up to the largest size that may be alike
    size = np.minimum(_SIZE, np.floor(n / T + 1e-6).astype(np.int64) + 1)
    place = np.arange(len(k)) + 1
    for x, y in _ranges(place, np.searchsorted(k, (h << SIZE_BITS) | size, side="right") - place, 400_000):
        if tag is not None:
            ok = tag[x] != tag[y]
            x, y = x[ok], y[ok]
        at = _close(x, y, n, c, marks)
        yield row[x[at]], row[y[at]]


def _first_least(row: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of every run: how far from its start its least row is."""
    hit = np.flatnonzero(row == np.repeat(np.minimum.reduceat(row, start), length))
    return hit[np.searchsorted(hit, start)] - start


def _scan(tagged: bool, star: bool, block: int):
    """Streams a task's rows in order of their keys; holds one block of at most ``block`` rows beside an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        over: int | None = None  # the block that is too large and leaves row by row

        def out(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(k)], names=["a", "b", "k"])

        def whole(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            k, row, p0, p1 = cols[:4]
            for a, b in _pairs(k, row, unpacked(np.stack([p0, p1], axis=1)), cols[4] if tagged else None, star):
                if len(a):
                    yield out(np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int64))

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(5 if tagged else 4)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            h = cols[0] >> SIZE_BITS
            if over is not None:
                n = int(np.searchsorted(h != over, True))
                if n:
                    yield out(cols[1][:n], np.full(n, -1), np.full(n, over))
                cols, h = [c[n:] for c in cols], h[n:]
                if not len(h):
                    held = None
                    continue
                over = None
            last = len(h) - int(np.searchsorted(h[::-1] != h[-1], True))
            # blocks inside that are too large leave as well
            edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
            big = np.repeat(np.diff(edge) > block, np.diff(edge))
            if big.any():
                yield out(cols[1][big], np.full(int(big.sum()), -1), h[big])
            ready = ~big
            ready[last:] = False
            if ready.any():
                yield from whole([c[ready] for c in cols])
            if big[-1]:
                over, held = int(h[-1]), None
            else:
                held = [c[last:] for c in cols]
        if held is not None and len(held[0]):
            yield from whole(held)

    return run


def candidates(sets: DataFrame, tag: str | None = None, star: bool = False, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: distinct pairs of rows that share a block and that sizes and pivots leave.

    With ``tag`` (a bigint column) only pairs of different tags; with ``star`` only pairs of a
    row and the least row of their block.
    """
    orders = orders_of(sets)
    hot = hot_blocks(sets, orders)
    every = bands(sets, orders, tag)
    cols = every.columns
    cold = every.join(F.broadcast(_frame(sets, hot)), block_of() == F.col("h"), "left_anti") if hot else every
    parts = partitions_for(sets, sets.count() * _KEYS // 2)
    scanned = materialise(cold.repartition(parts, block_of()).sortWithinPartitions("k").mapInArrow(_scan(bool(tag), star, block), _OUT), "blocks")
    light = scanned.where("b >= 0").select("a", "b")
    over = scanned.where("b < 0").select("k", F.col("a").alias("row")).distinct()
    if not hot and over.isEmpty():
        return light.distinct()
    payload = sets.select("row", F.least("n", F.lit(_SIZE)).alias("n"), *TABLE, *([tag] if tag else []))
    members = [over.join(payload, "row")]
    if hot:
        members.append(every.join(F.broadcast(_frame(sets, hot)), block_of() == F.col("h")).select(F.col("h").alias("k"), "row", F.col("k").bitwiseAND(F.lit(_SIZE)).cast("int").alias("n"), *cols[2:]))
    all_ = materialise(members[0] if not hot else members[0].unionByName(members[1]), "members")
    if tag:  # a block of one tag has nothing to give
        mixed = all_.groupBy("k").agg(F.min(tag).alias("x"), F.max(tag).alias("y")).where("x <> y").select("k")
        all_ = materialise(spread_join(all_, mixed, "k"), "mixed")
    heavy = salted_star(all_) if star else salted_pairs(all_, 2000, tag)
    return light.unionByName(heavy).distinct()


def _frame(df: DataFrame, blocks: list[int]) -> DataFrame:
    return df.sparkSession.createDataFrame([(h,) for h in blocks], "h bigint")


def _left(na: str = "na", nb: str = "nb") -> Column:
    """Whether sizes and tables leave a pair (columns na, nb, ap0, ap1, bp0, bp1)."""
    a, b = F.col(na), F.col(nb)
    lim = F.floor((a + b) * F.lit((1 - T) / (1 + T)) + F.lit(1e-9))
    return (a >= _SIZE) | (b >= _SIZE) | ((F.abs(a - b) <= lim) & (table_distance() <= lim))


def salted_pairs(members: DataFrame, piece: int, tag: str | None = None) -> DataFrame:
    """(a, b): pairs a < b of rows under one key, of (k, row[, n, p0, p1[, tag]]); with tables those they leave.

    A key's members are cut into pieces of about ``piece``; each row goes to one piece on the
    left and to every piece on the right, so the largest task joins ``piece`` rows with
    ``piece`` rows whatever the key holds.
    """
    count = F.count(F.lit(1))
    sizes = members.groupBy("k").agg(F.ceil(count / F.lit(piece)).cast("int").alias("pieces"), count.alias("c")).where("c > 1").drop("c")
    m = spread_join(members, sizes, "k").withColumn("s", F.pmod(F.xxhash64("row"), F.col("pieces")))
    more = [c for c in ("n", *TABLE, tag) if c and c in members.columns]
    side = lambda x: [F.col("row").alias(x), *(F.col(c).alias(f"n{x}" if c == "n" else f"{x}{c}") for c in more)]
    every = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    left = m.select("k", *side("a"), F.col("s").alias("sa"), every.alias("sb"))
    right = m.select("k", *side("b"), F.col("s").alias("sb"), every.alias("sa"))
    met = left.join(right, ["k", "sa", "sb"]).where("a < b")
    if tag:
        met = met.where(F.col(f"a{tag}") != F.col(f"b{tag}"))
    return (met.where(_left()) if "n" in more else met).select("a", "b")


def salted_star(members: DataFrame) -> DataFrame:
    """(a, b): every row with the least row of its key, of (k, row, n, p0, p1), where the tables leave the pair."""
    cols = ["n", *TABLE]
    least = members.groupBy("k").agg(F.min_by(F.struct("row", *cols), "row").alias("x"))
    lead = least.select("k", F.col("x.row").alias("a"), F.col("x.n").alias("na"), *(F.col(f"x.{c}").alias(f"a{c}") for c in TABLE))
    rows = members.select("k", F.col("row").alias("b"), F.col("n").alias("nb"), *(F.col(c).alias(f"b{c}") for c in TABLE))
    return spread_join(rows, lead, "k").where("a < b").where(_left()).select("a", "b")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, t: float = T) -> DataFrame:
    """Pairs (a, b) of which ``left`` (row a) and ``right`` (row b), with their hashes, are alike.

    ``pairs`` is a written table in which a may be hot (a group's least row).
    """
    ha = left.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("hs").alias("ha"))
    hb = right.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("hs").alias("hb"))
    both = spread_join(pairs, ha, "a").join(hb, "b").withColumn("both", F.size(F.array_intersect("ha", "hb")))
    return both.where(F.col("both") >= F.lit(t) * (F.col("na") + F.col("nb") - F.col("both")) - F.lit(1e-9)).select("a", "b", "both", "na", "nb")


def partitions_for(df: DataFrame, rows: int, per: int = 1_000_000) -> int:
    """Partitions of about ``per`` rows, at least those the session asks for."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))


def near_classes(df: DataFrame, row: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(members, representatives): members (row, rep) puts equal word sets in one class, named by its
    least row; representatives are the word sets of the classes.

    Defined cases: null columns count as empty; records of fewer than ``MIN_WORDS`` distinct
    words are in neither result; an empty table gives two empty results; rows must be unique
    non-negative integers.  Extra columns are never read.
    """
    sets = materialise(word_sets(df, row, *columns), "sets")
    both = F.struct(*KEY).alias("both")
    # most sets stand once and are their own class; only the others meet their class's name
    many = sets.groupBy(both).agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    named = materialise(spread_join(sets.select("row", both), many, "both").select("row", "rep"), "named")
    members = sets.select("row").join(named, "row", "left").select("row", F.coalesce("rep", "row").alias("rep"))
    first = materialise(sets.join(named.where("row <> rep").select("row"), "row", "left_anti").drop(*KEY), "representatives")
    return members, first


def near_links(first: DataFrame) -> DataFrame:
    """(a, b), a < b: the alike pairs of representatives."""
    pairs = materialise(candidates(first), "candidates")
    return materialise(verified(pairs, first, first).select("a", "b"), "links")


def near_pairs(df: DataFrame, row: str, *columns: str) -> DataFrame:
    """(a, b), a < b: every alike pair of rows, copies included (classes expanded by salted joins)."""
    members, first = near_classes(df, row, *columns)
    links = near_links(first)
    members = materialise(members, "members")
    inside = salted_pairs(members.select(F.col("rep").alias("k"), "row"), 2000)
    ma = members.select(F.col("rep").alias("a"), F.col("row").alias("ra"))
    mb = members.select(F.col("rep").alias("b"), F.col("row").alias("rb"))
    across = spread_join(mb, spread_join(ma, links, "a"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    return inside.unionByName(across)


def components(links: DataFrame) -> DataFrame:
    """(row, component): connected components of links (a, b), each named by its least row.

    Alternating large and small stars; every round is a few equi-joins on aggregated minima and is
    written to the shared folder, so lineage stays short and no component is gathered in a task.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    n = edges.count()
    while n:
        both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = spread_join(both, least, "a").where("b > a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        then = materialise(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        size = then.count()
        same = size == n and then.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges, n = then, size
        if same:
            break
    tops = edges.select(F.col("b").alias("row")).distinct().select("row", F.col("row").alias("component"))
    return edges.select(F.col("a").alias("row"), F.col("b").alias("component")).unionByName(tops)


def near_groups(df: DataFrame, row: str, *columns: str) -> DataFrame:
    """(row, class, group): one row per record with enough words.

    ``class`` is the least row with the same word set, ``group`` the least row reachable over
    links between alike classes.  Not every link is made: first each row meets the least row of
    each of its blocks only, which puts a group of n near copies together in n steps; then
    only pairs of different groups are looked at, in which every link that joins two groups is.
    """
    members, first = near_classes(df, row, *columns)
    stars = materialise(candidates(first, star=True), "stars")
    links = materialise(verified(stars, first, first).select("a", "b"), "links")
    so_far = components(links).withColumnRenamed("component", "tag")
    tagged = materialise(first.join(so_far, "row", "left").withColumn("tag", F.coalesce("tag", "row")), "tagged")
    more = materialise(candidates(tagged, tag="tag"), "candidates")
    rest = verified(more, first, first).select("a", "b")
    comp = components(links.unionByName(rest)).select(F.col("row").alias("rep"), "component")
    named = first.select(F.col("row").alias("rep")).join(comp, "rep", "left").select("rep", F.coalesce("component", "rep").alias("group"))
    return spread_join(materialise(members, "members"), named, "rep").select("row", F.col("rep").alias("class"), "group")
