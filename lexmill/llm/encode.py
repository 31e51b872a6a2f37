"""Byte-level BPE encoding of a corpus in two tiers.

Tier 1: a minimal perfect hash over the whole vocabulary (hash, displace and compress: keys
fall into buckets by one hash, every bucket stores the displacement that sends its keys to
free slots).  A pre-token that is in the vocabulary is resolved by one vectorised probe: the
slot's stored 64-bit checksum must agree, then its bytes are compared, so a miss is always seen.

Tier 2: the other pre-tokens are merged over a linked list of bytes with a heap of the
candidate merges, lowest rank first and leftmost on ties, O(n log n) for any length.

Work is done per Arrow batch on the batch's distinct pre-tokens; a task keeps a bounded cache
of the ids of pre-tokens it has merged.  The vocabulary (a fixed file whose path is a
parameter) is read on the driver and broadcast; its size is checked.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexmill.scratch import Shared

#: Fixed value: the published pre-token pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY = 1_000_000
CACHE = 200_000
#: Characters encoded at a time.
PIECE = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64(token) rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: ``n`` keys to the slots 0 .. n-1."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4) -> None:
        n = len(keys)
        self.n, self.buckets = n, max(1, n // per_bucket)
        h = self.hashes(keys)
        if len(np.unique(h)) != n:
            raise ValueError("two keys share a 64-bit hash")
        bucket = self._bucket(h)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.move = np.zeros(self.buckets, np.uint64)
        self.slot_key = np.zeros(n, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(-np.diff(edges), kind="stable"):
            members = order[edges[b] : edges[b + 1]]
            if not len(members):
                break
            start = 0
            while True:
                tries = np.arange(start, start + 64, dtype=np.uint64)
                slots = self._slot(h[members][None, :], tries[:, None])
                good = free[slots].all(axis=1)
                for i in np.flatnonzero(good):
                    if len(set(slots[i].tolist())) == len(members):
                        self.move[b] = tries[i]
                        free[slots[i]] = False
                        self.slot_key[slots[i]] = members
                        break
                else:
                    start += 64
                    continue
                break
        self.check = h[self.slot_key]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def _slot(self, h: np.ndarray, move: np.ndarray) -> np.ndarray:
        x = (h ^ (move * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Index of each key among the keys the hash was built of, or -1 if the checksums differ."""
        if not keys:
            return np.zeros(0, np.int64)
        h = self.hashes(keys)
        slot = self._slot(h, self.move[self._bucket(h)])
        return np.where(self.check[slot] == h, self.slot_key[slot], -1)


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: lowest-ranked neighbours first, by a heap over linked pieces."""
    n = len(word)
    if n == 0:
        return []
    end = list(range(1, n + 1))  # the piece at i is word[i:end[i]]; end[i] is the next piece's start
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\x01") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = 0
        end[i] = stop
        if stop < n:
            prev[stop] = i
            r = ranks.get(word[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = prev[i]
        if p >= 0:
            r = ranks.get(word[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Two-tier encoder of one vocabulary; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if len(ranks) > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary of {len(ranks)} tokens is too large to broadcast; the limit is {MAX_VOCABULARY}")
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("some byte is no token")
        self.ranks = ranks
        self.keys = list(ranks)
        self.hash = PerfectHash(self.keys)
        self.key_ids = np.fromiter((ranks[k] for k in self.keys), np.int64, len(self.keys))
        self.cache: dict[bytes, list[int]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "_split")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.cache = {}

    @cached_property
    def _split(self):
        return regex.compile(PATTERN).findall

    def resolve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, flat, and the number of ids of each."""
        raw = [w.encode() for w in words]
        at = self.hash.find(raw)
        counts = np.ones(len(raw), np.int64)
        ids = np.where(at >= 0, self.key_ids[at], 0)
        parts: dict[int, list[int]] = {}
        keys, cache = self.keys, self.cache
        for i, w in enumerate(raw):
            k = at[i]
            if k >= 0 and keys[k] == w:
                continue
            got = cache.get(w)
            if got is None:
                got = merge_bytes(w, self.ranks)
                if len(cache) >= CACHE:
                    cache.clear()
                if len(w) <= 256:
                    cache[w] = got
            parts[i] = got
            counts[i] = len(got)
        if not parts:
            return ids, counts
        ends = np.cumsum(counts)
        flat = np.zeros(ends[-1], np.int64)
        flat[ends - counts] = ids
        for i, got in parts.items():
            flat[ends[i] - len(got) : ends[i]] = got
        return flat, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat (int32), and the offsets of each text's ids."""
        words: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        split = self._split
        for i, t in enumerate(texts):
            if t:
                got = split(t)
                sizes[i] = len(got)
                words += got
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int32)
        index: dict[str, int] = {}
        codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        flat, counts = self.resolve(list(index))
        starts = np.cumsum(counts) - counts
        n = counts[codes]
        ends = np.cumsum(n)
        pos = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(starts[codes], n)
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]
        return flat[pos].astype(np.int32), bounds.astype(np.int32)


def encode_column(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row by the vocabulary file at ``path`` (read on the driver only).

    Null and empty texts give an empty list; strings that look like special tokens are
    ordinary text; white space and control characters are kept; repeated rows stay; texts of
    any length are encoded whole; an empty table gives no rows.
    """
    if os.path.getsize(path) > 64 << 20:
        raise ValueError("the vocabulary file is over 64 MB")
    shared = Shared(df.sparkSession, Encoder(read_ranks(path)))
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.get()
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy().astype(np.int64))
            at = 0
            while at < b.num_rows:  # pieces of about a million characters, at least one text each
                upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE))
                part = b.slice(at, max(1, upto - at))
                ids, bounds = enc.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])
                at += part.num_rows

    return df.select(key, F.col(text)).mapInArrow(run, f"`{key}` {key_type}, ids array<int>")
