"""Evaluation texts inside training text, by a generalised suffix automaton over words.

The automaton of the test items is built on the driver and broadcast, in shards of bounded size.
Each training text is normalised and streamed through it once: every step keeps the length of
the longest run of words, ending here, that stands in some item.  Where that length reaches
``least`` words, the items that hold the last ``least`` of them are those of one state, found
by a table.  Time is linear in the text, whatever it repeats.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lexmill.scratch import Shared

#: Words that count: at least so many in a row.
LEAST = 10
#: A text of which more than this share of words is leaked is removed whole.
COVERAGE = 0.5
#: An automaton holds about so many words of items at most; more items make more automata, and
#: every text streams through each of them in turn.
SHARD_WORDS = 2_000_000

_WORDS = re.compile(r"[^\W_]+").findall
_CLUSTER = regex.compile(r"\P{M}[\p{M}ᅠ-ᇿﾞﾟ]*|\p{M}+", regex.S)


def normal(text: str) -> str:
    """Compatibility composition, then lower case."""
    return unicodedata.normalize("NFKC", text).lower()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the normalised text; null gives none."""
    return _WORDS(normal(text)) if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each of ``words(text)`` stands in the source text."""
    low = text.lower()
    if unicodedata.is_normalized("NFKC", text) and len(low) == len(text):
        return [m.span() for m in re.finditer(r"[^\W_]+", low)]
    spans = []
    for chunk in re.finditer(r"\S+", text):  # nothing is composed across white space
        flat, at, end = [], [], []
        for m in _CLUSTER.finditer(chunk[0]):
            piece = normal(m[0])
            flat.append(piece)
            at += [m.start()] * len(piece)
            end += [m.end()] * len(piece)
        mine = [(at[m.start()], end[m.end() - 1]) for m in re.finditer(r"[^\W_]+", "".join(flat))]
        n = len(words(chunk[0]))
        if len(mine) != n:  # composed across clusters: the words stand for the whole piece
            mine = [(0, len(chunk[0]))] * n
        spans += [(chunk.start() + a, chunk.start() + z) for a, z in mine]
    if len(spans) != len(words(text)):
        raise ValueError("the words of a text can't be mapped back to it")
    return spans


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items of each state of ``least`` words."""

    def __init__(self, items: Iterable[tuple[int, list[str]]], least: int = LEAST) -> None:
        self.least, self.vocabulary = least, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        held: dict[int, set[int]] = defaultdict(set)
        for item, seq in items:
            last = 0
            for w in seq:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                held[last].add(item)
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        for v in order:  # items that end in a state also hold all its suffixes
            if self.len[self.link[v]] >= least:
                held[self.link[v]] |= held[v]
        self.top = [-1] * len(self.len)
        for v in reversed(order):
            if self.len[v] >= least:
                self.top[v] = v if self.len[self.link[v]] < least else self.top[self.link[v]]
        # a state's set gathered only longer states' items; the table needs those of the states on top
        self.items = {v: tuple(sorted(held[v])) for v in set(self.top) - {-1}}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def stream(self, seq: list[str]) -> Iterator[tuple[int, int, int]]:
        """(index of the last word, longest matching length, state on top) wherever the length reaches ``least``."""
        get = self.vocabulary.get
        nxt, link, length, least, top = self.next, self.link, self.len, self.least, self.top
        known = bytes(map(self.vocabulary.__contains__, seq))
        for run in re.finditer(b"\x01{%d,}" % least, known):
            v = n = 0
            for i in range(*run.span()):
                c = get(seq[i])
                while v and c not in nxt[v]:
                    v = link[v]
                    n = length[v]
                to = nxt[v].get(c)
                if to is not None:
                    v = to
                    n += 1
                if n >= least:
                    yield i, n, top[v]


def build(benchmark: DataFrame, item: str, text: str, least: int = LEAST) -> list[SuffixAutomaton]:
    """Automata of the items' texts, one for about every ``SHARD_WORDS`` words; null texts and texts
    under ``least`` words can't be matched."""
    out, held, size = [], [], 0
    for r in benchmark.where(F.col(item).isNotNull()).select(item, text).orderBy(item).toLocalIterator():
        seq = words(r[1])
        if held and r[0] != held[-1][0] and size + len(seq) > SHARD_WORDS:
            out.append(SuffixAutomaton(held, least))
            held, size = [], 0
        held.append((r[0], seq))
        size += len(seq)
    return [*out, SuffixAutomaton(held, least)]


def leaks(df: DataFrame, key: str, text: str, automata: Sequence[SuffixAutomaton]) -> DataFrame:
    """(key, item_id, longest): the items of which a text holds at least ``least`` words in a row.

    ``longest`` is the greatest matching length at a place that this item shares.  Null and
    empty texts hold nothing; a pair comes once per row of ``df``; an empty table gives no rows.
    """
    shards = [Shared(df.sparkSession, a) for a in automata]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, items, longest = [], [], []
            rows = [(k, words(t)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            for shard in shards:
                sam = shard.get(len(shards) == 1)
                for k, seq in rows:
                    best: dict[int, int] = {}
                    for _, n, top in sam.stream(seq):
                        for item in sam.items[top]:
                            if n > best.get(item, 0):
                                best[item] = n
                    keys += [k] * len(best)
                    items += best
                    longest += best.values()
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(items, pa.int64()), pa.array(longest, pa.int32())], names=[key, "item_id", "longest"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, item_id bigint, longest int")


def cleaned(df: DataFrame, key: str, text: str, automata: Sequence[SuffixAutomaton], coverage: float = COVERAGE) -> DataFrame:
    """(key, words, leaked, text): every text without the spans of ``least`` or more leaked words.

    A text of which more than ``coverage`` of the words are leaked becomes null; null stays null.
    """
    shards = [Shared(df.sparkSession, a) for a in automata]

    def one(t: str | None, seq: list[str], hit: np.ndarray) -> tuple[int, int, str | None]:
        inside = np.cumsum(hit)[: len(seq)] > 0
        leaked = int(inside.sum())
        if not leaked:
            return len(seq), 0, t
        if leaked > coverage * len(seq):
            return len(seq), leaked, None
        spans = word_spans(t)
        out, at = [], 0
        edge = np.flatnonzero(np.diff(np.r_[0, inside.astype(np.int8), 0]))
        for a, z in zip(edge[::2], edge[1::2]):
            out.append(t[at : spans[a][0]])
            at = spans[z - 1][1]
        return len(seq), leaked, "".join(out) + t[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            seqs = [words(t) for t in texts]
            hits = [np.zeros(len(seq) + 1, np.int64) for seq in seqs]
            for shard in shards:
                sam = shard.get(len(shards) == 1)
                for seq, hit in zip(seqs, hits):
                    for i, n, _ in sam.stream(seq):
                        hit[i - n + 1] += 1
                        hit[i + 1] -= 1
            got = [one(*x) for x in zip(texts, seqs, hits)]
            n, leaked, kept = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(leaked, pa.int32()), pa.array(kept, pa.string())], names=[key, "words", "leaked", "text"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, words int, leaked int, text string")
