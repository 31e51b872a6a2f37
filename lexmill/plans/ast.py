"""The query algebra: ten node types and their limits."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

# Limits of a query.
MAX_CLAUSES = 1024
MAX_DEPTH = 10
MAX_PHRASE_TERMS = 50
MAX_PROXIMITY_TERMS = 10
MAX_PROXIMITY_SLOP = 100
MAX_PATTERN_BYTES = 256
MAX_FUZZY_DISTANCE = 2
MIN_FUZZY_LENGTH = 3
MAX_FUZZY_TERMS = 500
MAX_TERMS = 1000


class QueryError(ValueError):
    """A query that is malformed or over a limit."""


class Occur(Enum):
    MUST = "must"
    SHOULD = "should"
    MUST_NOT = "must_not"


class Query:
    """Base of all nodes; nodes are immutable and compare by value."""


@dataclass(frozen=True)
class Term(Query):
    """Exact match of an already analyzed term."""

    field: str
    term: str
    boost: float = 1.0


@dataclass(frozen=True)
class Prefix(Query):
    field: str
    prefix: str
    boost: float = 1.0


@dataclass(frozen=True)
class Wildcard(Query):
    """``*`` is any run of characters, ``?`` one character; the whole term must match."""

    field: str
    pattern: str
    boost: float = 1.0


@dataclass(frozen=True)
class Regexp(Query):
    """The whole term must match."""

    field: str
    pattern: str
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy(Query):
    """Terms within an edit distance in characters, equal in the first ``prefix_length``."""

    field: str
    term: str
    max_distance: int = 1
    prefix_length: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase(Query):
    """Terms in order; up to ``slop`` other terms between first and last."""

    field: str
    terms: tuple[str, ...]
    slop: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class Proximity(Query):
    """All terms, in any order, within len(terms) + slop consecutive positions."""

    field: str
    terms: tuple[str, ...]
    slop: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class MatchAll(Query):
    boost: float = 1.0


@dataclass(frozen=True)
class MatchNone(Query):
    pass


@dataclass(frozen=True)
class Clause:
    occur: Occur
    query: Query


@dataclass(frozen=True)
class Boolean(Query):
    """Must, should and must-not clauses.

    With a must clause the should clauses are optional unless ``minimum_should_match`` asks for
    some; without one at least one should clause must match; with must-not clauses only, every
    other document matches.  No clauses at all match nothing.
    """

    clauses: tuple[Clause, ...] = field(default=())
    minimum_should_match: int = 0

    def of(self, occur: Occur) -> list[Query]:
        return [c.query for c in self.clauses if c.occur is occur]


def bool_of(must: list[Query] | None = None, should: list[Query] | None = None, must_not: list[Query] | None = None, minimum_should_match: int = 0) -> Boolean:
    parts = [Clause(o, q) for o, qs in ((Occur.MUST, must), (Occur.SHOULD, should), (Occur.MUST_NOT, must_not)) for q in qs or []]
    return Boolean(tuple(parts), minimum_should_match)


def check(q: Query, depth: int = 1) -> Query:
    """Raises :class:`QueryError` at the first broken limit; returns the query itself."""
    if depth > MAX_DEPTH:
        raise QueryError(f"query is nested deeper than {MAX_DEPTH}")
    boost = getattr(q, "boost", 1.0)
    if not 0 <= boost < float("inf"):
        raise QueryError(f"boost {boost} is not a number of at least 0")
    match q:
        case Boolean(clauses, least):
            if len(clauses) > MAX_CLAUSES:
                raise QueryError(f"{len(clauses)} clauses, at most {MAX_CLAUSES} are allowed")
            if least < 0:
                raise QueryError("minimum_should_match is below 0")
            for c in clauses:
                check(c.query, depth + 1)
        case Wildcard(_, pattern, _) | Regexp(_, pattern, _):
            if len(pattern.encode()) > MAX_PATTERN_BYTES:
                raise QueryError(f"pattern is longer than {MAX_PATTERN_BYTES} bytes")
        case Fuzzy(_, term, distance, prefix, _):
            if not 0 <= distance <= MAX_FUZZY_DISTANCE:
                raise QueryError(f"fuzzy distance {distance} is not in 0..{MAX_FUZZY_DISTANCE}")
            if distance and len(term.encode()) < MIN_FUZZY_LENGTH:
                raise QueryError(f"fuzzy term {term!r} is shorter than {MIN_FUZZY_LENGTH} bytes")
            if prefix < 0:
                raise QueryError("prefix_length is below 0")
        case Phrase(_, terms, slop, _):
            if not terms or len(terms) > MAX_PHRASE_TERMS:
                raise QueryError(f"a phrase has 1 to {MAX_PHRASE_TERMS} terms, not {len(terms)}")
            if slop < 0:
                raise QueryError("slop is below 0")
        case Proximity(_, terms, slop, _):
            if not terms or len(terms) > MAX_PROXIMITY_TERMS:
                raise QueryError(f"proximity takes 1 to {MAX_PROXIMITY_TERMS} terms, not {len(terms)}")
            if not 0 <= slop <= MAX_PROXIMITY_SLOP:
                raise QueryError(f"slop {slop} is not in 0..{MAX_PROXIMITY_SLOP}")
    return q
