"""Predicates on terms: prefix, wildcard, regular expression and edit distance, and their expansion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.plans import ast
from lexmill.plans.ast import QueryError

#: What a regular expression may not hold: look-around, back-references, possessive and atomic groups.
_FORBIDDEN = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9kG]|[*+?}]\+")
_META = re.compile(r"([\\.\[\]{}()+^$|])")


def wildcard_regex(pattern: str) -> str:
    """Anchored expression of a wildcard pattern; runs of ``*`` are one."""
    body = re.sub(r"\*+", "*", pattern)
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else _META.sub(r"\\\1", c) for c in body) + r"\z"


def regexp_regex(pattern: str) -> str:
    if _FORBIDDEN.search(pattern):
        raise QueryError("look-around, back-references and possessive quantifiers are not supported")
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(f"bad regular expression: {e}") from e
    return rf"^(?:{pattern})\z"


def literal_prefix(pattern: str, stop: str) -> str:
    """Leading characters of a pattern that stand for themselves."""
    m = re.match(f"[^{re.escape(stop)}]*", pattern)
    return m[0] if m else ""


def matches(q: ast.Query, term: Column) -> Column:
    """Whether a term satisfies a leaf; the parts that reach the Parquet scan come first."""
    match q:
        case ast.Term(_, t, _):
            return term == t
        case ast.Prefix(_, p, _):
            return term.startswith(p)
        case ast.Wildcard(_, p, _):
            head = literal_prefix(p, "*?")
            if head == p:
                return term == p
            return term.startswith(head) & term.rlike(wildcard_regex(p)) if head else term.rlike(wildcard_regex(p))
        case ast.Regexp(_, p, _):
            return term.rlike(regexp_regex(p))
        case ast.Fuzzy(_, t, d, n, _):
            near = F.levenshtein(term, F.lit(t), d) >= 0
            size = F.length(term).between(len(t) - d, len(t) + d)
            return term.startswith(t[:n]) & size & near if n else size & near
    raise TypeError(f"{type(q).__name__} is no term leaf")


#: The usual limits of a leaf; a number or None (no limit) may stand in its place.
USUAL = "usual"
Limit = int | str | None


def limit_of(q: ast.Query, limit: Limit = USUAL) -> int | None:
    """How many terms a leaf may stand for; None is all of them."""
    if limit == USUAL:
        return ast.MAX_FUZZY_TERMS if isinstance(q, ast.Fuzzy) else ast.MAX_TERMS
    return limit


def expand(terms: DataFrame, q: ast.Query, limit: Limit = USUAL) -> DataFrame:
    """Rows of the dictionary that a leaf stands for, the first ``limit`` in order of the term, or all."""
    if isinstance(q, ast.Term):
        return terms.where((F.col("field") == q.field) & (F.col("term") == q.term))
    found = terms.where((F.col("field") == q.field) & matches(q, F.col("term")))
    most = limit_of(q, limit)
    return found if most is None else found.orderBy("term").limit(most)


def count(terms: DataFrame, q: ast.Query, limit: Limit = USUAL) -> DataFrame:
    """(n): terms a leaf stands for; with a limit the count stops one behind it."""
    found = terms.where((F.col("field") == q.field) & matches(q, F.col("term"))).select("term")
    most = limit_of(q, limit)
    return (found if most is None else found.limit(most + 1)).agg(F.count(F.lit(1)).alias("n"))
