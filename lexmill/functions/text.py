"""Text analysis as Column expressions: everything stays inside whole-stage code generation.

Fixed values (they decide which terms exist, so they must be these):
``STANDARD`` letters, decimal digits and ``_``; ``WHITESPACE`` everything between Unicode
white space.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

STANDARD = r"[\p{L}\p{Nd}_]+"
WHITESPACE = r"[^\s\x0B\x{85}\p{Z}]+"


def lower_simple(c: Column) -> Column:
    """Lower case, one code point to one code point.

    Java's full mapping makes two code points of capital I with dot and looks at the
    neighbours of capital sigma; where one of them stands, both are mapped plainly first.
    """
    odd = F.contains(c, F.lit("İ")) | F.contains(c, F.lit("Σ"))
    return F.when(odd, F.lower(F.translate(c, "İΣ", "iσ"))).otherwise(F.lower(c))


def standard_tokens(c: Column) -> Column:
    """Array of lower-cased standard terms in order; null stays null, empty gives an empty array.

    The cut comes before the lower-casing, which is done once on the joined terms
    (a blank is never part of a term).
    """
    raw = F.regexp_extract_all(c, F.lit(STANDARD), F.lit(0))
    return F.array_remove(F.split(lower_simple(F.array_join(raw, " ")), " "), "")


def whitespace_tokens(c: Column) -> Column:
    """Array of the runs between Unicode white space, case kept."""
    return F.regexp_extract_all(c, F.lit(WHITESPACE), F.lit(0))


def keyword_tokens(c: Column) -> Column:
    """The whole value as one term; none for an empty value; null stays null."""
    return F.when(c == "", F.array().cast("array<string>")).when(c.isNotNull(), F.array(c))


def record_words(*columns: str) -> Column:
    """Standard terms of several columns in a row; null columns count as empty."""
    return standard_tokens(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))


def _lower(c: str) -> str:
    low = "i" if c == "İ" else c.lower()
    return low if len(low) == 1 else c


def _standard(text: str) -> list[str]:
    inside = "".join(_lower(c) if c == "_" or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in text)
    return [t for t in inside.split(" ") if t]


def _whitespace(text: str) -> list[str]:
    kept = "".join(" " if unicodedata.category(c)[0] == "Z" or c in "\t\n\x0b\x0c\r\x85" else c for c in text)
    return [t for t in kept.split(" ") if t]


#: The built-in analyzers on a text the driver holds (a query's).
PLAIN = {"standard": _standard, "whitespace": _whitespace, "keyword": lambda text: [text] if text else []}
