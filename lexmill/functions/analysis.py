"""Analyzers as functions from a text Column to a Column of terms, and their registry."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from lexmill.functions import text as tx

Analyzer = Callable[[Column], Column]


class Registry:
    """Named analyzers; the built-in ones are there from the start."""

    def __init__(self) -> None:
        self._by_name: dict[str, Analyzer] = {"standard": tx.standard_tokens, "whitespace": tx.whitespace_tokens, "keyword": tx.keyword_tokens}

    def get(self, name: str) -> Analyzer:
        if name not in self._by_name:
            raise KeyError(f"unknown analyzer {name!r}")
        return self._by_name[name]

    def register(self, name: str, analyzer: Analyzer) -> None:
        """Adds a ``Column -> Column`` function giving an array of terms; a taken name is an error."""
        if name in self._by_name:
            raise ValueError(f"analyzer {name!r} is already registered")
        self._by_name[name] = analyzer

    def register_python(self, name: str, terms: Callable[[str], Iterable[str]]) -> None:
        """Adds a Python function of one text, run in Arrow batches."""

        @pandas_udf("array<string>")
        def run(texts):  # noqa: ANN001, ANN202 - the types of a pandas UDF are taken from its declaration
            return texts.map(lambda t: None if t is None else list(terms(t)))

        run.func.__annotations__.clear()
        self.register(name, run)

    def names(self) -> list[str]:
        return sorted(self._by_name)


def analyze(df: DataFrame, key: str, text: str, analyzer: Analyzer) -> DataFrame:
    """(key, term, position): the terms of every text with positions 0, 1, 2, ...

    Null and empty texts have none; other columns are never read.
    """
    return df.select(F.col(key), F.posexplode(analyzer(F.col(text))).alias("position", "term")).select(key, "term", "position")


#: What separates the terms of the analyzers that have offsets.
PATTERNS = {"standard": tx.STANDARD, "whitespace": tx.WHITESPACE}


def token_offsets(df: DataFrame, key: str, text: str, analyzer: str = "standard") -> DataFrame:
    """(key, term, position, start_byte, end_byte): half-open UTF-8 byte ranges of every term.

    Gaps and raw terms of a text are summed up by a running window over its positions, so a
    text of n terms costs O(n) and nothing leaves the JVM.  ``key`` must be unique.
    """
    c = F.col(text)
    if analyzer == "keyword":
        return df.where(c != "").select(key, c.alias("term"), F.lit(0).alias("position"), F.lit(0).alias("start_byte"), F.octet_length(c).alias("end_byte"))
    p = PATTERNS[analyzer]
    raw = F.regexp_extract_all(c, F.lit(p), F.lit(0))
    parts = df.select(F.col(key), raw.alias("t"), F.split(c, p, -1).alias("g"))
    one = parts.select(F.col(key), F.posexplode(F.arrays_zip("t", F.slice("g", 1, F.size("t")).alias("g"))).alias("position", "x"))
    sized = one.select(key, "position", F.col("x.t").alias("raw"), F.octet_length("x.t").alias("n"), (F.octet_length("x.t") + F.octet_length("x.g")).alias("step"))
    end = F.expr(f"sum(step) over (partition by `{key}` order by position rows unbounded preceding)").cast("int")
    term = tx.lower_simple(F.col("raw")) if analyzer == "standard" else F.col("raw")
    return sized.select(F.col(key), term.alias("term"), "position", (end - F.col("n")).alias("start_byte"), end.alias("end_byte"))
