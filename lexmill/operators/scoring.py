"""BM25 as Column arithmetic, on doubles."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# The usual parameters.
K1, B = 1.2, 0.75


def idf(n_docs: Column, df: Column) -> Column:
    """ln(1 + (N - n + 0.5) / (n + 0.5)); above zero whenever n <= N."""
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_score(weight: Column, tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)); 0 where the denominator is."""
    length = F.when(avgdl > 0, dl / avgdl).otherwise(F.lit(0.0))
    low = tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length)
    return F.when(low == 0, F.lit(0.0)).otherwise(weight * tf * F.lit(k1 + 1.0) / low)


def explanation(field: Column, term: Column, tf: Column, dl: Column, df: Column, n_docs: Column, avgdl: Column, score: Column, boost: Column, k1: float = K1, b: float = B) -> Column:
    """Struct (value, description, details) of one term's score.

    The descriptions are fixed values: clients read them.
    """
    norm = tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl))
    part = lambda value, text: F.struct(value.cast("double").alias("value"), text.alias("description"))
    return F.struct(
        score.alias("value"),
        F.format_string("weight(%s:%s) [BM25]", field, term).alias("description"),
        F.array(
            part(boost, F.lit("boost")),
            part(idf(n_docs, df), F.format_string("idf(docFreq=%d, N=%d)", df.cast("bigint"), n_docs.cast("bigint"))),
            part(norm, F.format_string("tf(freq=%d, norm=%.4f)", tf.cast("bigint"), norm.cast("double"))),
            part(F.lit(b) * dl / avgdl, F.format_string("dl=%d, avgdl=%.1f", dl.cast("bigint"), avgdl.cast("double"))),
        ).alias("details"),
    )


@dataclass(frozen=True)
class Bm25:
    """The same formulas on single numbers, for checks and for callers without a table."""

    n_docs: int
    avgdl: float
    k1: float = K1
    b: float = B

    def idf(self, df: int) -> float:
        return math.log(1.0 + (self.n_docs - df + 0.5) / (df + 0.5))

    def score(self, tf: float, dl: float, weight: float) -> float:
        low = tf + self.k1 * (1 - self.b + self.b * (dl / self.avgdl if self.avgdl > 0 else 0.0))
        return weight * tf * (self.k1 + 1) / low if low else 0.0

    def score_terms(self, terms: Iterable[tuple[float, int, float]], dl: float) -> float:
        """Sum over (tf, df, boost); terms with tf 0 add nothing."""
        return sum(boost * self.score(tf, dl, self.idf(df)) for tf, df, boost in terms if tf)
