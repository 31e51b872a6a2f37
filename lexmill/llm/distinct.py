"""How distinctive a term is of a record: positive pointwise mutual information by group-bys and joins.

With joint counts n(t, r), marginals n(t) and n(r), and context counts smoothed by an exponent,
``score = max(0, ln(n(t, r) * sum_r n(r)^alpha / (n(t) * n(r)^alpha)))``.

The texts are dealt out by record once, so the group-by of (record, term) needs no further
shuffle.  The join with n(t) is split by a proven bound: at most ``HEAVY`` terms can hold more than
1 / ``HEAVY`` of all occurrences each, so those marginals are broadcast and their (many) rows
never move; only rows of the other terms are shuffled, and none of those terms is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill.functions.text import record_words
from lexmill.scratch import Scope, materialise

HEAVY = 50_000
#: Context counts are summed exactly, so the sum does not depend on the order of the tasks.
_EXACT = "decimal(38,12)"


def joint_counts(df: DataFrame, row: str, *columns: str) -> DataFrame:
    """(row, term, tf, len, kinds, head): occurrences of every distinct word of a record, the
    record's words and distinct words; ``head`` marks one term of each record."""
    words = df.select(F.col(row).alias("row"), *columns).repartition("row").select("row", record_words(*columns).alias("w"))
    sized = words.select("row", F.size("w").alias("len"), F.size(F.array_distinct("w")).alias("kinds"), "w")
    each = sized.select("row", "len", "kinds", F.posexplode("w").alias("at", "term"))
    n = each.groupBy("row", "len", "kinds", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.min("at").alias("at"))
    return n.select("row", "term", "tf", "len", "kinds", (F.col("at") == 0).alias("head"))


def term_scores(df: DataFrame, row: str, *columns: str, alpha: float = 0.75, joint: str = "count", weight: str = "one") -> DataFrame:
    """(row, term, score) of every distinct word of the columns together.

    ``joint``: ``count`` takes n(t, r) as occurrences, ``presence`` as 1.  ``weight``: ``tf``
    multiplies by the term's occurrences in the record.  With ``joint="presence",
    weight="tf"`` the score tends to tf * ln(N / df) as ``alpha`` tends to 0, and is it at 0.

    Null columns count as empty; rows without a word give no rows; ``row`` must be unique; an
    empty table gives no rows.
    """
    if joint not in ("count", "presence") or weight not in ("one", "tf"):
        raise ValueError("joint is count or presence, weight is one or tf")
    with Scope(df.sparkSession) as scope:
        kept = scope.keep(materialise(joint_counts(df, row, *columns), "joint"))
        ctx = F.pow(F.col("len" if joint == "count" else "kinds").cast("double"), F.lit(float(alpha)))
        n = F.sum("tf") if joint == "count" else F.count(F.lit(1))
        mass = F.sum(F.when(F.col("head"), ctx.cast(_EXACT)))
        marginals = scope.keep(materialise(kept.groupBy("term").agg(n.alias("nt"), mass.alias("mass")), "marginals"))
        sums = marginals.agg(F.sum("nt").alias("nt"), F.sum("mass").alias("mass")).first()
    total, mass = float(sums["nt"] or 0), float(sums["mass"] or 0)
    nt = marginals.select("term", F.col("nt").cast("double").alias("nt"))
    heavy = F.broadcast(nt.where(F.col("nt") > total / HEAVY))
    rare = nt.where(F.col("nt") <= total / HEAVY)
    hot = kept.join(heavy, "term")
    cold = kept.join(heavy.select("term"), "term", "left_anti").join(rare, "term")
    here = F.col("tf").cast("double") if joint == "count" else F.lit(1.0)
    pmi = F.greatest(F.lit(0.0), F.log(here * F.lit(mass) / (F.col("nt") * ctx)))
    score = pmi * F.col("tf") if weight == "tf" else pmi
    return hot.select("row", "term", score.alias("score")).unionByName(cold.select("row", "term", score.alias("score")))


def strongest(scores: DataFrame) -> DataFrame:
    """(row, term, score): the term with the highest score to 6 decimals, on a tie the first by code point."""
    best = F.min(F.struct((-F.round("score", 6)).alias("s"), F.col("term").alias("term")))
    return scores.groupBy("row").agg(best.alias("b")).select("row", "b.term", (-F.col("b.s")).alias("score"))
