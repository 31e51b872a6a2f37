"""Phrases and proximity over position lists, one row per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _lists(postings: DataFrame, field: str, terms: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(doc_id, dl, p0, p1, ...): position lists of the distinct terms of documents that hold all of them."""
    distinct = list(dict.fromkeys(terms))
    mine = postings.where((F.col("field") == field) & F.col("term").isin(distinct))
    cols = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(distinct)]
    rows = mine.groupBy("doc_id").agg(F.first("dl").alias("dl"), *cols)
    for i in range(len(distinct)):
        rows = rows.where(F.col(f"p{i}").isNotNull())
    return rows, distinct


def _moved(positions: str, back: int) -> Column:
    return F.transform(F.col(positions), lambda x: x - back)


def _tagged(positions: str, i: int) -> Column:
    return F.transform(F.col(positions), lambda x: F.struct(x.alias("pos"), F.lit(i).alias("i")))


def _next_places(runs: Column, positions: str) -> Column:
    """Runs (start s, last place l) moved on to the nearest position behind; runs without one end."""
    behind = lambda r: F.array_min(F.filter(F.col(positions), lambda y: y > r["l"]))
    return F.filter(F.transform(runs, lambda r: F.struct(r["s"].alias("s"), behind(r).alias("l"))), lambda r: r["l"].isNotNull())


def phrase_matches(postings: DataFrame, field: str, terms: Sequence[str], slop: int = 0) -> DataFrame:
    """(doc_id, dl, tf): starts at which the terms stand in order.

    With slop 0 they are neighbours.  Otherwise every next term is the nearest one behind the
    one before, and the first and last may be ``slop`` further apart than neighbours would be.
    Repeated terms are allowed; documents without positions match nothing.
    """
    rows, distinct = _lists(postings, field, terms)
    at = [f"p{distinct.index(t)}" for t in terms]
    if slop == 0:
        starts: Column = F.col(at[0])
        for i, p in enumerate(at[1:], 1):
            starts = F.array_intersect(starts, _moved(p, i))
        return rows.withColumn("tf", F.size(starts)).where("tf > 0").select("doc_id", "dl", "tf")
    runs = F.transform(F.col(at[0]), lambda x: F.struct(x.alias("s"), x.alias("l")))
    for p in at[1:]:
        runs = _next_places(runs, p)
    n = len(terms)
    good = F.filter(runs, lambda r: r["l"] - r["s"] - (n - 1) <= slop)
    return rows.withColumn("tf", F.size(good)).where("tf > 0").select("doc_id", "dl", "tf")


def proximity_matches(postings: DataFrame, field: str, terms: Sequence[str], slop: int = 0) -> DataFrame:
    """(doc_id, dl, tf): positions from which all distinct terms stand within n + slop positions, in any order.

    Only documents that hold all terms are unnested; the window moves over one document's positions.
    """
    rows, distinct = _lists(postings, field, terms)
    n = len(distinct)
    tagged = F.flatten(F.array(*(_tagged(f"p{i}", i) for i in range(n))))
    flat = rows.select("doc_id", "dl", F.explode(tagged).alias("x")).select("doc_id", "dl", "x.pos", "x.i")
    ahead = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(0, n - 1 + slop)
    kinds = flat.withColumn("kinds", F.size(F.collect_set("i").over(ahead)))
    return kinds.where(F.col("kinds") == n).groupBy("doc_id").agg(F.first("dl").alias("dl"), F.count(F.lit(1)).cast("int").alias("tf"))
