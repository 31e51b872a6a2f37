"""Joins in which a few keys hold most rows of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot if it holds more than one in so many rows; so at most this many keys are hot.
HOT_PARTS = 1000
#: Rows of a hot key that stay together.
PIECE = 20_000


def hot_keys(rows: DataFrame, key: str, parts: int = HOT_PARTS, piece: int = PIECE) -> DataFrame:
    """(key, pieces) of keys with more than ``piece`` rows and more than one in ``parts`` of all rows.

    Fewer than ``parts`` rows by construction, so the result may be broadcast.  Counts are
    combined before the shuffle; a null key is never hot.
    """
    n = F.count(F.lit(1))
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(n.alias("__c"))
    total = rows.agg(n).scalar()
    hot = counts.where((F.col("__c") > piece) & (F.col("__c") * parts > total))
    return hot.select(key, F.ceil(F.col("__c") / F.lit(piece)).cast("int").alias("__pieces"))


def spread_join(rows: DataFrame, other: DataFrame, key: str, parts: int = HOT_PARTS, piece: int = PIECE) -> DataFrame:
    """``rows JOIN other USING (key)`` where ``rows`` may have hot keys.

    Rows of a hot key are cut into pieces by a hash of the row; the other side's rows of that key
    go to every piece, so no task holds more than about ``piece`` rows of one key.  ``rows``
    should be a written table (it is read twice or more; hot keys are counted at once).  Columns other than the key must
    differ; null keys match nothing; empty sides give no rows.
    """
    found = hot_keys(rows, key, parts, piece)
    kept = found.collect()
    if not kept:
        return rows.join(other, key)
    hot = F.broadcast(rows.sparkSession.createDataFrame(kept, found.schema))
    place = F.coalesce(F.pmod(F.xxhash64(*[c for c in rows.columns if c != key] or [key]), F.col("__pieces")), F.lit(0).cast("bigint"))
    a = rows.join(hot, key, "left").withColumn("__at", place).drop("__pieces")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("__pieces"), F.lit(1)).cast("bigint") - 1))
    b = other.join(hot, key, "left").withColumn("__at", every).drop("__pieces")
    return a.join(b, [key, "__at"]).drop("__at")
