"""Items that appear together: pair counts, lift and pointwise mutual information from marginals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def tag_key(c: Column) -> Column:
    """Trimmed, lower case, each run of blanks, ``_`` or ``-`` as one ``-``."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s_-]+", "-")


def pair_counts(baskets: DataFrame, items: str, least: int = 1, least_share: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, pmi), item_a < item_b, of an array column.

    Null arrays, null and empty items are left out; an item counts once per basket; ``n`` is
    the number of baskets with an item; only pairs in at least ``least`` baskets and
    ``least_share`` of ``n`` are kept.  Repeated rows are baskets of their own; an empty
    table gives no rows.

    Pairs leave a basket one first item at a time, so a basket of many items never stands in
    memory as all its pairs, and are combined before the shuffle; a pair is one row per task
    however often it occurs.
    """
    b = baskets.select(F.array_sort(F.array_distinct(F.filter(F.col(items), lambda t: t.isNotNull() & (t != "")))).alias("t")).where(F.size("t") > 0)
    n = b.agg(F.count(F.lit(1)))
    single = b.select(F.explode("t").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    heads = b.select("t", F.posexplode("t").alias("i", "item_a")).where(F.col("i") + 1 < F.size("t"))
    rest = heads.select("item_a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("item_b"))
    pairs = rest.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab")).withColumn("n", n.scalar())
    pairs = pairs.where((F.col("n_ab") >= least) & (F.col("n_ab") >= F.lit(least_share) * F.col("n")))
    a = single.select(F.col("item").alias("item_a"), F.col("c").alias("n_a"))
    z = single.select(F.col("item").alias("item_b"), F.col("c").alias("n_b"))
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    out = pairs.join(a, "item_a").join(z, "item_b")
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), F.log(lift).alias("pmi"))
