"""Aggregation pushed below a join, for keys that hold most of the rows.

``SELECT group, sums FROM left JOIN right ON key GROUP BY group`` is computed on compact
states: both inputs are first aggregated by the join key (map-side combined, so a hot key
leaves each task as one row), the states are joined, counts are multiplied and sums scaled
by the other side's count, and the result is rolled up to the wanted groups.  No stage
moves or joins raw rows, so a key that holds a third of the input costs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    key: str,
    group: Mapping[str, Column],
    left_sums: Mapping[str, Column] | None = None,
    right_sums: Mapping[str, Column] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Counts and sums of ``left JOIN right USING (key)`` by ``group`` (columns of the left side).

    Result: the group columns, ``n_left`` (left rows taken, each once), ``n_joined`` (rows the
    join would give), then one column per entry of ``left_sums`` and ``right_sums`` summed over
    the joined rows.

    Defined cases: a null key matches nothing (dropped by ``inner``, kept once by ``left``);
    with ``left`` an unmatched row counts once and adds nothing to the right sums; null
    summands add nothing, a sum of nulls only is null; null group values form a group;
    repeated rows count as often as they stand; empty inputs give no rows (``left`` with an
    empty right side gives every left group).  Other columns are never touched, whatever
    their names.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    left_sums, right_sums = dict(left_sums or {}), dict(right_sums or {})
    names = [*group, "n_left", "n_joined", *left_sums, *right_sums]
    if len(set(names)) != len(names):
        raise ValueError(f"result columns repeat: {names}")
    gs = [f"__g{i}" for i in range(len(group))]
    ls = [f"__l{i}" for i in range(len(left_sums))]
    rs = [f"__r{i}" for i in range(len(right_sums))]

    a = (
        left.select(F.col(key).alias("__k"), *(c.alias(n) for n, c in zip(gs, group.values())), *(c.alias(n) for n, c in zip(ls, left_sums.values())))
        .groupBy("__k", *gs)
        .agg(F.count(F.lit(1)).alias("__ln"), *(F.sum(n).alias(n) for n in ls))
    )
    b = (
        right.where(F.col(key).isNotNull())
        .select(F.col(key).alias("__rk"), *(c.alias(n) for n, c in zip(rs, right_sums.values())))
        .groupBy("__rk")
        .agg(F.count(F.lit(1)).alias("__rn"), *(F.sum(n).alias(n) for n in rs))
    )
    if how == "left":
        # rows without a key match nothing; the second join column spreads them by group over all tasks
        a = a.withColumn("__s", F.when(F.col("__k").isNull(), F.xxhash64(F.lit(7), *gs)).otherwise(F.lit(0).cast("long")))
        b = b.withColumn("__rs", F.lit(0).cast("long"))
        joined = a.join(b, (F.col("__k") == F.col("__rk")) & (F.col("__s") == F.col("__rs")), "left")
    else:
        joined = a.where(F.col("__k").isNotNull()).join(b, F.col("__k") == F.col("__rk"))
    times = F.coalesce(F.col("__rn"), F.lit(1))
    states = joined.select(
        *gs,
        F.col("__ln"),
        (F.col("__ln") * times).alias("__n"),
        *((F.col(n) * times).alias(n) for n in ls),
        *((F.col(n) * F.col("__ln")).alias(n) for n in rs),
    )
    rolled = states.groupBy(*gs).agg(F.sum("__ln").alias("n_left"), F.sum("__n").alias("n_joined"), *(F.sum(n).alias(n) for n in [*ls, *rs]))
    return rolled.select(*(F.col(g).alias(n) for g, n in zip(gs, group)), "n_left", "n_joined", *(F.col(n).alias(m) for n, m in zip([*ls, *rs], [*left_sums, *right_sums])))
