"""Deterministic top-k: score descending, then document ascending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values.
DEFAULT_K = 10
MAX_K = 10_000


def effective_k(k: int | None) -> int:
    """0, negative or missing is the default; more than the cap is an error."""
    if not k or k <= 0:
        return DEFAULT_K
    if k > MAX_K:
        raise ValueError(f"top_k {k} is over {MAX_K}")
    return k


def topk(hits: DataFrame, k: int | None = None, offset: int = 0, score: str = "score", doc: str = "doc_id") -> DataFrame:
    """The best rows, planned as one TakeOrderedAndProject: each task keeps k rows."""
    ordered = hits.orderBy(F.col(score).desc(), F.col(doc).asc())
    return ordered.offset(offset).limit(effective_k(k)) if offset > 0 else ordered.limit(effective_k(k))


def shard_topk(hits: DataFrame, k: int | None = None, shard: str = "shard_id") -> DataFrame:
    """Every shard's best k; ``row_number() <= k`` is cut before the shuffle by WindowGroupLimit."""
    w = Window.partitionBy(shard).orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return hits.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= effective_k(k)).drop("__rank")


def merge_topk(shards: DataFrame, k: int | None = None) -> DataFrame:
    """Global best k of the shards' best; ties by document, then shard."""
    return shards.orderBy(F.col("score").desc(), F.col("doc_id").asc(), F.col("shard_id").asc()).limit(effective_k(k))


def above(hits: DataFrame, least: Column) -> DataFrame:
    return hits.where(F.col("score") >= least)
