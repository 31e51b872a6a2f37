"""Queries of problem 3, a few keys holding most records, over ``term_entry`` and ``segment_meta``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.operators.eager import eager_join_aggregate
from lexmill.scratch import materialise, spread

HEAVY_SHARE = 0.02


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """Per term: entries, sum of count, and the documents of the segments that hold the entries."""
    entries = spread(spark.read.parquet(f"{d}/term_entry.parquet")).withColumn("t", F.lower(F.trim("term"))).where(F.col("t") != "")
    segments = spark.read.parquet(f"{d}/segment_meta.parquet")
    # one state a segment, so that joined rows are entries
    segments = segments.groupBy("segment_id").agg(F.max("doc_count").alias("doc_count"))
    return eager_join_aggregate(
        entries,
        segments,
        "segment_id",
        {"term": F.col("t")},
        {"sum_count": F.col("count").cast("long")},
        {"sum_doc_count": F.col("doc_count").cast("long")},
        how="left",
    )


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    """Results of every term; null and blank terms are no terms, null counts add nothing."""
    return _terms(spark, d).select("term", F.col("n_left").alias("entries"), "sum_count", "sum_doc_count")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that hold more than 2 % of the rows that have a term.

    Rows are counted behind the join with the segments (``n_joined``, multiplied counts of the
    joined states); their total is the sum of the terms' counts.
    """
    terms = materialise(_terms(spark, d).select("term", "n_joined"), "terms")
    held = terms.agg(F.sum("n_joined"))
    return terms.where(F.col("n_joined") > F.lit(HEAVY_SHARE) * held.scalar()).select("term")


QUERIES = {"p3_found": p3_found, "p3_terms": p3_terms}

_VALID = "select lower(trim(term)) t, segment_id, count c from term_entry where trim(term) <> ''"

SQL = {
    "p3_found": f"with e as ({_VALID}) select t as term from e group by t having count(*) > 0.02 * (select count(*) from e)",
    "p3_terms": f"""with e as ({_VALID})
        select t as term, count(*) as entries, cast(sum(c) as bigint) as sum_count, cast(sum(doc_count) as bigint) as sum_doc_count
        from e left join segment_meta s on e.segment_id = s.segment_id group by t""",
}
