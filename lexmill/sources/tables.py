"""The test tables as documents of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.plans.view import IndexView
from lexmill.schema import Schema, keyword_field, stored_field, text_field
from lexmill.scratch import spread

DOCUMENTS = Schema((text_field("text", stored=False), keyword_field("lang"), keyword_field("source"), stored_field("n_chars")), "standard").validate()
CORPUS = Schema((text_field("title"), text_field("body", stored=False), keyword_field("tags", multi_valued=True), stored_field("metadata")), "standard").validate()

_views: dict[tuple[str, str, str], IndexView] = {}


def documents(spark: SparkSession, d: str) -> DataFrame:
    """documents with doc_id as the internal and its text as the external id."""
    return spread(spark.read.parquet(f"{d}/documents.parquet")).withColumn("id", F.col("doc_id").cast("string"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """small_corpus with row_no as the internal id."""
    return spread(spark.read.parquet(f"{d}/small_corpus.parquet")).withColumn("doc_id", F.col("row_no"))


def view(spark: SparkSession, d: str, table: str = "documents") -> IndexView:
    """The table's index, built once per session and folder and read from the shared folder after that."""
    key = (spark.sparkContext.applicationId, d, table)
    if key not in _views:
        docs, schema = (documents(spark, d), DOCUMENTS) if table == "documents" else (corpus(spark, d), CORPUS)
        _views[key] = IndexView.build(docs, schema)
    return _views[key]
