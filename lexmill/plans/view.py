"""What a query runs on: the tables of one index at one moment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lexmill.functions.analysis import Registry
from lexmill.operators import indexing
from lexmill.schema import Schema
from lexmill.scratch import materialise


@dataclass(frozen=True)
class IndexView:
    """postings (field, term, doc_id, tf, dl, positions), docs (doc_id, id, stored columns),
    terms (field, term, df, cf) and stats (one row per field), all over live documents.

    ``n_docs`` is the number of live documents.
    """

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    stats: DataFrame
    n_docs: int
    schema: Schema | None = None

    @staticmethod
    def build(docs: DataFrame, schema: Schema, registry: Registry | None = None, keep: bool = True) -> IndexView:
        """Index of ``docs`` (with ``doc_id``, ``id`` and the schema's columns).

        With ``keep`` the tables are written once to the shared folder, clustered by field and
        term, and read from there; without, they are plans over ``docs``.
        """
        postings = indexing.build_postings(docs, schema, registry=registry)
        if keep:
            # written as they come first: the range partitioning samples its input, which should not be analyzed twice
            postings = materialise(indexing.clustered(materialise(postings, "unordered")), "postings")
        terms = indexing.dictionary(postings)
        lengths = indexing.doc_lengths(docs, schema, registry=registry)
        if keep:
            terms = materialise(terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term"), "terms")
        stats = indexing.field_stats(terms, lengths)
        if keep:
            stats = materialise(stats.coalesce(1), "stats")
        stored = indexing.stored_fields(docs, schema)
        return IndexView(postings, stored, terms, stats, docs.count(), schema)

    @staticmethod
    def of_live(postings: DataFrame, docs: DataFrame, lengths: DataFrame, schema: Schema) -> IndexView:
        """View over several segments' rows that are already cut to live documents; statistics are made anew."""
        terms = indexing.dictionary(postings)
        return IndexView(postings, docs, terms, indexing.field_stats(terms, lengths), docs.count(), schema)

    def field_scale(self) -> DataFrame:
        """(field, avgdl): mean length over the documents that have the field."""
        return self.stats.select("field", (F.col("total_term_freq") / F.col("doc_count")).alias("avgdl"))
