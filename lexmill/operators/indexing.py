"""From documents to an inverted index: postings, dictionary, lengths and field statistics.

A document is one row, so its terms are grouped inside the row (sorted array, run ends) and no
shuffle is needed to build postings; only the clustering by (field, term) at write time moves them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions.analysis import Registry
from lexmill.schema import FieldDef, Schema
from lexmill.scratch import materialise

#: Terms above this many bytes are refused.
MAX_TERM_BYTES = 32 * 1024
POSTINGS = "field string, term string, doc_id bigint, tf int, dl int, positions array<int>"


class DocumentError(ValueError):
    """A batch with a document that can't be indexed."""


def field_postings(docs: DataFrame, doc_id: str, field: str, terms: Column, positions: bool) -> DataFrame:
    """(field, term, doc_id, tf, dl, positions) of one analyzed field, ``terms`` an array in text order.

    ``dl`` is the number of terms of the field in the document; ``positions`` is null unless
    wanted.  Null and empty arrays give no postings.
    """
    pair = F.transform("t", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), terms.alias("t")).where(F.size("t") > 0)
    rows = rows.select("doc_id", F.sort_array(pair).alias("s"))
    last = F.filter(F.sequence(F.lit(1), F.size("s")), lambda i: (i == F.size("s")) | (F.element_at("s", i)["term"] != F.get("s", i)["term"]))
    rows = rows.select("doc_id", "s", last.alias("e"))

    def entry(e: Column, i: Column) -> Column:
        before = F.when(i == 0, 0).otherwise(F.get("e", i - 1))
        where = F.transform(F.slice("s", before + 1, e - before), lambda x: x["pos"]) if positions else F.lit(None).cast("array<int>")
        return F.struct(F.get("s", e - 1)["term"].alias("term"), (e - before).alias("tf"), where.alias("positions"))

    out = rows.select("doc_id", F.size("s").alias("dl"), F.explode(F.transform("e", entry)).alias("x"))
    return out.select(F.lit(field).alias("field"), F.col("x.term").alias("term"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("x.tf").alias("tf"), "dl", F.col("x.positions").alias("positions"))


def keyword_values(f: FieldDef, c: Column) -> Column:
    """Terms of a keyword field as they stand; null elements are left out."""
    return F.filter(c, lambda t: t.isNotNull()) if f.multi_valued else F.when(c.isNotNull(), F.array(c))


def build_postings(docs: DataFrame, schema: Schema, doc_id: str = "doc_id", registry: Registry | None = None) -> DataFrame:
    """Postings of every searchable field; fields with ``indexed: false`` have none.

    A keyword repeated in a document is one posting whose tf is its multiplicity.
    """
    out = None
    for f, terms in _field_terms(docs, schema, registry or Registry()):
        part = field_postings(docs, doc_id, f.name, terms, f.positions)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], POSTINGS) if out is None else out


def dictionary(postings: DataFrame) -> DataFrame:
    """(field, term, df, cf): documents and occurrences of every term."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _field_terms(docs: DataFrame, schema: Schema, registry: Registry) -> list[tuple[FieldDef, Column]]:
    out = []
    for f in schema.fields:
        if f.searchable:
            c = F.col(f"`{f.name}`")
            out.append((f, registry.get(schema.analyzer_of(f))(c) if f.type == "text" else keyword_values(f, c)))
    return out


def doc_lengths(docs: DataFrame, schema: Schema, doc_id: str = "doc_id", registry: Registry | None = None) -> DataFrame:
    """(field, doc_id, dl) of the documents that have terms in a field; one pass, no shuffle."""
    sizes = [F.struct(F.lit(f.name).alias("field"), F.size(t).alias("dl")) for f, t in _field_terms(docs, schema, registry or Registry())]
    if not sizes:
        return docs.sparkSession.createDataFrame([], "field string, doc_id bigint, dl int")
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.explode(F.array(*sizes)).alias("x")).select("x.field", "doc_id", "x.dl").where("dl > 0")


def field_stats(terms: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per field: distinct terms, occurrences, documents with the field, sum of document
    frequencies, shortest and longest term in bytes; from the dictionary and the lengths."""
    d = terms.groupBy("field").agg(
        F.count(F.lit(1)).alias("term_count"), F.sum("df").alias("sum_doc_freq"),
        F.min(F.octet_length("term")).alias("min_term_length"), F.max(F.octet_length("term")).alias("max_term_length"),
    )
    n = lengths.groupBy("field").agg(F.count(F.lit(1)).alias("doc_count"), F.sum("dl").alias("total_term_freq"))
    return d.join(n, "field").select("field", "term_count", "total_term_freq", "doc_count", "sum_doc_freq", "min_term_length", "max_term_length")


def stored_fields(docs: DataFrame, schema: Schema, keep: Sequence[str] = ("doc_id", "id")) -> DataFrame:
    """The stored columns, strings as they are, other values as JSON."""
    types = dict(docs.dtypes)
    cols = []
    for name in schema.stored:
        if name not in keep:
            c = F.col(f"`{name}`")
            plain = types[name] == "string" or schema.field(name).multi_valued
            cols.append(c if plain else F.when(c.isNotNull(), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)).alias(name))
    return docs.select(*keep, *cols)


def duplicate_ids(docs: DataFrame, key: str = "id") -> DataFrame:
    """(id, n) of ids that stand more than once; nulls count as one id."""
    return docs.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_batch(docs: DataFrame) -> int:
    """Number of documents; raises :class:`DocumentError` for a missing, empty or repeated id."""
    got = docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull() | (F.col("id") == "")).alias("bad")).first()
    if got["bad"]:
        raise DocumentError(f"{got['bad']} documents have no id")
    twice = duplicate_ids(docs).limit(1).collect()
    if twice:
        raise DocumentError(f"document {twice[0]['id']!r} stands {twice[0]['n']} times in one batch")
    return got["n"]


def with_doc_ids(docs: DataFrame, by: str = "id", start: int = 0) -> DataFrame:
    """Dense ``doc_id`` from ``start`` in the order of ``by``, without a global sort in one task.

    Rows are range-partitioned and numbered within their partition; only the partitions' sizes
    reach the driver.  The partitioned rows are written once, so retries number alike.
    """
    parts = docs.repartitionByRange(by).sortWithinPartitions(by)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = materialise(parts.withColumn("__part", F.spark_partition_id()).withColumn("__local", local), "numbered")
    sizes = {r["__part"]: r["n"] for r in kept.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, at = [], start
    for p in sorted(sizes):
        base.append((p, at))
        at += sizes[p]
    offsets = docs.sparkSession.createDataFrame(base, "__part int, __base bigint")
    return kept.join(F.broadcast(offsets), "__part").withColumn("doc_id", F.col("__base") + F.col("__local")).drop("__part", "__local", "__base")


def clustered(postings: DataFrame) -> DataFrame:
    """Postings in the order of the dictionary, so files and row groups hold narrow term ranges.

    The document is part of the range, so a term that stands in every document is cut into pieces.
    """
    return postings.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id")


def refuse_long_terms(postings: DataFrame) -> DataFrame:
    """Postings of which reading fails if a term is over ``MAX_TERM_BYTES``."""
    long = F.octet_length("term") > MAX_TERM_BYTES
    return postings.withColumn("term", F.when(long, F.raise_error(F.lit(f"a term is over {MAX_TERM_BYTES} bytes"))).otherwise(F.col("term")))
