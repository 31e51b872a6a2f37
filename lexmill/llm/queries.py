"""Queries of the problems tagged llm, with their SQL twins where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.functions.text import standard_tokens
from lexmill.llm import distinct, encode, history, leak, near, personal, terms, together
from lexmill.scratch import spread


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/small_corpus.parquet"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Later rows of small_corpus whose document was there already."""
    return history.repeated_rows(_corpus(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of small_corpus rows whose word sets are alike."""
    pairs = near.near_pairs(_corpus(spark, d), "row_no", "title", "body")
    return pairs.select(F.col("a").alias("row_no_a"), F.col("b").alias("row_no_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per small_corpus row with enough words: class of equal sets, group over links."""
    g = near.near_groups(_corpus(spark, d), "row_no", "title", "body")
    return g.select(F.col("row").alias("row_no"), F.col("class").alias("class_row"), F.col("group").alias("group_row"))


RARE, COMMON_BODY, COMMON_DICTIONARY = 2, 5, 10


def _body_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.count_record_terms(_corpus(spark, d).select(standard_tokens(F.col("body")).alias("t")), "t")


def _taken(spark: SparkSession, d: str) -> DataFrame:
    """Rows of term_entry that count: term trimmed and in lower case, repeated dumps taken once."""
    e = spread(spark.read.parquet(f"{d}/term_entry.parquet")).select("segment_id", "field", F.lower(F.trim("term")).alias("term"), "count")
    return e.where("term <> '' and count >= 1").distinct()


def _dictionary_terms(taken: DataFrame) -> DataFrame:
    """A segment is the record: a term counts once in each, with its counts over all fields."""
    per = taken.groupBy("segment_id", "term").agg(F.sum("count").alias("occ"))
    return terms.count_term_rows(per, "term", "occ")


def _marks(src: str, counted: DataFrame, rare: str, common: int, records: DataFrame) -> DataFrame:
    marks = F.array(F.when(F.col(rare) <= RARE, F.lit("rare")), F.when(F.col("rec") * common > records.scalar(), F.lit("common")))
    marked = counted.select(F.lit(src).alias("src"), "term", F.explode(marks).alias("mark"))
    return marked.where("mark is not null")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms of bodies and of the dictionary that are too rare or too common."""
    with_words = _corpus(spark, d).where(F.col("body").rlike(r"[\p{L}\p{Nd}_]")).agg(F.count(F.lit(1)))
    body = _marks("body", _body_terms(spark, d), "rec", COMMON_BODY, with_words)
    taken = _taken(spark, d)
    segments = taken.agg(F.countDistinct("segment_id"))
    return body.unionByName(_marks("dictionary", _dictionary_terms(taken), "occ", COMMON_DICTIONARY, segments))


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and records of every term of both sources."""
    one = _body_terms(spark, d).select(F.lit("body").alias("src"), "term", F.col("occ").alias("occurrences"), F.col("rec").alias("records"))
    two = _dictionary_terms(_taken(spark, d)).select(F.lit("dictionary").alias("src"), "term", F.col("occ").alias("occurrences"), F.col("rec").alias("records"))
    return one.unionByName(two)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The most distinctive word of every row with one, by tf * ln(N / df)."""
    scores = distinct.term_scores(spark.read.parquet(f"{d}/small_corpus.parquet"), "row_no", "title", "body", alpha=0.0, joint="presence", weight="tf")
    return distinct.strongest(scores).select(F.col("row").alias("row_no"), "term")


def p5_ppmi(spark: SparkSession, d: str) -> DataFrame:
    """The most distinctive word of every row by smoothed positive pointwise mutual information."""
    scores = distinct.term_scores(spark.read.parquet(f"{d}/small_corpus.parquet"), "row_no", "title", "body", alpha=0.75)
    return distinct.strongest(scores).select(F.col("row").alias("row_no"), "term", "score")


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select(F.transform("tags", together.tag_key).alias("t"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Tag pairs in at least 5 rows and 0.4 % of the rows with tags, at least 4 times as often as by chance."""
    pairs = together.pair_counts(_tags(spark, d), "t", least=5, least_share=0.004)
    return pairs.where("n_ab * n >= 4 * n_a * n_b").select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every tag pair with its counts, lift and pointwise mutual information."""
    pairs = together.pair_counts(_tags(spark, d), "t")
    return pairs.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


#: Folder of the public vocabulary files; only the driver reads it.
TOKENIZERS = os.environ.get("LEXMILL_TOKENIZERS", "/opt/tokenizers")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode.encode_column(_documents(spark, d), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items of which they hold at least 10 words in a row."""
    sam = leak.build(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id", "text")
    return leak.leaks(_documents(spark, d), "doc_id", "text", sam).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every document without its leaked spans; null where most of it is leaked."""
    sam = leak.build(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id", "text")
    return leak.cleaned(_documents(spark, d), "doc_id", "text", sam)


def _names_model(spark: SparkSession, d: str) -> personal.NameModel:
    return personal.fit_model(_documents(spark, d), "text", spark.read.parquet(f"{d}/known_names.parquet"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal data of every document: kind, and value as it stands in the text."""
    return personal.values(_documents(spark, d), "doc_id", "text", _names_model(spark, d))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with typed placeholders in the place of personal data."""
    return personal.redacted(_documents(spark, d), "doc_id", "text", _names_model(spark, d))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_terms": p2_terms,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_ppmi": p5_ppmi,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_clean": p8_clean,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}

_W = r"[\p{L}\p{Nd}_]+"
_SETS = f"""words as (select row_no, batch, id, list_distinct(regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), coalesce(body, ''))), '{_W}')) w from small_corpus),
    sets as (select row_no, len(w) n, unnest(w) t from words where len(w) >= 12),
    alike as (select a.row_no ra, b.row_no rb from sets a join sets b on a.t = b.t and a.row_no < b.row_no
        group by a.row_no, b.row_no, a.n, b.n having count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-9)"""
_FULL, _HALF = history._FULL, history._HALF.replace("'", "''")
_IDS = rf"""ids as (select row_no, batch, regexp_replace(regexp_replace(lower(translate(id, '{_FULL}', '{_HALF}')), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g'), '(^|\D)0+(\d)', '\1\2', 'g') k from small_corpus)"""
_BODY = f"bt as (select row_no, unnest(regexp_extract_all(lower(body), '{_W}')) t from small_corpus)"
_TAKEN = "tk as (select distinct segment_id, field, lower(trim(term)) t, count c from term_entry where trim(term) <> '' and count >= 1)"
_ROWS = f"w as (select row_no, unnest(regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), coalesce(body, ''))), '{_W}')) t from small_corpus), tf as (select row_no, t, count(*) f from w group by all)"
_BASKETS = r"""b as (select list_distinct(list_filter(list_transform(tags, lambda x: regexp_replace(lower(trim(x)), '[\s_-]+', '-', 'g')), lambda x: x is not null and x <> '')) t from small_corpus),
    bb as (select row_number() over () r, t from b where len(t) > 0), i as (select r, unnest(t) x from bb), s as (select x, count(*) c from i group by x), n as (select count(*) n from bb),
    p as (select a.x tag_a, b.x tag_b, count(*) n_ab from i a join i b on a.r = b.r and a.x < b.x group by all),
    q as (select tag_a, tag_b, n_ab, sa.c n_a, sb.c n_b, n.n n from p join s sa on sa.x = tag_a join s sb on sb.x = tag_b, n)"""

SQL = {
    "p1_found": f"""with {_SETS}, {_IDS}, c as (select row_no, batch from small_corpus),
        same as (select b.row_no from ids b join ids a on a.k = b.k and a.k <> '' where b.batch >= 1 and (a.batch < b.batch or (a.batch = b.batch and a.row_no < b.row_no))
            union select case when (x.batch, x.row_no) > (y.batch, y.row_no) then x.row_no else y.row_no end from alike join c x on x.row_no = ra join c y on y.row_no = rb)
        select distinct row_no from same join c using (row_no) where batch >= 1""",
    "p2_found": f"""with {_BODY}, {_TAKEN}, bc as (select t, count(distinct row_no) r from bt group by t), n as (select count(distinct row_no) n from bt),
        dc as (select t, sum(c) o, count(distinct segment_id) r from tk group by t), m as (select count(distinct segment_id) n from tk)
        select 'body' as src, t as term, 'rare' as mark from bc where r <= 2 union all select 'body', t, 'common' from bc, n where 5 * r > n
        union all select 'dictionary', t, 'rare' from dc where o <= 2 union all select 'dictionary', t, 'common' from dc, m where 10 * r > n""",
    "p2_terms": f"""with {_BODY}, {_TAKEN} select 'body' as src, t as term, count(*) as occurrences, count(distinct row_no) as records from bt group by t
        union all select 'dictionary', t, cast(sum(c) as bigint), count(distinct segment_id) from tk group by t""",
    "p4_found": f"with {_SETS} select ra as row_no_a, rb as row_no_b from alike",
    "p5_found": f"""with {_ROWS}, df as (select t, count(*) d from tf group by t), n as (select count(distinct row_no) n from tf),
        x as (select row_no, t, round(f * ln(n / d), 6) s from tf join df using (t), n)
        select row_no, t as term from x qualify row_number() over (partition by row_no order by s desc, t) = 1""",
    "p5_ppmi": f"""with {_ROWS}, nt as (select t, sum(f) nt from tf group by t), nr as (select row_no, pow(sum(f), 0.75) c from tf group by row_no), z as (select sum(c) z from nr),
        x as (select row_no, t, round(greatest(0, ln(f * z / (nt * c))), 6) s from tf join nt using (t) join nr using (row_no), z)
        select row_no, t as term, s as score from x qualify row_number() over (partition by row_no order by s desc, t) = 1""",
    "p6_found": f"with {_BASKETS} select tag_a, tag_b from q where n_ab >= 5 and n_ab >= 0.004 * n and n_ab * n >= 4 * n_a * n_b",
    "p6_pairs": f"with {_BASKETS} select tag_a, tag_b, n_ab, n_a, n_b, round(n_ab * n / (n_a::double * n_b), 6) as lift, round(ln(n_ab * n / (n_a::double * n_b)), 6) as pmi from q",
}
