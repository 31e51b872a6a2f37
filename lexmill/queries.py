"""Queries over the test tables for the search engine's own operators, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.functions import analysis
from lexmill.operators import expand, indexing, scoring, topk as tk
from lexmill.plans import ast
from lexmill.plans.ast import bool_of
from lexmill.plans.compile import Scorer, compile_query, explain_hits
from lexmill.sources import tables

TEXT = "text"
T_THE, T_SEGMENT, T_MERGE, T_REBUILD, T_QUERY = (ast.Term(TEXT, t) for t in ("the", "segment", "merge", "rebuild", "query"))


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def _raw(q: ast.Query, spark: SparkSession, d: str, scorer: Scorer = Scorer(), table: str = "documents") -> DataFrame:
    return compile_query(q, tables.view(spark, d, table), scorer).select("doc_id", "score")


def _hits(q: ast.Query, scorer: Scorer = Scorer(), table: str = "documents") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _rounded(_raw(q, spark, d, scorer, table))


# --- sources, analysis, index -------------------------------------------------------------


def ingest_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as they enter an index: dense internal ids in the order of the external id."""
    docs = tables.documents(spark, d).select("id", "text", "lang", "source")
    return indexing.with_doc_ids(docs).select("doc_id", "id", "lang", "source", F.length("text").cast("bigint").alias("chars"))


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return indexing.duplicate_ids(spark.read.parquet(f"{d}/article.parquet"))


def build_postings(spark: SparkSession, d: str) -> DataFrame:
    p = indexing.build_postings(tables.documents(spark, d), tables.DOCUMENTS)
    return p.select("field", "term", "doc_id", F.col("tf").cast("bigint").alias("tf"), F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def stored_fields(spark: SparkSession, d: str) -> DataFrame:
    return indexing.stored_fields(tables.documents(spark, d), tables.DOCUMENTS)


def term_scan(spark: SparkSession, d: str) -> DataFrame:
    p = tables.view(spark, d).postings
    return p.where((F.col("field") == TEXT) & (F.col("term") == "segment")).select("doc_id", F.col("tf").cast("bigint").alias("tf"))


def field_stats(spark: SparkSession, d: str) -> DataFrame:
    s = tables.view(spark, d).stats
    return s.select("field", "term_count", "total_term_freq", "doc_count", "sum_doc_freq", *(F.col(c).cast("bigint").alias(c) for c in ("min_term_length", "max_term_length")))


def term_count(spark: SparkSession, d: str) -> DataFrame:
    return tables.view(spark, d).terms.agg(F.count(F.lit(1)).alias("term_count"))


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return tables.view(spark, d).terms.where(F.col("field") == TEXT).select("term", "df")


def term_freqs(spark: SparkSession, d: str) -> DataFrame:
    return indexing.field_postings(tables.documents(spark, d), "doc_id", TEXT, analysis.Registry().get("standard")(F.col("text")), False).select("doc_id", "term", F.col("tf").cast("bigint").alias("tf"))


def keyword_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the tags as they stand: documents with the tag, and how often it stands."""
    t = tables.view(spark, d, "small_corpus").terms.where(F.col("field") == "tags")
    return t.select("term", "df", "cf")


def _analyze(name: str, column: str = "text") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        a = analysis.analyze(tables.documents(spark, d), "doc_id", column, analysis.Registry().get(name))
        return a.select("doc_id", "term", F.col("position").cast("bigint").alias("position"))

    return run


def analyze_custom(spark: SparkSession, d: str) -> DataFrame:
    """A registered analyzer: standard terms of at least four characters."""
    r = analysis.Registry()
    r.register("long", lambda c: F.filter(r.get("standard")(c), lambda t: F.length(t) >= 4))
    a = analysis.analyze(tables.documents(spark, d), "doc_id", "text", r.get("long"))
    return a.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    t = analysis.token_offsets(tables.documents(spark, d), "doc_id", "text")
    return t.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("position", "start_byte", "end_byte")), "term")


# --- expansion, postings algebra ----------------------------------------------------------

PREFIX = ast.Prefix(TEXT, "re")
WILDCARD = ast.Wildcard(TEXT, "s*e?t")
REGEXP = ast.Regexp(TEXT, "(re|de)[a-z]+e")
FUZZY = ast.Fuzzy(TEXT, "shard", 2, 1)


def _docs(spark: SparkSession, d: str, q: ast.Query) -> DataFrame:
    return compile_query(q, tables.view(spark, d)).select("doc_id")


def q_prefix_limited(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 terms of a prefix in order."""
    return expand.expand(tables.view(spark, d).terms, ast.Prefix(TEXT, "s"), 25).select("term", "df")


def q_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Terms within two edits that share the first letter."""
    t = expand.expand(tables.view(spark, d).terms, FUZZY, None)
    return t.select("term", "df")


# --- scoring, top-k -----------------------------------------------------------------------


def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    v = tables.view(spark, d)
    return v.terms.where(F.col("field") == TEXT).select("term", F.round(scoring.idf(F.lit(float(v.n_docs)), F.col("df")), 6).alias("idf"))


OR3 = bool_of(should=[T_SEGMENT, T_MERGE, T_QUERY])
TWO = bool_of(should=[T_SEGMENT, T_REBUILD])


def topk(spark: SparkSession, d: str) -> DataFrame:
    """Two-term search: best 10 with stored fields, joined to the ten hits only."""
    v = tables.view(spark, d)
    best = _rounded(tk.topk(_raw(TWO, spark, d), 10))
    return v.docs.join(F.broadcast(best), "doc_id").select("doc_id", "score", "id", "lang", "source", "n_chars")


def hits_with_stored(spark: SparkSession, d: str) -> DataFrame:
    v = tables.view(spark, d)
    best = _rounded(tk.topk(_raw(ast.Prefix(TEXT, "seg"), spark, d), 25))
    return v.docs.join(F.broadcast(best), "doc_id").select("doc_id", "score", "id", "source")


def topk_offset(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(tk.topk(_raw(OR3, spark, d), 10, 10))


def bm25_explain(spark: SparkSession, d: str) -> DataFrame:
    """Best 10 of a term query with the explanation of their scores."""
    v = tables.view(spark, d)
    best = tk.topk(compile_query(TWO, v), 10)
    return explain_hits(TWO, best, v).select("doc_id", F.round("score", 6).alias("score"), "explanation")


def _shards(spark: SparkSession, d: str) -> DataFrame:
    """Hits tagged with the shard of their document."""
    return _raw(OR3, spark, d).withColumn("shard_id", F.pmod("doc_id", F.lit(4)).cast("bigint"))


def shard_topk_merge(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(tk.merge_topk(tk.shard_topk(_shards(spark, d), 15), 15).select("shard_id", "doc_id", "score"))


# --- segments and manifests as tables -----------------------------------------------------


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/segment_meta.parquet")


def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    """Entries and distinct terms of every segment of the manifest."""
    e = spark.read.parquet(f"{d}/term_entry.parquet").groupBy("segment_id").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("field", "term").alias("terms"))
    m = _meta(spark, d).select("segment_id", "generation", F.col("doc_count").cast("bigint").alias("doc_count"))
    zero = F.lit(0).cast("bigint")
    return m.join(e, "segment_id", "left").select("segment_id", "generation", "doc_count", F.coalesce("entries", zero).alias("entries"), F.coalesce("terms", zero).alias("terms"))


MULTI = bool_of(must=[ast.Term("title", "segment", 2.0)], should=[ast.Term("body", "merge"), ast.Term("tags", "search", 0.5)], must_not=[ast.Term("body", "crash")])
NESTED = bool_of(must=[bool_of(should=[T_SEGMENT, T_MERGE])], should=[ast.Term(TEXT, "shard", 2.0)], must_not=[ast.Term("source", "idx-mainline")])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ingest_docs": ingest_docs,
    "duplicate_ids": duplicate_ids,
    "build_postings": build_postings,
    "stored_fields": stored_fields,
    "term_scan": term_scan,
    "field_stats": field_stats,
    "term_count": term_count,
    "doc_freq": doc_freq,
    "term_freqs": term_freqs,
    "keyword_terms": keyword_terms,
    "analyze_standard": _analyze("standard"),
    "analyze_whitespace": _analyze("whitespace"),
    "analyze_keyword": _analyze("keyword", "source"),
    "analyze_custom": analyze_custom,
    "token_offsets": token_offsets,
    "q_term": _hits(T_SEGMENT),
    "q_bool": _hits(NESTED),
    "q_bool_fields": _hits(MULTI, table="small_corpus"),
    "q_and": lambda s, d: _docs(s, d, bool_of(must=[T_SEGMENT, T_MERGE, T_THE])),
    "q_or": lambda s, d: _docs(s, d, OR3),
    "q_and_not": lambda s, d: _docs(s, d, bool_of(must=[T_THE], must_not=[T_SEGMENT, T_MERGE])),
    "q_not": lambda s, d: _docs(s, d, bool_of(must_not=[T_THE])),
    "q_min_should_match": lambda s, d: _docs(s, d, bool_of(should=[T_SEGMENT, T_MERGE, T_REBUILD, T_QUERY], minimum_should_match=3)),
    "q_prefix": _hits(PREFIX),
    "q_prefix_limited": q_prefix_limited,
    "q_wildcard": lambda s, d: _docs(s, d, WILDCARD),
    "q_wildcard_all": _hits(ast.Wildcard(TEXT, "*e*")),
    "q_fuzzy_scored": _hits(FUZZY),
    "q_regexp": lambda s, d: _docs(s, d, REGEXP),
    "q_fuzzy": q_fuzzy,
    "q_phrase": _hits(ast.Phrase(TEXT, ("the", "segment"))),
    "q_phrase_slop": _hits(ast.Phrase(TEXT, ("merge", "the", "segment"), 3)),
    "q_proximity": _hits(ast.Proximity(TEXT, ("segment", "merge", "the"), 4)),
    "q_match_all": _hits(ast.MatchAll(1.5)),
    "q_match_none": _hits(ast.MatchNone()),
    "q_boost": _hits(bool_of(should=[ast.Term(TEXT, "segment", 3.0), ast.Term(TEXT, "merge", 0.25)])),
    "bm25_idf": bm25_idf,
    "bm25_term": _hits(T_REBUILD),
    "bm25_multi": _hits(OR3),
    "bm25_compat": _hits(T_SEGMENT, Scorer(compat=True)),
    "bm25_explain": bm25_explain,
    "topk": topk,
    "topk_offset": topk_offset,
    "hits_with_stored": hits_with_stored,
    "shard_topk_merge": shard_topk_merge,
    "segment_stats": segment_stats,
}

# --- SQL -----------------------------------------------------------------------------------

_P = r"[\p{L}\p{Nd}_]+"
_S = r"[^\s\x0B\x{85}\p{Z}]+"


def _tokens(table: str, key: str, column: str, pattern: str = _P, lower: bool = True, name: str = "tok") -> str:
    term = "lower(u.r)" if lower else "u.r"
    return f"{name} as (select doc_id, {term} term, u.i - 1 pos from (select {key} doc_id, unnest(list_transform(regexp_extract_all({column}, '{pattern}'), lambda r, i: {{'r': r, 'i': i}})) u from {table}))"


_TOK = _tokens("documents", "doc_id", "text")
_POST = f"""{_TOK}, post as (select term, doc_id, count(*) tf, list_sort(list(pos)) positions from tok group by term, doc_id),
    dl as (select doc_id, count(*) dl from tok group by doc_id), df as (select term, count(*) df from post group by term), n as (select count(*)::double n from documents), av as (select avg(dl) avgdl from dl)"""


def _bm25(weight: str = "1", dl: str = "dl", avgdl: str = "avgdl") -> str:
    return f"({weight}) * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * {dl} / {avgdl}))"


def _terms_sql(where: str, weight: str = "1", digits: str = ", 6") -> str:
    score = f"round(sum({_bm25(weight)}){digits})" if digits else f"sum({_bm25(weight)})"
    return f"""with {_POST} select doc_id, {score} as score
        from post join df using (term) join dl using (doc_id), n, av where {where} group by doc_id"""


_OR3 = _terms_sql("term in ('segment', 'merge', 'query')")
_RAW3 = _terms_sql("term in ('segment', 'merge', 'query')", digits="")
_TWO = _terms_sql("term in ('segment', 'rebuild')", digits="")
_SEG = _terms_sql("starts_with(term, 'seg')", digits="")
_HAS = f"with {_TOK}, h as (select doc_id, list(distinct term) t from tok where term in ('segment', 'merge', 'the', 'rebuild', 'query') group by doc_id)"
_IDFS = lambda *ts: "(" + " + ".join(f"(select ln(1 + (n - df + 0.5) / (df + 0.5)) from df, n where term = '{t}')" for t in ts) + ")"
_COUNTED = "round({idf} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) as score"
_FIELD_TERMS = f"""{_TOK}, ft as (select 'text' field, term, doc_id from tok union all select 'lang', lang, doc_id from documents where lang is not null
    union all select 'source', source, doc_id from documents where source is not null)"""


def _corpus_field(name: str, column: str) -> str:
    return f"""{_tokens("small_corpus", "row_no", column, name=f"{name}_tok")}, {name}_p as (select term, doc_id, count(*) tf from {name}_tok group by all),
        {name}_dl as (select doc_id, count(*) dl from {name}_tok group by doc_id), {name}_df as (select term, count(*) df from {name}_p group by term), {name}_av as (select avg(dl) avgdl from {name}_dl)"""


def _corpus_score(name: str, term: str, boost: str) -> str:
    return f"""(select doc_id, {boost} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) s
        from {name}_p join {name}_df using (term) join {name}_dl using (doc_id), {name}_av, n where term = '{term}')"""


SQL: dict[str, str] = {
    "ingest_docs": "select row_number() over (order by cast(doc_id as varchar)) - 1 as doc_id, cast(doc_id as varchar) as id, lang, source, cast(length(text) as bigint) as chars from documents",
    "duplicate_ids": "select id, count(*) as n from article group by id having count(*) > 1",
    "build_postings": f"""with {_FIELD_TERMS} select 'text' as field, term, doc_id, count(*) as tf, array_to_string(list_sort(list(pos)), ' ') as positions from tok group by term, doc_id
        union all select field, term, doc_id, 1, null from ft where field <> 'text'""",
    "stored_fields": "select doc_id, cast(doc_id as varchar) as id, lang, source, cast(n_chars as varchar) as n_chars from documents",
    "term_scan": f"with {_TOK} select doc_id, count(*) as tf from tok where term = 'segment' group by doc_id",
    "field_stats": f"""with {_FIELD_TERMS}, p as (select field, term, doc_id, count(*) tf from ft group by all), d as (select field, term, count(*) df from p group by all)
        select field, term_count, total_term_freq, doc_count, sum_doc_freq, min_term_length, max_term_length from
        (select field, count(*) term_count, cast(sum(df) as bigint) sum_doc_freq, min(strlen(term)) min_term_length, max(strlen(term)) max_term_length from d group by field)
        join (select field, cast(sum(tf) as bigint) total_term_freq, count(distinct doc_id) doc_count from p group by field) using (field)""",
    "term_count": f"with {_FIELD_TERMS} select count(*) as term_count from (select distinct field, term from ft)",
    "doc_freq": f"with {_TOK} select term, count(distinct doc_id) as df from tok group by term",
    "term_freqs": f"with {_TOK} select doc_id, term, count(*) as tf from tok group by all",
    "keyword_terms": "select term, count(distinct row_no) as df, count(*) as cf from (select row_no, unnest(tags) term from small_corpus) where term is not null group by term",
    "analyze_standard": f"with {_TOK} select doc_id, term, pos as position from tok",
    "analyze_whitespace": f"with {_tokens('documents', 'doc_id', 'text', _S, False)} select doc_id, term, pos as position from tok",
    "analyze_keyword": "select doc_id, source as term, 0::bigint as position from documents where source <> ''",
    "analyze_custom": f"with {_TOK} select term, count(*) as n from tok where length(term) >= 4 group by term",
    "q_term": _terms_sql("term = 'segment'"),
    "q_bool": f"""with {_POST}, s as (select doc_id, sum({_bm25("case term when 'shard' then 2 else 1 end")}) s, bool_or(term <> 'shard') m
        from post join df using (term) join dl using (doc_id), n, av where term in ('segment', 'merge', 'shard') group by doc_id)
        select doc_id, round(s, 6) as score from s join documents using (doc_id) where m and source is distinct from 'idx-mainline'""",
    "q_bool_fields": f"""with n as (select count(*)::double n from small_corpus), {_corpus_field("title", "title")}, {_corpus_field("body", "body")},
        tags_p as (select term, doc_id, count(*) tf from (select row_no doc_id, unnest(tags) term from small_corpus) where term is not null group by all),
        tags_dl as (select doc_id, sum(tf) dl from tags_p group by doc_id), tags_df as (select term, count(*) df from tags_p group by term), tags_av as (select avg(dl) avgdl from tags_dl)
        select a.doc_id, round(a.s + coalesce(b.s, 0) + coalesce(c.s, 0), 6) as score from {_corpus_score("title", "segment", "2")} a
        left join {_corpus_score("body", "merge", "1")} b on a.doc_id = b.doc_id left join {_corpus_score("tags", "search", "0.5")} c on a.doc_id = c.doc_id
        where a.doc_id not in (select doc_id from body_tok where term = 'crash')""",
    "q_and": f"{_HAS} select doc_id from h where list_has_all(t, ['segment', 'merge', 'the'])",
    "q_or": f"{_HAS} select doc_id from h where list_has_any(t, ['segment', 'merge', 'query'])",
    "q_and_not": f"{_HAS} select doc_id from h where list_contains(t, 'the') and not list_has_any(t, ['segment', 'merge'])",
    "q_not": f"with {_TOK} select doc_id from documents where doc_id not in (select doc_id from tok where term = 'the')",
    "q_min_should_match": f"{_HAS} select doc_id from h where len(list_intersect(t, ['segment', 'merge', 'rebuild', 'query'])) >= 3",
    "q_prefix": f"with {_POST}, x as (select term from df where starts_with(term, 're')) select doc_id, round(sum({_bm25()}), 6) as score from post join x using (term) join df using (term) join dl using (doc_id), n, av group by doc_id",
    "q_prefix_limited": f"with {_TOK} select term, count(distinct doc_id) as df from tok where starts_with(term, 's') group by term order by term limit 25",
    "q_wildcard": f"with {_TOK} select distinct doc_id from tok where regexp_full_match(term, '(?s)s.*e.t')",
    "q_wildcard_all": _terms_sql("contains(term, 'e')"),
    "q_fuzzy_scored": _terms_sql("starts_with(term, 's') and levenshtein(regexp_replace(term, '[^\\x00-\\x7f]', '#', 'g'), 'shard') <= 2"),
    "q_regexp": f"with {_TOK} select distinct doc_id from tok where regexp_full_match(term, '(re|de)[a-z]+e')",
    "q_fuzzy": f"with {_TOK} select term, count(distinct doc_id) as df from tok where starts_with(term, 's') and levenshtein(regexp_replace(term, '[^\\x00-\\x7f]', '#', 'g'), 'shard') <= 2 group by term",
    "q_phrase": f"""with {_POST}, m as (select a.doc_id, count(*) tf from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'the' and b.term = 'segment' group by a.doc_id)
        select doc_id, {_COUNTED.format(idf=_IDFS('the', 'segment'))} from m join dl using (doc_id), av""",
    "q_phrase_slop": f"""with {_POST}, a as (select doc_id, pos from tok where term = 'merge'), b as (select a.doc_id, a.pos s, min(t.pos) l from a join tok t on t.doc_id = a.doc_id and t.term = 'the' and t.pos > a.pos group by all),
        c as (select b.doc_id, b.s, min(t.pos) l from b join tok t on t.doc_id = b.doc_id and t.term = 'segment' and t.pos > b.l group by b.doc_id, b.s),
        m as (select doc_id, count(*) tf from c where l - s - 2 <= 3 group by doc_id) select doc_id, {_COUNTED.format(idf=_IDFS('merge', 'the', 'segment'))} from m join dl using (doc_id), av""",
    "q_proximity": f"""with {_POST}, w as (select doc_id, count(distinct term) over (partition by doc_id order by pos range between current row and 6 following) k from tok where term in ('segment', 'merge', 'the')),
        m as (select doc_id, count(*) tf from w where k = 3 group by doc_id) select doc_id, {_COUNTED.format(idf=_IDFS('segment', 'merge', 'the'))} from m join dl using (doc_id), av""",
    "q_match_all": "select doc_id, 1.5::double as score from documents",
    "q_match_none": "select doc_id, 0::double as score from documents where false",
    "q_boost": _terms_sql("term in ('segment', 'merge')", "case term when 'segment' then 3 else 0.25 end"),
    "bm25_idf": f"with {_POST} select term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from df, n",
    "bm25_term": _terms_sql("term = 'rebuild'"),
    "bm25_multi": _OR3,
    "bm25_compat": f"""with {_FIELD_TERMS}, p as (select term, doc_id, count(*) tf from tok where term = 'segment' group by all), d as (select count(*) df from p), n as (select count(*)::double n from documents),
        a as (select count(*) / (select n from n) avgdl from (select distinct field, term from ft)) select doc_id, round({_bm25(dl="100", avgdl="avgdl")}, 6) as score from p, d, n, a""",
    "topk": f"select b.doc_id, round(score, 6) as score, cast(b.doc_id as varchar) as id, lang, source, cast(n_chars as varchar) as n_chars from ({_TWO} order by score desc, doc_id limit 10) b join documents using (doc_id)",
    "topk_offset": f"select doc_id, round(score, 6) as score from ({_RAW3}) h order by h.score desc, doc_id limit 10 offset 10",
    "hits_with_stored": f"select b.doc_id, round(score, 6) as score, cast(b.doc_id as varchar) as id, source from ({_SEG} order by score desc, doc_id limit 25) b join documents using (doc_id)",
    "shard_topk_merge": f"select doc_id % 4 as shard_id, doc_id, round(score, 6) as score from ({_RAW3}) h order by h.score desc, doc_id limit 15",
    "segment_stats": """select segment_id, generation, cast(doc_count as bigint) as doc_count, coalesce(entries, 0) as entries, coalesce(terms, 0) as terms from segment_meta left join
        (select segment_id, count(*) entries, count(distinct case when field is not null and term is not null then {'f': field, 't': term} end) terms from term_entry group by segment_id) using (segment_id)""",
}
