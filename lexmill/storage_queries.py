"""Queries that run through storage and coordinator: commits, deletes, recovery, time travel, shards.

One index of ``documents`` is made per session and folder: three commits of a third of the rows
each (by doc_id), then one that deletes the documents of one source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.coordinator import Coordinator, IndexShard
from lexmill.queries import _tokens
from lexmill.scratch import new_path
from lexmill.sources import tables
from lexmill.storage import manifest as mf
from lexmill.storage.commit import CommitError
from lexmill.storage.index import Index

GONE = "idx-mainline"
SHARDS = 2
WORDS = ("segment", "merge", "query")

_made: dict[tuple, Index] = {}
_shards: dict[tuple, Coordinator] = {}


def _index(spark: SparkSession, d: str) -> Index:
    key = (spark.sparkContext.applicationId, d)
    if key not in _made:
        ix = Index.create(spark, new_path(spark, "index"), tables.DOCUMENTS)
        docs = tables.documents(spark, d)
        for part in range(3):
            ix.add(docs.where(F.pmod("doc_id", F.lit(3)) == part))
            ix.commit()
        ix.delete(docs.where(F.col("source") == GONE).select("id"))
        ix.commit()
        _made[key] = ix
    return _made[key]


def _coordinator(spark: SparkSession, d: str) -> Coordinator:
    key = (spark.sparkContext.applicationId, d)
    if key not in _shards:
        docs, shards = tables.documents(spark, d), []
        for n in range(SHARDS):
            ix = Index.create(spark, new_path(spark, "shard"), tables.DOCUMENTS)
            ix.add(docs.where(F.pmod("doc_id", F.lit(SHARDS)) == n))
            ix.commit()
            shards.append(IndexShard(f"s{n}", ix))
        _shards[key] = Coordinator(shards, timeout=300.0)
    return _shards[key]


def delete_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents left after the deleting commit."""
    return _index(spark, d).view().docs.select("id", "source")


def manifest_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the current manifest says, read from its file."""
    ix = _index(spark, d)
    m = mf.load(ix.fs, mf.read_current(ix.fs))
    row = (m.generation, len(m.segments), m.total_docs, m.total_docs_alive, sum(s.del_count for s in m.segments))
    return spark.createDataFrame([row], "generation long, segments long, docs long, docs_alive long, deleted long")


def snapshot_as_of(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of generation 2 sees of the text field."""
    v = _index(spark, d).view(2)
    s = v.stats.where(F.col("field") == "text")
    return s.select(F.lit(v.n_docs).cast("bigint").alias("docs"), F.col("term_count").alias("terms"), F.col("total_term_freq").alias("occurrences"))


def orphan_segments(spark: SparkSession, d: str) -> DataFrame:
    """A commit that dies behind the installation of its segment, and the recovery of the next opening."""
    path = _index(spark, d).fs.root

    def die(phase: str) -> None:
        if phase == "install":
            raise RuntimeError("crash")

    writer = Index(spark, path)
    writer.add(spark.createDataFrame([("new", "lost text")], "id string, text string"))
    try:
        writer.commit(after=die)
    except CommitError:
        pass
    ix = Index(spark, path)
    row = (len(ix.recovery.orphans_removed), ix.recovery.fell_back_from, ix.manifest.generation, ix.manifest.total_docs_alive)
    return spark.createDataFrame([row], "orphans long, fell_back_from long, generation long, docs_alive long")


def segments_union(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary over all segments' live documents: frequencies of a term added up."""
    return _index(spark, d).view().terms.where(F.col("field") == "text").select("term", "df", "cf")


def shard_totals(spark: SparkSession, d: str) -> DataFrame:
    """Merged best ten of the shards, each scored by its own statistics, and the number of all matches."""
    should = [{"term": {"field": "text", "value": w}} for w in WORDS]
    got = _coordinator(spark, d).search({"query": {"bool": {"should": should}}}, 10)
    rows = [(got.status, got.total_hits, h.shard_id, h.id, round(h.score, 6)) for h in got.hits]
    return spark.createDataFrame(rows, "status string, total_hits long, shard_id string, id string, score double")


def index_info(spark: SparkSession, d: str) -> DataFrame:
    i = _index(spark, d).info()
    row = (i["generation"], i["segments"], i["docs"], i["docs_alive"], ",".join(i["fields"]), i["pending"]["docs"])
    return spark.createDataFrame([row], "generation long, segments long, docs long, docs_alive long, fields string, pending long")


QUERIES = {
    "delete_anti_join": delete_anti_join,
    "manifest_totals": manifest_totals,
    "snapshot_as_of": snapshot_as_of,
    "orphan_segments": orphan_segments,
    "segments_union": segments_union,
    "shard_totals": shard_totals,
    "index_info": index_info,
}

_TOK = _tokens("documents", "doc_id", "text")
_ALIVE = f"source is distinct from '{GONE}'"

SQL = {
    "delete_anti_join": f"select cast(doc_id as varchar) as id, source from documents where {_ALIVE}",
    "manifest_totals": f"select 4 as generation, 4 as segments, count(*) as docs, count(*) filter ({_ALIVE}) as docs_alive, count(*) filter (not ({_ALIVE})) as deleted from documents",
    "snapshot_as_of": f"with {_TOK}, t as (select * from tok where doc_id % 3 < 2) select (select count(*) from documents where doc_id % 3 < 2) as docs, count(distinct term) as terms, count(*) as occurrences from t",
    "orphan_segments": f"select 1 as orphans, 0 as fell_back_from, 4 as generation, count(*) filter ({_ALIVE}) as docs_alive from documents",
    "segments_union": f"with {_TOK} select term, count(distinct doc_id) as df, count(*) as cf from tok where doc_id in (select doc_id from documents where {_ALIVE}) group by term",
    "shard_totals": f"""with {_TOK}, p as (select doc_id, doc_id % {SHARDS} s, term, count(*) tf from tok group by all), dl as (select doc_id, doc_id % {SHARDS} s, count(*) dl from tok group by all),
        av as (select s, avg(dl) avgdl from dl group by s), df as (select s, term, count(*) df from p group by all),
        ids as (select doc_id, doc_id % {SHARDS} s, row_number() over (partition by doc_id % {SHARDS} order by cast(doc_id as varchar)) r, count(*) over (partition by doc_id % {SHARDS})::double n from documents),
        h as (select doc_id, s, r, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) score
            from p join df using (s, term) join dl using (s, doc_id) join av using (s) join ids using (s, doc_id) where term in {WORDS} group by all)
        select 'ok' as status, (select count(*) from h) as total_hits, 's' || s as shard_id, cast(doc_id as varchar) as id, round(score, 6) as score from h order by score desc, r, s limit 10""",
    "index_info": f"select 4 as generation, 4 as segments, count(*) as docs, count(*) filter ({_ALIVE}) as docs_alive, 'text,lang,source,n_chars' as fields, 0 as pending from documents",
}
