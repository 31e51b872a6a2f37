import json
import threading
import time
import urllib.request

import pytest
from pyspark.sql import functions as F

from lexmill import coordinator as co
from lexmill.manager import LOCK, IndexManager
from lexmill.plans.limits import Budget, LimitError, OutOfTimeError
from lexmill.server import answer, serve
from lexmill.sources.documents import hits_json, read_json_documents
from lexmill.storage.index import Index, IndexBusyError
from lexmill.schema import Schema, keyword_field, stored_field, text_field
from lexmill.streaming.ingest import commit_batch, stream_into

FIELDS = [
    {"name": "title", "type": "text", "analyzer": "standard", "stored": True, "indexed": True, "positions": True},
    {"name": "body", "type": "text", "analyzer": "standard", "indexed": True, "positions": True},
    {"name": "tags", "type": "keyword", "stored": True, "indexed": True, "multi_valued": True},
]
DOCS = [
    {"id": "doc-1", "title": "Introduction to Search", "body": "Full-text search finds documents", "tags": ["search", "tutorial"]},
    {"id": "doc-2", "title": "Building Indexes", "body": "An index maps terms to documents", "tags": ["engineering"]},
    {"id": "doc-3", "title": "Search and Search Again", "body": "Ranking by BM25", "tags": ["search"]},
]


def test_the_whole_service(spark, tmp_path):
    root = f"file://{tmp_path}/data"
    m = IndexManager(spark, root)
    go = lambda method, path, body=None: answer(m, method, path, b"" if body is None else json.dumps(body).encode())
    assert go("GET", "/health") == (200, {"status": "ok"})
    assert go("POST", "/indexes", {"name": "articles", "fields": FIELDS})[0] == 201
    assert go("POST", "/indexes", {"name": "articles", "fields": FIELDS})[0] == 409
    assert go("POST", "/indexes", {"name": "", "fields": FIELDS})[0] == 400 and go("POST", "/indexes", {"name": "../x", "fields": []})[0] == 400
    assert go("PUT", "/indexes/other", {"schema": {"fields": [{"name": "_id", "type": "keyword"}]}})[0] == 400
    assert go("GET", "/indexes/none")[0] == 404 and go("GET", "/what")[0] == 404 and go("PUT", "/indexes")[0] == 405
    assert go("POST", "/indexes/articles/commit")[0] == 400
    assert go("POST", "/indexes/articles/documents", {"documents": []})[0] == 400
    assert answer(m, "POST", "/indexes/articles/documents", b"{")[0] == 400
    assert go("POST", "/indexes/articles/documents", {"documents": [{"title": "no id"}]})[0] == 400
    assert go("POST", "/indexes/articles/documents", {"documents": DOCS[:2]}) == (200, {"status": "accepted", "documents_received": 2})
    assert go("POST", "/indexes/articles/documents", {"documents": DOCS[2:]})[0] == 200
    # another process can't write meanwhile
    second = IndexManager(spark, root)
    with pytest.raises(IndexBusyError):
        second.ingest("articles", DOCS)
    assert answer(second, "POST", "/indexes/articles/commit", b"")[0] == 503
    status, got = go("POST", "/indexes/articles/commit")
    assert status == 200 and got["generation"] == 1 and got["docs"] == 3
    assert not m.fs.exists(f"articles/{LOCK}")
    status, got = go("POST", "/indexes/articles/search?explain=true", {"query": {"term": {"field": "title", "value": "search"}}, "size": 1})
    assert status == 200 and got["total_hits"] == 2 and [h["id"] for h in got["hits"]] == ["doc-3"]
    hit = got["hits"][0]
    assert hit["stored_fields"] == {"title": "Search and Search Again", "tags": ["search"]}
    top = hit["explanation"][0]["score"]
    assert top["description"] == "weight(title:search) [BM25]" and abs(top["value"] - hit["score"]) < 1e-9
    assert [d["description"].split("(")[0].split("=")[0] for d in top["details"]] == ["boost", "idf", "tf", "dl"]
    flat = go("POST", "/indexes/articles/search", {"query": {"type": "term", "field": "tags", "value": "search"}, "top_k": 10})[1]
    assert {h["id"] for h in flat["hits"]} == {"doc-1", "doc-3"}
    phrase = {"query": {"phrase": {"field": "body", "value": "Full-text SEARCH"}}}
    assert [h["id"] for h in go("POST", "/indexes/articles/search", phrase)[1]["hits"]] == ["doc-1"]
    assert go("POST", "/indexes/articles/search", {"query": {"nearest": {}}})[0] == 400
    assert go("DELETE", "/indexes/articles/documents", {"id": "doc-3"})[0] == 200 and go("DELETE", "/indexes/articles/documents", {})[0] == 400
    assert go("POST", "/indexes/articles/commit")[1]["generation"] == 2
    search = {"query": {"term": {"field": "title", "value": "search"}}}
    assert [h["id"] for h in go("POST", "/indexes/articles/search", search)[1]["hits"]] == ["doc-1"]
    assert len(go("POST", "/indexes/articles/search?generation=1", search)[1]["hits"]) == 2
    snapshot, _ = m.get("articles").snapshot()
    assert go("DELETE", "/indexes/articles")[0] == 400
    snapshot.release()
    server = serve(m, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/indexes") as r:
        assert json.load(r)["indexes"][0]["docs_alive"] == 2
    server.shutdown()
    m.fs.make("broken")
    again = IndexManager(spark, root)
    assert list(again.broken) == ["broken"] and again.index_info("articles")["generation"] == 2
    assert go("DELETE", "/indexes/articles")[0] == 200 and go("GET", "/indexes/articles")[0] == 404


class Shard:
    def __init__(self, name, scores, total=None, fail=None, status="ok", wait=0):
        self.shard_id, self.scores, self.total, self.fail, self.status, self.wait, self.calls = name, scores, total, fail, status, wait, 0

    def search(self, plan):
        self.calls += 1
        time.sleep(self.wait)
        if self.fail and self.calls <= self.fail:
            raise RuntimeError("down")
        hits = tuple(co.ShardHit(self.shard_id, i, s) for i, s in enumerate(self.scores))
        return co.ShardResponse(self.shard_id, hits, self.total or len(hits), self.status)

    def health(self):
        if self.fail:
            raise RuntimeError("down")
        return {}


def test_coordinator():
    one, two = Shard("a", [5.0, 3.0, 1.0], 100), Shard("b", [4.5, 2.5, 0.5], 200)
    r = co.Coordinator([one, two]).search({}, 3)
    assert ([h.score for h in r.hits], r.total_hits, r.status) == ([5.0, 4.5, 3.0], 300, "ok")
    r = co.Coordinator([one, Shard("c", [9.0], fail=9)]).search({}, 2)
    assert ([h.score for h in r.hits], r.status, list(r.errors)) == ([5.0, 3.0], "partial", ["c"])
    r = co.Coordinator([one, Shard("c", [9.0], fail=1)], retries=1).search({}, 1)
    assert r.status == "ok" and r.hits[0].score == 9.0
    r = co.Coordinator([one, Shard("slow", [9.0], wait=1.5)], timeout=0.3).search({}, 1)
    assert r.status == "partial" and "slow" in r.errors
    for shards in ([Shard("c", [], fail=9)], [Shard("d", [1.0], status="error")]):
        with pytest.raises(co.AllShardsFailedError):
            co.Coordinator(shards).search({})
    with pytest.raises(co.NoShardsError):
        co.Coordinator([]).search({})
    assert len(co.Coordinator([Shard("a", [1.0] * 30)]).search({}).hits) == 10
    c = co.Coordinator([one, Shard("c", [], fail=9)])
    assert [h.healthy for h in c.check_health().values()] == [True, False] and c.healthy_shards == 1
    tie = co.Coordinator([Shard("b", [1.0, 1.0]), Shard("a", [1.0])]).search({}, 2).hits
    assert [(h.doc_id, h.shard_id) for h in tie] == [(0, "a"), (0, "b")]


SCHEMA = Schema((text_field("title"), stored_field("seq")))


def test_shards_that_are_indexes(spark, tmp_path):
    shards = []
    for n in range(2):
        ix = Index.create(spark, f"file://{tmp_path}/s{n}", SCHEMA)
        ix.add(spark.createDataFrame([(f"{n}-{i}", "fox " * (i + 1 + n) + "hen") for i in range(3)], "id string, title string"))
        ix.commit()
        shards.append(co.IndexShard(f"s{n}", ix))
    r = co.Coordinator(shards).search({"query": {"term": {"field": "title", "value": "fox"}}}, 2)
    assert r.status == "ok" and r.total_hits == 6 and len(r.hits) == 2 and all(s.index.snapshots.active == 0 for s in shards)


def test_streaming(spark, tmp_path):
    ix = Index.create(spark, f"file://{tmp_path}/ix", SCHEMA)
    src = f"{tmp_path}/in"
    kind = "id string, title string, seq int, gone boolean"
    spark.createDataFrame([("a", "old fox", 1, None), ("a", "new fox", 2, False), ("b", "hen", 1, None), (None, "x", 1, None)], kind).write.parquet(src)
    run = lambda: stream_into(ix, spark.readStream.schema(kind).parquet(src), f"{tmp_path}/ck", "gone").awaitTermination(120)
    assert run()
    assert ix.manifest.source_batch == 0 and sorted(r["title"] for r in ix.view().docs.collect()) == ["hen", "new fox"]
    spark.createDataFrame([("b", None, 2, True), ("c", "cow", 1, None)], kind).write.mode("append").parquet(src)
    assert run()
    assert sorted(r["title"] for r in ix.view().docs.collect()) == ["cow", "new fox"]
    batch = spark.createDataFrame([("z", "zebra", 1, None)], kind)
    assert not commit_batch(ix, batch, 1, "gone") and not commit_batch(ix, batch.limit(0), 9, "gone")
    assert ix.view().n_docs == 2


def test_budgets(spark):
    b = Budget(terms=5)
    b.take(5)
    with pytest.raises(LimitError):
        b.take(1)
    with pytest.raises(OutOfTimeError):
        Budget(-1).run(spark, lambda: 7)
    slow = spark.range(4).select(F.udf(lambda x: time.sleep(20))("id"))
    began = time.time()
    with pytest.raises(OutOfTimeError):
        Budget(2).run(spark, slow.collect)
    assert time.time() - began < 15
    assert Budget(60).run(spark, lambda: 7) == 7


def test_expansions_of_a_request(spark, tmp_path, monkeypatch):
    from lexmill import search as se

    ix = Index.create(spark, f"file://{tmp_path}/ix", SCHEMA)
    ix.add(spark.createDataFrame([(f"d{i}", f"term{i:02}") for i in range(12)], "id string, title string"))
    ix.commit()
    ask = lambda **more: se.search(ix.view(), {"query": {"prefix": {"field": "title", "value": "term"}}, "size": 3, **more})
    assert [(r["total_hits"], r["limit_exceeded"], len(r["hits"])) for r in (ask(), ask(max_expansions=5), ask(max_expansions=None), ask(max_expansions=12))] == [(12, False, 3), (5, True, 3), (12, False, 3), (12, False, 3)]
    assert [h["stored_fields"]["title"] for h in ask(max_expansions=None)["hits"]] == [h["stored_fields"]["title"] for h in ask()["hits"]]
    got = se.search(ix.view(), {"query": {"prefix": {"field": "title", "value": "term"}}}, max_terms=4)
    assert got["status"] == "refused" and not got["hits"]

    def late(*_):
        raise OutOfTimeError("late")

    monkeypatch.setattr(se, "_details", late)
    got = ask()
    assert got["status"] == "partial" and got["timed_out"] and got["total_hits"] == 12 and len(got["hits"]) == 3


def test_registered_analyzers_and_full_buffers(spark, tmp_path):
    from lexmill.functions.analysis import Registry
    from lexmill.storage.index import BufferFullError, PendingLimits

    r = Registry()
    r.register("commas", lambda c: F.split(c, ","))
    schema = Schema((text_field("title", "commas"),))
    with pytest.raises(ValueError):
        Index.create(spark, f"file://{tmp_path}/no", schema)
    ix = Index.create(spark, f"file://{tmp_path}/ix", schema, registry=r, pending=PendingLimits(docs=2))
    docs = spark.createDataFrame([("a", "x,y z"), ("b", "q")], "id string, title string")
    ix.add(docs)
    with pytest.raises(BufferFullError):
        ix.add(docs.withColumn("id", F.concat("id", F.lit("2"))))
    ix.limits = PendingLimits(bytes=3, commit=True)
    ix.add(docs.withColumn("id", F.concat("id", F.lit("2"))))
    assert ix.manifest.generation == 1 and ix.pending["docs"] == 2
    assert sorted(t["term"] for t in ix.view().terms.collect()) == ["q", "x", "y z"]


def test_opening_beside_a_writer_removes_nothing(spark, tmp_path):
    ix = Index.create(spark, f"file://{tmp_path}/ix", SCHEMA)
    ix.add(spark.createDataFrame([("a", "x")], "id string, title string"))
    ix.commit()
    (tmp_path / "ix" / "tmp" / "in_flight").mkdir(parents=True)
    (tmp_path / "ix" / "write.lock").write_text("other")
    Index(spark, f"file://{tmp_path}/ix")
    assert (tmp_path / "ix" / "tmp" / "in_flight").exists()
    (tmp_path / "ix" / "write.lock").unlink()
    Index(spark, f"file://{tmp_path}/ix")
    assert not (tmp_path / "ix" / "tmp" / "in_flight").exists()


def test_json_files(spark, tmp_path):
    s = Schema((text_field("title"), keyword_field("tags", True)))
    p = tmp_path / "d.json"
    p.write_text('{"id": "1", "title": "x", "tags": ["a"], "other": 3}\n{"id": "2"}\n')
    rows = read_json_documents(spark, str(p), s).orderBy("id").collect()
    assert [r.asDict() for r in rows] == [{"id": "1", "title": "x", "tags": ["a"]}, {"id": "2", "title": None, "tags": None}]
    p.write_text('{"id": "1", "tags": {"a": 1}}\n')
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader raises
        read_json_documents(spark, str(p), s).collect()
    assert json.loads(hits_json(spark.createDataFrame([(1, 2.5)], "doc_id long, score double")).first()[0]) == {"doc_id": 1, "score": 2.5}
