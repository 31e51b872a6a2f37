import json

import pytest

from lexmill.plans import ast
from lexmill.plans.compile import compile_query
from lexmill.schema import Schema, keyword_field, stored_field, text_field
from lexmill.sources.documents import documents_frame
from lexmill.storage import commit as cm, manifest as mf, recovery as rc
from lexmill.storage.index import EmptyCommitError, Index
from lexmill.storage.manifest import Manifest, ManifestError, Segment
from lexmill.storage.snapshot import SegmentRefs, SnapshotError, SnapshotManager

SCHEMA = Schema((keyword_field("id"), text_field("title"), text_field("body", stored=False), keyword_field("tags", multi_valued=True), stored_field("metadata")))


def docs(spark, *rows):
    return documents_frame(spark, SCHEMA, [{"id": i, "title": t, "body": f"{t} body", "tags": ["a", i], "metadata": {"n": 1}} for i, t in rows])


def ids(index, q, generation=None):
    v = index.view(generation)
    return sorted(r["id"] for r in compile_query(q, v).join(v.docs, "doc_id").collect())


@pytest.fixture
def index(spark, tmp_path):
    return Index.create(spark, f"file://{tmp_path}/ix", SCHEMA)


def test_commits_add_replace_and_delete(spark, index):
    with pytest.raises(EmptyCommitError):
        index.commit()
    index.add(docs(spark, ("d1", "red fox"), ("d2", "red hen")))
    assert index.view().n_docs == 0  # not visible before the commit
    r = index.commit()
    assert (r.generation, r.docs) == (1, 2)
    index.add(docs(spark, ("d3", "red cow"), ("d1", "blue fox")))
    index.delete(["d2", "unknown"])
    index.commit()
    red = ast.Term("title", "red")
    assert ids(index, red) == ["d3"]
    assert ids(index, ast.Term("title", "fox")) == ["d1"]
    assert ids(index, red, 1) == ["d1", "d2"]  # time travel
    m = index.manifest
    assert (m.total_docs, m.total_docs_alive, [s.del_count for s in m.segments]) == (4, 2, [2, 0])
    terms = {(t["field"], t["term"]): t["df"] for t in index.view().terms.collect()}
    assert terms["title", "red"] == 1 and terms["title", "fox"] == 1 and ("title", "hen") not in terms
    assert terms["tags", "a"] == 2
    index.delete(["d3"])  # a commit of deletes only
    index.commit()
    assert ids(index, red) == []
    before = ids(index, ast.MatchAll())
    index.merge()
    assert ids(index, ast.MatchAll()) == before == ["d1"]
    assert len(index.manifest.segments) == 1 and index.manifest.total_docs == 1
    index.add(docs(spark, ("d1", "green fox")))
    index.commit()
    assert ids(index, ast.Term("title", "blue")) == [] and [s.del_count for s in index.manifest.segments] == [1, 0]


def test_reopened_index_is_the_same(spark, tmp_path, index):
    index.add(docs(spark, ("d1", "red fox")))
    index.commit()
    again = Index(spark, index.fs.root)
    assert ids(again, ast.Term("title", "red")) == ["d1"] and again.schema == index.schema
    assert again.recovery.fell_back_from == 0 and not again.recovery.orphans_removed
    assert json.loads(index.view().docs.first()["metadata"]) == {"n": 1}


@pytest.mark.parametrize("phase", cm.PHASES)
def test_crash_after_each_phase(spark, index, phase):
    index.add(docs(spark, ("d1", "red fox")))
    index.commit()
    index.add(docs(spark, ("d2", "red hen")))

    def crash(now):
        if now == phase:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        index.commit(after=crash)
    again = Index(spark, index.fs.root)
    done = cm.PHASES.index(phase) >= cm.PHASES.index("activate")
    assert again.manifest.generation == (2 if done else 1)
    assert ids(again, ast.Term("title", "red")) == (["d1", "d2"] if done else ["d1"])
    assert again.fs.names(mf.TMP) == []
    assert len(again.fs.folders(mf.SEGMENTS)) == again.manifest.generation
    again.add(docs(spark, ("d3", "red cow")))
    again.commit()
    assert "d3" in ids(again, ast.Term("title", "red"))


def test_error_while_writing_leaves_nothing(spark, index):
    index.add(docs(spark, ("d1", "x" * 40_000)))
    with pytest.raises(cm.CommitError):
        index.commit()
    assert index.fs.names(mf.TMP) == [] and mf.read_current(index.fs) == 0


def test_recovery_falls_back(spark, index):
    for i in range(1, 6):
        index.add(docs(spark, (f"d{i}", "red fox")))
        index.commit()
    fs = index.fs
    assert rc.recover(fs).generation == 5 and mf.generations(fs) == [3, 4, 5]
    fs.make(f"{mf.SEGMENTS}/seg_gen_99_deadbeef")
    fs.write(f"{mf.TMP}/a", b"1")
    fs.write(f"{mf.TMP}/b", b"2")
    r = rc.recover(fs)
    assert r.orphans_removed == ("seg_gen_99_deadbeef",) and r.tmp_removed == 2
    fs.write(mf.manifest_path(5), b"{}")
    r = rc.recover(fs)
    assert (r.generation, r.fell_back_from) == (4, 5) and mf.read_current(fs) == 4
    newest = r.manifest.segments[-1] if r.manifest.segments[-1].generation == 4 else next(s for s in r.manifest.segments if s.generation == 4)
    path = f"{mf.SEGMENTS}/{newest.id}/{next(p for p in newest.files if p.startswith('docs'))}"
    fs.write(path, fs.read(path) + b"x")
    r = rc.recover(fs, verify=False)
    assert r.generation == 4
    r = rc.recover(fs)
    assert r.generation == 3 and r.corrupt_segments == (newest.id,)
    for s in r.manifest.segments:
        fs.delete(f"{mf.SEGMENTS}/{s.id}")
    with pytest.raises(rc.RecoveryError):
        rc.recover(fs)


def test_manifests():
    a, b = Segment("a", 1, 10, 8, size_bytes=100), Segment("b", 2, 20, 20, size_bytes=200)
    m = Manifest(2, (b, a))
    assert (m.total_docs, m.total_docs_alive, m.total_size_bytes) == (30, 28, 300)
    assert m.to_json() == Manifest(2, (a, b)).to_json()
    assert Manifest.from_json(m.to_json()).segments == (a, b)
    with pytest.raises(ManifestError):
        Manifest.from_json(m.to_json().replace('"doc_count": 10', '"doc_count": 11'))
    assert [mf.generation_of(n) for n in ("manifest_gen_42.json", "manifest_gen_0.json", "other_file.json", "manifest_gen_.json", "manifest_gen_abc.json")] == [42, 0, None, None, None]
    assert [mf.parse_current(x) for x in (None, b"", b"42", b"10\n")] == [0, 0, 42, 10]
    with pytest.raises(ManifestError):
        mf.parse_current(b"not-a-number")


def test_snapshots():
    m = SnapshotManager(5, ["a", "b"])
    old = m.acquire()
    assert m.update_generation(6, ["a", "b", "c"]) == []
    new = m.acquire()
    assert (old.generation, len(old.segments), new.generation, len(new.segments)) == (5, 2, 6, 3)
    assert m.update_generation(7, ["c", "d"]) == []  # a and b are pinned
    old.release()
    old.release()
    assert m.reclaim() == []
    new.release()
    assert m.reclaim() == ["a", "b"] and m.reclaim() == []
    with pytest.raises(SnapshotError):
        m.update_generation(7, [])
    assert SnapshotManager().acquire().segments == ()
    late = SnapshotManager(1, ["a"], leak_after=1e-9)
    s = late.acquire()
    assert late.leaks() == [s]
    late.leak_after = 0
    assert late.leaks() == []
    r = SegmentRefs()
    r.hold(["x"])
    assert [r.reclaimable("y", False), r.reclaimable("y", True), r.reclaimable("x", True), r.reclaimable("x", False)] == [True, False, False, False]
    r.drop(["x"])
    with pytest.raises(SnapshotError):
        r.drop(["x"])


def test_refused_batches(spark, index):
    from lexmill.operators.indexing import DocumentError

    with pytest.raises(DocumentError):
        index.add(docs(spark, ("d1", "a"), ("d1", "b")))
    index.add(docs(spark, ("d1", "a")))
    with pytest.raises(DocumentError):
        index.add(docs(spark, ("d1", "again")))
    for bad in ({"title": "x"}, {"id": ""}, {"id": 3}, {"id": "x", "title": 5}, {"id": "x", "tags": [1]}):
        with pytest.raises(DocumentError):
            documents_frame(spark, SCHEMA, [bad])
    index.commit()
    assert index.view().n_docs == 1
