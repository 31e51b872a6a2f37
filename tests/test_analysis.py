import pytest
from pyspark.sql import functions as F

from lexmill.functions.analysis import Registry, analyze, token_offsets
from lexmill.operators import indexing
from lexmill.schema import FieldDef, Schema, keyword_field, stored_field, text_field

CASES = [
    ("standard", "hello, world! foo-bar", ["hello", "world", "foo", "bar"]),
    ("standard", "café résumé", ["café", "résumé"]),
    ("standard", "test123 456abc", ["test123", "456abc"]),
    ("standard", "", []),
    ("standard", "İstanbul ΑΣ snake_case é", ["istanbul", "ασ", "snake_case", "e"]),
    ("standard", "don't", ["don", "t"]),
    ("whitespace", "hello, world!", ["hello,", "world!"]),
    ("whitespace", " A b c\u0085d\x0be ", ["A", "b", "c", "d", "e"]),
    ("keyword", "hello world", ["hello world"]),
    ("keyword", "", []),
]


@pytest.mark.parametrize(("name", "text", "want"), CASES)
def test_analyzers(spark, name, text, want):
    df = spark.createDataFrame([(1, text), (2, None)], "id long, t string")
    got = analyze(df, "id", "t", Registry().get(name)).orderBy("position").collect()
    assert [r["term"] for r in got] == want and [r["position"] for r in got] == list(range(len(want)))


def test_registry(spark):
    r = Registry()
    assert r.names() == ["keyword", "standard", "whitespace"]
    with pytest.raises(KeyError):
        r.get("none")
    with pytest.raises(ValueError):
        r.register("standard", lambda c: c)
    r.register_python("letters", lambda t: list(t))
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, t string")
    assert [x["term"] for x in analyze(df, "id", "t", r.get("letters")).orderBy("position").collect()] == ["a", "b", "c"]


@pytest.mark.parametrize("name", ["standard", "whitespace", "keyword"])
def test_offsets_cut_the_source(spark, name):
    texts = ["hello world", "  Çé, ☃ (x)\tİs\n", "", None, "日本 語😀 a_b", "x" * 3000 + " y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rows = token_offsets(df, "id", "t", name).collect()
    lower = {"İs": "is"}
    for r in rows:
        raw = texts[r["id"]].encode()[r["start_byte"] : r["end_byte"]].decode()
        assert r["term"] == (lower.get(raw, raw.lower()) if name == "standard" else raw)
    want = {(r["id"], r["position"]) for r in analyze(df, "id", "t", Registry().get(name)).collect()}
    assert {(r["id"], r["position"]) for r in rows} == want


SCHEMA = Schema((text_field("title"), FieldDef("plain", "text", "standard", indexed=True), FieldDef("hidden", "text", "standard", stored=True), keyword_field("tags", True), stored_field("n")))


def _docs(spark):
    rows = [
        (0, "a", "Red red fox", "x y x", "secret", ["t", "t", None, "u"], 5, "clash"),
        (1, "b", None, "", None, None, None, None),
        (2, "c", "fox", "y", "secret", [], 7, "clash"),
    ]
    return spark.createDataFrame(rows, "doc_id long, id string, title string, plain string, hidden string, tags array<string>, n int, term string")


def test_postings(spark):
    got = {(r["field"], r["term"], r["doc_id"]): (r["tf"], r["dl"], r["positions"]) for r in indexing.build_postings(_docs(spark), SCHEMA).collect()}
    assert got == {
        ("title", "red", 0): (2, 3, [0, 1]), ("title", "fox", 0): (1, 3, [2]), ("title", "fox", 2): (1, 1, [0]),
        ("plain", "x", 0): (2, 3, None), ("plain", "y", 0): (1, 3, None), ("plain", "y", 2): (1, 1, None),
        ("tags", "t", 0): (2, 3, None), ("tags", "u", 0): (1, 3, None),
    }
    p = indexing.build_postings(_docs(spark), SCHEMA)
    assert {(r["field"], r["term"]): (r["df"], r["cf"]) for r in indexing.dictionary(p).collect()}["tags", "t"] == (1, 2)
    stats = {r["field"]: r.asDict() for r in indexing.field_stats(indexing.dictionary(p), indexing.doc_lengths(_docs(spark), SCHEMA)).collect()}
    assert stats["title"] == {"field": "title", "term_count": 2, "total_term_freq": 4, "doc_count": 2, "sum_doc_freq": 3, "min_term_length": 3, "max_term_length": 3}
    assert stats["tags"]["total_term_freq"] == 3
    assert indexing.build_postings(_docs(spark).limit(0), SCHEMA).count() == 0
    assert indexing.build_postings(_docs(spark), Schema((stored_field("n"),))).count() == 0


def test_stored_ids_and_batches(spark):
    s = indexing.stored_fields(_docs(spark), SCHEMA).orderBy("doc_id").collect()
    assert s[0]["n"] == "5" and s[1]["n"] is None and "plain" not in s[0].asDict() and s[0]["tags"] == ["t", "t", None, "u"]
    ids = indexing.with_doc_ids(spark.range(100).select(F.col("id").cast("string").alias("id")), start=7).collect()
    assert sorted(r["doc_id"] for r in ids) == list(range(7, 107))
    assert [r["id"] for r in sorted(ids, key=lambda r: r["doc_id"])] == sorted(str(i) for i in range(100))
    twice = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string")
    assert [(r["id"], r["n"]) for r in indexing.duplicate_ids(twice).collect()] == [("a", 2)]
    for bad in (twice, twice.where("id is null"), twice.where("id = 'a'")):
        with pytest.raises(indexing.DocumentError):
            indexing.check_batch(bad)
    with pytest.raises(Exception, match="32768"):
        indexing.refuse_long_terms(indexing.build_postings(_docs(spark).withColumn("title", F.repeat(F.lit("x"), 40_000)), SCHEMA)).collect()
