import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import standard_tokens
from lexmill.llm import distinct, terms, together

TEXTS = ["the red fox the", "The hen", None, "", " \n", "fox fox", "x " * 5000 + "y", "fox fox", "İs ﬁ é"]


def test_record_terms(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "row long, b string, term string").select("row", "term", standard_tokens(F.col("b")).alias("t"))
    rows = [r.t for r in df.orderBy("row").collect() if r.t]
    occ, rec = Counter(w for r in rows for w in r), Counter(w for r in rows for w in set(r))
    got = terms.count_record_terms(df, "t").collect()
    assert {r.term: (r.occ, r.rec) for r in got} == {w: (occ[w], rec[w]) for w in occ}
    assert sorted(r.term_id for r in got) == list(range(len(occ)))
    assert terms.count_record_terms(df.limit(0), "t").count() == 0
    holes = spark.createDataFrame([(["a", None, "a"],), (None,), ([],)], "t array<string>")
    assert [(r.term, r.occ, r.rec) for r in terms.count_record_terms(holes, "t").collect()] == [("a", 2, 1)]


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(terms, "FLUSH", 1)
    monkeypatch.setattr(terms, "RANGE", 1)
    df = spark.createDataFrame([(["a", "b"],), (["a"],), (["c", "c"],)], "t array<string>")
    assert {(r.term, r.occ, r.rec) for r in terms.count_record_terms(df, "t").collect()} == {("a", 2, 2), ("b", 1, 1), ("c", 2, 1)}


def test_term_rows(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), (None, 5), ("b", None), ("c", 2)], "term string, occ int")
    assert {(r.term, r.occ, r.rec) for r in terms.count_term_rows(df, "term", "occ").collect()} == {("a", 4, 2), ("c", 2, 1)}


def test_scores(spark):
    rows = [(1, "red fox", "fox the"), (2, None, "the hen"), (3, "", ""), (4, None, None), (5, "the", "the the"), (6, "b a", ""), (7, "z " * 3000, "q")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "row_no long, title string, body string, term string, tf int")
    docs = {r[0]: Counter(f"{r[1] or ''} {r[2] or ''}".split()) for r in rows}
    docs = {k: v for k, v in docs.items() if v}
    df_t = Counter(w for d in docs.values() for w in d)
    got = {(r.row, r.term): r.score for r in distinct.term_scores(df, "row_no", "title", "body", alpha=0.0, joint="presence", weight="tf").collect()}
    want = {(k, w): tf * math.log(len(docs) / df_t[w]) for k, d in docs.items() for w, tf in d.items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    best = {r.row: r.term for r in distinct.strongest(distinct.term_scores(df, "row_no", "title", "body", alpha=0.0, joint="presence", weight="tf")).collect()}
    assert best == {k: min(d, key=lambda w: (-round(want[k, w], 6), w)) for k, d in docs.items()} and best[6] == "a"
    near = {(r.row, r.term): r.score for r in distinct.term_scores(df, "row_no", "title", "body", alpha=1e-6, joint="presence", weight="tf").collect()}
    assert near.keys() == want.keys() and all(math.isclose(near[k], want[k], rel_tol=1e-4, abs_tol=0.05) for k in want)
    n_t, mass = Counter(), sum(sum(d.values()) ** 0.75 for d in docs.values())
    for d in docs.values():
        n_t.update(d)
    got = {(r.row, r.term): r.score for r in distinct.term_scores(df, "row_no", "title", "body").collect()}
    for (k, w), s in got.items():
        assert math.isclose(s, max(0.0, math.log(docs[k][w] * mass / (n_t[w] * sum(docs[k].values()) ** 0.75))), abs_tol=1e-9)
    assert distinct.term_scores(df.limit(0), "row_no", "title", "body").count() == 0
    with pytest.raises(ValueError):
        distinct.term_scores(df, "row_no", "body", joint="x")


def test_heavy_split_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, "the " + " ".join(f"w{(i * j) % 17}" for j in range(5))) for i in range(40)], "row_no long, b string")
    run = lambda: {(r.row, r.term): r.score for r in distinct.term_scores(df, "row_no", "b").collect()}
    want = run()
    for heavy in (1, 8, 10**9):
        monkeypatch.setattr(distinct, "HEAVY", heavy)
        assert run() == want


def test_pairs(spark):
    rows = [(["b", "a", "a", None],), (["A ", "b", "c"],), (None,), ([],), ([None, ""],), (["x y", "x_y", "x--y", "a"],), (["a", "b"],)]
    df = spark.createDataFrame(rows, "tags array<string>").select(F.transform("tags", together.tag_key).alias("t"), F.lit(1).alias("item_a"))
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in together.pair_counts(df, "t").collect()}
    assert got == {("a", "b"): (3, 4, 3, 4), ("a", "c"): (1, 4, 1, 4), ("b", "c"): (1, 3, 1, 4), ("a", "x-y"): (1, 4, 1, 4)}
    r = together.pair_counts(df, "t", least=2).collect()
    assert len(r) == 1 and math.isclose(r[0].lift, 1.0) and math.isclose(r[0].pmi, 0.0)
    assert together.pair_counts(df, "t", least_share=0.5).count() == 1 and together.pair_counts(df.limit(0), "t").count() == 0
    big = spark.createDataFrame([([f"t{i:03}" for i in range(300)],)], "t array<string>")
    assert together.pair_counts(big, "t").count() == 300 * 299 // 2
