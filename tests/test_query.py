import math
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexmill.operators import expand, phrase, topk as tk
from lexmill.operators.scoring import Bm25
from lexmill.plans import ast
from lexmill.plans.ast import Boolean, Clause, MatchAll, MatchNone, Occur, QueryError, Term, bool_of
from lexmill.plans.compile import compile_query, count_terms
from lexmill.plans.parse import parse_query, parse_request
from lexmill.plans.rewrite import rewrite
from lexmill.plans.view import IndexView
from lexmill.schema import Schema, keyword_field, text_field

a, b, c = (Term("f", x) for x in "abc")
ALL, NONE = MatchAll(), MatchNone()


def test_rewrites():
    must = lambda *q: bool_of(must=list(q))
    assert rewrite(must(must(a, b), c)) == must(a, b, c)
    assert rewrite(must(a, ALL)) == a
    assert rewrite(must(a, NONE)) == NONE
    assert rewrite(must(ALL, ALL)) == ALL
    negative = bool_of(must_not=[must(a, b)])
    assert rewrite(negative) == negative
    assert rewrite(must(a)) == a and rewrite(must(must(must(a)))) == a
    assert rewrite(bool_of(should=[bool_of(should=[a, b]), c])) == bool_of(should=[a, b, c])
    assert rewrite(bool_of(should=[a, NONE])) == a and rewrite(bool_of(should=[NONE])) == NONE
    assert rewrite(bool_of(must_not=[ALL])) == NONE and rewrite(Boolean()) == NONE
    # meaning is kept: optional clauses stay optional, a demanded number stays demanded
    assert rewrite(bool_of(must=[ALL], should=[a])) == bool_of(must=[ALL], should=[a])
    assert rewrite(bool_of(must=[ALL], must_not=[a])) == bool_of(must=[ALL], must_not=[a])
    nested = bool_of(must=[bool_of(must=[a], minimum_should_match=0), bool_of(should=[a, b, c], minimum_should_match=2)])
    assert rewrite(nested) == bool_of(must=[a, bool_of(should=[a, b, c], minimum_should_match=2)])
    assert rewrite(must(a, Boolean())) == NONE


leaf = st.sampled_from([a, b, c, ALL, NONE])
tree = st.recursive(
    leaf,
    lambda q: st.builds(lambda cs, m: Boolean(tuple(cs), m), st.lists(st.builds(Clause, st.sampled_from(list(Occur)), q), max_size=4), st.integers(0, 2)),
    max_leaves=10,
)


def holds(q, doc):
    match q:
        case Term(_, t, _):
            return t in doc
        case MatchAll():
            return True
        case MatchNone():
            return False
    musts, shoulds, nots = ([holds(x, doc) for x in q.of(o)] for o in Occur)
    least = q.minimum_should_match or (1 if shoulds and not musts else 0)
    return bool(q.clauses) and all(musts) and not any(nots) and sum(shoulds) >= least


@given(tree)
@settings(max_examples=400, deadline=None)
def test_rewriting_keeps_the_matches(q):
    r = rewrite(q)
    for n in range(8):
        doc = {x for i, x in enumerate("abc") if n >> i & 1}
        assert holds(q, doc) == holds(r, doc)
    assert rewrite(r) == r


SCHEMA = Schema((text_field("f"), keyword_field("k", True), text_field("np", positions=False)))
WORDS = ["ho", "heo", "hello", "hallo", "h", "world", "hel", "hell", "help", "helmet", "he", "HEL", "tion", "action", "mention", "tio", "actions", "hxllo", "heello", "hällo"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return {i: [rng.choice("abcd") for _ in range(rng.randint(0, 14))] for i in range(60)}


@pytest.fixture(scope="module")
def view(spark, corpus):
    rows = [(i, str(i), " ".join(ws), ["x"] if i % 2 else [], WORDS[i % len(WORDS)], "clash") for i, ws in corpus.items()]
    docs = spark.createDataFrame(rows, "doc_id long, id string, f string, k array<string>, np string, score string")
    return IndexView.build(docs, SCHEMA)


def run(q, view):
    return {r["doc_id"]: r["score"] for r in compile_query(q, view).collect()}


def test_boolean_trees_against_plain_evaluation(view, corpus):
    rng = random.Random(9)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([a, b, c, ALL, NONE, Term("f", "zzz")])
        return Boolean(tuple(Clause(rng.choice(list(Occur)), make(depth - 1)) for _ in range(rng.randint(1, 3))), rng.choice([0, 0, 0, 1, 2]))

    for _ in range(14):
        q = make(2)
        got = set(run(q, view))
        assert got == {i for i, ws in corpus.items() if holds(q, set(ws))}, q
    assert set(run(bool_of(must_not=[a]), view)) == {i for i, ws in corpus.items() if "a" not in ws}
    assert run(Term("nofield", "a"), view) == {} and run(Term("f", ""), view) == {}


def test_scores(view, corpus):
    n, lens = len(corpus), [len(w) for w in corpus.values() if w]
    m = Bm25(n, sum(lens) / len(lens))
    df = {t: sum(t in w for w in corpus.values()) for t in "abcd"}
    got = run(bool_of(should=[Term("f", "a", 2.0), b]), view)
    for i, ws in corpus.items():
        want = m.score_terms([(ws.count("a"), df["a"], 2.0), (ws.count("b"), df["b"], 1.0)], len(ws))
        assert math.isclose(got.get(i, 0.0), want, rel_tol=1e-9, abs_tol=1e-12)
    assert run(MatchAll(1.5), view) == dict.fromkeys(corpus, 1.5)


def test_golden_scores():
    assert abs(Bm25(100, 25).idf(10) - 2.2637453) < 1e-6
    big = Bm25(10000, 25)
    assert [round(big.idf(x), 5) for x in (10, 100, 500, 5000, 9999)] == [6.85907, 4.60028, 2.99483, 0.69315, 0.00015]
    w = big.idf(100)
    got = [round(big.score(tf, dl, w), 5) for tf, dl in ((1, 25), (3, 25), (10, 25), (3, 10), (3, 100), (0, 25))]
    assert got == [4.60028, 7.22902, 9.03627, 8.29559, 4.40027, 0.0]
    assert abs(big.score_terms([(3, 100, 1.0), (1, 500, 1.0), (0, 7, 1.0)], 25) - 10.2238493) < 1e-5


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_phrases_against_brute_force(view, corpus, slop):
    for terms in (("a", "b"), ("a", "b", "a"), ("c", "c"), ("a", "zzz"), ("d",)):
        want = {}
        for i, ws in corpus.items():
            n = 0
            for s, w in enumerate(ws):
                if w != terms[0]:
                    continue
                at = s
                for t in terms[1:]:
                    at = next((j for j in range(at + 1, len(ws)) if ws[j] == t), None)
                    if at is None:
                        break
                n += at is not None and at - s - (len(terms) - 1) <= slop
            if n:
                want[i] = n
        got = {r["doc_id"]: r["tf"] for r in phrase.phrase_matches(view.postings, "f", terms, slop).collect()}
        assert got == want, terms


def test_proximity_against_brute_force(view, corpus):
    for terms, slop in ((("a", "b"), 0), (("a", "b", "c"), 2), (("d", "a", "c"), 0)):
        want = {}
        for i, ws in corpus.items():
            n = sum(ws[s] in terms and set(terms) <= set(ws[s : s + len(terms) + slop]) for s in range(len(ws)))
            if n:
                want[i] = n
        got = {r["doc_id"]: r["tf"] for r in phrase.proximity_matches(view.postings, "f", terms, slop).collect()}
        assert got == want
    assert run(ast.Phrase("np", ("hello",)), view) == {}  # a field without positions
    assert set(run(ast.Phrase("f", ("a", "b")), view)) == {r["doc_id"] for r in phrase.phrase_matches(view.postings, "f", ("a", "b")).collect()}


def accepted(spark, q):
    df = spark.createDataFrame([("f", w, 1, 1) for w in [*WORDS, "", "a\nb", "h!llo"]], "field string, term string, df long, cf long")
    return {r["term"] for r in expand.expand(df, q).collect()}


def test_expansions(spark):
    assert accepted(spark, ast.Prefix("f", "hel")) == {"hel", "hell", "hello", "help", "helmet"}
    assert accepted(spark, ast.Prefix("f", "")) == {*WORDS, "", "a\nb", "h!llo"}
    assert accepted(spark, ast.Wildcard("f", "h*o")) == {"ho", "heo", "hello", "hallo", "hxllo", "heello", "hällo", "h!llo"}
    assert accepted(spark, ast.Wildcard("f", "h?llo")) == {"hallo", "hello", "hxllo", "hällo", "h!llo"}
    assert accepted(spark, ast.Wildcard("f", "*tion")) == {"tion", "action", "mention"}
    assert accepted(spark, ast.Wildcard("f", "")) == {""} and accepted(spark, ast.Wildcard("f", "a*b")) == {"a\nb"}
    assert accepted(spark, ast.Wildcard("f", "h.*")) == set()
    assert accepted(spark, ast.Regexp("f", "h[ae]llo|tion")) == {"hello", "hallo", "tion"}
    assert accepted(spark, ast.Fuzzy("f", "hello", 1)) == {"hello", "hallo", "hell", "hxllo", "heello", "hällo", "h!llo"}
    assert accepted(spark, ast.Fuzzy("f", "hello", 1, 2)) == {"hello", "hell", "heello"}
    assert accepted(spark, ast.Fuzzy("f", "ab", 0)) == set()
    df = spark.createDataFrame([("f", f"t{i:04}", 1, 1) for i in range(30)], "field string, term string, df long, cf long")
    assert [r["term"] for r in expand.expand(df, ast.Prefix("f", "t"), 3).collect()] == ["t0000", "t0001", "t0002"]
    assert [expand.count(df, ast.Prefix("f", "t"), n).first()[0] for n in (28, 29, 30, 31, None)] == [29, 30, 30, 30, 30]
    assert len(expand.expand(df, ast.Prefix("f", "t"), None).collect()) == 30


@given(st.text("ab*?.", max_size=6), st.text("ab.\n", max_size=6))
@settings(max_examples=300, deadline=None)
def test_wildcard_expression(pattern, text):
    def fits(p, t):
        if not p:
            return not t
        if p[0] == "*":
            return fits(p[1:], t) or (bool(t) and fits(p, t[1:]))
        return bool(t) and p[0] in ("?", t[0]) and fits(p[1:], t[1:])

    assert bool(re.match(expand.wildcard_regex(pattern).replace(r"\z", r"\Z"), text)) == fits(pattern, text)


def test_expanding_leaves_score_the_sum_of_their_terms(view, corpus):
    for q, fits in ((ast.Prefix("np", "hel", 2.0), lambda w: w.startswith("hel")), (ast.Fuzzy("np", "hello", 1), lambda w: w in {"hello", "hallo", "hell", "hxllo", "heello", "hällo"})):
        got = run(q, view)
        assert set(got) == {i for i in corpus if fits(WORDS[i % len(WORDS)].lower())}
    one = run(ast.Prefix("np", "help", 2.0), view)
    assert {i: round(s, 9) for i, s in one.items()} == {i: round(s, 9) for i, s in run(bool_of(should=[Term("np", "help", 2.0)]), view).items()}
    assert run(ast.Phrase("f", ("a",)), view).keys() == run(a, view).keys()


def test_limits():
    bad = [
        ast.Wildcard("f", "x" * 257), ast.Fuzzy("f", "hello", 3), ast.Fuzzy("f", "ab", 1), ast.Phrase("f", ()), ast.Phrase("f", ("a",) * 51), ast.Proximity("f", ("a",) * 11),
        ast.Proximity("f", ("a",), 101), ast.Term("f", "a", -1.0), ast.Term("f", "a", float("nan")), bool_of(should=[a] * 1025), bool_of(must=[a], minimum_should_match=-1),
    ]
    deep = a
    for _ in range(11):
        deep = bool_of(must=[deep])
    for q in [*bad, deep]:
        with pytest.raises(QueryError):
            ast.check(q)
    with pytest.raises(QueryError):
        expand.regexp_regex("(?=a)b")
    with pytest.raises(QueryError):
        expand.regexp_regex("(a")


def test_parsing():
    split = lambda f, t: t.lower().split()
    p = lambda q: parse_query(q, split)
    assert p({"term": {"field": "f", "value": "a"}}) == p({"type": "term", "field": "f", "value": "a"}) == a
    assert p({"prefix": {"field": "f", "prefix": "he", "boost": 2}}) == ast.Prefix("f", "he", 2.0)
    assert p({"phrase": {"field": "f", "value": "Full text", "slop": 1}}) == ast.Phrase("f", ("full", "text"), 1)
    assert p({"proximity": {"field": "f", "terms": ["a", "b"], "slop": 3}}) == ast.Proximity("f", ("a", "b"), 3)
    assert p({"fuzzy": {"field": "f", "value": "serch", "fuzziness": 2}}) == ast.Fuzzy("f", "serch", 2)
    assert p({"wildcard": {"field": "f", "pattern": "s*"}}) == ast.Wildcard("f", "s*") and p({"regexp": {"field": "f", "pattern": "colou?r"}}) == ast.Regexp("f", "colou?r")
    assert p({"match_all": {}}) == ALL and p({"match_none": {}}) == NONE
    assert p({"bool": {"must": [{"term": {"field": "f", "value": "a"}}], "should": {"term": {"field": "f", "value": "b"}}, "must_not": [], "minimum_should_match": 1}}) == bool_of([a], [b], minimum_should_match=1)
    for bad in ({}, {"term": 3}, {"term": {"field": "f"}}, {"term": {"field": "", "value": "x"}}, {"term": {"field": "f", "value": 3}}, {"what": {}}, {"type": "what"}, {"term": {}, "prefix": {}}, {"term": {"field": "f", "value": "a", "boost": "x"}}):
        with pytest.raises(QueryError):
            p(bad)
    r = parse_request('{"query": {"match_all": {}}, "size": 3, "explain": true}', split)
    assert (r.query, r.top_k, r.explain) == (ALL, 3, True)
    assert parse_request({"query": {"match_all": {}}}, split).top_k == 10
    for bad in ("x", "[]", "{}", {"query": []}, {"query": {"match_all": {}}, "top_k": "3"}, {"query": {"match_all": {}}, "top_k": 10_001}, {"query": {"match_all": {}}, "offset": -1}):
        with pytest.raises(QueryError):
            parse_request(bad, split)


def test_topk(spark):
    df = spark.createDataFrame([(i, s, i % 2) for i, s in enumerate([1.0, 3.0, 2.0, 5.0, 4.0, 3.0])], "doc_id long, score double, shard_id long")
    assert [r["score"] for r in tk.topk(df, 3).collect()] == [5.0, 4.0, 3.0]
    assert [r["doc_id"] for r in tk.topk(df, 4).collect()] == [3, 4, 1, 5]
    assert [r["doc_id"] for r in tk.topk(df, 2, 2).collect()] == [1, 5]
    assert tk.topk(df, 0).count() == 6 and tk.topk(df.limit(0), 5).count() == 0
    assert [r["score"] for r in tk.merge_topk(tk.shard_topk(df, 2), 3).collect()] == [5.0, 4.0, 3.0]
    assert "TakeOrderedAndProject" in tk.topk(df, 3)._jdf.queryExecution().toString()


def test_scan_is_pruned(view):
    plan = compile_query(Term("f", "a"), view)._jdf.queryExecution().toString()
    assert "EqualTo(term,a)" in plan and "EqualTo(field,f)" in plan and "positions" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert count_terms(ast.Prefix("f", "a"), view)[1] is False
    assert count_terms(ast.bool_of(should=[Term("f", "a"), ast.Wildcard("f", "*")]), view, 1) == (2, True)


def test_patterns_without_a_limit(spark, view, monkeypatch):
    from lexmill.plans import compile as co

    for q in (ast.Wildcard("f", "*"), ast.Prefix("f", "a"), ast.bool_of(must=[ast.Regexp("f", ".*")], should=[Term("f", "a"), ast.Fuzzy("f", "abc", 2)])):
        want = {r["doc_id"]: round(r["score"], 9) for r in compile_query(q, view, expansions=10_000).collect()}
        assert want
        for heavy in (1, 3, 20_000):  # all terms shuffled, some, none
            monkeypatch.setattr(co, "HEAVY", heavy)
            assert {r["doc_id"]: round(r["score"], 9) for r in compile_query(q, view).collect()} == want


def test_plain_analyzers_match_the_expressions(spark):
    from lexmill.functions import analysis
    from lexmill.functions.text import PLAIN

    texts = ["Ab_c ДЖ ΣΑΣ İstanbul ﬁ é e\u0301 ١٢ ² Ⅷ x-y", " \u00a0a\u2003b\u0085c\x0bd\x1ce ", "", "a"]
    for name in PLAIN:
        a = analysis.Registry().get(name)
        got = [r.a for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(a(F.col("t")).alias("a")).collect()]
        assert got == [PLAIN[name](t) for t in texts], name
