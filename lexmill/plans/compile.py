"""Queries to DataFrames.

Leaves that stand for terms share one scan of the postings: the literal predicates go to the
scan (row groups are sorted by field and term), the expanded terms with their weights (one row
for a term, at most the limit for a pattern) are broadcast, and all leaves' scores meet in one
aggregation by document, where the Boolean tree is a column expression over the leaves' flags.

A pattern without a limit may stand for most of the dictionary, so its terms are not broadcast as
a whole: at most ``HEAVY`` terms can hold more than one in ``HEAVY`` postings each and are, the
rows of the others are shuffled, and none of those terms is hot.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.operators import expand, phrase, scoring
from lexmill.operators.expand import Limit
from lexmill.plans import ast
from lexmill.plans.ast import Boolean, MatchAll, MatchNone, Occur, Phrase, Proximity, Query
from lexmill.plans.rewrite import rewrite
from lexmill.plans.view import IndexView

_TERM_LEAVES = (ast.Term, ast.Prefix, ast.Wildcard, ast.Regexp, ast.Fuzzy)


@dataclass(frozen=True)
class Scorer:
    """BM25 parameters; ``compat`` takes 100 as every length and distinct terms per document as the mean."""

    k1: float = scoring.K1
    b: float = scoring.B
    compat: bool = False


HEAVY = 20_000


def compile_query(q: Query, view: IndexView, scorer: Scorer = Scorer(), rewritten: bool = False, expansions: Limit = None) -> DataFrame:
    """(doc_id, score) of every matching live document, each once.

    A leaf on an unknown or unindexed field, or with an empty term, matches nothing; equal
    leaves count each time they stand; scores are sums over the matching must and should leaves.
    Patterns stand for all their terms unless ``expansions`` limits them.
    """
    q = ast.check(q) if rewritten else rewrite(ast.check(q))
    spark = view.postings.sparkSession
    leaves: list[Query] = []
    _collect(q, leaves)
    hits = [*_term_hits(leaves, view, scorer, expansions), *_position_hits(leaves, view, scorer)]
    alls = [(i, x) for i, x in enumerate(leaves) if isinstance(x, MatchAll)]
    if alls or _needs_all(q):
        marks = [F.struct(F.lit(i).alias("leaf"), F.lit(float(x.boost)).alias("s")) for i, x in alls] or [F.struct(F.lit(-1).alias("leaf"), F.lit(0.0).alias("s"))]
        hits.append(view.docs.select("doc_id", F.explode(F.array(*marks)).alias("x")).select("doc_id", "x.leaf", "x.s"))
    if not hits:
        return spark.createDataFrame([], "doc_id bigint, score double")
    every = reduce(DataFrame.unionByName, hits)
    if isinstance(q, _TERM_LEAVES + (Phrase, Proximity, MatchAll)):
        return every.groupBy("doc_id").agg(F.sum("s").alias("score"))
    n = len(leaves)
    flags = [F.max(F.col("leaf") == i).alias(f"m{i}") for i in range(n)]
    scores = [F.sum(F.when(F.col("leaf") == i, F.col("s"))).alias(f"s{i}") for i in range(n)]
    table = every.groupBy("doc_id").agg(*flags, *scores)
    match, score = _tree(q, iter(range(n)))
    return table.where(match).select("doc_id", score.alias("score"))


def _collect(q: Query, out: list[Query]) -> None:
    if isinstance(q, Boolean):
        for c in q.clauses:
            _collect(c.query, out)
    else:
        out.append(q)


def _needs_all(q: Query) -> bool:
    """Whether a document without any leaf can match."""
    if isinstance(q, MatchAll):
        return True
    if not isinstance(q, Boolean) or not q.clauses or q.minimum_should_match > 0 and not any(_needs_all(x) for x in q.of(Occur.SHOULD)):
        return False
    musts, shoulds = q.of(Occur.MUST), q.of(Occur.SHOULD)
    if any(_needs_all(x) for x in q.of(Occur.MUST_NOT)):
        return False
    if musts:
        return all(_needs_all(x) for x in musts)
    return any(_needs_all(x) for x in shoulds) if shoulds else True


def _tree(q: Query, at) -> tuple[Column, Column]:
    """Match and score of a node over the leaves' columns; ``at`` gives leaf numbers in order."""
    if isinstance(q, MatchNone):
        next(at)
        return F.lit(False), F.lit(0.0)
    if not isinstance(q, Boolean):
        i = next(at)
        return F.coalesce(F.col(f"m{i}"), F.lit(False)), F.coalesce(F.col(f"s{i}"), F.lit(0.0))
    match, score, should = F.lit(bool(q.clauses)), F.lit(0.0), F.lit(0)
    shoulds = musts = 0
    for c in q.clauses:
        m, s = _tree(c.query, at)
        if c.occur is Occur.MUST_NOT:
            match = match & ~m
            continue
        score = score + F.when(m, s).otherwise(F.lit(0.0))
        if c.occur is Occur.MUST:
            match, musts = match & m, musts + 1
        else:
            should, shoulds = should + m.cast("int"), shoulds + 1
    least = q.minimum_should_match or (1 if shoulds and not musts else 0)
    return (match & (should >= least) if least else match), score


def _usable(leaf: Query, view: IndexView) -> bool:
    f = view.schema.field(leaf.field) if view.schema else None
    if view.schema and (f is None or not f.searchable):
        return False
    return bool(leaf.field)


def leaf_terms(leaves: list[tuple[int, Query]], view: IndexView, scorer: Scorer, expansions: Limit) -> DataFrame | None:
    """(leaf, field, term, df, idf, weight, avgdl) of the expanded terms of term leaves."""
    out = None
    for i, leaf in leaves:
        part = expand.expand(view.terms, leaf, expansions).select(F.lit(i).alias("leaf"), "field", "term", "df", F.lit(float(leaf.boost)).alias("boost"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return None
    n = F.lit(float(view.n_docs))
    scale = view.field_scale()
    if scorer.compat:
        kinds = view.stats.agg((F.sum("term_count") / F.lit(float(max(1, view.n_docs)))).alias("avgdl"))
        scale = scale.select("field", kinds.scalar().alias("avgdl"))
    idf = scoring.idf(n, F.col("df"))
    return out.join(F.broadcast(scale), "field").withColumn("idf", idf).withColumn("weight", F.col("boost") * F.col("idf"))


def _term_hits(leaves: list[Query], view: IndexView, scorer: Scorer, expansions: Limit) -> list[DataFrame]:
    mine = _term_leaves(leaves, view)
    open_ = [(i, x) for i, x in mine if not isinstance(x, ast.Term) and expand.limit_of(x, expansions) is None]
    few = [x for x in mine if x not in open_]
    out = []
    if few:
        terms = leaf_terms(few, view, scorer, expansions)
        out.append(_scored(_scan(few, view).join(F.broadcast(_weights(terms)), ["field", "term"]), scorer))
    if open_:
        bar = view.stats.agg((F.coalesce(F.sum("sum_doc_freq"), F.lit(0)) / F.lit(HEAVY)).alias("bar")).scalar()
        for one in open_:
            terms, rows = leaf_terms([one], view, scorer, None), _scan([one], view)
            heavy = F.broadcast(_weights(terms.where(F.col("df") > bar)))
            out.append(_scored(rows.join(heavy, ["field", "term"]), scorer))
            out.append(_scored(rows.join(heavy.select("field", "term"), ["field", "term"], "left_anti").join(_weights(terms.where(F.col("df") <= bar)), ["field", "term"]), scorer))
    return out


def _term_leaves(leaves: list[Query], view: IndexView) -> list[tuple[int, Query]]:
    return [(i, x) for i, x in enumerate(leaves) if isinstance(x, _TERM_LEAVES) and _usable(x, view) and not (isinstance(x, ast.Term) and not x.term)]


def _scan(leaves: list[tuple[int, Query]], view: IndexView) -> DataFrame:
    scan = reduce(Column.__or__, ((F.col("field") == x.field) & expand.matches(x, F.col("term")) for _, x in leaves))
    return view.postings.where(scan).select("field", "term", "doc_id", "tf", "dl")


def _weights(terms: DataFrame) -> DataFrame:
    return terms.select("leaf", "field", "term", "weight", "avgdl")


def _scored(hits: DataFrame, scorer: Scorer) -> DataFrame:
    dl = F.lit(100.0) if scorer.compat else F.col("dl").cast("double")
    s = scoring.term_score(F.col("weight"), F.col("tf").cast("double"), dl, F.col("avgdl"), scorer.k1, scorer.b)
    return hits.select("doc_id", "leaf", s.alias("s"))


def _position_hits(leaves: list[Query], view: IndexView, scorer: Scorer) -> list[DataFrame]:
    """Phrases and proximity: BM25 of the number of matches, weighted by the sum of the terms' idf."""
    out = []
    for i, x in enumerate(leaves):
        if not isinstance(x, (Phrase, Proximity)) or not _usable(x, view):
            continue
        f = view.schema.field(x.field) if view.schema else None
        if f and not f.positions:
            continue
        find = phrase.phrase_matches if isinstance(x, Phrase) else phrase.proximity_matches
        found = find(view.postings, x.field, x.terms, x.slop)
        counts = Counter(x.terms) if isinstance(x, Phrase) else dict.fromkeys(x.terms, 1)
        times = F.create_map(*(F.lit(v) for kv in counts.items() for v in kv))
        mine = view.terms.where((F.col("field") == x.field) & F.col("term").isin(list(counts)))
        each = scoring.idf(F.lit(float(view.n_docs)), F.col("df"))
        weight = mine.agg(F.sum(each * F.element_at(times, F.col("term"))).alias("weight"))
        avgdl = view.field_scale().where(F.col("field") == x.field).select("avgdl")
        s = scoring.term_score(weight.scalar() * F.lit(float(x.boost)), F.col("tf").cast("double"), F.col("dl").cast("double"), avgdl.scalar(), scorer.k1, scorer.b)
        out.append(found.select("doc_id", F.lit(i).alias("leaf"), s.alias("s")))
    return out


def count_terms(q: Query, view: IndexView, expansions: Limit = expand.USUAL) -> tuple[int, bool]:
    """(terms the leaves stand for, whether some leaf has more than it may), in one job.

    Terms are one each; a pattern's count stops one behind its limit.
    """
    leaves: list[Query] = []
    _collect(rewrite(q), leaves)
    mine = [x for _, x in _term_leaves(leaves, view)]
    patterns = [x for x in mine if not isinstance(x, ast.Term)]
    if not patterns:
        return len(mine), False
    counts = [expand.count(view.terms, x, expansions).withColumn("i", F.lit(i)) for i, x in enumerate(patterns)]
    n = {r["i"]: r["n"] for r in reduce(DataFrame.unionByName, counts).collect()}
    over = False
    total = len(mine) - len(patterns)
    for i, x in enumerate(patterns):
        most = expand.limit_of(x, expansions)
        over |= most is not None and n[i] > most
        total += n[i] if most is None else min(n[i], most)
    return total, over


def explain_hits(q: Query, hits: DataFrame, view: IndexView, scorer: Scorer = Scorer(), expansions: Limit = None) -> DataFrame:
    """``hits`` (a page of results) with ``explanation``: JSON of every matching term's score."""
    leaves: list[Query] = []
    _collect(rewrite(q), leaves)
    mine = _term_leaves(leaves, view)
    terms = leaf_terms(mine, view, scorer, expansions)
    if terms is None:
        return hits.withColumn("explanation", F.lit(None).cast("string"))
    # a page is at most topk.MAX_K rows; the terms meet only its postings
    rows = _scan(mine, view).join(F.broadcast(hits.select("doc_id")), "doc_id").join(terms, ["field", "term"])
    tf, dl = F.col("tf").cast("double"), F.lit(100.0) if scorer.compat else F.col("dl").cast("double")
    s = scoring.term_score(F.col("weight"), tf, dl, F.col("avgdl"), scorer.k1, scorer.b)
    one = scoring.explanation(F.col("field"), F.col("term"), tf, dl, F.col("df"), F.lit(view.n_docs), F.col("avgdl"), s, F.col("boost"), scorer.k1, scorer.b)
    per = rows.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("leaf", "field", "term", one.alias("score"))))).alias("explanation"))
    return hits.join(per, "doc_id", "left")
