"""A search from request to page of hits."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Observation, functions as F

from lexmill.functions.analysis import Registry
from lexmill.functions.text import PLAIN
from lexmill.operators import topk as tk
from lexmill.plans.compile import Scorer, compile_query, count_terms, explain_hits
from lexmill.plans.limits import Budget, LimitError, OutOfTimeError
from lexmill.plans.parse import Request, parse_request
from lexmill.plans.view import IndexView
from lexmill.schema import Schema


def text_analyzer(view: IndexView, registry: Registry):
    """Splits a query's text as its field is split: built-in analyzers on the driver, others by their expression."""
    spark = view.postings.sparkSession

    def run(field: str, text: str) -> list[str]:
        schema: Schema | None = view.schema
        f = schema.field(field) if schema else None
        name = schema.analyzer_of(f) if f and f.type == "text" else "keyword" if f else "standard"
        if name in PLAIN:
            return PLAIN[name](text)
        return spark.createDataFrame([(text,)], "t string").select(registry.get(name)(F.col("t")).alias("a")).first()["a"] or []

    return run


def search_page(view: IndexView, request: Request, budget: Budget, scorer: Scorer = Scorer()) -> tuple[list, int]:
    """(rows of the page by rank, number of all matches), both of one pass over the hits."""
    seen = Observation()
    hits = compile_query(request.query, view, scorer, expansions=request.max_expansions).observe(seen, F.count(F.lit(1)).alias("n"))
    rows = budget.run(view.postings.sparkSession, tk.topk(hits, request.top_k, request.offset).collect)
    return rows, seen.get["n"]


def _details(view: IndexView, request: Request, rows: list, scorer: Scorer) -> DataFrame:
    """Stored fields (and explanations) of a page's rows."""
    page = view.postings.sparkSession.createDataFrame([(r["doc_id"], r["score"]) for r in rows], "doc_id bigint, score double")
    if request.explain:
        page = explain_hits(request.query, page, view, scorer, request.max_expansions)
    return F.broadcast(page).join(view.docs, "doc_id")


def search(view: IndexView, body: str | Mapping[str, Any], registry: Registry | None = None, explain: bool = False, scorer: Scorer = Scorer(), timeout: float = 30.0, generation: int = 0, max_terms: int | None = None) -> dict:
    """The answer to a request: status, time, true number of matches, and the page of hits.

    Patterns stand for their first terms only, as many as the request's ``max_expansions`` says (default:
    the usual limits; null: all), and ``limit_exceeded`` tells if some had more.  A request whose leaves
    stand for more than ``max_terms`` terms together is refused.  If the time runs out behind the
    scoring, the page comes with documents and scores only and the status ``partial``.
    """
    began = time.monotonic()
    request = parse_request(body, text_analyzer(view, registry or Registry()), explain)
    spark = view.postings.sparkSession
    budget = Budget(timeout, max_terms)
    answer: dict[str, Any] = {"status": "ok", "generation": generation, "timed_out": False, "limit_exceeded": False, "total_hits": 0, "hits": []}
    rows, more = [], {}
    try:
        terms, answer["limit_exceeded"] = budget.run(spark, lambda: count_terms(request.query, view, request.max_expansions))
        budget.take(terms)
        rows, answer["total_hits"] = search_page(view, request, budget, scorer)
        if rows:
            more = {r["doc_id"]: r for r in budget.run(spark, _details(view, request, rows, scorer).collect)}
    except OutOfTimeError:
        answer |= {"status": "partial" if rows else "timeout", "timed_out": True}
    except LimitError as e:
        answer |= {"status": "refused", "limit_exceeded": True, "error": str(e)}
    stored = [c for c in view.docs.columns if c not in ("doc_id", "id")]
    for r in rows:
        d = more.get(r["doc_id"])
        hit = {"doc_id": r["doc_id"], "score": r["score"], "id": d["id"] if d else None, "stored_fields": {c: d[c] for c in stored if d[c] is not None} if d else {}}
        if request.explain and d:
            hit["explanation"] = json.loads(d["explanation"]) if d["explanation"] else None
        answer["hits"].append(hit)
    answer["took_ms"] = int((time.monotonic() - began) * 1000)
    return answer
