"""Documents from JSON: request bodies and files."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.operators.indexing import DocumentError
from lexmill.schema import FieldDef, Schema


def _value(f: FieldDef, v: Any, i: int) -> Any:
    if v is None:
        return None
    if f.type == "stored_only":
        return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    if f.type == "keyword" and f.multi_valued:
        values = [v] if isinstance(v, str) else v
        if not isinstance(values, list) or not all(isinstance(x, str) for x in values):
            raise DocumentError(f"document {i}: field {f.name} takes a string or an array of strings")
        return values
    if not isinstance(v, str):
        raise DocumentError(f"document {i}: field {f.name} takes a string")
    return v


def documents_frame(spark: SparkSession, schema: Schema, docs: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Rows of JSON objects by the schema's type: a value of a wrong type refuses the batch, unknown
    keys are dropped, non-strings in stored-only fields become JSON text."""
    struct = schema.struct()
    rows = []
    for i, d in enumerate(docs):
        if not isinstance(d, Mapping):
            raise DocumentError(f"document {i} is no object")
        if not isinstance(d.get("id"), str) or not d["id"]:
            raise DocumentError(f"document {i} has no string id")
        rows.append(tuple(d["id"] if n == "id" else _value(schema.field(n), d.get(n), i) for n in struct.names))
    return spark.createDataFrame(rows, struct)


def read_json_documents(spark: SparkSession, path: str, schema: Schema, multi_line: bool = False) -> DataFrame:
    """Documents of JSON files by the declared type; nothing is inferred and wrong types fail the read."""
    struct = schema.struct()
    return spark.read.schema(struct).option("mode", "FAILFAST").option("multiLine", multi_line).option("primitivesAsString", "true").json(path)


def hits_json(hits: DataFrame) -> DataFrame:
    """(value): one JSON object per hit, for a text sink."""
    return hits.select(F.to_json(F.struct(*hits.columns)).alias("value"))
