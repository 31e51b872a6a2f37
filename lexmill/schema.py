"""Index schemas: fields, validation, Spark types and checksummed JSON."""

from __future__ import annotations

import datetime
import json
from collections.abc import Collection, Mapping
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import types as T

from lexmill.storage.checksum import checksum

# Fixed values.
FIELD_TYPES = ("text", "keyword", "stored_only")
ANALYZERS = ("standard", "whitespace", "keyword")
RESERVED_NAMES = ("_id", "_score", "_source")
MAX_FIELDS = 256
MAX_NAME_BYTES = 255


class SchemaError(ValueError):
    """A schema that breaks a rule."""


@dataclass(frozen=True)
class FieldDef:
    name: str
    type: str
    analyzer: str = ""
    stored: bool = False
    indexed: bool = False
    positions: bool = False
    multi_valued: bool = False

    @property
    def searchable(self) -> bool:
        return self.indexed and self.type != "stored_only"


@dataclass(frozen=True)
class Schema:
    fields: tuple[FieldDef, ...]
    default_analyzer: str = ""
    version: int = 1
    created_at: str = ""

    def validate(self, strict: bool = False, analyzers: Collection[str] = ANALYZERS) -> Schema:
        """Raises :class:`SchemaError` at the first broken rule; returns the schema itself.

        A text field without an analyzer takes the default one; with ``strict`` it is an error.
        Names may be of any characters; an ``id`` field is not required.  ``analyzers`` are the
        names that may be used (a registry's, or the built-in ones).
        """
        if len(self.fields) > MAX_FIELDS:
            raise SchemaError(f"{len(self.fields)} fields, at most {MAX_FIELDS} are allowed")
        seen: set[str] = set()
        for f in self.fields:
            if f.name in RESERVED_NAMES:
                raise SchemaError(f"field name {f.name} is reserved")
            if f.name in seen:
                raise SchemaError(f"field {f.name} is defined twice")
            seen.add(f.name)
            if len(f.name.encode()) > MAX_NAME_BYTES:
                raise SchemaError(f"field name {f.name[:40]}... is longer than {MAX_NAME_BYTES} bytes")
            if f.type not in FIELD_TYPES:
                raise SchemaError(f"field {f.name} has unknown type {f.type!r}")
            if f.analyzer and f.analyzer not in analyzers:
                raise SchemaError(f"field {f.name} has unknown analyzer {f.analyzer!r}")
            if f.type == "text" and not f.analyzer and (strict or not self.default_analyzer):
                raise SchemaError(f"text field {f.name} needs an analyzer")
            if f.positions and f.type != "text":
                raise SchemaError(f"field {f.name}: only text fields have positions")
            if f.type == "stored_only" and (f.indexed or not f.stored):
                raise SchemaError(f"field {f.name}: stored_only must be stored and not indexed")
        if self.default_analyzer and self.default_analyzer not in analyzers:
            raise SchemaError(f"unknown default analyzer {self.default_analyzer!r}")
        return self

    def field_id(self, name: str) -> int:
        """Ordinal of a field, -1 if there is none."""
        return next((i for i, f in enumerate(self.fields) if f.name == name), -1)

    def field(self, name: str) -> FieldDef | None:
        i = self.field_id(name)
        return self.fields[i] if i >= 0 else None

    def analyzer_of(self, f: FieldDef) -> str:
        return f.analyzer or self.default_analyzer or "standard"

    @property
    def stored(self) -> list[str]:
        return [f.name for f in self.fields if f.stored]

    def struct(self) -> T.StructType:
        """Spark type of an ingested batch; flags and analyzers go into the fields' metadata."""
        out = [] if self.field("id") else [T.StructField("id", T.StringType(), True)]
        for f in self.fields:
            kind = T.ArrayType(T.StringType()) if f.multi_valued and f.type == "keyword" else T.StringType()
            meta = {"type": f.type, "analyzer": f.analyzer, "stored": f.stored, "indexed": f.indexed, "positions": f.positions, "multi_valued": f.multi_valued}
            out.append(T.StructField(f.name, kind, True, meta))
        return T.StructType(out)

    def created(self, now: datetime.datetime | None = None) -> Schema:
        return replace(self, version=1, created_at=(now or datetime.datetime.now(datetime.UTC)).isoformat())

    def to_json(self) -> str:
        """Indented JSON with a checksum over the same JSON whose checksum is empty."""
        body = {"version": self.version, "created_at": self.created_at, "default_analyzer": self.default_analyzer, "fields": [asdict(f) for f in self.fields], "checksum": ""}
        body["checksum"] = checksum(json.dumps(body, indent=2).encode())
        return json.dumps(body, indent=2)

    @staticmethod
    def from_json(text: str) -> Schema:
        body = json.loads(text)
        said, body["checksum"] = body.get("checksum", ""), ""
        if checksum(json.dumps(body, indent=2).encode()) != said:
            raise SchemaError("schema checksum does not match")
        return Schema.from_dict(body)

    @staticmethod
    def from_dict(body: Mapping[str, Any]) -> Schema:
        """Of a request: the fields at top level, or below ``schema``; unknown keys are passed over."""
        body = body.get("schema", body)
        known = FieldDef.__dataclass_fields__
        fields = tuple(FieldDef(**{k: v for k, v in f.items() if k in known}) for f in body.get("fields", []))
        return Schema(fields, body.get("default_analyzer", "") or "", body.get("version", 1) or 1, body.get("created_at", "") or "")


def text_field(name: str, analyzer: str = "standard", stored: bool = True, positions: bool = True) -> FieldDef:
    return FieldDef(name, "text", analyzer, stored, True, positions)


def keyword_field(name: str, multi_valued: bool = False, stored: bool = True) -> FieldDef:
    return FieldDef(name, "keyword", "", stored, True, False, multi_valued)


def stored_field(name: str) -> FieldDef:
    return FieldDef(name, "stored_only", "", True)
