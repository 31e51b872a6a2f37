import pytest

from lexmill.schema import FieldDef, Schema, SchemaError, keyword_field, stored_field, text_field
from lexmill.storage.checksum import ChecksumError, checksum, parse, verify

GOOD = Schema((keyword_field("id"), text_field("title"), text_field("body", stored=False), keyword_field("tags", True), stored_field("metadata")))


@pytest.mark.parametrize(
    "fields",
    [
        [text_field(f"f{i}") for i in range(257)],
        [keyword_field("_id")], [keyword_field("_score")], [keyword_field("_source")],
        [keyword_field("a"), text_field("a")],
        [keyword_field("ü" * 128)],
        [FieldDef("a", "number", indexed=True)],
        [FieldDef("a", "text", "snowball", indexed=True)],
        [FieldDef("a", "text", indexed=True)],
        [FieldDef("a", "keyword", indexed=True, positions=True)],
        [FieldDef("a", "stored_only", stored=True, indexed=True)],
        [FieldDef("a", "stored_only", stored=False)],
    ],
)
def test_broken_rules(fields):
    with pytest.raises(SchemaError):
        Schema(tuple(fields)).validate()


def test_default_analyzer():
    s = Schema((FieldDef("a", "text", indexed=True),), "whitespace")
    assert s.validate().analyzer_of(s.fields[0]) == "whitespace"
    with pytest.raises(SchemaError):
        s.validate(strict=True)
    with pytest.raises(SchemaError):
        Schema((), "porter").validate()


def test_round_trip_and_tampering():
    s = GOOD.validate().created()
    assert Schema.from_json(s.to_json()) == s and s.version == 1 and s.created_at
    with pytest.raises(SchemaError):
        Schema.from_json(s.to_json().replace('"title"', '"titel"'))
    assert [s.field_id("id"), s.field_id("tags"), s.field_id("no")] == [0, 3, -1]
    st = s.struct()
    assert st["tags"].dataType.simpleString() == "array<string>" and st["title"].metadata["positions"]
    assert Schema.from_dict({"schema": {"fields": [{"name": "a", "type": "keyword", "colour": 1}]}}).fields[0].name == "a"


def test_checksums():
    c = checksum(b"abc")
    assert c == "sha256:ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    verify(b"abc", c.replace("ba78", "BA78"))
    for bad in ("", "sha256:", "md5:" + "0" * 64, c + "0", c[:-1] + "g"):
        with pytest.raises(ChecksumError):
            parse(bad)
    with pytest.raises(ChecksumError):
        verify(b"abd", c)
