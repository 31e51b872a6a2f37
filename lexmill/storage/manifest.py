"""Manifests: which segments make up a generation of an index."""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import asdict, dataclass, field

from lexmill.storage.checksum import checksum
from lexmill.storage.fs import Fs

# Places and names.
CURRENT = "manifest.current"
MANIFESTS, SEGMENTS, TMP, SCHEMA, LOCK = "manifests", "segments", "tmp", "schema.json", "write.lock"
_NAME = re.compile(r"manifest_gen_(\d+)\.json\Z")


class ManifestError(ValueError):
    """A manifest that is missing, malformed or does not match its checksum."""


@dataclass(frozen=True)
class Segment:
    """One immutable set of tables; ``tombstones`` counts ids it deletes from older segments."""

    id: str
    generation: int
    doc_count: int
    doc_count_alive: int
    del_count: int = 0
    min_doc_id: int = 0
    max_doc_id: int = 0
    size_bytes: int = 0
    tombstones: int = 0
    files: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class Manifest:
    generation: int
    segments: tuple[Segment, ...] = ()
    timestamp: str = ""
    commit_id: str = ""
    source_batch: int = -1
    version: int = 1

    @property
    def total_docs(self) -> int:
        return sum(s.doc_count for s in self.segments)

    @property
    def total_docs_alive(self) -> int:
        return sum(s.doc_count_alive for s in self.segments)

    @property
    def total_size_bytes(self) -> int:
        return sum(s.size_bytes for s in self.segments)

    def to_json(self) -> str:
        """Segments in order of their id, so equal manifests are equal texts."""
        body = {
            "version": self.version, "generation": self.generation, "timestamp": self.timestamp, "commit_id": self.commit_id, "source_batch": self.source_batch,
            "segments": [asdict(s) for s in sorted(self.segments, key=lambda s: s.id)],
            "total_docs": self.total_docs, "total_docs_alive": self.total_docs_alive, "total_size_bytes": self.total_size_bytes, "checksum": "",
        }
        body["checksum"] = checksum(json.dumps(body, indent=2, sort_keys=True).encode())
        return json.dumps(body, indent=2, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Manifest:
        try:
            body = json.loads(text)
            said, body["checksum"] = body["checksum"], ""
        except (ValueError, KeyError, TypeError) as e:
            raise ManifestError(f"malformed manifest: {e}") from e
        if checksum(json.dumps(body, indent=2, sort_keys=True).encode()) != said:
            raise ManifestError(f"manifest of generation {body.get('generation')} does not match its checksum")
        segments = tuple(Segment(**s) for s in body["segments"])
        return Manifest(body["generation"], segments, body["timestamp"], body["commit_id"], body["source_batch"], body["version"])


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


def manifest_path(generation: int) -> str:
    return f"{MANIFESTS}/manifest_gen_{generation}.json"


def generation_of(name: str) -> int | None:
    """The generation in a manifest's file name; None if it is no such name."""
    m = _NAME.match(name)
    return int(m[1]) if m else None


def parse_current(data: bytes | None) -> int:
    """Generation in the pointer; missing or blank is 0, anything but a number an error."""
    text = (data or b"").decode().strip()
    if not text:
        return 0
    if not text.isdecimal():
        raise ManifestError(f"the current pointer holds {text[:40]!r}")
    return int(text)


def read_current(fs: Fs) -> int:
    return parse_current(fs.read(CURRENT) if fs.exists(CURRENT) else None)


def write_current(fs: Fs, generation: int) -> None:
    fs.write(CURRENT, str(generation).encode())


def load(fs: Fs, generation: int) -> Manifest:
    path = manifest_path(generation)
    if not fs.exists(path):
        raise ManifestError(f"no manifest of generation {generation}")
    m = Manifest.from_json(fs.read(path).decode())
    if m.generation != generation:
        raise ManifestError(f"{path} is of generation {m.generation}")
    return m


def generations(fs: Fs) -> list[int]:
    return sorted(g for n in fs.names(MANIFESTS) if (g := generation_of(n)) is not None)


def load_with_fallback(fs: Fs, generation: int) -> Manifest:
    """The manifest of a generation, or the newest older one that can be read."""
    why = None
    for g in range(generation, 0, -1):
        try:
            return load(fs, g)
        except ManifestError as e:
            why = why or e
    raise ManifestError(f"no manifest up to generation {generation} can be read") from why
