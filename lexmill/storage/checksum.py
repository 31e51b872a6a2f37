"""SHA-256 checksums in the form ``sha256:<64 hex digits>``."""

from __future__ import annotations

import hashlib
import re
from typing import BinaryIO

PREFIX = "sha256:"
_FORM = re.compile(r"sha256:([0-9a-fA-F]{64})\Z")
_PIECE = 1 << 20


class ChecksumError(ValueError):
    """A malformed checksum, or one that does not match."""


def checksum(data: bytes) -> str:
    return PREFIX + hashlib.sha256(data).hexdigest()


def checksum_stream(f: BinaryIO) -> str:
    h = hashlib.sha256()
    while piece := f.read(_PIECE):
        h.update(piece)
    return PREFIX + h.hexdigest()


def checksum_file(path: str) -> str:
    with open(path, "rb") as f:
        return checksum_stream(f)


def parse(text: str) -> bytes:
    """The digest of a checksum; upper-case digits are accepted."""
    m = _FORM.match(text)
    if not m:
        raise ChecksumError(f"not a checksum: {text[:80]!r}")
    return bytes.fromhex(m[1])


def verify(data: bytes, expected: str) -> None:
    if hashlib.sha256(data).digest() != parse(expected):
        raise ChecksumError(f"checksum mismatch, expected {expected}")
