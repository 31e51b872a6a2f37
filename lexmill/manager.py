"""All indexes below one folder: the operations of the service without its transport."""

from __future__ import annotations

import os
import re
import socket
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lexmill.functions.analysis import Registry
from lexmill.plans.compile import Scorer
from lexmill.schema import Schema
from lexmill.search import search
from lexmill.sources.documents import documents_frame
from lexmill.storage.commit import CommitResult
from lexmill.storage import manifest as mf
from lexmill.storage.fs import Fs
from lexmill.storage.index import Index, IndexBusyError

_NAME = re.compile(r"[A-Za-z0-9_-]{1,255}\Z")
LOCK = mf.LOCK


class NoSuchIndexError(KeyError):
    """No index of that name."""


class IndexInUseError(RuntimeError):
    """An index with active snapshots can't be deleted."""


class IndexManager:
    """Opens every index below ``root``; those that can't be recovered are listed in ``broken``."""

    def __init__(self, spark: SparkSession, root: str, registry: Registry | None = None) -> None:
        self.spark, self.fs, self.registry = spark, Fs(spark, root), registry or Registry()
        self.fs.make("")
        self._open: dict[str, Index] = {}
        self.broken: dict[str, str] = {}
        self._owner = f"{socket.gethostname()}:{os.getpid()}:{id(self)}"
        self._writing: set[str] = set()
        for name in self.fs.folders(""):
            if _NAME.match(name):
                try:
                    self._open[name] = Index(spark, self.fs.full(name), self.registry)
                except Exception as e:  # noqa: BLE001 - one broken index must not keep the others closed
                    self.broken[name] = str(e)[:500]

    def list_indexes(self) -> list[dict]:
        return [self.index_info(n) for n in sorted(self._open)]

    def create_index(self, name: str, schema: Schema | Mapping[str, Any]) -> Index:
        if not _NAME.match(name or ""):
            raise ValueError(f"bad index name {name!r}")
        if name in self._open or name in self.broken:
            raise FileExistsError(f"index {name} exists")
        schema = schema if isinstance(schema, Schema) else Schema.from_dict(schema)
        self._open[name] = Index.create(self.spark, self.fs.full(name), schema, registry=self.registry)
        return self._open[name]

    def get(self, name: str) -> Index:
        if name not in self._open:
            raise NoSuchIndexError(name)
        return self._open[name]

    def index_info(self, name: str) -> dict:
        return {"name": name, **self.get(name).info()}

    def delete_index(self, name: str) -> None:
        index = self.get(name)
        if index.snapshots.active:
            raise IndexInUseError(f"index {name} has {index.snapshots.active} active snapshots")
        del self._open[name]
        self.fs.delete(name)

    def acquire_writer(self, name: str) -> Index:
        """The index for writing: one writer process at a time, by a lock file; the holder may ask again."""
        index = self.get(name)
        if name not in self._writing:
            if not self.fs.create_new(f"{name}/{LOCK}", self._owner.encode()):
                raise IndexBusyError(f"index {name} is held by another writer")
            self._writing.add(name)
        return index

    def release_writer(self, name: str) -> None:
        """Drops what is not committed and gives the index free."""
        if name in self._writing:
            self._writing.discard(name)
            self.fs.delete(f"{name}/{LOCK}")
            self.get(name).abort()

    def ingest(self, name: str, docs: DataFrame | Iterable[Mapping[str, Any]]) -> int:
        """Adds documents to the next commit, as rows or as JSON objects; several batches may follow each other."""
        index = self.acquire_writer(name)
        df = docs if isinstance(docs, DataFrame) else documents_frame(self.spark, index.schema, docs)
        return index.add(df)

    def delete(self, name: str, ids: Iterable[str]) -> int:
        return self.acquire_writer(name).delete(list(ids))

    def commit(self, name: str) -> CommitResult:
        index = self.acquire_writer(name)
        result = index.commit()
        self.release_writer(name)
        return result

    def search(self, name: str, body: str | Mapping[str, Any], explain: bool = False, scorer: Scorer = Scorer(), timeout: float = 30.0, generation: int | None = None) -> dict:
        """Search of the current generation, pinned meanwhile, or of an older retained one."""
        index = self.get(name)
        snapshot, view = index.snapshot()
        try:
            view = view if generation is None else index.view(generation)
            return search(view, body, self.registry, explain, scorer, timeout, snapshot.generation if generation is None else generation)
        finally:
            index.release(snapshot)
