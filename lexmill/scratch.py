"""Places for intermediate tables that every executor can read, and their end.

A lineage is cut by writing Parquet below the folder the session names in
``spark.checkpoint.dir``.  Where a session names none, a local master gets a temporary folder;
any other master is an error, since executors elsewhere could not read it.

Tables made inside a :class:`Scope` are deleted at its end, but for those it keeps; what is left
goes when the process ends.
"""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import threading
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex
_roots: dict[str, tuple] = {}
_local = threading.local()


class NoSharedFolderError(RuntimeError):
    """A cluster session without ``spark.checkpoint.dir``."""


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one, set once, for a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise NoSharedFolderError("set spark.checkpoint.dir to a folder that every executor can read")
    own = tempfile.mkdtemp(prefix="lexmill-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def _delete(jvm, conf, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def _root(spark: SparkSession) -> str:
    root = f"{shared_dir(spark)}/lexmill-{_RUN}"
    if root not in _roots:
        _roots[root] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    return root


@atexit.register
def release_all() -> None:
    """Deletes everything this process still has below shared folders; frames that read it become invalid."""
    while _roots:
        root, (jvm, conf) = _roots.popitem()
        try:
            _delete(jvm, conf, root)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


class Scope:
    """``with Scope(spark) as s:`` deletes at its end what was made inside, except ``s.keep(df)``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scope:
        _scopes().append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """Hands a materialised table to the scope around this one (or to the process)."""
        path = df._lexmill_path
        self.paths.remove(path)
        outer = _scopes()[:-1]
        if outer:
            outer[-1].paths.append(path)
        return df

    def __exit__(self, *_: object) -> None:
        _scopes().remove(self)
        for path in self.paths:
            _delete(self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration(), path)


def _scopes() -> list[Scope]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


def new_path(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder; it belongs to the innermost scope."""
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes():
        _scopes()[-1].paths.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: short lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """A scanned table, dealt out again where it has fewer splits than the cluster has cores.

    Only for frames that come straight from files (no shuffle runs to count the splits).  A
    large table has more splits than cores and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


class Shared:
    """An object for Python workers: sent once per executor, decoded once per worker process."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self, keep: bool = True):
        """The object; without ``keep`` it is decoded anew each time, for objects used one after the other."""
        sent = self._sent
        if not keep:
            return pickle.loads(sent.value)
        if not hasattr(sent, "decoded"):
            sent.decoded = pickle.loads(sent.value)
        return sent.decoded
