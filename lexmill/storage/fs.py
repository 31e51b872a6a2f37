"""Files of an index through the cluster's own file system API, and checksums by the executors."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from lexmill.storage.checksum import PREFIX


class Fs:
    """The file system that holds ``root``; paths are relative to it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def full(self, path: str) -> str:
        return f"{self.root}/{path}" if path else self.root

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.full(path))

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def names(self, path: str) -> list[str]:
        """Sorted names in a folder; none if it is missing."""
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def folders(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if s.isDirectory()) if self._fs.exists(p) else []

    def read(self, path: str) -> bytes:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        """Replaces a small file at once: written beside, made durable, then renamed over the old one."""
        beside = f"{path}.tmp"
        stream = self._fs.create(self._path(beside), True)
        try:
            stream.write(data)
            stream.hsync()
        finally:
            stream.close()
        self._replace(beside, path)

    def _replace(self, old: str, new: str) -> None:
        jvm = self._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context.rename(self._path(old), self._path(new), options)

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"could not rename {old} to {new}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def empty(self, path: str) -> int:
        """Deletes what is in a folder; a missing folder is no error."""
        found = self.names(path)
        for n in found:
            self.delete(f"{path}/{n}")
        return len(found)

    def create_new(self, path: str, data: bytes) -> bool:
        """Makes a file unless there is one."""
        if self.exists(path):
            return False
        try:
            stream = self._fs.create(self._path(path), False)
        except Exception as e:  # noqa: BLE001 - a Java exception of any file system
            if self.exists(path):
                return False
            raise OSError(str(e)) from e
        stream.write(data)
        stream.close()
        return True

    def sizes(self, path: str) -> dict[str, int]:
        """Sizes of the data files below a folder, from its listing alone."""
        out, files = {}, self._fs.listFiles(self._path(path), True)
        while files.hasNext():
            f = files.next()
            name = f.getPath().toString()
            if name.endswith(".parquet"):
                out[name.split(f"/{path}/", 1)[1]] = f.getLen()
        return out

    def checksums(self, path: str) -> dict[str, dict]:
        """Size and SHA-256 of every data file below a folder, computed where the data is read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.full(path))
        rows = files.select("path", "length", F.sha2("content", 256).alias("sha")).collect()
        return {r["path"].split(f"/{path}/", 1)[1]: {"size": r["length"], "checksum": PREFIX + r["sha"]} for r in rows}
