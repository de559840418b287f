"""Published versions of stages and models.

A version is written to a folder of its own below a root and becomes visible when a small pointer
file is replaced in one step. What breaks off while it is written, or before the pointer moves, is never
read; readers of the version before keep their files until it is two versions old.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


@dataclass(frozen=True)
class Version:
    path: str
    fingerprint: str


class Storage:
    """Hadoop's file system below a path, whatever store that is."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(path).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._files.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Names of what lies in a folder, sorted; none if it is not there."""
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path(path))) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self._files.open(self._path(path))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write a file beside and move it over `path` in one step."""
        beside = f"{path}-{uuid.uuid4().hex}"
        stream = self._files.create(self._path(beside))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        how[0] = rename.OVERWRITE
        source = self._files.makeQualified(self._path(beside))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self._conf)
        context.rename(source, self._files.makeQualified(self._path(path)), how)

    def remove(self, path: str) -> None:
        self._files.delete(self._path(path), True)

    def remove_at_exit(self, path: str) -> None:
        """Make a folder that goes when the driver ends."""
        self._files.mkdirs(self._path(path))
        self._files.deleteOnExit(self._path(path))

    def states(self, path: str) -> list[tuple[str, int, int]]:
        """(name, length, time of writing) of a file, or of the files of a folder."""
        target = self._path(path)
        if not self._files.exists(target):
            return []
        found = [self._files.getFileStatus(target)]
        if found[0].isDirectory():
            found = [s for s in self._files.listStatus(target) if not s.getPath().getName().startswith(("_", "."))]
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found)


def fingerprint(spark: SparkSession, sources: Sequence[str] = (), options: Mapping[str, object] | None = None) -> str:
    """A digest of the inputs' files and of the options: any change of either is another one, older or newer."""
    states = {s: Storage(spark, s).states(s) for s in sources}
    return hashlib.sha256(json.dumps([states, options or {}], sort_keys=True, default=str).encode()).hexdigest()


def current(spark: SparkSession, root: str) -> Version | None:
    """The published version below `root`, if there is one."""
    storage = Storage(spark, root)
    if not storage.exists(f"{root}/{POINTER}"):
        return None
    told = json.loads(storage.read(f"{root}/{POINTER}"))
    return Version(f"{root}/{told['version']}", told["fingerprint"])


def publish(spark: SparkSession, root: str, write: Callable[[str], object], mark: str = "", keep: int = 2) -> Version:
    """Write a version by `write(path)`, point to it, and remove all but the last `keep`.

    Names rise with time, so the newest is the last by name. What an earlier run left unfinished goes too,
    once it is older than the versions that are kept.
    """
    storage = Storage(spark, root)
    name = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    write(f"{root}/{name}")
    storage.replace(f"{root}/{POINTER}", json.dumps({"version": name, "fingerprint": mark}))
    versions = [n for n in storage.names(root) if n.startswith("v") and n <= name]
    for old in versions[:-keep]:
        storage.remove(f"{root}/{old}")
    return Version(f"{root}/{name}", mark)


def materialize(make: Callable[[], DataFrame], root: str, sources: Sequence[str] = (), force: bool = False,
                spark: SparkSession | None = None, options: Mapping[str, object] | None = None) -> DataFrame:
    """Reuse a published stage unless it is missing, forced, or made from other inputs or options."""
    spark = spark or SparkSession.active()
    mark = fingerprint(spark, sources, options)
    version = current(spark, root)
    if force or version is None or version.fingerprint != mark:
        version = publish(spark, root, lambda path: make().write.parquet(path), mark)
    return spark.read.parquet(version.path)
