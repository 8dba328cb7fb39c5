"""Files through Hadoop's file systems: one way for local folders, HDFS and object stores."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a path pattern matches anything."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    got = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return got is not None and len(got) > 0


class Store:
    """A folder on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(self.url(name))

    def url(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, none if it is not there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str = "") -> tuple[int, int]:
        """Files and bytes below a name."""
        if not self.exists(name):
            return 0, 0
        s = self._fs.getContentSummary(self._path(name))
        return s.getFileCount(), s.getLength()

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Write a file that must not be there yet; it appears whole or not at all.  FileExistsError if somebody else was first."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        stream = self._fs.create(self._path(part), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name) or not self._fs.rename(self._path(part), self._path(name)):
            self.delete(part)
            raise FileExistsError(self.url(name))

    def delete(self, name: str) -> None:
        if self.exists(name):
            self._fs.delete(self._path(name), True)


class Versions:
    """Numbered JSON records of what is valid; writing the next one is the commit.

    A reader takes the highest number, so it sees a commit wholly or not at
    all; of two writers that started from the same one, the second fails.
    """

    def __init__(self, store: Store, folder: str = "versions") -> None:
        self.store, self.folder = store, folder

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.store.names(self.folder) if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> tuple[int, dict[str, Any]] | None:
        numbers = self._numbers()
        return (numbers[-1], json.loads(self.store.read(f"{self.folder}/{numbers[-1]:010d}.json"))) if numbers else None

    def commit(self, after: int, record: dict[str, Any]) -> int:
        self.store.write_new(f"{self.folder}/{after + 1:010d}.json", json.dumps(record, sort_keys=True))
        return after + 1

    def forget_before(self, number: int) -> None:
        for n in self._numbers():
            if n < number:
                self.store.delete(f"{self.folder}/{n:010d}.json")
