"""Tables in segments: whole keys are added, replaced and deleted, in commits that are seen wholly or not at all.

A table is a folder of kinds (``documents``, ``events`` and the like), each a
folder of segments.  What a commit adds is a new segment; what it replaces or
deletes is named by tombstones.  Nothing that a reader may be reading is ever
changed, so neither a lost executor nor a failed job can lose rows, on any file
system.  ``optimize`` merges the segments.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.storage import Store, Versions

SEGMENT = T.StructField("segment", T.IntegerType())
TOMBSTONE = T.StructType([T.StructField("key", T.StringType()), SEGMENT])


class Segments:
    """``create(spark, path)``, ``open(spark, path)``.  Subclasses name the kinds of rows and the column that keys them."""

    kinds: dict[str, T.StructType] = {}
    key = "session_id"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)
        self._versions = Versions(self.store)
        self._depth, self._open = 0, None
        self._known: dict[tuple[str, tuple[int, ...]], DataFrame | None] = {}

    @classmethod
    def create(cls, spark: SparkSession, path: str, **settings: Any) -> Segments:
        """An empty table; one that is there is opened as it is."""
        table = cls(spark, path)
        if table._versions.latest() is None:
            table._versions.commit(0, {"segments": [], "tombstones": [], "next": 1, **settings})
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Segments:
        """The table; FileNotFoundError if there is none."""
        table = cls(spark, path)
        if table._versions.latest() is None:
            raise FileNotFoundError(f"there is no table at {path}: ingest first")
        return table

    def state(self) -> dict[str, Any]:
        return self._open[1] if self._open is not None else self._versions.latest()[1]

    def rows(self, kind: str, keep: list[str] | None = None) -> DataFrame:
        """The valid rows of a kind (without the number of their segment)."""
        state = self.state()
        got = self._read(kind, state["segments"])
        if got is None:
            return self.spark.createDataFrame([], T.StructType([f for f in self.kinds[kind].fields if f.name not in ("segment", *(keep or []))]))
        return self.alive(got, state)

    def _read(self, kind: str, numbers: list[int]) -> DataFrame | None:
        """Rows of segments of a kind; segments are folders, so others are never read.  They never change, so what was listed once is kept."""
        known = (kind, tuple(numbers))
        if known not in self._known or self._depth:
            self._known[known] = self._listed(kind, numbers)
        return self._known[known]

    def _listed(self, kind: str, numbers: list[int]) -> DataFrame | None:
        paths = [p for p in (f"{kind}/segment={n}" for n in numbers) if self.store.exists(p)]
        if not paths:
            return None
        schema = TOMBSTONE if kind == "tombstones" else self.kinds[kind]
        return self.spark.read.schema(schema).option("basePath", self.store.url(kind)).parquet(*[self.store.url(p) for p in paths])

    def alive(self, rows: DataFrame, state: dict[str, Any]) -> DataFrame:
        """Rows whose key no later segment replaced or deleted."""
        dead = self._read("tombstones", state["tombstones"])
        if dead is None:
            return rows.drop("segment")
        last = dead.groupBy(F.col("key").alias("__key")).agg(F.max("segment").alias("__dead"))
        return rows.join(last, F.col(self.key) == F.col("__key"), "left").where(F.col("__dead").isNull() | (F.col("segment") >= F.col("__dead"))).drop("segment", "__key", "__dead")

    def size(self) -> dict[str, int]:
        """Segments, files and bytes."""
        files, size = (sum(x) for x in zip(*[self.store.size(k) for k in (*self.kinds, "tombstones")]))
        return {"segments": len(self.state()["segments"]), "files": files, "bytes": size}

    # changes -------------------------------------------------------------------------------------

    @contextmanager
    def batch(self) -> Iterator[Segments]:
        """Changes inside are committed together when the outermost batch ends; an error leaves the table as it was."""
        if self._depth == 0:
            number, record = self._versions.latest()
            self._open = (number, copy.deepcopy(record), record["next"])
        self._depth += 1
        try:
            yield self
            if self._depth == 1 and self._open[1]["next"] != self._open[2]:
                record = self._open[1]
                record |= self.totals()
                self._versions.commit(self._open[0], record)
        finally:
            self._depth -= 1
            if self._depth == 0:
                self._open = None

    def totals(self) -> dict[str, Any]:
        """What else a commit records."""
        return {}

    def _next(self) -> int:
        record = self._open[1]
        record["next"] += 1
        return record["next"] - 1

    def place(self, kind: str, n: int) -> str:
        return self.store.url(f"{kind}/segment={n}")

    def write(self, rows: dict[str, DataFrame], n: int) -> None:
        """Write a segment; subclasses say how rows lie in files."""
        for kind, df in rows.items():
            df.write.mode("overwrite").parquet(self.place(kind, n))

    def bury(self, keys: DataFrame, n: int) -> None:
        keys.select(F.col(self.key).cast("string").alias("key")).where("key is not null").distinct().write.mode("overwrite").parquet(self.place("tombstones", n))
        self._open[1]["tombstones"].append(n)

    def put(self, rows: dict[str, DataFrame], whole: str) -> None:
        """Add rows; everything that the table has of the keys in the kind ``whole`` gives way to them."""
        with self.batch():
            n, record = self._next(), self._open[1]
            self.write(rows, n)
            if record["segments"]:
                self.bury(self.spark.read.schema(self.kinds[whole]).parquet(self.place(whole, n)), n)
            record["segments"].append(n)

    def delete(self, keys: DataFrame) -> None:
        """Delete all rows of the keys."""
        with self.batch():
            self.bury(keys, self._next())

    def replace_all(self, rows: dict[str, DataFrame]) -> None:
        """Nothing but these rows."""
        with self.batch():
            n, record = self._next(), self._open[1]
            self.write(rows, n)
            record["segments"], record["tombstones"] = [n], []

    def optimize(self) -> None:
        """Merge the segments into one and delete what the current version does not use (searches of older versions must have ended)."""
        with self.batch():
            state = self.state()
            if state["segments"] and (len(state["segments"]) > 1 or state["tombstones"]):
                self.replace_all({k: self.rows(k) for k in self.kinds if self._read(k, state["segments"]) is not None})
        number, record = self._versions.latest()
        for kind in (*self.kinds, "tombstones"):
            for name in self.store.names(kind):
                if name.startswith("segment=") and int(name[8:]) not in record["segments"]:
                    self.store.delete(f"{kind}/{name}")
        self._versions.forget_before(number)
