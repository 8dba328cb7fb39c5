"""SQLite key-value stores as a Spark data source (read only, one partition a database)."""

from __future__ import annotations

import glob
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.adapters import EVENT_COLUMNS
from quern.operators import blocks
from quern.sources.connector import Connector
from quern.sources.files import role_of, stem


class SqliteSource(DataSource):
    """``spark.read.format("quern_sqlite").option("query", ...).load(path)``: file, n, key, value."""

    @classmethod
    def name(cls) -> str:
        return "quern_sqlite"

    def schema(self) -> str:
        return "file string, n bigint, key string, value string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = sorted(f for p in options["path"].split(",") for f in glob.glob(p))
        self.query = options["query"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        con = sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True)
        try:
            con.execute("pragma cache_size=-8192")
            for n, row in enumerate(con.execute(self.query)):
                key, value = (row[0], row[1]) if len(row) > 1 else (None, row[0])
                text = lambda x: x.decode("utf-8", "replace") if isinstance(x, bytes) else None if x is None else str(x)
                yield partition.value, n, text(key), text(value)
        finally:
            con.close()


def events(spark: SparkSession, c: Connector, path: str) -> DataFrame:
    """Events of key-value stores whose values are a message or an array of messages in JSON.

    Values that are no JSON are one assistant message if no role field is
    configured.  Messages of no known role and without text give no event.  The
    session is the first group of ``key_pattern`` in the key, else the file.
    """
    spark.dataSource.register(SqliteSource)
    p = c.parser
    raw = spark.read.format("quern_sqlite").option("query", p["query"]).load(path)
    if p.get("key_filter"):
        raw = raw.where(F.col("key").rlike(p["key_filter"]))
    v = F.try_parse_json("value")
    at = F.try_variant_get(v, "$." + p["content_path"], "variant") if p.get("content_path") else v
    many = F.coalesce(F.try_variant_get(at, "$", "array<variant>"), F.when(at.isNotNull(), F.array(at)))
    plain = not p.get("role")
    m = raw.withColumn("ms", many).select("file", "n", "key", "value", F.posexplode_outer("ms").alias("i", "v"))
    get = lambda k: F.try_variant_get("v", "$." + k, "string")
    role = role_of(F.coalesce(get(p.get("role", "role")), get("type"), F.when(F.col("v").isNull() & F.lit(plain), "assistant")), c.role_map)
    content = F.coalesce(get(p.get("content", "text")), F.when(F.col("v").isNull() & F.lit(plain), F.col("value")))
    when = F.try_to_timestamp(get(p.get("timestamp", "createdAt"))).cast("timestamp_ntz")
    pattern = c.detection.get("key_pattern")
    sid = F.coalesce(F.nullif(F.regexp_extract("key", pattern, 1), F.lit("")), stem(F.col("file"))) if pattern else stem(F.col("file"))
    nul = F.lit(None).cast("string")
    e = m.select(F.concat(F.lit(c.agent + "/"), sid).alias("session_id"), "file", "n", "i", role.alias("role"), content.alias("content"), when.alias("ts")).where("role is not null and content is not null and content != ''")
    e = e.withColumns({"source_agent": F.lit(c.agent), "project": nul, "model": nul, "tool": nul, "path": nul, "command": nul})
    e = blocks.numbered(e, "session_id", ["file", "n", "i"], "seq")
    return e.select(*EVENT_COLUMNS)
