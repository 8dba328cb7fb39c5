"""Ingest: read what changed, normalise, and put whole sessions into the archive."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.adapters import EVENT
from quern.operators import documents, knowledge, relational
from quern.segments import SEGMENT, Segments
from quern.sources import files, sqlite
from quern.sources.connector import Connector, expanded
from quern.storage import Store, matches

#: Events as they are kept: the core columns and what some sources have besides.
ARCHIVED = T.StructType([
    *EVENT.fields, T.StructField("source_version", T.StringType()), T.StructField("tokens", T.StructType([T.StructField("input", T.LongType()), T.StructField("output", T.LongType())])),
    T.StructField("file_paths", T.ArrayType(T.StringType())),
])
PATTERN = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_events", T.LongType()), T.StructField("fingerprints", T.ArrayType(T.StringType())), T.StructField("alternatives", T.ArrayType(T.StringType()))])
SEEN = T.StructType([T.StructField("path", T.StringType()), T.StructField("mtime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("connector", T.StringType()), T.StructField("scraped", T.TimestampType())])


def as_events(df: DataFrame) -> DataFrame:
    """The columns of ``ARCHIVED``, those that are missing as nulls."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ARCHIVED.fields])


class Archive(Segments):
    """All sessions: events, sorted by session and place, in folders by agent; and beside them the anti-patterns found in them."""

    kinds = {"events": T.StructType([*ARCHIVED.fields, SEGMENT]), "antipatterns": T.StructType([*PATTERN.fields, SEGMENT])}

    def write(self, rows: dict[str, DataFrame], n: int) -> None:
        for kind, df in rows.items():
            if kind == "events":
                # by range: a session of any length is spread over as many files as its size asks for
                df = as_events(df).repartitionByRange("source_agent", "session_id", "seq").sortWithinPartitions("source_agent", "session_id", "seq")
                df.write.mode("overwrite").partitionBy("source_agent").parquet(self.place(kind, n))
            else:
                df.select(*PATTERN.fieldNames()).write.mode("overwrite").parquet(self.place(kind, n))

    def events(self, agent: str | None = None, session: str | None = None) -> DataFrame:
        """Events, of one agent or one session where asked for."""
        e = self.rows("events")
        e = e if agent is None else e.where(F.col("source_agent") == agent)
        return e if session is None else e.where(F.col("session_id") == session)

    def sessions(self, agent: str | None = None) -> DataFrame:
        """session_id, source_agent of all sessions."""
        return self.events(agent).select("session_id", "source_agent").distinct()

    def add(self, events: DataFrame) -> None:
        """Replace whole sessions; running it again changes nothing."""
        self.put({"events": events}, "events")

    def antipatterns(self) -> DataFrame:
        return self.rows("antipatterns")

    def find_antipatterns(self) -> None:
        """Work out the anti-patterns of all sessions and keep them beside the events, in a segment of their own."""
        with self.batch():
            found = knowledge.antipatterns(self.events())
            n = self._next()
            self.write({"antipatterns": found}, n)
            state = self.state()
            for old in state["segments"]:
                if old in state.get("found", []):
                    state["segments"] = [x for x in state["segments"] if x != old]
            state["segments"].append(n)
            state["found"] = [n]

    def drop_older(self, before: str) -> dict[str, int]:
        """Retention: delete sessions whose first event is older; sessions and bytes of content that went."""
        old = self.events().groupBy("session_id").agg(F.min_by("ts", "seq").alias("started"), F.sum(F.octet_length("content")).alias("bytes")).where(F.col("started") < F.lit(before).cast("timestamp_ntz"))
        got = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
        if got["n"]:
            self.delete(old)
        return {"sessions": got["n"], "bytes": got["b"]}

    def status(self, seen: Scraped | None = None) -> DataFrame:
        """source_agent, sessions, events, bytes, last_event, files, last_scraped: the archive joined to what was scraped."""
        per = self.events().groupBy("source_agent", "session_id").agg(F.count("*").alias("e"), F.sum(F.octet_length("content")).alias("b"), F.max("ts").alias("t"))
        g = per.groupBy("source_agent").agg(F.count("*").alias("sessions"), F.sum("e").alias("events"), F.sum("b").alias("bytes"), F.max("t").alias("last_event"))
        if seen is None:
            return g.withColumns({"files": F.lit(None).cast("bigint"), "last_scraped": F.lit(None).cast("timestamp")})
        s = seen.rows("files").groupBy(F.col("connector").alias("source_agent")).agg(F.count("*").alias("files"), F.max("scraped").alias("last_scraped"))
        return g.join(s, "source_agent", "left")


class Scraped(Segments):
    """What was read of each file, and when."""

    kinds = {"files": T.StructType([*SEEN.fields, SEGMENT])}
    key = "path"


@contextmanager
def locked(store: Store, timeout: float = 30.0, name: str = "scrape.lock") -> Iterator[None]:
    """One scrape at a time in a folder; TimeoutError if another does not end in time."""
    end = time.time() + timeout
    while True:
        try:
            store.write_new(name, str(time.time()))
            break
        except FileExistsError:
            if time.time() >= end:
                raise TimeoutError(f"{store.url(name)} is held by another scrape") from None
            time.sleep(min(0.2, timeout))
    try:
        yield
    finally:
        store.delete(name)


def listing(spark: SparkSession, c: Connector) -> DataFrame:
    """path, mtime, length of a connector's files, listed by Spark (in parallel, on any file system) without reading them; excluded and empty ones left out."""

    def of(patterns: list[str]) -> DataFrame:
        found = [p for p in map(expanded, patterns) if matches(spark, p)]
        if not found:
            return spark.createDataFrame([], "path string, mtime timestamp, length bigint")
        return spark.read.format("binaryFile").load(found).select("path", F.col("modificationTime").alias("mtime"), "length").distinct()

    return of(c.paths).join(of(c.exclude).select("path"), "path", "left_anti")


def changed(listed: DataFrame, seen: DataFrame, c: Connector) -> DataFrame:
    """path, mtime, length of the files to read: new, modified or shrunk ones; all of a source that rotates."""
    return listed if c.truncation_limit else relational.changed_files(listed, seen.select("path", "mtime", "length"))


def truncated(listed: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that are shorter than when they were read: path, length, was."""
    return listed.join(seen.select("path", F.col("length").alias("was")), "path").where("length < was").select("path", "length", "was")


def parse(spark: SparkSession, c: Connector, paths: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Events of files, and where lines are read the counts of bad ones."""
    if c.format == "jsonl":
        ev, counts = files.jsonl(spark, c, paths)
        return (files.split_by_gap(ev, int(c.detection.get("gap_seconds", 1800))) if c.detection.get("method") == "timestamp-gap" else ev), counts
    if c.format == "markdown":
        return files.markdown(spark, c, paths), None
    if c.format == "sqlite":
        return sqlite.events(spark, c, ",".join(p.removeprefix("file:") for p in paths)), None
    roots = {p.split("/session/")[0].split("/message/")[0].split("/part/")[0] for p in paths}
    trees = [files.json_tree(spark, c, r) for r in sorted(roots)]
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    return out, None


def ingest(spark: SparkSession, c: Connector, out: str, timeout: float = 30.0) -> dict[str, int]:
    """Read the changed files of a connector into the archive at ``out``; what was read.

    The names of the changed files come to the driver, for readers are told
    what to read.  Events are committed before the files are noted as read: a
    crash between the two reads them again, which changes nothing.
    """
    archive, seen = Archive.create(spark, f"{out}/archive"), Scraped.create(spark, f"{out}/scraped")
    with locked(seen.store, timeout):
        todo = changed(listing(spark, c), seen.rows("files"), c).collect()
        if not todo:
            return {"files": 0, "sessions": 0, "events": 0, "bad": 0}
        events, counts = parse(spark, c, [r.path for r in todo])
        archive.add(events)
        n = archive.state()["segments"][-1]
        stored = spark.read.schema(Archive.kinds["events"]).option("basePath", archive.store.url("events")).parquet(archive.place("events", n))
        got = stored.agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions")).first()
        bad = counts.agg(F.coalesce(F.sum("bad"), F.lit(0))).first()[0] if counts is not None else 0
        note = spark.createDataFrame([(r.path, r.mtime, r.length, c.agent) for r in todo], "path string, mtime timestamp, length bigint, connector string").withColumn("scraped", F.current_timestamp())
        seen.put({"files": note}, "files")
    return {"files": len(todo), "sessions": got["sessions"], "events": got["events"], "bad": bad}


def ingest_all(spark: SparkSession, connectors: list[Connector], out: str) -> dict[str, int]:
    """All connectors one after the other, their results added up."""
    total: dict[str, int] = {}
    for c in connectors:
        for k, n in ingest(spark, c, out).items():
            total[k] = total.get(k, 0) + n
    return total


def rebuild_index(archive: Archive, index: Any, agent: str | None = None, words: list[str] | None = None) -> None:
    """The index anew from the archive; with an agent only that agent's sessions are replaced."""
    ev = archive.events(agent).drop("source_version", "tokens", "file_paths")
    docs = documents.session_documents(ev, words).unionByName(documents.artifact_documents(ev), allowMissingColumns=True)
    if agent is None:
        index.rebuild(docs)
    else:
        with index.batch():
            index.delete(index.documents().where(F.col("source_agent") == agent))
            index.add(docs)
