"""Structured Streaming: incremental ingest, event-time windows, gap sessions, debouncing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quern.adapters import EVENT
from quern.ingest import Archive, ingest
from quern.session import shared_folder
from quern.sources.connector import Connector, expanded
from quern.storage import Store

#: State in files beside the executors, with a bounded share of their memory, in place of their heaps.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "64",
}


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less UTC times as timestamps, which watermarks need (the session's zone is UTC)."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def table_files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The files of a Parquet table, one file or a folder of them, as a stream."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, for a stream's path may be no single file


def window_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; rows later than the watermark are left out."""
    e = timed(events).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Gap sessions of each user; without ``late`` no row is left out (mode complete only)."""
    e = timed(events)
    e = e.withWatermark("ts", late) if late else e
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("until"), "n")


def ingest_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Event files that land in a folder, put into the archive at ``out`` by session.

    A micro-batch replaces the sessions it holds, so a batch that runs again
    after a failure leaves the same archive.
    """
    s = spark.readStream.schema(EVENT).parquet(landing)
    return s.writeStream.foreachBatch(lambda df, _: Archive.create(spark, out).add(df)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch(spark: SparkSession, connectors: list[Connector], out: str, checkpoint: str, trigger: dict | None = None, done: Callable[[dict], None] | None = None) -> list[StreamingQuery]:
    """One stream a connector over the files that its patterns match: each trigger lists them again, and every changed file is scraped into ``out``.

    The stream tells that something changed; what changed is asked of the
    listing (new, modified, shrunk, rotated), and the archive takes whole
    sessions, so a trigger that runs again does no harm.  ``done`` gets each
    scrape's counts.
    """

    def scrape(c: Connector) -> Callable[[DataFrame, int], None]:
        def run(_: DataFrame, __: int) -> None:
            got = ingest(spark, c, out)
            if done:
                done(got)

        return run

    out_ = []
    for c in connectors:
        s = spark.readStream.format("text").schema("value string").option("wholetext", "true").load(",".join(map(expanded, c.paths)) if len(c.paths) == 1 else common(c.paths))
        out_.append(s.writeStream.foreachBatch(scrape(c)).option("checkpointLocation", f"{checkpoint}/{c.name}").trigger(**(trigger or {"availableNow": True})).start())
    return out_


def common(patterns: list[str]) -> str:
    """One pattern for several: alternatives in braces."""
    return "{" + ",".join(map(expanded, patterns)) + "}"


class Counters(StreamingQueryListener):
    """Batches, rows and the time of the last batch, by stream."""

    def __init__(self) -> None:
        self.batches: dict[str, int] = {}
        self.rows: dict[str, int] = {}
        self.last: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        k = p.name or str(p.id)
        self.batches[k] = self.batches.get(k, 0) + 1
        self.rows[k] = self.rows.get(k, 0) + p.numInputRows
        self.last[k] = p.timestamp

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass


def debounce(changes: DataFrame, quiet_ms: int = 5_000) -> DataFrame:
    """path, changes: a path once nothing changed on it for ``quiet_ms`` (processing time).  ``changes``: path."""

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0]
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "changes": [n]})
        else:
            n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
            state.update((n,))
            state.setTimeoutDuration(quiet_ms)

    return changes.groupBy("path").applyInPandasWithState(settle, "path string, changes bigint", "n bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_to_end(df: DataFrame, name: str, mode: str = "append", after: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over what is there into a table in memory (tests, bounded replays, small results)."""
    at = f"{shared_folder(df.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    if after:
        after()
    return df.sparkSession.table(name)


def run_to_files(df: DataFrame, name: str) -> DataFrame:
    """Run a stream in mode complete over what is there into Parquet files of the shared folder: its whole result, of any size, and nothing of it on the driver.

    Every batch holds the whole result, so the last one counts, and a batch
    that runs again replaces its own files.  The checkpoint goes when the
    stream has ended; the rows stay as long as the shared folder.
    """
    spark = df.sparkSession
    store = Store(spark, f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(store.url(f"rows/{n}"))
        for old in store.names("rows"):
            if old != str(n):
                store.delete(f"rows/{old}")

    was = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        q = df.writeStream.foreachBatch(keep).queryName(name).outputMode("complete").option("checkpointLocation", store.url("checkpoint")).trigger(availableNow=True).start()  # with a copy of the session's settings
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    store.delete("checkpoint")
    rows = [store.url(f"rows/{n}") for n in store.names("rows")]
    return spark.read.schema(df.schema).parquet(*rows) if rows else spark.createDataFrame([], df.schema)
