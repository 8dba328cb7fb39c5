"""Joins and set operations that logs need: intervals, prefixes, upserts, gap sessions, transcripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import blocks
from quern.sources.connector import PATH_HINTS, Connector, pattern_of


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, bucket_seconds: int = 86_400) -> DataFrame:
    """Points within spans of the same key, ends included.

    Spans are dealt to the time buckets they touch, so the join is an equi-join
    on key and bucket: one busy key is spread over its buckets, and only pairs
    of one bucket are compared.
    """
    b = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (bucket_seconds * 1_000_000))
    s = spans.withColumn("__b", F.explode(F.sequence(b(F.col(start)), b(F.col(end)))))
    return points.withColumn("__b", b(F.col(at))).join(s, [key, "__b"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__b")


def longest_prefix_join(rows: DataFrame, table: DataFrame, name: str, key: str) -> DataFrame:
    """Each row with the table row whose key equals its name, else the longest key that is a prefix of it, else nulls.

    The name's prefixes are exploded (one a length that keys have) and joined by
    equality, in place of comparing every name with every key.
    """
    names = rows.select(name).where(F.col(name).isNotNull()).distinct()
    prefixes = names.withColumn("__p", F.explode(F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(F.col(name), F.lit(1), i)))).where("__p != ''")
    hit = prefixes.join(table, F.col("__p") == F.col(key))
    best = hit.groupBy(name).agg(F.max_by(F.struct(*table.columns), F.length("__p")).alias("__m")).select(name, "__m.*")
    return rows.join(best, name, "left")


def prefix_join(rows: DataFrame, table: DataFrame, name: str, key: str) -> DataFrame:
    """Each row with the table row whose key equals its name, else whose key is the longest prefix of it, else whose name is a prefix of the key (the longest), else nulls.

    Both sides' prefixes are exploded and joined by equality; a name takes one
    row, equal lengths the smallest key.
    """
    names = rows.select(name).where(F.col(name).isNotNull()).distinct()
    heads = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.col(c), F.lit(1), i))
    of_name = names.where(F.length(name) > 0).withColumn("__p", F.explode(heads(name))).join(table, F.col("__p") == F.col(key))
    of_key = table.where(F.length(key) > 0).withColumn("__p", F.explode(heads(key))).join(names, F.col("__p") == F.col(name))
    rank = F.when(F.col(key) == F.col(name), 0).when(F.length(key) <= F.length(name), 1).otherwise(2)
    hit = of_name.drop("__p").unionByName(of_key.drop("__p")).withColumn("__r", F.struct(rank, -F.length(key), F.col(key)))
    best = hit.groupBy(name).agg(F.min_by(F.struct(*table.columns), "__r").alias("__m")).select(name, "__m.*")
    return rows.join(best, name, "left")


def route(changes: DataFrame, path: str, connectors: list[Connector]) -> DataFrame:
    """Changed paths with the first connector, in order of names, whose patterns they fit and whose exclusions they do not; null for none."""
    fits = lambda ps: reduce(lambda a, b: a | b, [F.col(path).rlike("^" + pattern_of(p) + "$") for p in ps], F.lit(False))
    first = F.coalesce(*[F.when(fits(c.paths) & ~fits(c.exclude), F.lit(c.name)) for c in sorted(connectors, key=lambda c: c.name)], F.lit(None).cast("string"))
    return changes.withColumn("connector", first)


def guessed(path: Column) -> Column:
    """The agent that a part of a path tells."""
    return reduce(lambda acc, h: acc.when(path.contains(h[0]), h[1]), PATH_HINTS, F.when(F.lit(False), ""))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not in the new ones, and the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti")


def gap_sessions(events: DataFrame, by: str, at: str, order: str, gap_seconds: int, block_seconds: int = 86_400) -> DataFrame:
    """Rows with the number of their session: a new one begins after a gap longer than ``gap_seconds``.

    Rows are cut into blocks of time, so that one busy key is no single task.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    e = events.withColumns({"__u": us, "__o": F.struct(us, F.col(order))})
    blk = F.floor(F.col("__u") / (block_seconds * 1_000_000))
    e = blocks.lag(e, by, "__o", ["__u"], "__p", blk)
    e = e.withColumn("__n", F.when(F.col("__u") - F.col("__p")["__u"] > gap_seconds * 1_000_000, 1).otherwise(0))
    e = blocks.running(e, by, "__o", "__n", "session_no", blk)
    return e.withColumn("session_no", F.col("session_no") + F.col("__n")).drop("__u", "__o", "__n", "__p")


def changed_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Files to read again: new ones, those modified since, and those that shrank.  Columns path, mtime, length."""
    s = state.select("path", F.col("mtime").alias("__m"), F.col("length").alias("__l"))
    return listing.join(s, "path", "left").where(F.col("__m").isNull() | (F.col("mtime") > F.col("__m")) | (F.col("length") < F.col("__l"))).drop("__m", "__l")


def tree_events(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Events of a document tree, in the order of the lists: session_id, message_id, part_id, role, text, mpos, ppos.

    ``sessions``: id, message_ids; ``messages``: id, role, part_ids; ``parts``:
    id, message_id, text.  Listed ids without a document give no event; of
    documents written again the latest counts (``arrived_at``).
    """
    def latest(df: DataFrame, *key: str) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(F.desc("arrived_at"), *[F.to_json(F.struct(*sorted(df.columns)))])
        return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "arrived_at")

    s = latest(sessions, "id").select(F.col("id").alias("session_id"), F.posexplode("message_ids").alias("mpos", "message_id"))
    m = latest(messages, "id").select(F.col("id").alias("message_id"), F.coalesce("role", F.lit("assistant")).alias("role"), F.posexplode("part_ids").alias("ppos", "part_id"))
    p = latest(parts, "id").select(F.col("id").alias("part_id"), F.col("message_id"), "text")
    return s.join(m, "message_id").join(p, ["part_id", "message_id"]).select("session_id", "message_id", "part_id", "role", "text", "mpos", "ppos")


def markdown_events(files: DataFrame, user: str = "#### ", tool: str = "> ", assistant: str = "", delimiter: str = r"^# aider chat started at (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})") -> DataFrame:
    """Events of Markdown transcripts: file, session_no, event_no, role, started, content.

    ``files``: file, text.  A line that matches the delimiter begins a session;
    a line with a role's prefix begins an event; other lines continue it.  Text
    before the first role of a session is dropped.  An empty prefix never
    matches.  The order of the prefixes is user, assistant, tool.
    """
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    starts = lambda p: F.col("line").startswith(p) if p else F.lit(False)
    role = F.when(starts(user), "user").when(starts(assistant), "assistant").when(starts(tool), "tool_result")
    cut = F.when(starts(user), F.substring("line", len(user) + 1, 1 << 30)).when(starts(assistant), F.substring("line", len(assistant) + 1, 1 << 30)).when(starts(tool), F.substring("line", len(tool) + 1, 1 << 30)).otherwise(F.col("line"))
    marked = lines.withColumns({"is_d": F.col("line").rlike(delimiter).cast("int"), "role": role, "body": cut})
    marked = marked.withColumn("starts", F.when(F.col("role").isNotNull() & (F.col("is_d") == 0), 1).otherwise(0))
    # running counts over a file's lines, in blocks
    marked = blocks.running(marked, "file", "n", "is_d", "session_no").withColumn("session_no", F.col("session_no") + F.col("is_d"))
    marked = blocks.running(marked, "file", "n", "starts", "event").withColumn("event", F.col("event") + F.col("starts"))
    begun = marked.where("is_d = 1").groupBy("file", "session_no").agg(F.max(F.regexp_extract("line", delimiter, 1)).alias("started"))
    g = marked.where("is_d = 0 and event > 0").groupBy("file", "session_no", "event").agg(F.max("role").alias("role"), F.array_sort(F.collect_list(F.struct("n", "body"))).alias("x"))
    g = g.where("role is not null")  # what stands behind a delimiter before any role belongs to nothing
    first = g.groupBy("file", "session_no").agg(F.min("event").alias("first"))
    g = g.join(first, ["file", "session_no"]).join(begun, ["file", "session_no"], "left").withColumn("event_no", F.col("event") - F.col("first") + 1)
    text = F.array_join(F.transform("x", lambda v: v["body"]), "\n")
    return g.select("file", "session_no", "event_no", "role", "started", F.regexp_replace(text, r"\s+$", "").alias("content"))


def json_path(text: Column, path: str) -> Column:
    """Value at a dotted path with array indexes (``a.b[0].c``), as text: numbers and booleans written out, null '', objects null."""
    v = F.try_variant_get(F.try_parse_json(text), "$." + path, "string")
    return v


def parse_time(raw: Column) -> Column:
    """RFC 3339, else epoch (above 1e12 milliseconds, else seconds), else null; null also beyond what a clock can show, and for a time without date."""
    number = raw.rlike(r"^\s*[+-]?\d{1,18}(\.\d+)?\s*$")
    n = F.when(number, raw.try_cast("double"))
    epoch = F.when((n > 1e12) & (n < 8.2e15), F.timestamp_millis(n.cast("bigint"))).when((n <= 1e12) & (n >= -1e12), F.timestamp_seconds(n.cast("bigint")))
    dated = raw.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}(?:$|[Tt ]\d{1,2}:\d)")
    return F.when(number, epoch).when(dated, F.try_to_timestamp(raw))
