"""Scans of log files: JSON lines, Markdown, JSON document trees, usage logs, speech results."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.adapters import EVENT_COLUMNS, canonical_role
from quern.operators import blocks, relational
from quern.sources.connector import Connector, expanded
from quern.storage import matches


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, seq, value: the lines of text files in their order.

    Large files are read in splits: lines are numbered within a split, and the
    splits' sizes are added up, so that no file is sorted as a whole.  Blank
    lines are kept (and counted) here.
    """
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    base = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return raw.withColumn("own", own).join(base, ["file", "block"]).select("file", (F.col("own") + F.col("base")).cast("bigint").alias("seq"), "value")


def stem(file: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")


def _get(path: str | None, kind: str = "string") -> Column:
    return F.lit(None).cast(kind) if not path else F.try_variant_get("v", "$." + path, kind)


def role_of(raw: Column, role_map: dict[str, str]) -> Column:
    """The connector's mapping first, then the known spellings; null for a role that is none."""
    mapped = reduce(lambda c, kv: c.when(raw == kv[0], F.lit(kv[1])), role_map.items(), F.when(F.lit(False), ""))
    return canonical_role(F.coalesce(mapped, raw))


def jsonl(spark: SparkSession, c: Connector, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Events of JSON-lines files, and per file the counts of lines, blank, unreadable and kept ones.

    A truncated last line is one unreadable line; the lines before it are kept.
    Excluded types are dropped, lines without type pass; lines of no known role
    are no events.  Missing content is the empty text.
    """
    p = c.parser
    text = lines(spark, paths)
    parsed = text.withColumn("v", F.try_parse_json("value"))
    kind = _get(c.type_field)
    keep = F.col("v").isNotNull()
    if p.get("include_types"):
        keep = keep & (kind.isNull() | kind.isin(*p["include_types"]))
    if p.get("exclude_types"):
        keep = keep & (kind.isNull() | ~kind.isin(*p["exclude_types"]))
    role = role_of(_get(p.get("role")), c.role_map)
    marked = parsed.withColumns({"role": F.when(keep, role), "blank": F.trim("value") == ""})
    counts = marked.groupBy("file").agg(F.count("*").alias("lines"), F.count_if("blank").alias("blank"), F.count_if(~F.col("blank") & F.col("v").isNull()).alias("bad"), F.count("role").alias("events"))
    named = F.coalesce(_get(p.get("session_id")), stem(F.col("file"))) if c.detection.get("session_id_from") == "field" else stem(F.col("file"))
    tool = F.when(F.col("role").isin("tool_call", "tool_result"), _get(p.get("tool")))
    project = p.get("project") or {}
    where = _get(project.get("field")) if project.get("method") == "field" else F.regexp_extract("file", r"([^/]+)/[^/]+$", 1) if project.get("method") == "parent_dir" else F.lit(None).cast("string")
    model = p.get("model") or {}
    named_model = F.lit(model.get("value")) if model.get("source") == "static" else _get(model.get("field"))
    paths_of = (p.get("file_paths") or {}).get("tool_call_field") or p.get("file_path")
    named_paths = F.coalesce(_get(paths_of, "array<string>"), F.when(_get(paths_of).isNotNull(), F.array(_get(paths_of))), F.array().cast("array<string>"))
    at = lambda k: _get(p.get(k), "bigint")
    counted = F.when(at("tokens_in").isNotNull() | at("tokens_out").isNotNull(), F.struct(at("tokens_in").alias("input"), at("tokens_out").alias("output")))
    ev = marked.where("role is not null").select(
        F.concat(F.lit(c.agent + "/"), named).alias("session_id"), F.lit(c.agent).alias("source_agent"), where.alias("project"), named_model.cast("string").alias("model"), "role",
        F.coalesce(_get(p.get("content")), F.lit("")).alias("content"), tool.alias("tool"), "seq", relational.parse_time(_get(p.get("timestamp"))).cast("timestamp_ntz").alias("ts"),
        F.get(named_paths, F.lit(0)).alias("path"), _get(p.get("command")).alias("command"), F.lit(c.static.get("source_version")).alias("source_version"), counted.alias("tokens"), named_paths.alias("file_paths"), "file",
    )
    if project.get("method") == "git_root":
        ev = git_roots(ev)
    if model.get("source") == "metadata":
        ev = model_of_metadata(spark, ev, model["path"], model.get("field", "model"))
    return ev.select(*EVENT_COLUMNS, *EXTRA_COLUMNS), counts


EXTRA_COLUMNS = ["source_version", "tokens", "file_paths"]


def git_roots(events: DataFrame) -> DataFrame:
    """Events with the nearest folder above their file that holds ``.git`` as project, null if none does.  Looked up once a folder, where Spark reads the folders' file system."""

    @F.pandas_udf("string")
    def root(folders: pd.Series) -> pd.Series:
        def up(f: str | None) -> str | None:
            here = Path(f) if f else None
            while here is not None and here != here.parent:
                if (here / ".git").exists():
                    return str(here)
                here = here.parent
            return None

        return folders.map(up).astype(object)

    folder = F.regexp_replace(F.regexp_extract("file", r"^(.*)/[^/]*$", 1), "^file:/+", "/")
    e = events.withColumn("__folder", folder)
    known = e.select("__folder").distinct().withColumn("__root", root("__folder"))
    return e.join(known, "__folder", "left").drop("project", "__folder").withColumnRenamed("__root", "project")


def model_of_metadata(spark: SparkSession, events: DataFrame, template: str, field: str) -> DataFrame:
    """Events with the model that a metadata file of their session names; ``template`` is its path with ``{session_id}``."""
    pattern = expanded(template).replace("{session_id}", "*")
    if not matches(spark, pattern):
        return events
    found = spark.read.text(pattern, wholetext=True).select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_path").alias("at"))
    head, tail = (re.escape(Path(x).name if i == 0 and not x.endswith("/") else "" if i == 0 else x) for i, x in enumerate(template.split("{session_id}")))
    ident = F.regexp_extract("at", f"{head}([^/]*){tail}$", 1)
    models = found.select(ident.alias("__id"), _get(field).alias("__model")).where("__id != '' and __model is not null").groupBy("__id").agg(F.max("__model").alias("__model"))
    own = F.regexp_extract("session_id", "^[^/]*/(.*)$", 1)
    return events.withColumn("__id", own).join(models, "__id", "left").withColumn("model", F.coalesce("model", "__model")).drop("__id", "__model")


def backfilled(events: DataFrame, project: Column | None = None, model: Column | None = None) -> DataFrame:
    """Events with project, model and file paths filled in where they lack them: from the arguments, and paths from the text."""
    from quern.functions import text as T

    said = F.filter(T.file_paths(F.col("content")), T.path_like)
    out = events.withColumns({"project": F.coalesce("project", project if project is not None else F.lit(None)), "model": F.coalesce("model", model if model is not None else F.lit(None))})
    own = F.col("file_paths") if "file_paths" in events.columns else F.when(F.col("path").isNotNull(), F.array("path"))
    return out.withColumn("file_paths", F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(said))


def split_by_gap(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Sessions of a file split where events are further apart than the gap."""
    e = relational.gap_sessions(events, "session_id", "ts", "seq", gap_seconds)
    return e.withColumn("session_id", F.concat_ws("-", "session_id", F.col("session_no").cast("string"))).drop("session_no")


def markdown(spark: SparkSession, c: Connector, paths: list[str]) -> DataFrame:
    """Events of Markdown transcripts; every delimiter line begins a session of its own."""
    p = c.parser
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    e = relational.markdown_events(files, p.get("user_prefix", ""), p.get("tool_prefix", ""), p.get("assistant_prefix", ""), c.detection.get("delimiter_pattern") or r"$^")
    many = F.max("session_no").over(Window.partitionBy("file")) > 1
    name = F.when(many, F.concat_ws("-", stem(F.col("file")), F.col("session_no").cast("string"))).otherwise(stem(F.col("file")))
    return e.select(
        F.concat(F.lit(c.agent + "/"), name).alias("session_id"), F.lit(c.agent).alias("source_agent"), F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("model"), "role", "content",
        F.lit(None).cast("string").alias("tool"), F.col("event_no").cast("bigint").alias("seq"), F.try_to_timestamp("started").cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("command"),
    )


def json_tree(spark: SparkSession, c: Connector, base: str) -> DataFrame:
    """Events of a tree of JSON documents ``session/*/*``, ``message/*/*`` and ``part/*/*`` below ``base``."""

    def docs(kind: str) -> DataFrame:
        d = spark.read.text(f"{base}/{kind}/*/*.json", wholetext=True)
        return d.select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("arrived_at")).where("v is not null")

    ident = F.coalesce(_get("id"), stem(F.col("file")))
    s = docs("session").select(ident.alias("id"), _get("messageIds", "array<string>").alias("message_ids"), "arrived_at")
    m = docs("message").select(ident.alias("id"), _get("role").alias("role"), _get("createdAt").alias("created"), _get("partIds", "array<string>").alias("part_ids"), "arrived_at")
    p = docs("part").select(ident.alias("id"), F.coalesce(_get("messageId"), F.element_at(F.split("file", "/"), -2)).alias("message_id"), _get("text").alias("text"), _get("toolName").alias("tool"), "arrived_at")
    e = relational.tree_events(s, m.drop("created"), p.drop("tool"))
    extra = p.select(F.col("id").alias("part_id"), "tool").dropDuplicates(["part_id"])
    when = m.select(F.col("id").alias("message_id"), F.try_to_timestamp("created").cast("timestamp_ntz").alias("ts")).dropDuplicates(["message_id"])
    e = e.join(extra, "part_id", "left").join(when, "message_id", "left")
    e = blocks.numbered(e, "session_id", [F.col("ts").asc_nulls_last(), "mpos", "ppos"], "seq").withColumn("role", role_of(F.col("role"), c.role_map)).where("role is not null")
    return e.select(
        F.concat(F.lit(c.agent + "/"), "session_id").alias("session_id"), F.lit(c.agent).alias("source_agent"), F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("model"), "role",
        F.coalesce("text", F.lit("")).alias("content"), "tool", "seq", "ts", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("command"),
    )


def usage_logs(spark: SparkSession, base: str) -> DataFrame:
    """Usage turns of a directory tree of JSON lines, files below ``subagents/`` left out; a text filter goes before the JSON reader."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(base)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq")).where(~F.col("file").contains("/subagents/") & F.col("value").contains("usage"))
    v = raw.withColumn("v", F.try_parse_json("value")).where("v is not null")
    u = lambda k: F.coalesce(_get(f"message.usage.{k}", "bigint"), F.lit(0))
    out = v.where(_get("type") == "assistant").select(
        "file", "seq", _get("message.id").alias("message_id"), _get("message.model").alias("model"), F.try_to_timestamp(_get("timestamp")).cast("timestamp_ntz").alias("ts"),
        u("input_tokens").alias("input_tokens"), u("output_tokens").alias("output_tokens"), u("cache_read_input_tokens").alias("cache_read"), u("cache_creation_input_tokens").alias("cache_write"),
    )
    return out.where("ts is not null")


_WORDS_A = "transcription array<struct<text:string, offsets:struct<from:bigint, to:bigint>, tokens:array<struct<text:string, p:double, offsets:struct<from:bigint, to:bigint>>>>>"
_WORDS_B = "text string, segments array<struct<text:string, start:double, `end`:double, words:array<struct<word:string, start:double, `end`:double, probability:double>>>>"


def speech(results: DataFrame) -> DataFrame:
    """file, utterances (text, start_ms, end_ms) of speech results in either of two schemas; null for neither.  ``results``: file, value."""
    a, b = F.from_json("value", "struct<" + _to_struct(_WORDS_A) + ">"), F.from_json("value", "struct<" + _to_struct(_WORDS_B) + ">")
    ua = F.transform(a["transcription"], lambda x: F.struct(F.trim(x["text"]).alias("text"), x["offsets"]["from"].alias("start_ms"), x["offsets"]["to"].alias("end_ms")))
    ub = F.transform(b["segments"], lambda x: F.struct(F.trim(x["text"]).alias("text"), (x["start"] * 1000).cast("bigint").alias("start_ms"), (x["end"] * 1000).cast("bigint").alias("end_ms")))
    return results.select("file", F.coalesce(ua, ub).alias("utterances"))


def _to_struct(fields: str) -> str:
    out, depth, name = [], 0, True
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if depth == 0 and ch == ",":
            name = True
            out.append(ch)
        elif depth == 0 and ch == " " and name and out and out[-1] not in ", ":
            out.append(":")
            name = False
        else:
            out.append(ch)
    return "".join(out)
