"""The training-data queries of the core: problems 3, 4, 5 and 6 of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import orphans, schema_drift, shredding, timestamps
from quern.session import spread, table


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "workspaces").select("cwd", "tz_name")


def _timed_rows(spark: SparkSession, d: str, keep: Column | None = None) -> DataFrame:
    """Rows of both logs as src_table, row_id, raw, tz_name, source; ``keep`` filters on ``raw`` before any join."""
    keep = F.lit(True) if keep is None else keep
    zones = _zones(spark, d)
    said = table(spark, d, "session_messages").select(F.lit("session_messages").alias("src_table"), F.col("line_id").alias("row_id"), F.col("ts_raw").alias("raw"), "cwd", F.col("collector").alias("source"))
    said = said.where(keep).join(zones, "cwd", "left").drop("cwd")
    rollout = table(spark, d, "rollout_records")
    # The header names the machine's folder; headers that disagree name none.
    header = rollout.where("rec_type = 'Meta' and cwd is not null").groupBy("source_file").agg(F.min("cwd").alias("cwd"), F.max("cwd").alias("other")).where("cwd = other").select("source_file", "cwd")
    header = header.join(zones, "cwd", "inner").select("source_file", "tz_name")
    ran = rollout.select(F.lit("rollout_records").alias("src_table"), F.col("rec_id").alias("row_id"), F.col("time_raw").alias("raw"), "source_file", F.lit("rollout").alias("source"))
    ran = ran.where(keep).join(header, "source_file", "left").drop("source_file")
    return said.unionByName(ran)


def p4_times(spark: SparkSession, d: str) -> DataFrame:
    """Every row of both logs with its instant and how it was settled."""
    done = timestamps.normalise(_timed_rows(spark, d), "raw", "tz_name", "source")
    return done.select("src_table", "row_id", "utc_micros", "time_state")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows in another notation than the two canonical ones that denote exactly one instant."""
    other = ~F.coalesce(F.col("raw").rlike(timestamps.CANONICAL), F.lit(True))
    done = timestamps.normalise(_timed_rows(spark, d, other), "raw", "tz_name", "source")
    return done.where("utc_micros is not null").select("src_table", "row_id", F.floor(F.col("utc_micros") / 1000).cast("bigint").alias("utc_ms"))


def _archive_lines(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "raw_lines").select("raw_id", "archive_id", "agent", "file_seq", "file_name", "line_no", "raw_json"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Files in which a followed field changed its carrier."""
    return p3_changes(spark, d).select("file_name", "field_name")


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(schema_drift.carriers(_archive_lines(spark, d)))


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(_archive_lines(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Files of tool calls, linked to their call and line."""
    return shredding.files(_archive_lines(spark, d))


def p5_calls(spark: SparkSession, d: str) -> DataFrame:
    return shredding.calls(_archive_lines(spark, d))


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line with whether it could be read and the numbers of its calls and files: the parent table of p5_calls."""
    at = table(spark, d, "raw_lines").select("raw_id", "archive_id", "agent", "file_name", "line_no")
    return shredding.read_lines(_archive_lines(spark, d)).join(at, "raw_id").select("raw_id", "archive_id", "agent", "file_name", "line_no", "readable", "n_calls", "n_files")


def p5_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns that the lines are shredded into, with their levels."""
    return shredding.columns(_archive_lines(spark, d))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    period = F.date_format("arrived_at", "yyyy-MM").alias("period")
    parts = table(spark, d, "oc_parts").select(F.lit("oc_parts").alias("ref_table"), period, F.col("part_id").alias("row_key"), F.col("message_id").alias("key"))
    listed = table(spark, d, "oc_sessions").select(F.lit("oc_sessions").alias("ref_table"), period, F.col("oc_session_id").alias("row_key"), F.explode("message_ids").alias("key"))
    live = table(spark, d, "oc_messages").where("deleted_at is null").select(F.col("message_id").alias("key"))
    return parts.unionByName(listed), live


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    refs, live = _references(spark, d)
    return orphans.orphan_references(refs, live).select("ref_table", "row_key", F.col("key").alias("missing_id"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Per referring table and month: keys, missing keys, references, references that lead nowhere."""
    return orphans.orphan_report(*_references(spark, d))


QUERIES = {
    "p3_found": p3_found, "p3_changes": p3_changes, "p3_table": p3_table,
    "p4_found": p4_found, "p4_times": p4_times,
    "p5_found": p5_found, "p5_calls": p5_calls, "p5_lines": p5_lines, "p5_columns": p5_columns,
    "p6_found": p6_found, "p6_report": p6_report,
}

_REFS = """
    select 'oc_parts' as ref_table, strftime(arrived_at, '%Y-%m') as period, part_id as row_key, message_id as key from oc_parts
    union all
    select 'oc_sessions', strftime(arrived_at, '%Y-%m'), oc_session_id, unnest(message_ids) from oc_sessions"""
_LIVE = "select message_id from oc_messages where deleted_at is null and message_id is not null"
SQL: dict[str, str] = {
    "p6_found": f"select distinct ref_table, row_key, key as missing_id from ({_REFS}) r where key is not null and key not in ({_LIVE})",
    "p6_report": f"""with r as (select ref_table, period, key, count(*) as n, key not in ({_LIVE}) as lost from ({_REFS}) x where key is not null group by all)
        select ref_table, period, count(*) as keys, count(*) filter (where lost) as missing_keys, cast(sum(n) as bigint) as refs,
        cast(coalesce(sum(n) filter (where lost), 0) as bigint) as missing_refs from r group by 1, 2""",
}
