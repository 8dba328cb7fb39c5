"""Canonical tables from the logs at hand: events, usage turns, commits and document sessions.

``EVENT`` is the schema every source is normalised to; ``seq`` is the place of
an event in its source, for all folds go by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import table

EVENT = T.StructType([
    T.StructField("session_id", T.StringType(), False), T.StructField("source_agent", T.StringType(), False),
    T.StructField("project", T.StringType()), T.StructField("model", T.StringType()), T.StructField("role", T.StringType(), False),
    T.StructField("content", T.StringType(), False), T.StructField("tool", T.StringType()), T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("path", T.StringType()), T.StructField("command", T.StringType()),
])
EVENT_COLUMNS = EVENT.fieldNames()
BOOKKEEPING = ["progress", "file-history-snapshot"]


def canonical_role(role: Column) -> Column:
    r = F.lower(role)
    bare = F.regexp_replace(r, "_", "")
    return F.when(r.isin("human", "user"), "user").when(r.isin("ai", "assistant"), "assistant").when(bare == "toolcall", "tool_call").when(bare == "toolresult", "tool_result").when(r == "system", "system")


def log_events(spark: SparkSession, d: str, derived: dict[str, Column] | None = None) -> DataFrame:
    """Events of the claude-code and codex logs; a message sent again counts once, rows of no role are dropped.

    ``derived`` columns are worked out on each event as it is read, before
    copies are looked for; of an event only what is used afterwards moves, so
    that flags of a text travel in place of the text.
    """
    zones = table(spark, d, "workspaces").select("cwd", "project")
    nul = F.lit(None).cast("string")
    m = table(spark, d, "session_messages").where(F.col("rec_type").isNull() | ~F.col("rec_type").isin(*BOOKKEEPING))
    a = m.select(
        F.concat(F.lit("claude-code/"), "session_id").alias("session_id"), F.lit("claude-code").alias("source_agent"), nul.alias("model"), canonical_role(F.col("msg_role")).alias("role"),
        F.coalesce("msg_content", F.lit("")).alias("content"), F.col("msg_tool").alias("tool"), F.col("line_no").cast("bigint").alias("seq"), F.col("received_at").alias("ts"),
        F.col("input_file_path").alias("path"), F.col("input_command").alias("command"), "cwd", F.coalesce("msg_uuid", F.concat(F.lit("line "), "line_id")).alias("__of"), F.col("line_id").alias("__id"),
    )
    r = table(spark, d, "rollout_records")
    header = r.where("rec_type = 'Meta'").groupBy("source_file").agg(F.min("cwd").alias("cwd"), F.min("model").alias("model"))
    b = r.where("msg_role is not null").select(
        F.concat(F.lit("codex/"), F.regexp_replace("source_file", r"\.jsonl$", "")).alias("session_id"), F.lit("codex").alias("source_agent"), canonical_role(F.col("msg_role")).alias("role"),
        F.coalesce("msg_content", F.lit("")).alias("content"), F.col("msg_tool").alias("tool"), F.col("line_no").cast("bigint").alias("seq"), F.col("received_at").alias("ts"),
        F.col("input_path").alias("path"), F.col("input_command").alias("command"), F.col("source_file").alias("__of"), F.col("rec_id").alias("__id"),
    )
    a, b = (x.withColumns(derived or {}) for x in (a, b))
    first = F.row_number().over(Window.partitionBy("session_id", "__of").orderBy("seq", "__id"))
    once = F.row_number().over(Window.partitionBy("__of", "seq").orderBy("__id"))
    a = a.withColumn("__n", first).where("__n = 1")
    b = b.withColumn("__n", once).where("__n = 1").join(header.withColumnRenamed("source_file", "__of"), "__of", "left")
    out = a.unionByName(b).where("role is not null").join(zones, "cwd", "left")
    return out.select(*EVENT_COLUMNS, *(derived or {}))


EVENTS_SQL = """raw as (
  select 'claude-code/' || session_id as session_id, 'claude-code' as source_agent, project, cast(null as varchar) as model, msg_role, coalesce(msg_content, '') as content,
    msg_tool as tool, cast(line_no as bigint) as seq, received_at as ts, input_file_path as path, input_command as command
  from (select *, row_number() over (partition by session_id, coalesce(msg_uuid, 'line ' || line_id) order by line_no, line_id) as rn from session_messages where rec_type is null or rec_type not in ('progress', 'file-history-snapshot')) m
  left join workspaces using (cwd) where rn = 1
  union all
  select 'codex/' || regexp_replace(r.source_file, '\\.jsonl$', ''), 'codex', h.project, h.model, r.msg_role, coalesce(r.msg_content, ''), r.msg_tool, cast(r.line_no as bigint), r.received_at, r.input_path, r.input_command
  from (select *, row_number() over (partition by source_file, line_no order by rec_id) as rn from rollout_records where msg_role is not null) r
  left join (select source_file, g.model, w.project from (select source_file, min(cwd) as cwd, min(model) as model from rollout_records where rec_type = 'Meta' group by 1) g left join workspaces w using (cwd)) h
  on h.source_file = r.source_file where rn = 1
), ev as (
  select * exclude (msg_role), case when lower(msg_role) in ('human', 'user') then 'user' when lower(msg_role) in ('ai', 'assistant') then 'assistant'
    when replace(lower(msg_role), '_', '') = 'toolcall' then 'tool_call' when replace(lower(msg_role), '_', '') = 'toolresult' then 'tool_result' when lower(msg_role) = 'system' then 'system' end as role
  from raw where lower(msg_role) in ('human', 'user', 'ai', 'assistant', 'system', 'tool_call', 'toolcall', 'tool_result', 'toolresult')
)"""


def usage_turns(spark: SparkSession, d: str) -> DataFrame:
    """Usage turns of accounts, from the event stream: account, file, message_id, ts, token counts."""
    e = table(spark, d, "events")
    v = F.floor(F.col("value") * 10).cast("bigint")
    return e.select(
        (F.col("user_id") % 5).alias("account"), (F.col("user_id") % 50).alias("file"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "signup", F.concat(F.lit("m"), (F.col("event_id") % 30011).cast("string"))).alias("message_id"), "ts",
        F.when(F.col("event_type") == "error", "<synthetic>").otherwise("model-a").alias("model"),
        v.alias("input_tokens"), (v % 7 * 10).alias("output_tokens"), (v % 11 * 5).alias("cache_read"), (v % 3 * 20).alias("cache_write"),
    )


USAGE_SQL = """turns as (
  select user_id % 5 as account, user_id % 50 as file, event_id as seq, case when event_type <> 'signup' then 'm' || (event_id % 30011) end as message_id, ts,
    case when event_type = 'error' then '<synthetic>' else 'model-a' end as model, cast(floor(value * 10) as bigint) as input_tokens,
    cast(floor(value * 10) as bigint) % 7 * 10 as output_tokens, cast(floor(value * 10) as bigint) % 11 * 5 as cache_read, cast(floor(value * 10) as bigint) % 3 * 20 as cache_write
  from events)"""
