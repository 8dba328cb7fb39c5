"""Queries of sources, joins, windows, capacity and incremental writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.adapters import EVENTS_SQL, USAGE_SQL, log_events, usage_turns
from quern.functions import text as T
from quern.operators import capacity, enrich, relational
from quern.plans import search, sessions
from quern.session import table
from quern.sources.connector import Connector
from quern.streaming import streams

Q: dict = {}
S: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def wrap(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return wrap


_USED = "input_tokens + output_tokens + cache_read + cache_write > 0"
_BILL = f"""{USAGE_SQL}, firsts as (select * from turns where message_id is null union all
    select * from turns where message_id is not null qualify row_number() over (partition by file, message_id order by seq) = 1),
  bill as (select *, cast(trunc(input_tokens + cache_read * 0.10 + cache_write * 0.25 + output_tokens * 5.0) as bigint) as cost from firsts where model <> '<synthetic>' and {_USED})"""
_NOW = "2024-01-20 12:00:00"


@add("dedupe_first", f"with {_BILL} select account, file, seq, message_id from firsts")
def dedupe_first(spark, d):
    return capacity.first_copies(usage_turns(spark, d)).select("account", "file", "seq", "message_id")


@add("cost_equiv_tokens", f"with {_BILL} select account, count(*) as turns, cast(sum(cost) as bigint) as cost from bill group by 1")
def cost_equiv_tokens(spark, d):
    return capacity.billable(usage_turns(spark, d)).groupBy("account").agg(F.count("*").alias("turns"), F.sum("cost").alias("cost"))


@add("capacity_horizons", f"""with {_BILL}, g as (select account, cast(coalesce(sum(cost) filter (where ts > timestamp '{_NOW}' - interval 1 hour), 0) as bigint) as cost_1h,
    cast(coalesce(sum(cost) filter (where ts > timestamp '{_NOW}' - interval 5 hour), 0) as bigint) as cost_5h, cast(coalesce(sum(cost) filter (where ts > timestamp '{_NOW}' - interval 7 day), 0) as bigint) as cost_7d,
    count(*) filter (where ts > timestamp '{_NOW}' - interval 5 hour) as turns_5h from bill group by 1)
  select *, round(least(100.0, cost_5h * 100.0 / 500000), 6) as use_5h, round(least(100.0, cost_7d * 100.0 / 7500000), 6) as use_7d, round(cost_1h / 60.0, 6) as burn_per_minute,
    case when cost_5h >= 500000 then 0.0 when cost_1h > 0 then round((500000 - cost_5h) / (cost_1h / 60.0), 6) end as minutes_left from g""")
def capacity_horizons(spark, d):
    return capacity.horizons(usage_turns(spark, d), _NOW, 500_000, 7_500_000)


@add("rolling_5h", f"with {_BILL} select account, seq, cast(sum(cost) over (partition by account order by epoch_us(ts) range between 17999999999 preceding and current row) as bigint) as cost_window from bill")
def rolling_5h(spark, d):
    return capacity.rolling(usage_turns(spark, d))


@add("gap_sessions", """with g as (select event_id, user_id, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) > 1800 * 1000000 then 1 else 0 end as n, ts from events)
    select event_id, user_id, cast(sum(n) over (partition by user_id order by ts, event_id) as bigint) as session_no from g""")
def gap_sessions(spark, d):
    return relational.gap_sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 1800).select("event_id", "user_id", "session_no")


@add("stream_window_counts", """select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def stream_window_counts(spark, d):
    """Event-time windows, counted by a stream over the table's files until it has read them all."""
    schema = table(spark, d, "events").schema
    s = streams.window_counts(streams.table_files(spark, f"{d}/events.parquet", schema))
    done = streams.run_to_end(s, f"windows_{uuid.uuid4().hex[:12]}", "complete")
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@add("stream_sessions", """with g as (select user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 1800 * 1000000 then 0 else 1 end as b from events), s as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, min(ts) as started, max(ts) + interval 30 minute as until, count(*) as n from s group by user_id, k""")
def stream_sessions(spark, d):
    """Gap sessions by a stream over the table's files; there are nearly as many as events.

    Windows that touch are one to Spark, so the gap is a microsecond shorter: events 30 minutes apart are two sessions.
    """
    schema = table(spark, d, "events").schema
    s = streams.sessions(streams.table_files(spark, f"{d}/events.parquet", schema), "1799999999 microseconds", None)
    length = F.unix_micros("until") - F.unix_micros("started") + 1  # of most sessions the same, which takes no room
    done = streams.run_to_files(s.select("user_id", "started", length.alias("length"), "n"), f"sessions_{uuid.uuid4().hex[:12]}")
    until = F.timestamp_micros(F.unix_micros("started") + F.col("length"))
    return done.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), until.cast("timestamp_ntz").alias("until"), "n")


@add("interval_commits", f"""{sessions._FACTS}, c as (select line_id as commit_id, received_at as ts, project from session_messages join workspaces using (cwd) where input_command like 'git %')
    select c.commit_id, f.session_id from c join facts f on c.project = f.project and c.ts between f.started and f.ended + interval 2 hour""")
def interval_commits(spark, d):
    """Version-control commands within the sessions of their project, up to two hours after the end."""
    return search.commits_in_sessions(spark, d)


@add("commit_index", f"""{sessions._FACTS}, h as (select md5(session_id) as full_hash, session_id, started from facts), k as (select full_hash as hash, session_id, started from h union all select left(full_hash, 3), session_id, started from h)
    select hash, max_by(session_id, (started, session_id)) as session_id from k group by 1""")
def commit_index(spark, d):
    """Full and short hashes to the session that started last."""
    f = sessions.session_facts(spark, d).select(F.md5("session_id").alias("h"), "session_id", "started")
    k = f.select(F.explode(F.array("h", F.left("h", F.lit(3)))).alias("hash"), "session_id", "started")
    return k.groupBy("hash").agg(F.max_by("session_id", F.struct("started", "session_id")).alias("session_id"))


_LATEST = "select * from {t} qualify row_number() over (partition by {k} order by arrived_at desc, {o}) = 1"


@add("tree_join3", """with s as (select oc_session_id as session_id, message_ids from oc_sessions qualify row_number() over (partition by oc_session_id order by arrived_at desc, to_json(message_ids)) = 1),
    m as (select message_id, msg_role, part_ids from oc_messages where message_id is not null qualify row_number() over (partition by message_id order by arrived_at desc, msg_role, to_json(part_ids)) = 1),
    p as (select part_id, message_id from oc_parts qualify row_number() over (partition by part_id order by arrived_at desc, message_id) = 1),
    se as (select session_id, unnest(message_ids) as message_id, unnest(range(len(message_ids))) as mpos from s), me as (select message_id, msg_role, unnest(part_ids) as part_id, unnest(range(len(part_ids))) as ppos from m)
    select session_id, message_id, part_id, coalesce(msg_role, 'assistant') as role, cast(mpos as integer) as mpos, cast(ppos as integer) as ppos from se join me using (message_id) join p using (part_id, message_id)""")
def tree_join3(spark, d):
    s = table(spark, d, "oc_sessions").select(F.col("oc_session_id").alias("id"), "message_ids", "arrived_at")
    m = table(spark, d, "oc_messages").where("message_id is not null").select(F.col("message_id").alias("id"), F.col("msg_role").alias("role"), "part_ids", "arrived_at")
    p = table(spark, d, "oc_parts").select(F.col("part_id").alias("id"), "message_id", F.col("part_text").alias("text"), "arrived_at")
    return relational.tree_events(s, m, p).select("session_id", "message_id", "part_id", "role", "mpos", "ppos")


_MD = """md as (select doc_id as file, 'before' || chr(10) || '# aider chat started at 2024-01-02 03:04:05' || chr(10) || replace(replace(text, '[user] ', '#### '), '$ ', '> ') || chr(10) || '# aider chat started at 2024-02-03 04:05:06' || chr(10) || 'lost' || chr(10) || '#### again ' as text from documents where source = 'aider' and text is not null),
    ml as (select file, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as n from md),
    mm as (select *, case when starts_with(line, '#### ') then 'user' when starts_with(line, '> ') then 'tool_result' end as role, regexp_matches(line, '^# aider chat started at \\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}') as is_d from ml),
    ms as (select *, sum(cast(is_d as integer)) over (partition by file order by n) as session_no from mm),
    me as (select *, count(*) filter (where role is not null and not is_d) over (partition by file, session_no order by n) as event_no, max(case when is_d then regexp_extract(line, '(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2})', 1) end) over (partition by file, session_no) as started from ms),
    mev as (select file, session_no, event_no, max(role) as role, any_value(started) as started, regexp_replace(string_agg(case when role = 'user' then substr(line, 6) when role = 'tool_result' then substr(line, 3) else line end, chr(10) order by n), '\\s+$', '') as content
      from me where not is_d and event_no > 0 group by 1, 2, 3)"""


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts in Markdown made of the texts of one source: two sessions each, text before and behind delimiters that belongs to none."""
    t = F.replace(F.replace("text", F.lit("[user] "), F.lit("#### ")), F.lit("$ "), F.lit("> "))
    whole = F.concat(F.lit("before\n# aider chat started at 2024-01-02 03:04:05\n"), t, F.lit("\n# aider chat started at 2024-02-03 04:05:06\nlost\n#### again "))
    return table(spark, d, "documents").where("source = 'aider' and text is not null").select(F.col("doc_id").alias("file"), whole.alias("text"))


@add("md_events", f"with {_MD} select file, cast(session_no as bigint) as session_no, event_no, role, started, md5(content) as digest from mev")
def md_events(spark, d):
    """Events of Markdown transcripts by the state of their lines."""
    e = relational.markdown_events(_transcripts(spark, d))
    return e.select("file", "session_no", "event_no", "role", "started", F.md5("content").alias("digest"))


@add("md_sessions", f"with {_MD} select file, count(distinct session_no) as sessions, count(*) as events from mev group by 1")
def md_sessions(spark, d):
    e = relational.markdown_events(_transcripts(spark, d))
    return e.groupBy("file").agg(F.count_distinct("session_no").alias("sessions"), F.count("*").alias("events"))


@add("md_roles", """with l as (select doc_id as file, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as n from documents where source = 'aider' and text is not null),
    m as (select *, case when starts_with(line, '#### ') then 'user' when starts_with(line, '> ') then 'tool_result' end as role, regexp_matches(line, '^# aider chat started at \\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}') as is_d from l),
    s as (select *, sum(cast(is_d as integer)) over (partition by file order by n) as session_no from m)
    select file, cast(session_no as bigint) as session_no, count(*) filter (where role = 'user' and not is_d) as users, count(*) filter (where role = 'tool_result' and not is_d) as results from s group by 1, 2 having count(*) filter (where role is not null and not is_d) > 0""")
def md_roles(spark, d):
    files = table(spark, d, "documents").where("source = 'aider' and text is not null").select(F.col("doc_id").alias("file"), "text")
    e = relational.markdown_events(files)
    return e.groupBy("file", "session_no").agg(F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "tool_result").alias("results"))


@add("json_path", "select raw_id, case when json_valid(raw_json) then json_extract_string(raw_json, '$.message.input.file_path') end as file_path from raw_lines where agent = 'claude-code' and json_valid(raw_json) and json_type(raw_json, '$.message.input.file_path') = 'VARCHAR'")
def json_path(spark, d):
    r = table(spark, d, "raw_lines").where("agent = 'claude-code'").withColumn("v", F.try_parse_json("raw_json"))
    kind = F.schema_of_variant(F.variant_get("v", "$.message.input.file_path", "variant"))
    return r.where(kind == "STRING").select("raw_id", F.try_variant_get("v", "$.message.input.file_path", "string").alias("file_path"))


@add("jsonl_scan", """select file_name, count(*) as total, count(*) filter (where trim(coalesce(raw_json, '')) = '') as blank,
    count(*) filter (where trim(coalesce(raw_json, '')) <> '' and not json_valid(raw_json)) as bad from raw_lines group by 1""")
def jsonl_scan(spark, d):
    """Lines of each file: all, blank, unreadable."""
    r = table(spark, d, "raw_lines")
    blank = F.trim(F.coalesce("raw_json", F.lit(""))) == ""
    return r.groupBy("file_name").agg(F.count("*").alias("total"), F.count_if(blank).alias("blank"), F.count_if(~blank & F.try_parse_json("raw_json").isNull()).alias("bad"))


@add("type_exclude", "select source_file, count(*) as kept from session_messages where rec_type is null or rec_type not in ('progress', 'file-history-snapshot') group by 1")
def type_exclude(spark, d):
    return table(spark, d, "session_messages").where(F.col("rec_type").isNull() | ~F.col("rec_type").isin("progress", "file-history-snapshot")).groupBy("source_file").agg(F.count("*").alias("kept"))


@add("type_include", "select rec_type, count(*) as kept from rollout_records where rec_type is null or rec_type in ('Meta') group by 1")
def type_include(spark, d):
    return table(spark, d, "rollout_records").where(F.col("rec_type").isNull() | F.col("rec_type").isin("Meta")).groupBy("rec_type").agg(F.count("*").alias("kept"))


@add("role_map", f"with {EVENTS_SQL} select source_agent, role, count(*) as n from ev group by 1, 2")
def role_map(spark, d):
    return log_events(spark, d).groupBy("source_agent", "role").agg(F.count("*").alias("n"))


@add("tool_names", f"with {EVENTS_SQL} select source_agent, tool, count(*) as n from ev where role in ('tool_call', 'tool_result') and tool is not null group by 1, 2")
def tool_names(spark, d):
    return log_events(spark, d).where(F.col("role").isin("tool_call", "tool_result") & F.col("tool").isNotNull()).groupBy("source_agent", "tool").agg(F.count("*").alias("n"))


@add("backfill", f"with {EVENTS_SQL} select session_id, coalesce(max(project), regexp_extract(session_id, '^([^/]*)/', 1)) as project, coalesce(max(model), 'unknown') as model from ev group by 1")
def backfill(spark, d):
    """Project and model of a session, filled where the events lack them."""
    g = log_events(spark, d).groupBy("session_id").agg(F.max("project").alias("p"), F.max("model").alias("m"))
    return g.select("session_id", F.coalesce("p", F.regexp_extract("session_id", "^([^/]*)/", 1)).alias("project"), F.coalesce("m", F.lit("unknown")).alias("model"))


@add("epoch_parse", """select rec_id, case when regexp_full_match(time_raw, '\\d{1,18}(\\.\\d+)?') then case when cast(time_raw as double) >= 8.2e15 then null when cast(time_raw as double) > 1e12 then cast(cast(time_raw as double) as bigint) else cast(cast(time_raw as double) as bigint) * 1000 end
    else cast(floor(epoch_us(try_cast(regexp_replace(regexp_replace(time_raw, ' ([+-]\\d\\d:|Z)', '\\1'), '(\\.\\d{6})\\d+', '\\1') as timestamptz)) / 1000) as bigint) end as ms from rollout_records""")
def epoch_parse(spark, d):
    """Times of sources as their readers take them: RFC 3339 or epochs, null for what is neither."""
    return table(spark, d, "rollout_records").select("rec_id", F.unix_millis(relational.parse_time(F.col("time_raw"))).alias("ms"))


_MODELS = [("gpt", 1), ("gpt-main", 2), ("sonnet", 3), ("o-", 4)]


@add("prefix_join", f"""with k(key, tier) as (values {', '.join(f"('{a}', {b})" for a, b in _MODELS)}), d as (select model, count(*) as n from documents where model is not null group by 1)
    select model, n, (select key from k where starts_with(model, key) order by length(key) desc limit 1) as key, coalesce((select tier from k where starts_with(model, key) order by length(key) desc limit 1), -1) as tier from d""")
def prefix_join(spark, d):
    """Models joined to a table by equality, else by their longest prefix."""
    k = spark.createDataFrame(_MODELS, "key string, tier int")
    m = table(spark, d, "documents").where("model is not null").groupBy("model").agg(F.count("*").alias("n"))
    return relational.longest_prefix_join(m, k, "model", "key").na.fill(-1, ["tier"])


@add("upsert_merge", """with o as (select doc_id, source, coalesce(n_chars, -1) as n_chars from documents where doc_id % 3 <> 0), n as (select doc_id, 'again' as source, coalesce(n_chars, -1) + 1 as n_chars from documents where doc_id % 5 = 0)
    select * from o where doc_id not in (select doc_id from n) union all select * from n""")
def upsert_merge(spark, d):
    t = table(spark, d, "documents").na.fill(-1, ["n_chars"])
    old = t.where("doc_id % 3 <> 0").select("doc_id", "source", "n_chars")
    new = t.where("doc_id % 5 = 0").select("doc_id", F.lit("again").alias("source"), (F.col("n_chars") + 1).alias("n_chars"))
    return relational.upsert(old, new, "doc_id")


@add("index_delete", "select source_file, count(*) as n from session_messages where session_id not in (select session_id from session_messages where rec_type = 'progress' and session_id is not null) group by 1")
def index_delete(spark, d):
    m = table(spark, d, "session_messages")
    return relational.delete(m, m.where("rec_type = 'progress' and session_id is not null"), "session_id").groupBy("source_file").agg(F.count("*").alias("n"))


@add("changed_files_anti", """with l as (select file_name as path, max(received_at) as mtime, count(*) as length from raw_lines group by 1), s as (select path, case when length % 2 = 0 then mtime else mtime - interval 1 hour end as mtime, length + (length % 3) as length from l where length % 7 <> 0)
    select l.path from l left join s using (path) where s.mtime is null or l.mtime > s.mtime or l.length < s.length""")
def changed_files_anti(spark, d):
    listing = table(spark, d, "raw_lines").groupBy(F.col("file_name").alias("path")).agg(F.max("received_at").alias("mtime"), F.count("*").alias("length"))
    state = listing.where("length % 7 <> 0").select("path", F.when(F.col("length") % 2 == 0, F.col("mtime")).otherwise(F.col("mtime") - F.expr("interval 1 hour")).alias("mtime"), (F.col("length") + F.col("length") % 3).alias("length"))
    return relational.changed_files(listing, state).select("path")


@add("set_union", "select cwd from session_messages where cwd is not null union select cwd from rollout_records where cwd is not null")
def set_union(spark, d):
    a, b = (table(spark, d, t).select("cwd").where("cwd is not null") for t in ("session_messages", "rollout_records"))
    return a.union(b).distinct()


@add("set_intersect", "select cwd from session_messages where cwd is not null intersect select cwd from rollout_records where cwd is not null")
def set_intersect(spark, d):
    a, b = (table(spark, d, t).select("cwd").where("cwd is not null") for t in ("session_messages", "rollout_records"))
    return a.intersect(b)


@add("set_except", "select cwd from workspaces except select cwd from rollout_records where cwd is not null")
def set_except(spark, d):
    return table(spark, d, "workspaces").select("cwd").exceptAll(table(spark, d, "rollout_records").select("cwd").where("cwd is not null").distinct())


@add("session_route", "select source_file, session_id, count(*) as n, min(line_no) as first_line from session_messages group by 1, 2 having session_id = regexp_replace(source_file, '\\.jsonl$', '')")
def session_route(spark, d):
    """Lines routed to the session that their file names."""
    m = table(spark, d, "session_messages").where(F.col("session_id") == F.regexp_replace("source_file", r"\.jsonl$", ""))
    return m.groupBy("source_file", "session_id").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


@add("status", f"with {EVENTS_SQL} select source_agent, count(distinct session_id) as sessions, count(*) as events, cast(sum(strlen(content)) as bigint) as bytes, max(ts) as last_event from ev group by 1")
def status(spark, d):
    """Sessions, events, bytes and the latest event of each agent."""
    per = log_events(spark, d).groupBy("source_agent", "session_id").agg(F.count("*").alias("e"), F.sum(F.octet_length("content")).alias("b"), F.max("ts").alias("t"))
    return per.groupBy("source_agent").agg(F.count("*").alias("sessions"), F.sum("e").alias("events"), F.sum("b").alias("bytes"), F.max("t").alias("last_event"))


@add("quarter_bounds", """select distinct year(collected_at) || '-Q' || quarter(collected_at) as quarter, date_trunc('quarter', collected_at) as first_instant, date_trunc('quarter', collected_at) + interval 3 month - interval 1 second as last_instant,
    strftime(date_trunc('quarter', collected_at), '%B %Y') as first_month from documents where collected_at is not null""")
def quarter_bounds(spark, d):
    q = table(spark, d, "documents").where("collected_at is not null").select(F.date_trunc("quarter", "collected_at").cast("timestamp_ntz").alias("q")).distinct()
    return q.select(F.concat(F.year("q").cast("string"), F.lit("-Q"), F.quarter("q").cast("string")).alias("quarter"), F.col("q").alias("first_instant"), (F.col("q") + F.expr("interval 3 months") - F.expr("interval 1 second")).alias("last_instant"), F.date_format("q", "MMMM yyyy").alias("first_month"))


@add("gotchas_join", f"""{sessions._OUTCOME}, p as (select distinct path, session_id from ev where path is not null), worst as (select path, o.session_id, row_number() over (partition by path order by o.score, o.session_id) as rn from p join outcomes o using (session_id) where outcome = 'failure')
    select path, session_id from worst where rn = 1""")
def gotchas_join(spark, d):
    """For each file the worst failed session that touched it."""
    ev = log_events(spark, d, enrich.signals())
    bad = enrich.outcome(ev).where("outcome = 'failure'")
    p = ev.where("path is not null").select("path", "session_id").distinct().join(bad, "session_id")
    return p.groupBy("path").agg(F.min_by("session_id", F.struct("score", "session_id")).alias("session_id"))


@add("order_lines", """select o_orderpriority, count(distinct o_orderkey) as orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from orders join lineitem on l_orderkey = o_orderkey join customer on c_custkey = o_custkey
    join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where l_shipdate >= timestamp '1995-01-01' group by 1""")
def order_lines(spark, d):
    """A many-way join; dimension sides are broadcast where Spark measures them small."""
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, d, "nation").select("n_nationkey", "n_regionkey"), table(spark, d, "region").select("r_regionkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("o_orderpriority").agg(F.count_distinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@add("path_fields", """select line_id, regexp_extract(input_file_path, '[^/]*$') as name, nullif(regexp_extract(regexp_extract(input_file_path, '[^/]*$'), '[^.]\\.([^.]*)$', 1), '') as extension, nullif(regexp_replace(input_file_path, '/?[^/]*$', ''), '') as parent
    from session_messages where input_file_path is not null""")
def path_fields(spark, d):
    m = table(spark, d, "session_messages").where("input_file_path is not null")
    return m.select("line_id", T.path_parts(F.col("input_file_path")).alias("p")).select("line_id", "p.*")


_EXTS = "|".join(T.FILE_EXTENSIONS)


@add("path_like", f"""select w, count(*) as n from (select unnest(regexp_split_to_array(msg_content, '\\s+')) as w from session_messages where msg_content is not null) where not regexp_matches(w, '^(?:https?|ftp)://') and not contains(w, chr(27))
    and (regexp_matches(w, '^(?:~/|\\.{{1,2}}/|/[\\p{{L}}\\p{{N}}])') or regexp_matches(w, '\\.(?:{_EXTS})$')) group by 1""")
def path_like(spark, d):
    """Words of messages that look like a file's path."""
    w = table(spark, d, "session_messages").where("msg_content is not null").select(F.explode(F.split("msg_content", r"\s+")).alias("w"))
    return w.where(T.path_like(F.col("w"))).groupBy("w").agg(F.count("*").alias("n"))


@add("resolved_paths", """select line_id, case when starts_with(input_file_path, '/') then input_file_path when starts_with(input_file_path, '~/') then '/home/me/' || substr(input_file_path, 3) when cwd is not null then regexp_replace(cwd, '/+$', '') || '/' || input_file_path else input_file_path end as path
    from session_messages where input_file_path is not null""")
def resolved_paths(spark, d):
    m = table(spark, d, "session_messages").where("input_file_path is not null")
    return m.select("line_id", T.resolve_path(F.col("input_file_path"), F.col("cwd"), F.lit("/home/me")).alias("path"))


_CONNECTORS = {"claude-code": ["/logs/**/arc*-1*.jsonl"], "codex": ["/logs/?/*.jsonl"], "rest": ["/logs/**"]}


def _connectors() -> list[Connector]:
    return [Connector(n, "1", p, "jsonl", exclude=["/logs/**/*7.jsonl"]) for n, p in _CONNECTORS.items()]


_AT = "'/logs/' || left(md5(file_name), 1) || '/' || file_name || case when file_name like '%.jsonl' then '' else '.jsonl' end"


@add("change_routes", f"""select path, case when regexp_matches(path, '^/logs/(?:.*/)?[^/]*7\\.jsonl$') then null when regexp_matches(path, '^/logs/(?:.*/)?arc[^/]*-1[^/]*\\.jsonl$') then 'claude-code'
    when regexp_matches(path, '^/logs/[^/]/[^/]*\\.jsonl$') then 'codex' when regexp_matches(path, '^/logs/.*$') then 'rest' end as connector from (select distinct {_AT} as path from raw_lines)""")
def change_routes(spark, d):
    """Changed files with the first connector whose patterns they fit."""
    ends = F.when(F.col("file_name").endswith(".jsonl"), F.lit("")).otherwise(F.lit(".jsonl"))
    p = table(spark, d, "raw_lines").select(F.concat(F.lit("/logs/"), F.left(F.md5("file_name"), F.lit(1)), F.lit("/"), "file_name", ends).alias("path")).distinct()
    return relational.route(p, "path", _connectors())


@add("guessed_agents", "select case when contains(p, '.claude') then 'claude-code' when contains(p, 'aider') then 'aider' when contains(p, 'codex') then 'codex' when contains(p, 'opencode') then 'opencode' end as agent, count(*) as n from (select '/x/.' || agent || '/' || file_name as p from raw_lines) group by 1")
def guessed_agents(spark, d):
    """Agents told by a part of the path."""
    p = table(spark, d, "raw_lines").select(F.concat(F.lit("/x/."), "agent", F.lit("/"), "file_name").alias("p"))
    return p.select(relational.guessed(F.col("p")).alias("agent")).groupBy("agent").agg(F.count("*").alias("n"))


@add("metadata_models", f"with {EVENTS_SQL}, md as (select thread_id, max(model) as model from rollout_records where thread_id is not null and model is not null group by 1) select source_file, coalesce(max(r.model), max(md.model)) as model from rollout_records r left join md using (thread_id) group by 1")
def metadata_models(spark, d):
    """Models of sessions, filled in from metadata by their id."""
    r = table(spark, d, "rollout_records").select("source_file", "thread_id", "model")
    md = r.where("thread_id is not null and model is not null").groupBy("thread_id").agg(F.max("model").alias("known"))
    return r.join(md, "thread_id", "left").groupBy("source_file").agg(F.coalesce(F.max("model"), F.max("known")).alias("model"))


@add("scrape_status", f"""with {EVENTS_SQL}, per as (select source_agent, count(distinct session_id) as sessions, count(*) as events, cast(sum(strlen(content)) as bigint) as bytes from ev group by 1),
    seen as (select agent as source_agent, count(distinct file_name) as files, max(received_at) as last_scraped from raw_lines group by 1) select source_agent, sessions, events, bytes, files, last_scraped from per left join seen using (source_agent)""")
def scrape_status(spark, d):
    """Each agent's sessions beside what was scraped of it."""
    per = log_events(spark, d, {"n_bytes": F.octet_length("content")}).groupBy("source_agent", "session_id").agg(F.count("*").alias("e"), F.sum("n_bytes").alias("b"))
    g = per.groupBy("source_agent").agg(F.count("*").alias("sessions"), F.sum("e").alias("events"), F.sum("b").alias("bytes"))
    seen = table(spark, d, "raw_lines").groupBy(F.col("agent").alias("source_agent")).agg(F.count_distinct("file_name").alias("files"), F.max("received_at").alias("last_scraped"))
    return g.join(seen, "source_agent", "left")


@add("both_prefixes", """with names as (select distinct model from documents where model is not null), k(key, tier) as (values ('gpt', 1), ('gpt-main', 2), ('sonnet', 3), ('opus-large-2', 4))
    select model, (select key from k where starts_with(model, key) or starts_with(key, model) order by case when key = model then 0 else 1 end, case when starts_with(model, key) then 0 else 1 end, length(key) desc, key limit 1) as key from names""")
def both_prefixes(spark, d):
    """Names joined to keys that are a prefix of them, or of which they are one."""
    k = spark.createDataFrame([("gpt", 1), ("gpt-main", 2), ("sonnet", 3), ("opus-large-2", 4)], "key string, tier int")
    m = table(spark, d, "documents").where("model is not null").select("model").distinct()
    return relational.prefix_join(m, k, "model", "key").select("model", "key")


@add("result_json", """select source_agent as agent, to_json({'sessions': count(distinct session_id), 'first': min(ts), 'fuzzy_fallback': null}) is not null as ok, count(*) as n from (select 'claude-code' as source_agent, session_id, received_at as ts from session_messages) group by 1""")
def result_json(spark, d):
    """Aggregates as JSON lines and back."""
    g = table(spark, d, "session_messages").groupBy(F.lit("claude-code").alias("agent")).agg(F.count_distinct("session_id").alias("sessions"), F.min("received_at").alias("first"), F.count("*").alias("n"))
    line = F.to_json(F.struct("sessions", "first"))
    back = F.from_json(line, "sessions bigint, first timestamp_ntz")
    return g.select("agent", (back["sessions"] == F.col("sessions")).alias("ok"), "n")


QUERIES, SQL = Q, S
