"""Queries over the canonical events: enrichment, analytics, recurring problems, file knowledge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.adapters import EVENTS_SQL, log_events
from quern.functions import text as T
from quern.operators import blocks, enrich

AS_OF = "2025-01-01"  # the reference date of every report
Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


_HAPPY, _SAD, _DONE = (x.replace("'", "''") for x in (enrich.SATISFACTION, enrich.FRUSTRATION, enrich.COMPLETION))
_EDIT = "role = 'tool_call' and coalesce(tool, '') in ('Edit', 'Write', 'apply_edit')"
_FLAGS = f"""with {EVENTS_SQL}, f as (
  select *, {_EDIT} as edit, coalesce(lag({_EDIT}) over (partition by session_id order by seq), false) as after_edit,
    role = 'user' and regexp_matches(content, '{_HAPPY}') as happy, role = 'user' and regexp_matches(content, '{_SAD}') as sad,
    role = 'user' and regexp_matches(content, '{_DONE}') as complete, role = 'tool_result' and regexp_matches(content, '{enrich.TOOL_ERROR}') as err,
    role = 'tool_result' and regexp_matches(content, '{enrich.TOOL_SUCCESS}') as fine,
    row_number() over (partition by session_id order by seq desc) as back from ev)"""
_OUTCOME = f"""{_FLAGS}, g as (
  select session_id, count(*) as turns, count(*) filter (where happy) as h, count(*) filter (where sad) as s, count(*) filter (where complete) as c,
    max(seq) filter (where happy) as lh, max(seq) filter (where sad) as ls, bool_or(err) as any_err, max_by(err, seq) filter (where err or fine) as last_err,
    bool_or(role = 'user') as any_user, bool_or(back = 1 and (edit or (role = 'tool_result' and after_edit))) as final_edit, bool_or(back = 1 and err) as final_err
  from f group by 1), o as (
  select session_id, turns, any_user, case when turns < 3 then -5 else 0 end + 30 * h - 25 * s + 25 * c + case when final_edit then 15 else 0 end + case when final_err then -20 else 0 end
    + case when any_err and not (lh is not null and (ls is null or lh > ls)) then -15 else 0 end + case when last_err is null then 0 when last_err then -10 else 10 end as score from g), outcomes as (
  select session_id, cast(score as bigint) as score, case when score >= 20 then 'success' when score <= -20 then 'failure' when turns < 3 and any_user then 'abandoned' else 'unknown' end as outcome from o)"""
_FACTS = f"""{_OUTCOME}, facts as (
  select e.session_id, any_value(source_agent) as source_agent, max(project) as project, min_by(model, seq) filter (where model is not null) as model, min_by(ts, seq) as started, max_by(ts, seq) as ended,
    count(*) as turns, sum(strlen(content)) as content_bytes, any_value(o.outcome) as outcome
  from ev e join outcomes o using (session_id) group by 1)"""


def session_facts(spark: SparkSession, d: str) -> DataFrame:
    """One row a session with its outcome; every report derives from it."""
    return enrich.facts(log_events(spark, d, enrich.signals())).drop("score", "unresolved")


@query("outcome_detect", f"{_OUTCOME} select session_id, score, outcome from outcomes")
def outcome_detect(spark, d):
    return enrich.outcome(log_events(spark, d, enrich.signals()))


@query("manifest", f"""with {EVENTS_SQL} select session_id, min_by(ts, seq) as started, max_by(ts, seq) as ended, count(*) as turns, min_by(role, seq) as first_role,
    max_by(role, seq) as last_role, count(distinct path) as n_files from ev group by 1""")
def manifest(spark, d):
    return enrich.manifest(log_events(spark, d, {"n_bytes": F.octet_length("content")})).select("session_id", "started", "ended", "turns", "first_role", "last_role", "n_files")


@query("content_concat", f"""with {EVENTS_SQL} select session_id, md5(string_agg(role || ': ' || case when role = 'tool_result' then left(content, 1000) else content end, chr(10) || chr(10) order by seq)) as digest from ev group by 1""")
def content_concat(spark, d):
    return enrich.content(log_events(spark, d)).select("session_id", F.md5("content").alias("digest"))


@query("summary", f"""with {EVENTS_SQL}, p as (select session_id, trim(regexp_replace(min_by(content, seq) filter (where role = 'user'), '\\s+', ' ', 'g')) as p from ev group by 1)
    select session_id, case when coalesce(p, '') = '' then 'Session with no user prompt' when length(p) <= 80 then p
    when contains(left(p, 80), ' ') then regexp_replace(left(p, 80), ' [^ ]*$', '') || '...' else left(p, 80) || '...' end as summary from p""")
def summary(spark, d):
    return enrich.summary(log_events(spark, d))


@query("signal_last_wins", f"""{_FLAGS} select session_id, coalesce(max(seq) filter (where happy), -1) as last_happy, coalesce(max(seq) filter (where sad), -1) as last_sad,
    coalesce(max(seq) filter (where happy) > coalesce(max(seq) filter (where sad), -1), false) as satisfied from f group by 1""")
def signal_last_wins(spark, d):
    g = log_events(spark, d, enrich.signals()).groupBy("session_id").agg(F.max(F.when(F.col("happy"), F.col("seq"))).alias("last_happy"), F.max(F.when(F.col("sad"), F.col("seq"))).alias("last_sad"))
    return g.na.fill(-1, ["last_happy", "last_sad"]).withColumn("satisfied", F.col("last_happy") > F.col("last_sad"))


@query("solution_window", f"""{_FLAGS}, i as (select session_id, err, row_number() over (partition by session_id order by seq) - 1 as idx from f)
    select session_id, cast(coalesce(max(idx) filter (where err), count(*) // 3) as bigint) as from_idx from i group by 1""")
def solution_window(spark, d):
    return enrich.solution_start(log_events(spark, d, enrich.signals()))


_ZERO = "{'a': 0, 's': -1, 'e': -1, 'c': 0, 'o': 0, 'i': cast(-1 as bigint), 'k': 0}"
_KEEP = "'i': x.i, 'k': 0}"


_REJECT = f"""n as (select session_id, row_number() over (partition by session_id order by seq) - 1 as i, case when role = 'tool_result' and regexp_matches(lower(content), '{enrich.ERROR_SIGNALS}') then 1
      when role = 'tool_result' then 2 when role = 'tool_call' then 3 when role = 'user' and regexp_matches(lower(content), '{enrich.POSITIVE_SIGNALS}') then 4 end as k from ev),
    l as (select session_id, list({{'a': 0, 's': -1, 'e': -1, 'c': 0, 'o': 0, 'i': i, 'k': k}} order by i) as xs from n where k is not null group by 1),
    z as (select session_id, list_reduce(list_prepend({_ZERO}, xs), lambda z, x: case when z.o = 1 then z
      when x.k = 1 then {{'a': z.a, 's': case when z.s >= 0 then z.s else cast(greatest(x.i - 5, 0) as integer) end, 'e': cast(x.i as integer), 'c': z.c + 1, 'o': 0, {_KEEP}
      when x.k = 2 then {{'a': z.a, 's': z.s, 'e': z.e, 'c': 0, 'o': 0, {_KEEP} when x.k = 3 then {{'a': z.a + case when z.c > 0 then 1 else 0 end, 's': z.s, 'e': z.e, 'c': z.c, 'o': 0, {_KEEP}
      else {{'a': 0, 's': -1, 'e': z.e, 'c': 0, 'o': case when z.a >= 2 then 1 else 0 end, {_KEEP} end) as z from l),
    rejected as (select session_id, z.s as start_idx, z.e + 1 as end_idx, z.a as attempts from z where z.o = 0 and z.a >= 2 and z.s >= 0)"""


@query("rejection_window", f"with {EVENTS_SQL}, {_REJECT} select session_id, start_idx, end_idx, attempts from rejected")
def rejection_window(spark, d):
    return enrich.rejection_windows(log_events(spark, d, enrich.step()))


def _prints() -> dict:
    return {"prints": T.error_fingerprints(F.col("content"))}


def _fingerprints(spark, d, events: DataFrame | None = None) -> DataFrame:
    """session_id, source_agent, project, role, seq, ts, fingerprint of every event; worked out where the text is read."""
    ev = log_events(spark, d, _prints()) if events is None else events
    ev = ev if "prints" in ev.columns else ev.withColumns(_prints())
    return ev.where("size(prints) > 0").select("session_id", "source_agent", "project", "role", "seq", "ts", F.explode("prints").alias("fingerprint"))


def _sql_norm(e: str) -> str:
    for p, r in T.ERROR_RULES:
        e = f"regexp_replace({e}, '{p}', '{r}', 'g')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


_PATS = [p.replace("'", "''") for p in T.ERROR_PATTERNS]
_MATCHES = "list_concat(" * (len(_PATS) - 1) + f"regexp_extract_all(content, '{_PATS[0]}', 0)" + "".join(f", regexp_extract_all(content, '{p}', 0))" for p in _PATS[1:])
_FP = f"""fp as (select distinct session_id, source_agent, project, role, seq, ts, case when strlen(n) > 200 and strlen(regexp_replace(n, ' [^ ]*$', '')) > 150 then regexp_replace(n, ' [^ ]*$', '') else n end as fingerprint
    from (select session_id, source_agent, project, role, seq, ts, {_sql_norm('m')} as n from (select session_id, source_agent, project, role, seq, ts, unnest({_MATCHES}) as m from ev)))"""


@query("err_fingerprint", f"with {EVENTS_SQL}, {_FP} select session_id, seq, fingerprint from fp")
def err_fingerprint(spark, d):
    return _fingerprints(spark, d).select("session_id", "seq", "fingerprint")


@query("escalation", f"with {EVENTS_SQL}, {_FP} select session_id, count(distinct fingerprint) as fingerprints, min(seq) as first_seq, max(seq) as last_seq from fp where role = 'tool_result' group by 1 having count(distinct fingerprint) >= 3")
def escalation(spark, d):
    return enrich.escalations(_fingerprints(spark, d).where("role = 'tool_result'"))


_RECUR = f"""{_FACTS}, {_FP}, per as (select session_id, source_agent, project, fingerprint, count(*) as n, max(ts) as last_ts from fp group by 1, 2, 3, 4)
    select fingerprint, count(*) as session_count, cast(sum(n) as bigint) as event_count, count(distinct p.project) as projects, count(distinct p.source_agent) as agents, max(last_ts) as last_seen,
      max(case when outcome = 'success' then last_ts end) as last_fix_at, max_by(p.session_id, (last_ts, p.session_id)) filter (where outcome = 'success') as last_fix_session
    from per p join facts f using (session_id) group by 1"""


@query("recurring_problems", f"{_RECUR} having count(*) >= 3")
def recurring_problems(spark, d, threshold: int = 3):
    """Errors met in at least ``threshold`` sessions, with the last session that ended well."""
    per = _fingerprints(spark, d).groupBy("session_id", "source_agent", "project", "fingerprint").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    ok = per.join(session_facts(spark, d).select("session_id", "outcome"), "session_id")
    good = F.col("outcome") == "success"
    return ok.groupBy("fingerprint").agg(
        F.count("*").alias("session_count"), F.sum("n").alias("event_count"), F.count_distinct("project").alias("projects"), F.count_distinct("source_agent").alias("agents"),
        F.max("last_ts").alias("last_seen"), F.max(F.when(good, F.col("last_ts"))).alias("last_fix_at"),
        F.max_by("session_id", F.when(good, F.struct("last_ts", "session_id"))).alias("last_fix_session")).where(F.col("session_count") >= threshold)


@query("error_patterns", f"with {EVENTS_SQL}, {_FP} select fingerprint, count(*) as n, min(ts) as first_seen, max(ts) as last_seen from fp group by 1 order by n desc, fingerprint limit 15")
def error_patterns(spark, d):
    return _fingerprints(spark, d).groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).orderBy(F.desc("n"), "fingerprint").limit(15)


@query("agg_new_errors", f"""with {EVENTS_SQL}, {_FP} select fingerprint, count(*) as n, min(ts) as first_seen from fp where ts >= timestamp '{AS_OF}'
    and fingerprint not in (select fingerprint from fp where ts < timestamp '{AS_OF}') group by 1""")
def agg_new_errors(spark, d):
    fp = _fingerprints(spark, d)
    since = F.lit(AS_OF).cast("timestamp_ntz")
    return fp.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen")).where(F.col("first_seen") >= since)


@query("alternatives_semi", f"""{_FACTS}, {_FP}, good as (select distinct session_id from (select session_id, role, content, row_number() over (partition by session_id order by seq desc) as rn from ev)
      where rn <= 5 and role = 'user' and regexp_matches(lower(content), '{enrich.POSITIVE_SIGNALS}')), p as (select distinct session_id, fingerprint from fp),
    pairs as (select distinct a.session_id, b.session_id as alternative from p a join p b using (fingerprint) where a.session_id <> b.session_id
      and a.session_id in (select session_id from facts where outcome in ('failure', 'abandoned')) and b.session_id in (select session_id from good))
    select session_id, alternative from (select *, row_number() over (partition by session_id order by alternative) as rn from pairs) where rn <= 5""")
def alternatives_semi(spark, d):
    ev = log_events(spark, d, enrich.signals() | enrich.welcome() | _prints())
    failed = enrich.outcome(ev).where("outcome in ('failure', 'abandoned')").select("session_id")
    return enrich.alternatives(_fingerprints(spark, d, ev), enrich.ended_well(ev), failed)


_RATE = "coalesce(100.0 * count(*) filter (where outcome = 'success') / nullif(count(*), 0), 0)"


def _metrics(df: DataFrame, *by: str) -> DataFrame:
    good = F.col("outcome") == "success"
    return df.groupBy(*by).agg(
        F.count("*").alias("total_sessions"), F.count_if(good).alias("success_count"), F.count_if(F.col("outcome") == "failure").alias("failure_count"), F.count_if(F.col("outcome") == "abandoned").alias("abandoned_count"),
        F.count_if(F.col("outcome") == "unknown").alias("unknown_count"), F.round(F.coalesce(F.count_if(good) * 100.0 / F.count("*"), F.lit(0.0)), 6).alias("success_rate"),
        F.round(F.coalesce(F.avg(F.when(good, F.col("turns"))), F.lit(0.0)), 6).alias("avg_turns_success"), F.round(F.coalesce(F.avg("turns"), F.lit(0.0)), 6).alias("avg_turns_all"),
        F.round(F.coalesce(F.avg(F.when(good, F.col("content_bytes") / 4.0)), F.lit(0.0)), 6).alias("avg_tokens_success"))


_METRICS = f"""count(*) as total_sessions, count(*) filter (where outcome = 'success') as success_count, count(*) filter (where outcome = 'failure') as failure_count,
    count(*) filter (where outcome = 'abandoned') as abandoned_count, count(*) filter (where outcome = 'unknown') as unknown_count, round({_RATE}, 6) as success_rate,
    round(coalesce(avg(turns) filter (where outcome = 'success'), 0), 6) as avg_turns_success, round(coalesce(avg(turns), 0), 6) as avg_turns_all,
    round(coalesce(avg(content_bytes / 4.0) filter (where outcome = 'success'), 0), 6) as avg_tokens_success"""


@query("agg_agent_metrics", f"{_FACTS} select source_agent as agent, {_METRICS} from facts group by 1")
def agg_agent_metrics(spark, d):
    return _metrics(session_facts(spark, d).withColumnRenamed("source_agent", "agent"), "agent")


@query("agg_overall", f"{_FACTS} select {_METRICS}, min(started) as period_start, max(started) as period_end from facts")
def agg_overall(spark, d):
    f = session_facts(spark, d)
    return _metrics(f.withColumn("x", F.lit(1)), "x").drop("x").crossJoin(f.agg(F.min("started").alias("period_start"), F.max("started").alias("period_end")))  # one row each


@query("agg_weekly_trend", f"{_FACTS} select cast(date_trunc('week', started) as timestamp) as week, count(*) as sessions, count(*) filter (where outcome = 'success') as success_count, round({_RATE}, 6) as success_rate from facts group by 1")
def agg_weekly_trend(spark, d):
    g = session_facts(spark, d).groupBy(F.date_trunc("week", "started").cast("timestamp_ntz").alias("week")).agg(F.count("*").alias("sessions"), F.count_if(F.col("outcome") == "success").alias("success_count"))
    return g.withColumn("success_rate", F.round(F.col("success_count") * 100.0 / F.col("sessions"), 6))


@query("agg_monthly", f"{_FACTS} select strftime(started, '%Y-%m') as month, source_agent as agent, count(*) as sessions, count(*) filter (where outcome = 'success') as success_count, cast(sum(turns) as bigint) as turns from facts group by 1, 2")
def agg_monthly(spark, d):
    return session_facts(spark, d).groupBy(F.date_format("started", "yyyy-MM").alias("month"), F.col("source_agent").alias("agent")).agg(F.count("*").alias("sessions"), F.count_if(F.col("outcome") == "success").alias("success_count"), F.sum("turns").alias("turns"))


@query("agg_growth", f"""{_FACTS}, m as (select strftime(started, '%Y-%m') as month, count(*) as n from facts group by 1)
    select min_by(n, month) as first_n, max_by(n, month) as last_n, round(100.0 * (max_by(n, month) - min_by(n, month)) / min_by(n, month), 6) as growth from m""")
def agg_growth(spark, d):
    m = session_facts(spark, d).groupBy(F.date_format("started", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    g = m.agg(F.min_by("n", "month").alias("first_n"), F.max_by("n", "month").alias("last_n"))
    return g.withColumn("growth", F.round((F.col("last_n") - F.col("first_n")) * 100.0 / F.col("first_n"), 6))


@query("agg_model_usage", f"{_FACTS} select coalesce(model, 'unknown') as model, count(*) as sessions, cast(sum(content_bytes) as bigint) as bytes, sum(content_bytes) / 4.0 as tokens, round({_RATE}, 6) as success_rate, row_number() over (order by count(*) desc, coalesce(model, 'unknown')) as place from facts group by 1")
def agg_model_usage(spark, d):
    g = session_facts(spark, d).groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(F.count("*").alias("sessions"), F.sum("content_bytes").alias("bytes"), F.count_if(F.col("outcome") == "success").alias("s"))
    place = F.row_number().over(Window.orderBy(F.desc("sessions"), "model"))  # a row a model
    return g.select("model", "sessions", "bytes", (F.col("bytes") / 4.0).alias("tokens"), F.round(F.col("s") * 100.0 / F.col("sessions"), 6).alias("success_rate"), place.alias("place"))


@query("agg_by_project", f"{_FACTS} select project, count(*) as sessions, round(100.0 * count(*) / sum(count(*)) over (), 6) as share from facts where project is not null group by 1")
def agg_by_project(spark, d):
    g = session_facts(spark, d).where("project is not null").groupBy("project").agg(F.count("*").alias("sessions"))
    return g.crossJoin(g.agg(F.sum("sessions").alias("t"))).select("project", "sessions", F.round(F.col("sessions") * 100.0 / F.col("t"), 6).alias("share"))  # one row


@query("agg_touched_files", f"with {EVENTS_SQL} select path, count(distinct session_id) as sessions from ev where path is not null group by 1 order by sessions desc, path limit 20")
def agg_touched_files(spark, d):
    p = log_events(spark, d).where("path is not null").select("path", "session_id").distinct()
    return p.groupBy("path").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "path").limit(20)


@query("file_knowledge", f"""{_FACTS}, p as (select distinct path, session_id from ev where path is not null)
    select path, count(*) as sessions, round({_RATE}, 6) as success_rate, string_agg(distinct source_agent, '|' order by source_agent) as agents, count(distinct project) as projects, max(ended) as last_touched from p join facts using (session_id) group by 1""")
def file_knowledge(spark, d):
    p = log_events(spark, d).where("path is not null").select("path", "session_id").distinct().join(session_facts(spark, d), "session_id")
    return p.groupBy("path").agg(
        F.count("*").alias("sessions"), F.round(F.count_if(F.col("outcome") == "success") * 100.0 / F.count("*"), 6).alias("success_rate"),
        F.array_join(F.array_sort(F.collect_set("source_agent")), "|").alias("agents"), F.count_distinct("project").alias("projects"), F.max("ended").alias("last_touched"))


_PT = {k: v for k, v in T.PROBLEM.items()}


def _cnt(k: str) -> str:
    return f"len(regexp_extract_all(content, '{_PT[k]}'))"


_PROBLEM = f"""with {EVENTS_SQL}, t as (select session_id, string_agg(role || ': ' || case when role = 'tool_result' then left(content, 1000) else content end, chr(10) || chr(10) order by seq) as content,
    bool_or(coalesce(regexp_matches(path, '{T.CONFIG_FILE}'), false)) as cfg, bool_or(coalesce(regexp_matches(path, '{T.DOC_FILE}'), false)) as doc from ev group by 1),
  s as (select session_id, unnest([(0, 'debug', {_cnt('debug')}), (1, 'feature', {_cnt('feature')}), (2, 'refactor', case when {_cnt('refactor')} > 0 then 2 else 0 end), (3, 'investigation', case when {_cnt('investigation')} > 0 then 2 else 0 end),
    (4, 'configuration', case when cfg then 3 else 0 end), (5, 'documentation', {_cnt('documentation')} + case when doc then 3 else 0 end)]) as x from t),
  r as (select session_id, x[2] as k, x[3] as n, row_number() over (partition by session_id order by x[3] desc, x[1]) as rn from s)"""


@query("problem_type", f"{_PROBLEM} select session_id, max(k) filter (where rn = 1) as primary_type, max(k) filter (where rn = 2 and n > 0) as secondary_type from r group by 1")
def problem_type(spark, d):
    ev = log_events(spark, d)
    files = ev.groupBy("session_id").agg(F.max(F.coalesce(F.col("path").rlike(T.CONFIG_FILE), F.lit(False))).alias("cfg"), F.max(F.coalesce(F.col("path").rlike(T.DOC_FILE), F.lit(False))).alias("doc"))
    c = enrich.content(ev).join(files, "session_id")
    return c.withColumn("t", T.problem_type(F.col("content"), F.lit(False), F.col("cfg"), F.col("doc"))).select("session_id", F.col("t.primary").alias("primary_type"), F.col("t.secondary").alias("secondary_type"))


@query("agg_problem_types", f"{_PROBLEM} select k as problem_type, count(*) as sessions, round(100.0 * count(*) / sum(count(*)) over (), 6) as share from r where rn = 1 group by 1")
def agg_problem_types(spark, d):
    g = problem_type(spark, d).groupBy(F.col("primary_type").alias("problem_type")).agg(F.count("*").alias("sessions"))
    return g.crossJoin(g.agg(F.sum("sessions").alias("t"))).select("problem_type", "sessions", F.round(F.col("sessions") * 100.0 / F.col("t"), 6).alias("share"))  # one row


@query("agg_specialization", f"{_PROBLEM} select split_part(session_id, '/', 1) as agent, k as problem_type, count(*) as sessions from r where rn = 1 group by 1, 2")
def agg_specialization(spark, d):
    return problem_type(spark, d).groupBy(F.split_part("session_id", F.lit("/"), F.lit(1)).alias("agent"), F.col("primary_type").alias("problem_type")).agg(F.count("*").alias("sessions"))


_ST = ", ".join(f"({i}, '{k}', " + " + ".join(f"{w} * cast(contains(c, '{s}') as integer)" for s in words) + ")" for i, (k, (w, words)) in enumerate(T.SESSION_SIGNALS.items()))


@query("session_type", f"""with {EVENTS_SQL}, t as (select session_id, lower(string_agg(role || ': ' || case when role = 'tool_result' then left(content, 1000) else content end, chr(10) || chr(10) order by seq)) as c from ev group by 1),
  s as (select session_id, unnest([{_ST}]) as x from t), r as (select session_id, x[2] as k, x[3] as n, row_number() over (partition by session_id order by x[3] desc, x[1] desc) as rn from s)
  select session_id, case when n = 0 then 'investigation' else k end as session_type from r where rn = 1""")
def session_type(spark, d):
    return enrich.content(log_events(spark, d)).select("session_id", T.session_type(F.col("content")).alias("session_type"))


_EXT = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.EXTENSION_TAGS.items()) + "}"
_CMD = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.COMMAND_TAGS.items()) + "}"


@query("tags", f"""with {EVENTS_SQL}, t as (select session_id, lower(tool) as tag from ev where role = 'tool_call' and tool is not null
    union all select session_id, {_EXT}[regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)] from ev where path is not null
    union all select session_id, {_CMD}[regexp_split_to_array(trim(command), '\\s+')[1]] from ev where command is not null)
    select session_id, string_agg(distinct tag, '|' order by tag) as tags from t where tag is not null group by 1""")
def tags(spark, d):
    ev = log_events(spark, d)
    found = F.array(F.when(F.col("role") == "tool_call", F.lower("tool")), T.extension_tag(F.col("path")), T.command_tag(F.col("command")))
    t = ev.select("session_id", F.explode(found).alias("tag")).where("tag is not null").distinct()
    return t.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"))


_KEYWORDS = ["docker", "cargo", "pytest", "go", "make", "npm", "git", "sql", "redis", "postgres"]


@query("tags_keyword", f"""with {EVENTS_SQL}, w as (select distinct session_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) as tag from ev where role <> 'tool_result')
    select session_id, string_agg(distinct tag, '|' order by tag) as tags from w where tag in ({', '.join(f"'{k}'" for k in _KEYWORDS)}) group by 1""")
def tags_keyword(spark, d, words: list[str] | None = None):
    """Words of a dictionary (a parameter) that a session's text holds as whole words."""
    w = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), 0))
    hit = F.array_intersect(w, F.array(*map(F.lit, words or _KEYWORDS)))
    t = log_events(spark, d).where("role <> 'tool_result'").select("session_id", F.explode(hit).alias("tag"))
    return t.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"))


_SQLPATHS = [p.replace("'", "''") for p in T.PATH_PATTERNS]
_PLIST = "list_concat(" * 4 + f"regexp_extract_all(content, '{_SQLPATHS[0]}', 1)" + "".join(f", regexp_extract_all(content, '{p}', 1))" for p in _SQLPATHS[1:])


@query("file_paths_extract", f"with {EVENTS_SQL} select session_id, seq, array_to_string(list_sort(list_distinct({_PLIST})), '|') as paths from ev where len({_PLIST}) > 0 and role <> 'tool_result'")
def file_paths_extract(spark, d):
    e = log_events(spark, d).where("role <> 'tool_result'").withColumn("p", T.file_paths(F.col("content")))
    return e.where(F.size("p") > 0).select("session_id", "seq", F.array_join("p", "|").alias("paths"))


@query("rules_commands", f"""with {EVENTS_SQL} select project, cmd as command, n from (select *, row_number() over (partition by project order by n desc, cmd) as rn from (select project, regexp_split_to_array(trim(command), '\\s+')[1] as cmd, count(*) as n from ev where command is not null and project is not null group by 1, 2)) where rn <= 5""")
def rules_commands(spark, d):
    """The commands a project uses most."""
    g = log_events(spark, d).where("command is not null and project is not null").groupBy("project", F.split(F.trim("command"), r"\s+")[0].alias("command")).agg(F.count("*").alias("n"))
    return blocks.first_of(g, ["project"], [F.desc("n"), F.asc("command")], 5)


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in T.COMPETING_TOOLS)


@query("competing_tools", f"""with {EVENTS_SQL}, c as (select regexp_split_to_array(trim(command), '\\s+')[1] as tool, count(*) as n from ev where command is not null group by 1), p(a, b) as (values {_PAIRS})
    select a, b, coalesce(x.n, 0) as n_a, coalesce(y.n, 0) as n_b, case when coalesce(x.n, 0) >= coalesce(y.n, 0) then a else b end as winner from p left join c x on x.tool = a left join c y on y.tool = b""")
def competing_tools(spark, d):
    c = log_events(spark, d).where("command is not null").groupBy(F.split(F.trim("command"), r"\s+")[0].alias("tool")).agg(F.count("*").alias("n"))
    p = spark.createDataFrame(T.COMPETING_TOOLS, "a string, b string")
    j = p.join(c.select(F.col("tool").alias("a"), F.col("n").alias("n_a")), "a", "left").join(c.select(F.col("tool").alias("b"), F.col("n").alias("n_b")), "b", "left").na.fill(0)
    return j.withColumn("winner", F.when(F.col("n_a") >= F.col("n_b"), F.col("a")).otherwise(F.col("b")))


@query("digest", f"""{_FACTS} select source_agent as agent, coalesce(project, '-') as project, count(*) as sessions, cast(sum(turns) as bigint) as turns, round({_RATE}, 6) as success_rate from facts
    where started >= timestamp '{AS_OF}' group by 1, 2""")
def digest(spark, d):
    f = session_facts(spark, d).where(F.col("started") >= F.lit(AS_OF).cast("timestamp_ntz"))
    return f.groupBy(F.col("source_agent").alias("agent"), F.coalesce("project", F.lit("-")).alias("project")).agg(
        F.count("*").alias("sessions"), F.sum("turns").alias("turns"), F.round(F.count_if(F.col("outcome") == "success") * 100.0 / F.count("*"), 6).alias("success_rate"))


@query("quarter_report", f"""{_FACTS} select year(started) || '-Q' || quarter(started) as quarter, count(*) as sessions, round({_RATE}, 6) as success_rate, count(distinct source_agent) as agents,
    count(distinct project) as projects, round(avg(turns), 6) as avg_turns from facts group by 1""")
def quarter_report(spark, d):
    f = session_facts(spark, d).withColumn("quarter", F.concat(F.year("started").cast("string"), F.lit("-Q"), F.quarter("started").cast("string")))
    return f.groupBy("quarter").agg(
        F.count("*").alias("sessions"), F.round(F.count_if(F.col("outcome") == "success") * 100.0 / F.count("*"), 6).alias("success_rate"), F.count_distinct("source_agent").alias("agents"),
        F.count_distinct("project").alias("projects"), F.round(F.avg("turns"), 6).alias("avg_turns"))


@query("gc_candidates", f"{_FACTS} select session_id, started from facts where started < timestamp '{AS_OF}' - interval 365 day")
def gc_candidates(spark, d):
    return session_facts(spark, d).where(F.col("started") < F.expr(f"timestamp_ntz'{AS_OF} 00:00:00' - interval 365 days")).select("session_id", "started")


QUERIES, SQL = Q, S
