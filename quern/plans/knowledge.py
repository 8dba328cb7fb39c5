"""Queries of what many sessions together tell: anti-patterns, files, rules, recurring errors, reports by filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.adapters import log_events
from quern.functions import text as T
from quern.operators import enrich, knowledge
from quern.plans import sessions
from quern.plans.search import _PROMPT
from quern.session import table

Q: dict = {}
S: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def wrap(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return wrap


def _events(spark: SparkSession, d: str) -> DataFrame:
    return log_events(spark, d, knowledge.read())


_GOOD = f"""good as (select distinct session_id from (select session_id, role, content, row_number() over (partition by session_id order by seq desc) as rn from ev)
      where rn <= 5 and role = 'user' and regexp_matches(lower(content), '{enrich.POSITIVE_SIGNALS}'))"""
_ANTI = f"""{sessions._FACTS}, {sessions._FP}, {_GOOD}, {sessions._REJECT}, pos as (select session_id, seq, row_number() over (partition by session_id order by seq) - 1 as idx from ev),
    fpi as (select fp.session_id, fp.role, fingerprint, idx from fp join pos using (session_id, seq)), failed as (select session_id from facts where outcome in ('failure', 'abandoned')),
    spans as (select session_id, 'rejection' as kind, cast(attempts as bigint) as n, start_idx as a, end_idx - 1 as b from rejected where session_id in (select session_id from failed)
      union all select session_id, 'escalation', count(distinct fingerprint), min(idx), max(idx) from fpi where role = 'tool_result' and session_id in (select session_id from failed) group by 1 having count(distinct fingerprint) >= 3),
    met as (select distinct s.session_id, kind, fingerprint from spans s join fpi f on f.session_id = s.session_id and idx between a and b),
    alt as (select session_id, kind, other from (select *, row_number() over (partition by session_id, kind order by other) as rn from (select distinct m.session_id, m.kind, f.session_id as other from met m join (select distinct session_id, fingerprint from fp) f using (fingerprint)
      where f.session_id <> m.session_id and f.session_id in (select session_id from good))) where rn <= 5),
    antis as (select session_id, kind, n, b - a + 1 as n_events, coalesce((select string_agg(fingerprint, '|' order by fingerprint) from met m where m.session_id = s.session_id and m.kind = s.kind), '') as fingerprints,
      coalesce((select string_agg(other, '|' order by other) from alt x where x.session_id = s.session_id and x.kind = s.kind), '') as alternatives,
      case when kind = 'rejection' then n || ' attempts in vain over ' || (b - a + 1) || ' events' else n || ' kinds of errors within ' || (b - a + 1) || ' events' end as pattern from spans s)"""


@add("antipatterns", f"{_ANTI} select session_id, kind, n, cast(n_events as bigint) as n_events, fingerprints, alternatives from antis")
def antipatterns(spark, d):
    a = knowledge.antipatterns(_events(spark, d))
    return a.withColumns({c: F.array_join(c, "|") for c in ("fingerprints", "alternatives")})


@add("file_gotchas", f"""{_ANTI}, p as (select distinct path, session_id from ev where path is not null)
    select path, pattern, session_id, alternatives from (select *, row_number() over (partition by path, pattern order by session_id, kind) as rn from p join antis using (session_id)) where rn = 1""")
def file_gotchas(spark, d):
    """What went wrong in sessions that touched a file, each description once."""
    ev = _events(spark, d)
    g = knowledge.file_gotchas(knowledge.touched(ev), knowledge.antipatterns(ev))
    return g.withColumn("alternatives", F.array_join("alternatives", "|"))


@add("file_errors", f"""{sessions._FACTS}, {sessions._FP}, p as (select distinct path, session_id from ev where path is not null)
    select path, fingerprint, count(*) as sessions, max(started) as last_seen from p join (select distinct session_id, fingerprint from fp) using (session_id) join facts using (session_id) group by 1, 2""")
def file_errors(spark, d):
    ev = _events(spark, d)
    prints = ev.where("size(prints) > 0").select("session_id", F.explode("prints").alias("fingerprint"))
    return knowledge.file_errors(knowledge.touched(ev), enrich.facts(ev), prints)


@add("file_samples", f"""{sessions._FACTS}, p as (select distinct path, session_id from ev where path is not null)
    select path, session_id, started from (select path, session_id, started, row_number() over (partition by path order by started desc, session_id) as rn from p join facts using (session_id)) where rn <= 5""")
def file_samples(spark, d):
    """The five most recent sessions of each file."""
    ev = log_events(spark, d, enrich.signals())
    return knowledge.file_samples(knowledge.touched(ev), enrich.facts(ev))


_WORD = "regexp_split_to_array(trim(coalesce(command, content)), '\\s+')"
_HABITS = f"""shown as (
    select project, 'command' as kind, case when {_WORD}[1] in ('$', '#') then {_WORD}[2] else {_WORD}[1] end as value from ev where role = 'tool_call' and tool = 'Bash'
    union all select project, 'tool', lower(tool) from ev where role = 'tool_call' union all select project, 'extension', lower(regexp_extract(path, '[^.]*$')) from ev where path is not null
    union all select project, 'fence', lower(f) from (select project, unnest(regexp_extract_all(content, '```([a-zA-Z0-9_+#-]+)', 1)) as f from ev) where lower(f) not in ('text', 'plaintext')
    union all select project, 'error', fingerprint from fp
    union all select project, 'test', part from (select project, unnest(string_split(path, '/')) as part from ev where path is not null) where part in ('tests', '__tests__', 'spec', 'specs')
    union all select project, 'test', part || '_files' from (select project, unnest(string_split(path, '/')) as part from ev where path is not null) where starts_with(part, 'test_') or ends_with(part, '_test')),
  counted as (select project, kind, value, count(*) as n from shown where project is not null and value is not null and value <> '' group by 1, 2, 3)"""


@add("habits", f"with {sessions.EVENTS_SQL}, {sessions._FP}, {_HABITS} select project, kind, value, n from counted")
def habits(spark, d):
    """Commands, tools, fence languages, extensions, errors and test folders of each project."""
    return knowledge.habits(log_events(spark, d, knowledge.shown()))


_TOP = "(select *, row_number() over (partition by project, kind order by n desc, value) as rk from counted)"
_SHORT = """case when length(value) <= 100 then value when regexp_extract(value, '^[^:]*:') <> '' and 100 - length(regexp_extract(value, '^[^:]*:')) - 4 > 10
    then regexp_extract(value, '^[^:]*:') || substr(value, length(regexp_extract(value, '^[^:]*:')) + 1, 100 - length(regexp_extract(value, '^[^:]*:')) - 4) || '...' else left(value, 97) || '...' end"""
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in T.COMPETING_TOOLS)
_BUILDS = ", ".join(f"'{t}'" for t in knowledge.BUILD_TOOLS)


@add("rules", f"""with {sessions.EVENTS_SQL}, {sessions._FP}, {_HABITS}, pairs(a, b) as (values {_PAIRS}), c as (select project, value, n from counted where kind = 'command'), said as (
    select x.project, 2 as rank, 'convention' as category, 'Use ' || a || ', not ' || b || ' (' || x.n || ' times against ' || coalesce(y.n, 0) || ')' as rule, x.n from pairs join c x on x.value = a left join c y on y.value = b and y.project = x.project where x.n > coalesce(y.n, 0)
    union all select project, 3, 'warning', 'Comes back: ' || {_SHORT} || ' (' || n || ' times)', n from {_TOP} where kind = 'error' and rk <= 5 and n >= 2
    union all select project, 4, 'context', 'Main language: ' || value, n from {_TOP} where kind = 'fence' and rk <= 3 and n >= 2
    union all select project, 4, 'context', 'Built with ' || value, n from c where value in ({_BUILDS}) and n >= 2
    union all select project, 4, 'context', case when ends_with(value, '_files') then 'Test files are named like ' || regexp_replace(value, '_files$', '') else 'Tests are in ' || value end, n from {_TOP} where kind = 'test' and rk = 1)
    select project, category, rule, row_number() over (partition by project order by rank, n desc, rule) as place from (select project, rank, category, rule, max(n) as n from said group by all)""")
def rules(spark, d):
    """Rules of all projects (no user of these logs corrects anything; ``corrections`` has the rest)."""
    ev = log_events(spark, d, {**knowledge.shown(), "told": F.when(F.col("role") == "user", T.corrections(F.col("content")))})
    told = ev.where("size(told) > 0").select("project", F.explode("told").alias("correction")).groupBy("project", "correction").agg(F.count("*").alias("n"))
    return knowledge.rules(knowledge.habits(ev), told)


_TOLD = """case line_no % 6 when 0 then 'Please don''t use ' || w || ' here, use make.' when 1 then 'use ' || w || ' instead of make!' when 2 then 'You should always use ' || w || ', ok?' when 3 then 'never use ' || w || '.'
    when 4 then 'I prefer ' || w || ' over make' else w || ' is not preferred' end"""
_FOUND = ", ".join(f"trim(regexp_replace(trim(regexp_extract(t, '{p.replace(chr(39), chr(39) * 2)}')), '[.!?,]+$', ''))" for p in T.CORRECTIONS)


@add("corrections", f"""with s as (select cwd, {_TOLD} as t from (select cwd, line_no, regexp_split_to_array(trim(input_command), '\\s+')[1] as w from session_messages where input_command is not null)),
    c as (select distinct cwd, t, unnest([{_FOUND}]) as correction from s) select correction, count(*) as n from (select s.cwd, s.t, c.correction from s join (select distinct t, correction from c) c using (t)) where strlen(correction) between 5 and 200 group by 1""")
def corrections(spark, d):
    """Corrections in sentences made of the commands of the logs (no user of these logs corrects anything)."""
    w = F.split(F.trim("input_command"), r"\s+")[0]
    k = F.col("line_no") % 6
    say = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    t = F.when(k == 0, say("Please don't use ", w, " here, use make.")).when(k == 1, say("use ", w, " instead of make!")).when(k == 2, say("You should always use ", w, ", ok?")).when(k == 3, say("never use ", w, "."))
    t = t.when(k == 4, say("I prefer ", w, " over make")).otherwise(say(w, " is not preferred"))
    m = table(spark, d, "session_messages").where("input_command is not null").select(F.explode(T.corrections(t)).alias("correction"))
    return m.groupBy("correction").agg(F.count("*").alias("n"))


_LISTS = f"""{sessions._FACTS}, {sessions._FP}, per as (select p.session_id, p.source_agent, p.project, fingerprint, count(*) as n, max(ts) as last_ts from fp p join facts f using (session_id) where f.started >= timestamp '2024-06-01' and fingerprint <> '' group by 1, 2, 3, 4),
    listed as (select fingerprint, count(*) as session_count, cast(sum(n) as bigint) as event_count, coalesce(string_agg(distinct p.project, '|' order by p.project), '') as projects, string_agg(distinct p.source_agent, '|' order by p.source_agent) as agents,
      coalesce(string_agg(distinct p.source_agent, '|' order by p.source_agent) filter (where outcome = 'success'), '') as fix_agents, max(last_ts) as last_seen from per p join facts f using (session_id) group by 1)"""


def _recurring(spark: SparkSession, d: str, since: str, threshold: int) -> DataFrame:
    """Errors of sessions begun since a time, with the projects, agents and agents that fixed them."""
    ev = log_events(spark, d, enrich.signals() | {"prints": T.error_fingerprints(F.col("content"))})
    facts = knowledge.narrowed(enrich.facts(ev), since=since).select("session_id", "outcome")
    per = ev.where("size(prints) > 0").select("session_id", "source_agent", "project", "ts", F.explode("prints").alias("fingerprint")).where("fingerprint != ''")
    per = per.groupBy("session_id", "source_agent", "project", "fingerprint").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).join(facts, "session_id")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    g = per.groupBy("fingerprint").agg(
        F.count("*").alias("session_count"), F.sum("n").alias("event_count"), names("project").alias("projects"), names("source_agent").alias("agents"),
        names(F.when(F.col("outcome") == "success", F.col("source_agent"))).alias("fix_agents"), F.max("last_ts").alias("last_seen"))
    return g.where(F.col("session_count") >= threshold)


@add("recurring_since", f"{_LISTS} select *, row_number() over (order by session_count desc, last_seen desc, fingerprint) as place from listed where session_count >= 3 order by place limit 100")
def recurring_since(spark, d):
    """The hundred errors met in most sessions since a time, in order."""
    r = _recurring(spark, d, "2024-06-01", 3).orderBy(F.desc("session_count"), F.desc("last_seen"), "fingerprint").limit(100)
    return r.withColumn("place", F.row_number().over(Window.orderBy(F.desc("session_count"), F.desc("last_seen"), "fingerprint")))  # a hundred rows


@add("error_entries", f"""{_LISTS} select fingerprint, session_count as occurrences, case when fix_agents <> '' then 1.0 else 0.0 end as resolution_rate, agents from listed where session_count >= 2
    order by session_count desc, last_seen desc, fingerprint limit 15""")
def error_entries(spark, d):
    """The fifteen most frequent errors of a report, with whether anything fixed them."""
    r = _recurring(spark, d, "2024-06-01", 2).orderBy(F.desc("session_count"), F.desc("last_seen"), "fingerprint").limit(15)
    return r.select("fingerprint", F.col("session_count").alias("occurrences"), F.when(F.col("fix_agents") != "", 1.0).otherwise(0.0).alias("resolution_rate"), "agents")


@add("agg_filtered", f"{sessions._FACTS} select source_agent as agent, {sessions._METRICS} from facts where source_agent = 'claude-code' and project = (select min(project) from facts) and started >= timestamp '2024-01-01' group by 1")
def agg_filtered(spark, d):
    """Metrics of one agent's sessions in one project since a time."""
    f = sessions.session_facts(spark, d)
    first = f.agg(F.min("project")).first()[0]  # one value
    return sessions._metrics(knowledge.narrowed(f, "claude-code", first, "2024-01-01").withColumnRenamed("source_agent", "agent"), "agent")


@add("agents_ranked", f"{sessions._FACTS} select source_agent as agent, count(*) as sessions, row_number() over (order by count(*) desc, source_agent) as place from facts group by 1")
def agents_ranked(spark, d):
    """Agents by their sessions."""
    g = sessions.session_facts(spark, d).groupBy(F.col("source_agent").alias("agent")).agg(F.count("*").alias("sessions"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("sessions"), "agent")))  # a row an agent


@add("types_ranked", f"{sessions._PROBLEM} select k as problem_type, count(*) as sessions, row_number() over (order by count(*) desc, k) as place from r where rn = 1 group by 1")
def types_ranked(spark, d):
    """Problem types by their sessions."""
    g = sessions.agg_problem_types(spark, d).select("problem_type", "sessions")
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("sessions"), "problem_type")))  # six rows at most


@add("months_ranked", f"{sessions._FACTS} select strftime(started, '%Y-%m') as month, count(*) as sessions, row_number() over (order by strftime(started, '%Y-%m')) as place from facts group by 1")
def months_ranked(spark, d):
    """Months in their order."""
    g = sessions.session_facts(spark, d).groupBy(F.date_format("started", "yyyy-MM").alias("month")).agg(F.count("*").alias("sessions"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("month")))  # a row a month


@add("gc_bytes", f"{sessions._FACTS} select source_agent, count(*) as sessions, cast(sum(content_bytes) as bigint) as bytes from facts where started < timestamp '2025-01-01' - interval 365 day group by 1")
def gc_bytes(spark, d):
    """What retention would free, by agent."""
    old = sessions.session_facts(spark, d).where(F.col("started") < F.expr("timestamp_ntz'2025-01-01 00:00:00' - interval 365 days"))
    return old.groupBy("source_agent").agg(F.count("*").alias("sessions"), F.sum("content_bytes").alias("bytes"))


@add("summarize", f"""{sessions._FACTS}, {_PROMPT} select session_id, summary, outcome, started from summed join facts using (session_id) where project = (select min(project) from facts) and started >= timestamp '2024-01-01' order by started, session_id limit 20""")
def summarize(spark, d):
    """The first twenty sessions of a project since a time, with their summaries."""
    from quern.operators import documents

    f = sessions.session_facts(spark, d)
    first = f.agg(F.min("project")).first()[0]  # one value
    page = knowledge.narrowed(f, project=first, since="2024-01-01").orderBy("started", "session_id").limit(20)
    ev = log_events(spark, d).join(F.broadcast(page.select("session_id")), "session_id", "left_semi")  # twenty rows
    return documents.summaries(ev).join(page.select("session_id", "outcome", "started"), "session_id").select("session_id", "summary", "outcome", "started")


@add("rules_below", f"with {sessions.EVENTS_SQL}, {sessions._FP}, {_HABITS} select kind, cast(sum(n) as bigint) as n from counted where project = (select min(project) from counted) or starts_with(project, (select min(project) from counted) || '/') group by 1")
def rules_below(spark, d):
    """Habits of a project and the folders below it."""
    h = knowledge.habits(log_events(spark, d, knowledge.shown()))
    first = h.agg(F.min("project")).first()[0]  # one value
    return knowledge.of_project(h, first or "").groupBy("kind").agg(F.sum("n").alias("n"))


QUERIES, SQL = Q, S
