"""Queries of full-text search: over ``documents`` and over the sessions and code artifacts of the logs, both through stored indexes."""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.adapters import log_events
from quern.functions import text as T
from quern.index import Index
from quern.operators import documents, fulltext, relational, search
from quern.plans import sessions
from quern.session import shared_folder, table

Q: dict = {}
S: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def wrap(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return wrap


_indexes: dict[tuple[str, str, str], Index] = {}


def _index(spark: SparkSession, d: str, kind: str, build) -> Index:
    """The index of a data folder, built once an application in the shared folder."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _indexes:
        ix = Index.create(spark, f"{shared_folder(spark)}/index-{kind}-{hashlib.md5(d.encode()).hexdigest()[:12]}")
        if not ix.state()["segments"]:
            ix.rebuild(build())
        _indexes[key] = ix
    return _indexes[key]


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def document_index(spark: SparkSession, d: str) -> Index:
    return _index(spark, d, "documents", lambda: search.documents_as_sessions(table(spark, d, "documents").where("text is not null")))


def commits_in_sessions(spark: SparkSession, d: str) -> DataFrame:
    """commit_id, session_id: version-control commands within the sessions of their project, up to two hours after the end."""
    m = table(spark, d, "session_messages").where("input_command like 'git %'").join(table(spark, d, "workspaces").select("cwd", "project"), "cwd")
    c = m.select(F.col("line_id").alias("commit_id"), F.col("received_at").alias("ts"), "project")
    f = sessions.session_facts(spark, d).where("project is not null").select("session_id", "project", "started", (F.col("ended") + F.expr("interval 2 hours")).alias("until"))
    return relational.interval_join(c, f, "project", "ts", "started", "until").select("commit_id", "session_id")


def _commits(spark: SparkSession, d: str) -> DataFrame:
    """session_id, hash: version-control commands within sessions, each with a hash of its own."""
    return commits_in_sessions(spark, d).select("session_id", F.md5(F.col("commit_id").cast("string")).alias("hash"))


KEYWORDS = ["docker", "cargo", "pytest", "go", "make", "npm", "git", "sql", "redis", "postgres", "next.js", "docker-compose", "c++"]


def log_index(spark: SparkSession, d: str) -> Index:
    """Sessions and code artifacts of both logs in one index."""

    def build() -> DataFrame:
        ev = log_events(spark, d)
        s = documents.session_documents(ev, KEYWORDS, _commits(spark, d))
        return s.unionByName(documents.artifact_documents(ev), allowMissingColumns=True)

    return _index(spark, d, "logs", build)


# documents ---------------------------------------------------------------------------------------

_SPLIT = r"[^\p{L}\p{N}]+"


def _toks(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '{_SPLIT}'), lambda t: t <> '' and strlen(t) <= 40)"


_HEAD = "regexp_extract(text, '^[^\\n]*')"
_BASE = f"docs as (select doc_id, text as content, {_HEAD} as summary from documents where text is not null), tk as (select doc_id, {_toks('content')} as toks from docs)"


def _bm25(name: str, clauses: dict[str, tuple[float, list[str]]]) -> str:
    """SQL of the BM25 sum over fields of ``docs``: field -> (boost, terms)."""
    out = []
    for f, (boost, terms) in clauses.items():
        n = f"{name}_{f}"
        inside = ", ".join(f"'{t}'" for t in terms)
        out.append(f"""{n}_t as (select doc_id, {_toks(f)} as toks from docs), {n}_st as (select count(*) as n_docs, sum(len(toks)) / count(*) as avgdl from {n}_t),
          {n}_p as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, unnest(toks) as term, len(toks) as dl from {n}_t) where term in ({inside}) group by 1, 2),
          {n}_df as (select term, count(*) as df from {n}_p group by 1),
          {n}_s as (select doc_id, {boost} * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) as s from {n}_p join {n}_df using (term), {n}_st)""")
    every = " union all ".join(f"select * from {name}_{f}_s" for f in clauses)
    return ", ".join(out) + f", {name} as (select doc_id, round(sum(s), 6) as score from ({every}) group by 1)"


def _scored(spark: SparkSession, d: str, words: list[str], fields: dict[str, float] | None = None) -> DataFrame:
    ix = document_index(spark, d)
    s = search.scores(ix, [(f, w, b) for w in words for f, b in (fields or {"content": 1.0}).items()])
    return s.select(F.col("doc_id").cast("bigint").alias("doc_id"), "score")


@add("fts_bm25_topk", f"with {_BASE}, {_bm25('bm', {'content': (1.0, ['deadlock'])})} select doc_id, score from bm order by score desc, doc_id limit 10")
def fts_bm25_topk(spark, d):
    return fulltext.top(_scored(spark, d, ["deadlock"]), 10)


_THREE = ["parser", "timeout", "snapshot"]


@add("fts_multi_term", f"with {_BASE}, {_bm25('bm', {'content': (1.0, _THREE)})} select doc_id, score from bm order by score desc, doc_id limit 20")
def fts_multi_term(spark, d):
    return fulltext.top(_scored(spark, d, _THREE), 20)


@add("search_offset", f"with {_BASE}, {_bm25('bm', {'content': (1.0, _THREE)})} select doc_id, score from bm order by score desc, doc_id limit 10 offset 10")
def search_offset(spark, d):
    return fulltext.top(_scored(spark, d, _THREE), 10, 10)


@add("fts_any_script", f"with {_BASE}, {_bm25('bm', {'content': (1.0, ['größe', 'ошибка', 'données'])})} select doc_id, score from bm order by score desc, doc_id limit 20")
def fts_any_script(spark, d):
    """A query text with words of several scripts, through the reader of queries."""
    q = search.parse("Größe Ошибка données")
    return fulltext.top(_scored(spark, d, q.should), 20)


@add("fts_summary_boost", f"with {_BASE}, {_bm25('bm', {'content': (1.0, ['batcher', 'limiter']), 'summary': (1.5, ['batcher', 'limiter'])})} select doc_id, score from bm order by score desc, doc_id limit 10")
def fts_summary_boost(spark, d):
    """Terms in the text and, with more weight, in the summary (the first line)."""
    return fulltext.top(_scored(spark, d, ["batcher", "limiter"], {"content": 1.0, "summary": search.SUMMARY_BOOST}), 10)


def _found(spark: SparkSession, d: str, s: search.Search, fuzzy: bool = False) -> DataFrame:
    hits = search._hits(document_index(spark, d), s, search.parse(s.query or ""), fuzzy)
    return hits.select(F.col("doc_id").cast("bigint").alias("doc_id"), "score")


_HELD = f"tk2 as (select doc_id, {_toks('content')} as a, {_toks('summary')} as b from docs), held as (select doc_id, list_concat(a, b) as toks, a, b from tk2)"


@add("fts_must_not", f"with {_BASE}, {_HELD} select doc_id from held where list_contains(toks, 'parser') and list_contains(toks, 'digest') and not list_contains(toks, 'queue')")
def fts_must_not(spark, d):
    return _found(spark, d, search.Search(query="+parser +digest -queue")).select("doc_id")


@add("fts_phrase", f"with {_BASE}, {_HELD} select doc_id from held where contains(' ' || array_to_string(a, ' ') || ' ', ' schema mismatch ') or contains(' ' || array_to_string(b, ' ') || ' ', ' schema mismatch ')")
def fts_phrase(spark, d):
    return _found(spark, d, search.Search(query='"schema mismatch"')).select("doc_id")


@add("fts_query_syntax", f"""with {_BASE}, {_HELD}, {_bm25('bm', {'content': (1.0, ['parser', 'timeout', 'schema', 'mismatch']), 'summary': (1.5, ['parser', 'timeout', 'schema', 'mismatch'])})}
    select doc_id, score from bm join held using (doc_id) join documents using (doc_id) where list_contains(toks, 'parser') and list_contains(toks, 'timeout') and not list_contains(toks, 'queue') and source = 'codex'
    and (contains(' ' || array_to_string(a, ' ') || ' ', ' schema mismatch ') or contains(' ' || array_to_string(b, ' ') || ' ', ' schema mismatch '))""")
def fts_query_syntax(spark, d):
    """The whole query language at once: AND, a phrase, an exclusion and a field."""
    return _found(spark, d, search.Search(query='parser AND timeout "schema mismatch" -queue agent:codex'))


@add("fts_fuzzy", f"with {_BASE}, v as (select doc_id, unnest(list_distinct(toks)) as term from tk) select doc_id, count(distinct w) as hits from v, (values ('deadlok'), ('snapshto')) q(w) where damerau_levenshtein(term, w) <= 1 group by 1")
def fts_fuzzy(spark, d):
    s = search.fuzzy_scores(document_index(spark, d), ["deadlok", "snapshto"], 1, ["content"])
    return s.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("score").cast("bigint").alias("hits"))


@add("fts_fuzzy_fields", f"""with {_BASE}, v as (select doc_id, 'content' as f, unnest(list_distinct({_toks('content')})) as term from docs union all select doc_id, 'summary', unnest(list_distinct({_toks('summary')})) from docs)
    select doc_id, count(distinct w || f) as hits from v, (values ('deadlok'), ('snapshto')) q(w) where damerau_levenshtein(term, w) <= 1 group by 1""")
def fts_fuzzy_fields(spark, d):
    """Fuzzy words over all fields, a clause a word and field."""
    s = search.fuzzy_scores(document_index(spark, d), ["deadlok", "snapshto"], 1)
    return s.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("score").cast("bigint").alias("hits"))


@add("fts_fuzzy_two", f"with {_BASE}, v as (select doc_id, unnest(list_distinct(toks)) as term from tk) select doc_id, count(distinct w) as hits from v, (values ('dedalok'), ('snaphsto')) q(w) where damerau_levenshtein(term, w) <= 2 group by 1")
def fts_fuzzy_two(spark, d):
    """Two edits, swaps among them."""
    s = search.fuzzy_scores(document_index(spark, d), ["dedalok", "snaphsto"], 2, ["content"])
    return s.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("score").cast("bigint").alias("hits"))


@add("fts_fuzzy_fallback", f"""with {_BASE}, v as (select doc_id, 'content' as f, unnest(list_distinct({_toks('content')})) as term from docs union all select doc_id, 'summary', unnest(list_distinct({_toks('summary')})) from docs)
    select doc_id, count(distinct f) as hits from v where damerau_levenshtein(term, 'deadlok') <= 1 group by 1 order by hits desc, doc_id limit 10""")
def fts_fuzzy_fallback(spark, d):
    """The plain query first; only if it finds nothing the fuzzy one."""
    s = search.Search(query="deadlok")
    hits = _found(spark, d, s)
    if hits.isEmpty():
        hits = _found(spark, d, s, True)
    return hits.select("doc_id", F.col("score").cast("bigint").alias("hits")).orderBy(F.desc("hits"), "doc_id").limit(10)


@add("fts_vocabulary", f"with {_BASE} select term, count(*) as df from (select unnest(list_distinct(toks)) as term from tk) group by 1")
def fts_vocabulary(spark, d):
    return document_index(spark, d).vocabulary()


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_MLT = f"""own as (select term, count(*) as tf from (select unnest(regexp_split_to_array(lower(content || ' ' || summary || ' '), '[\\t-\\r\\x{{85}}\\p{{Z}}]+')) as term from docs where doc_id = 5) where strlen(term) > 2 and term not in ({_STOP}) group by 1),
  d0 as (select term, count(*) as df from (select unnest(list_distinct(toks)) as term from tk) where term in (select term from own) group by 1),
  w as (select term, round(tf * 1.0 / (select sum(tf) from own) * ln((select count(*) from docs) * 1.0 / df), 9) as s from own join d0 using (term) order by s desc, term limit 20),
  b as (select term, round(case when max(s) over () > 0 then s / max(s) over () * 2 else 0 end + 0.5, 6) as boost from w)"""


@add("fts_mlt_terms", f"with {_BASE}, {_MLT} select term, boost from b")
def fts_mlt_terms(spark, d):
    return spark.createDataFrame(search.similar_terms(document_index(spark, d), "5"), "term string, boost double")


@add("fts_mlt", f"""with {_BASE}, {_MLT}, dl as (select doc_id, len(toks) as dl from tk), st as (select count(*) as n_docs, avg(dl) as avgdl from dl), p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(toks) as term from tk) where term in (select term from b) group by 1, 2),
    f as (select term, count(*) as df from p group by 1)
    select doc_id, round(round(sum(boost * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6), 4) as score from p join f using (term) join b using (term) join dl using (doc_id), st
    where doc_id <> 5 group by 1 order by score desc, doc_id limit 10""")
def fts_mlt(spark, d):
    ix = document_index(spark, d)
    s = search.scores(ix, [("content", t, b) for t, b in search.similar_terms(ix, "5")]).where("doc_id <> '5'")
    return s.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.round("score", 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@add("search_filters_all", f"""with {_BASE}, {_bm25('bm', {'content': (1.0, ['parser']), 'summary': (1.5, ['parser'])})} select doc_id, score, source, project from bm join documents using (doc_id) where source in ('claude-code', 'codex')
    and collected_at >= timestamp '2024-01-01' and collected_at < timestamp '2025-01-01' and model is not null""")
def search_filters_all(spark, d):
    """Facets at once; several agents are alternatives, ``since`` is inclusive and ``before`` exclusive."""
    s = search.Search(query="parser", agents=("claude-code", "codex"), since="2024-01-01", before="2025-01-01")
    meta = table(spark, d, "documents").where("model is not null").select("doc_id", "source", "project")
    return _found(spark, d, s).join(meta, "doc_id").select("doc_id", "score", "source", "project")


@add("search_sort_newest", f"with {_BASE}, {_bm25('bm', {'content': (1.0, ['parser'])})}, t as (select doc_id, score from bm order by score desc, doc_id limit 20) select doc_id, score, collected_at, row_number() over (order by collected_at desc, doc_id) as place from t join documents using (doc_id)")
def search_sort_newest(spark, d):
    """The relevance page, re-ordered by time (the page, not the corpus)."""
    page = fulltext.top(_scored(spark, d, ["parser"]), 20)
    j = page.join(table(spark, d, "documents").select("doc_id", "collected_at"), "doc_id")
    return j.withColumn("place", F.row_number().over(Window.orderBy(F.desc("collected_at"), "doc_id")))  # 20 rows


@add("snippet", "select doc_id, case when length(text) <= 120 then text else trim(case when contains(left(text, 120), ' ') then regexp_replace(left(text, 120), ' [^ ]*$', '', 's') else left(text, 120) end) || '...' end as snippet from documents where text is not null")
def snippet(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", T.snippet(F.col("text"), 120).alias("snippet"))


@add("knapsack_pack", f"""with recursive {_BASE}, {_bm25('bm', {'content': (1.0, ['parser', 'timeout'])})}, page as (select doc_id, score from bm order by score desc, doc_id limit 50),
    x as (select row_number() over (order by score desc, doc_id) as n, doc_id, cast(ceil((strlen(sn) + strlen(su)) / 4.0) as bigint) as full_cost, cast(ceil(strlen(su) / 4.0) as bigint) as sum_cost from (select doc_id, score, left(regexp_extract(text, '^[^\n]*'), 60) as su,
      case when length(text) <= 200 then text else trim(case when contains(left(text, 200), ' ') then regexp_replace(left(text, 200), ' [^ ]*$', '', 's') else left(text, 200) end) || '...' end as sn from page join documents using (doc_id))),
    f as (select cast(0 as bigint) as n, cast(600 as bigint) as room, cast(null as bigint) as doc_id, cast(null as bigint) as cost, cast(null as varchar) as mode
      union all select x.n, case when full_cost <= room then room - full_cost when sum_cost > 0 and sum_cost <= room then room - sum_cost else room end, x.doc_id,
        case when full_cost <= room then full_cost when sum_cost > 0 and sum_cost <= room then sum_cost end, case when full_cost <= room then 'full' when sum_cost > 0 and sum_cost <= room then 'summary' end
      from f join x on x.n = f.n + 1)
    select doc_id, cost, mode from f where mode is not null""")
def knapsack_pack(spark, d):
    """The best 50 hits packed into 600 tokens."""
    page = fulltext.top(_scored(spark, d, ["parser", "timeout"]), 50)
    j = page.join(docs(spark, d), "doc_id").select("doc_id", "score", T.snippet(F.col("text"), 200).alias("snippet"), F.left(F.regexp_extract("text", r"^[^\n]*", 0), F.lit(60)).alias("summary"))
    return fulltext.pack(j, 600)


@add("fts_error_lookup", "select doc_id, regexp_extract(text, 'error: ([a-z]+ [a-z]+)', 1) as fp from documents where damerau_levenshtein(regexp_extract(text, 'error: ([a-z]+ [a-z]+)', 1), 'deadlok detected') <= 1")
def fts_error_lookup(spark, d):
    """Documents whose error is the asked one up to one edit, as a whole term."""
    fp = F.regexp_extract("text", r"error: ([a-z]+ [a-z]+)", 1)
    return docs(spark, d).withColumn("fp", fp).where(T.osa_within(F.col("fp"), F.lit("deadlok detected"))).select("doc_id", "fp")


# sessions and code artifacts -----------------------------------------------------------------------

_EXT = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.EXTENSION_TAGS.items()) + "}"
_CMD = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.COMMAND_TAGS.items()) + "}"
_KEYS = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"
_FIRST = "regexp_split_to_array(trim(coalesce(command, content)), '\\s+')"
_TAGS = f"""tagged as (select distinct session_id, tag from (
    select session_id, lower(tool) as tag from ev where role = 'tool_call' union all select session_id, lower(unnest(regexp_extract_all(content, '```([a-zA-Z0-9_+#-]+)', 1))) from ev
    union all select session_id, {_EXT}[regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)] from ev where path is not null
    union all select session_id, {_CMD}[case when {_FIRST}[1] in ('$', '#') then {_FIRST}[2] else {_FIRST}[1] end] from ev where role = 'tool_call' and tool = 'Bash'
    union all select session_id, lower(fingerprint) from fp
    union all select session_id, unnest(list_filter({_KEYS}, lambda k: regexp_matches(lower(content), '\\b' || regexp_escape(k) || '\\b'))) from ev) where tag is not null)"""
_PROMPT = """prompted as (select session_id, trim(regexp_replace(min_by(content, seq) filter (where role = 'user'), '\\s+', ' ', 'g')) as p from ev group by 1),
    pfiles as (select session_id, path, min(seq) as first_at, regexp_extract(path, '[^/]*$') as name from ev where path is not null and path <> '' group by 1, 2),
    kfiles as (select session_id, string_agg(name, ', ' order by k) as files from (select *, row_number() over (partition by session_id order by typed desc, case when typed then strlen(path) end nulls first, first_at, path) as k
      from (select *, contains(name, '.') and not starts_with(name, '.') as typed from pfiles)) where k <= 3 group by 1),
    summed as (select session_id, case when coalesce(p, '') = '' and files is null then 'Session with no user prompt' else concat_ws(' ', case when p = '' then null when length(p) <= 80 then p when contains(left(p, 80), ' ') then regexp_replace(left(p, 80), ' [^ ]*$', '') || '...' else left(p, 80) || '...' end,
      '(' || files || ')') end as summary from prompted left join kfiles using (session_id))"""
_RESULT_ERR = "|".join(T.quoted(w) for w in documents.RESULT_ERRORS)
_USER_ERR = "|".join(T.quoted(w) for w in documents.USER_ERRORS).replace("'", "''")
_SOLVED = f"""told as (select session_id, seq, row_number() over (partition by session_id order by seq) - 1 as idx, count(*) over (partition by session_id) as n,
      (role = 'tool_result' and regexp_matches(lower(content), '{_RESULT_ERR}')) or (role = 'user' and regexp_matches(lower(content), '{_USER_ERR}')) as failed, role, tool, content, command,
      list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ' || chr(13))), lambda x: x <> '') as ls from ev),
    lasts as (select session_id, max(idx) filter (where failed) as last_error from told group by 1),
    dids as (select session_id, seq, case when tool in ('Edit', 'Write') then '[' || tool || '] ' || coalesce(list_filter(ls, lambda x: starts_with(x, 'File: ') or starts_with(x, 'Path: '))[1], case when strlen(ls[1]) > 100 then left(ls[1], 100) || '...' else ls[1] end, '(file operation)')
      when tool = 'Bash' then '[Bash] ' || trim(left(string_split(coalesce(command, content), chr(10))[1], 120)) end as did from told join lasts using (session_id) where role = 'tool_call' and idx >= coalesce(last_error, n // 3)),
    solved as (select session_id, case when strlen(s) > 2000 then left(s, 2000) || '...' || chr(10) || '(truncated)' else s end as solution from (select session_id, string_agg(did, chr(10) order by seq) as s from dids where did is not null group by 1))"""
_CONTENT = "told_all as (select session_id, string_agg(role || ': ' || case when role = 'tool_result' then left(content, 1000) else content end, chr(10) || chr(10) order by seq) as content from ev group by 1)"
_BLOCKS = f"""fenced as (select session_id, seq, lower(unnest(regexp_extract_all(content, '{documents.enrich.FENCE}', 1))) as language, unnest(regexp_extract_all(content, '{documents.enrich.FENCE}', 2)) as code, unnest(range(len(regexp_extract_all(content, '{documents.enrich.FENCE}', 1)))) as block_no,
      trim(regexp_extract(content, '{documents.CONTEXT_FILE}', 1)) as named from ev where role = 'assistant' and contains(content, '```')),
    arts as (select session_id, seq, cast(block_no as integer) as block_no, language, case when regexp_matches(named, '[/.]') then named end as file_path, code,
      row_number() over (partition by session_id, language, case when regexp_matches(named, '[/.]') then named end order by seq desc, block_no desc) = 1 as is_final from fenced where regexp_replace(code, '\\s', '', 'g') <> '')"""
_LOGS = f"""{sessions._FACTS}, {sessions._FP}, {_TAGS}, {_PROMPT}, {_SOLVED}, {_CONTENT}, {_BLOCKS},
    docs as (select session_id as doc_id, session_id, 'session' as doc_type, content, summary, solution as solution_summary, null as code_content, null as code_language from told_all join summed using (session_id) left join solved using (session_id)
      union all select session_id || '#' || seq || '#' || block_no, session_id, 'code_artifact', code, null, null, code, language from arts)"""


@add("session_tags", f"with {sessions.EVENTS_SQL}, {sessions._FP}, {_TAGS} select session_id, string_agg(tag, '|' order by tag) as tags from tagged group by 1")
def session_tags(spark, d):
    """All tiers of tags united: tools, fences, extensions, commands, fingerprints, dictionary."""
    t = documents.tags(log_events(spark, d, documents.own_tags(KEYWORDS)))
    return t.select("session_id", F.array_join("tags", "|").alias("tags"))


@add("summary_files", f"with {sessions.EVENTS_SQL}, {_PROMPT} select session_id, summary from summed")
def summary_files(spark, d):
    """The first prompt and the key files."""
    return documents.summaries(log_events(spark, d))


@add("solution_text", f"with {sessions.EVENTS_SQL}, {_SOLVED} select session_id, solution from solved")
def solution_text(spark, d):
    return documents.solutions(log_events(spark, d, documents.solution_lines()))


@add("code_artifacts", f"with {sessions.EVENTS_SQL}, {_BLOCKS} select session_id, seq, block_no, language, file_path, md5(code) as digest, is_final from arts")
def code_artifacts(spark, d):
    a = documents.artifacts(log_events(spark, d))
    return a.select("session_id", "seq", "block_no", "language", "file_path", F.md5("code").alias("digest"), "is_final")


@add("index_stats", f"{_LOGS} select doc_type, count(*) as docs, cast(sum(len({_toks('content')})) as bigint) as tokens from docs group by 1")
def index_stats(spark, d):
    """Documents and words of the stored index, by kind."""
    return log_index(spark, d).documents().groupBy("doc_type").agg(F.count("*").alias("docs"), F.sum("n_content").alias("tokens"))


@add("index_scan", f"{_LOGS} select session_id, source_agent, project, outcome, turns from docs join facts using (session_id) where doc_type = 'session' and started is not null")
def index_scan(spark, d):
    """The full scan that analytics read: session documents that have a time."""
    x = log_index(spark, d).documents().where("doc_type = 'session' and timestamp is not null")
    return x.select("session_id", "source_agent", "project", "outcome", F.col("turn_count").alias("turns"))


def _logs(spark: SparkSession, d: str, s: search.Search) -> DataFrame:
    hits = search._hits(log_index(spark, d), s, search.parse(s.query or ""), s.fuzzy)
    return hits


_WORDS = ["timeout", "parser"]
_LOG_BM = _bm25("bm", {"content": (1.0, _WORDS), "summary": (1.5, _WORDS)})
_ASKED = search.Search(query="timeout parser")


@add("search_default_type", f"{_LOGS}, {_LOG_BM} select doc_id, score from bm join docs using (doc_id) where doc_type = 'session'")
def search_default_type(spark, d):
    """Without a kind sessions are asked for, artifacts are not."""
    return _logs(spark, d, _ASKED)


@add("search_project", f"{_LOGS}, {_LOG_BM} select doc_id, score from bm join docs using (doc_id) join facts using (session_id) where doc_type = 'session' and project = (select min(project) from facts)")
def search_project(spark, d):
    first = log_index(spark, d).documents().agg(F.min("project")).first()[0]  # one value
    return _logs(spark, d, replace(_ASKED, project=first))


@add("search_model", f"{_LOGS}, {_LOG_BM} select doc_id, score from bm join docs using (doc_id) join facts using (session_id) where doc_type = 'session' and model = 'gpt-main'")
def search_model(spark, d):
    return _logs(spark, d, replace(_ASKED, model="gpt-main"))


@add("search_tags", f"{_LOGS}, {_LOG_BM} select doc_id, score from bm join docs using (doc_id) where doc_type = 'session' and session_id in (select session_id from tagged where tag = 'bash') and session_id in (select session_id from tagged where tag = 'rust')")
def search_tags(spark, d):
    """All of the tags."""
    return _logs(spark, d, replace(_ASKED, tags=("bash", "rust")))


@add("search_outcome", f"{_LOGS}, {_LOG_BM} select doc_id, score from bm join docs using (doc_id) join facts using (session_id) where doc_type = 'session' and outcome = 'failure'")
def search_outcome(spark, d):
    return _logs(spark, d, replace(_ASKED, outcome="failure"))


@add("search_file", f"{_LOGS} select doc_id from docs where doc_type = 'session' and session_id in (select session_id from ev where path = (select min(path) from ev))")
def search_file(spark, d):
    """Sessions that touched exactly this path; a filter alone is a search."""
    path = log_index(spark, d).documents().agg(F.min(F.array_min("file_paths"))).first()[0]  # one value
    return _logs(spark, d, search.Search(file_path=path or "none")).select("doc_id")


_COMMITS_SQL = """commits as (select c.commit_id, f.session_id from (select line_id as commit_id, received_at as ts, project from session_messages join workspaces using (cwd) where input_command like 'git %') c
    join facts f on c.project = f.project and c.ts between f.started and f.ended + interval 2 hour)"""


@add("search_commit", f"{_LOGS}, {_COMMITS_SQL} select doc_id from docs where doc_type = 'session' and session_id in (select session_id from commits where md5(cast(commit_id as varchar)) = (select min(md5(cast(commit_id as varchar))) from commits))")
def search_commit(spark, d):
    first = log_index(spark, d).documents().agg(F.min(F.array_min("git_commits"))).first()[0]  # one value
    return _logs(spark, d, search.Search(git_commit=first or "none")).select("doc_id")


_CODE = ["def", "return", "self"]


@add("search_code", f"{_LOGS}, {_bm25('bm', {'code_content': (1.0, _CODE)})} select doc_id, score from bm")
def search_code(spark, d):
    """Words of code artifacts."""
    return _logs(spark, d, search.Search(code=" ".join(_CODE)))


@add("search_code_lang", f"{_LOGS}, {_bm25('bm', {'code_content': (1.0, _CODE)})} select doc_id, score from bm join docs using (doc_id) where code_language = (select min(language) from arts)")
def search_code_lang(spark, d):
    """Words of code artifacts of one language (the empty one is that of fences without a name)."""
    first = log_index(spark, d).documents().agg(F.min("code_language")).first()[0]  # one value
    return _logs(spark, d, search.Search(code=" ".join(_CODE), code_lang=first))


_SOLVE = ["edit", "cargo", "refactor"]


@add("search_solution", f"""{_LOGS}, {_bm25('bm', {'content': (1.0, _SOLVE), 'summary': (1.5, _SOLVE)})}, {_bm25('so', {'solution_summary': (1.0, _SOLVE)})}
    select bm.doc_id, round(bm.score + coalesce(so.score, 0), 6) as score from bm join docs using (doc_id) left join so using (doc_id) where doc_type = 'session'""")
def search_solution(spark, d):
    """Words in the solution add to the score and filter nothing."""
    return _logs(spark, d, search.Search(query=" ".join(_SOLVE), solution=True))


@add("search_error", f"{_LOGS} select distinct session_id as doc_id from fp where damerau_levenshtein(fingerprint, (select min(fingerprint) from fp) || 'x') <= 1")
def search_error(spark, d):
    """Sessions with an error up to one edit from the one asked for."""
    first = log_index(spark, d).documents().agg(F.min(F.array_min("error_fingerprint"))).first()[0]  # one value
    return _logs(spark, d, search.Search(error=(first or "") + "x")).select("doc_id")


@add("search_session", f"""{_LOGS} select f.session_id, f.source_agent, f.project, date_trunc('second', f.started) as timestamp, f.turns, f.outcome, summary, doc_type, f.model from docs join facts f using (session_id)
    where doc_type = 'session' and session_id = (select min(session_id) from facts)""")
def search_session(spark, d):
    """A session by its id."""
    ix = log_index(spark, d)
    first = ix.documents().agg(F.min("session_id")).first()[0]  # one value
    return search.search(ix, search.Search(session=first or "none"))[0].select("session_id", "source_agent", "project", "timestamp", "turns", "outcome", "summary", "doc_type", "model")


@add("search_page", f"""{_LOGS}, {_LOG_BM}, page as (select doc_id, session_id, score, summary, content from bm join docs using (doc_id) where doc_type = 'session' order by score desc, doc_id limit 10)
    select p.session_id, f.source_agent, f.project, date_trunc('second', f.started) as timestamp, f.turns, f.outcome, score, summary, md5(sn) as snippet, coalesce((select string_agg(tag, '|' order by tag) from tagged t where t.session_id = p.session_id), '') as tags, 'session' as doc_type, f.model,
      cast(ceil((strlen(sn) + strlen(summary)) / 4.0) as bigint) as token_count, row_number() over (order by f.turns desc, doc_id) as place
    from (select *, case when length(content) <= 200 then content else trim(case when contains(left(content, 200), ' ') then regexp_replace(left(content, 200), ' [^ ]*$', '', 's') else left(content, 200) end) || '...' end as sn from page) p join facts f using (session_id)""")
def search_page(spark, d):
    """A page of results with all that a result shows, the longest sessions first."""
    page, _ = search.search(log_index(spark, d), replace(_ASKED, sort="turns"))
    place = F.row_number().over(Window.orderBy(F.desc("turns"), "session_id"))  # one page
    return page.withColumns({"place": place, "tags": F.array_join("tags", "|"), "snippet": F.md5("snippet")})


# personal data --------------------------------------------------------------------------------------

_RED = "text"
for _k, _p in T.PII.items():
    _RED = f"regexp_replace({_RED}, '{_p}', '[REDACTED:{_k}]', 'g')"


@add("pii_redact", f"select doc_id, md5({_RED}) as digest from documents where text is not null and {_RED} <> text")
def pii_redact(spark, d):
    dd = docs(spark, d).withColumn("r", T.redact(F.col("text")))
    return dd.where(F.col("r") != F.col("text")).select("doc_id", F.md5("r").alias("digest"))


@add("pii_flag", "select lang, count(*) filter (where " + " or ".join(f"regexp_matches(text, '{p}')" for p in T.PII.values()) + ") as flagged, count(*) as n from documents where text is not null group by 1")
def pii_flag(spark, d):
    dd = table(spark, d, "documents").where("text is not null")
    return dd.groupBy("lang").agg(F.count_if(T.has_pii(F.col("text"))).alias("flagged"), F.count("*").alias("n"))


QUERIES, SQL = Q, S
