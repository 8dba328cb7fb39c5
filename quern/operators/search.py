"""Search as users ask it: a query language, filters, code, errors, similar sessions, fallbacks, packing, context packs."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.index import TEXT_FIELDS, Index, term_score
from quern.operators import fulltext

SUMMARY_BOOST = 1.5
FUZZY_FIELDS = ["content", "summary", "solution_summary"]


@dataclass
class Query:
    """Parts of a query text: ``+must -not "a phrase" field:value word`` (words are alternatives, AND makes neighbours mandatory)."""

    should: list[str] = field(default_factory=list)
    must: list[str] = field(default_factory=list)
    must_not: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    fields: dict[str, str] = field(default_factory=dict)


def words_of(text: str) -> list[str]:
    """Words of any script, in lower case."""
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def parse(text: str) -> Query:
    """A lenient reader: what it does not understand are plain words."""
    q, both = Query(), False
    for m in re.finditer(r'([+-]?)(?:"([^"]*)"|(\S+))', text):
        sign, quoted, plain = m[1], m[2], m[3]
        if quoted is not None:
            if ws := words_of(quoted):
                q.must_not.extend(ws) if sign == "-" else q.phrases.append(ws)
            continue
        if plain in ("AND", "OR", "NOT"):
            both = plain == "AND"
            if plain == "AND" and q.should:
                q.must.append(q.should.pop())
            sign = ""
            continue
        if (f := re.fullmatch(r"([a-z_]+):(\S+)", plain)) and not plain.startswith("http"):
            q.fields[f[1]] = f[2]
            continue
        for w in words_of(plain):
            (q.must_not if sign == "-" else q.must if sign == "+" or both else q.should).append(w)
        both = False
    return q


FACETS = {"agent": "source_agent", "source": "source_agent", "project": "project", "model": "model", "type": "doc_type", "outcome": "outcome", "lang": "code_language"}


@dataclass(frozen=True)
class Search:
    """What is asked.  Exactly the documents that pass all filters and fit a text clause are found."""

    query: str | None = None
    error: str | None = None  # an error fingerprint, up to one edit
    code: str | None = None  # words of code artifacts
    code_lang: str | None = None
    like: str | None = None  # a session to which others are similar
    session: str | None = None
    solution: bool = False  # words in the solution add to the score
    agents: tuple[str, ...] = ()
    project: str | None = None
    since: str | None = None  # inclusive
    before: str | None = None  # exclusive
    tags: tuple[str, ...] = ()  # all of them
    outcome: str | None = None
    doc_type: str | None = None  # sessions, unless code is asked for
    model: str | None = None
    file_path: str | None = None
    git_commit: str | None = None
    limit: int = 10
    offset: int = 0
    fuzzy: bool = False
    distance: int = 1
    sort: str = "relevance"
    snippet_length: int = 200
    token_budget: int | None = None


def filters(s: Search, q: Query) -> list[Column]:
    eq = lambda c, v: F.col(c) == v
    out = [eq(FACETS[k], v) for k, v in q.fields.items() if k in FACETS]
    out += [F.col("source_agent").isin(*s.agents)] if s.agents else []
    out += [eq(c, v) for c, v in (("project", s.project), ("outcome", s.outcome), ("model", s.model)) if v is not None]
    out += [F.col("timestamp") >= F.date_trunc("second", F.lit(s.since).cast("timestamp_ntz")).cast("timestamp_ntz")] if s.since else []
    out += [F.col("timestamp") < F.lit(s.before).cast("timestamp_ntz")] if s.before else []
    out += [F.array_contains("tags", t) for t in s.tags]
    out += [F.array_contains(c, v) for c, v in (("file_paths", s.file_path), ("git_commits", s.git_commit)) if v is not None]
    out += [eq("doc_type", s.doc_type or ("code_artifact" if s.code else "session"))] if "type" not in q.fields else []
    out += [eq("code_language", s.code_lang)] if s.code and s.code_lang is not None else []
    out += [F.col("session_id") != s.like] if s.like else []
    out += [F.exists("error_fingerprint", lambda fp: T.osa_within(fp, F.lit(s.error), 1))] if s.error is not None else []
    return out


def scores(index: Index, clauses: list[tuple[str, str, float]]) -> DataFrame:
    """doc_id, score: the BM25 sum of clauses (field, term, boost); scores rounded to six places."""
    n_docs, average = index.counts()
    boost: dict[tuple[str, str], float] = {}
    for f, t, b in clauses:
        boost[f, t] = boost.get((f, t), 0.0) + b
    if not boost:
        return index.spark.createDataFrame([], "doc_id string, score double")
    p = index.postings(sorted({t for _, t in boost}), sorted({f for f, _ in boost}))
    df = {(r.field, r.term): r["count"] for r in p.groupBy("field", "term").count().collect()}  # a row a clause
    weights = [(f, t, b * math.log(1 + (n_docs - df[f, t] + 0.5) / (df[f, t] + 0.5))) for (f, t), b in boost.items() if (f, t) in df]
    if not weights:
        return index.spark.createDataFrame([], "doc_id string, score double")
    key = F.concat_ws(" ", "field", "term")
    w = F.create_map(*[F.lit(x) for f, t, v in weights for x in (f"{f} {t}", v)])[key]
    mean = F.create_map(*[F.lit(x) for f in {f for f, _, _ in weights} for x in (f, average[f] or 1.0)])[F.col("field")]
    scored = p.withColumn("__w", w).where(F.col("__w").isNotNull())  # a term may be asked of one field and stand in another
    return scored.groupBy("doc_id").agg(F.round(F.sum(term_score(F.col("__w"), F.col("tf"), F.col("dl"), mean)), 6).alias("score"))


def fuzzy_scores(index: Index, words: list[str], distance: int, fields: list[str] = FUZZY_FIELDS) -> DataFrame:
    """doc_id, score: in how many (word, field) clauses a document has a term within the distance."""
    v = index.postings(fields=fields).select("field", "term").distinct()
    near = [fulltext.fuzzy_terms(v, w, distance, "field").withColumn("word", F.lit(w)) for w in words]
    if not near:
        return index.spark.createDataFrame([], "doc_id string, score double")
    terms = reduce(DataFrame.unionByName, near)
    hit = index.postings(fields=fields).join(terms, ["field", "term"]).select("doc_id", "field", "word").distinct()
    return hit.groupBy("doc_id").agg(F.count("*").cast("double").alias("score"))


def similar_terms(index: Index, session: str, most: int = 20) -> list[tuple[str, float]]:
    """(term, boost) of a session's document that set it apart, by tf-idf; boosts run from 0.5 to 2.5."""
    d = index.documents().where((F.col("session_id") == session) & (F.col("doc_type") == "session"))
    text = F.concat_ws(" ", "content", "summary", F.array_join("tags", " "))
    own = d.select(F.explode(F.split(F.lower(text), r"[\t-\r\x{85}\p{Z}]+")).alias("term")).where((F.octet_length("term") > 2) & ~F.col("term").isin(*T.STOP_WORDS))
    tf = {r.term: r.tf for r in own.groupBy("term").agg(F.count("*").alias("tf")).collect()}  # the words of one document, which is bounded
    if not tf:
        return []
    n_docs, total = index.counts()[0], sum(tf.values())
    df = index.postings(sorted(tf), ["content"]).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.round(F.col("tf") / F.lit(total) * F.log(F.lit(n_docs) / F.col("df")), 9)
    mine = index.spark.createDataFrame(list(tf.items()), "term string, tf long")
    best = df.join(F.broadcast(mine), "term").select("term", weight.alias("s")).orderBy(F.desc("s"), "term").limit(most).collect()
    top = max((r.s for r in best), default=0.0)
    return [(r.term, round((r.s / top * 2 if top > 0 else 0.0) + 0.5, 6)) for r in best]


def _phrases(index: Index, docs: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """The documents that hold each phrase in their content or summary; only those with all its words are read."""
    pattern = index.state()["pattern"]
    for ws in phrases:
        for w in ws:
            docs = docs.join(index.postings([w], ["content", "summary"]).select("doc_id").distinct(), "doc_id", "left_semi")
        joined = lambda f: F.concat(F.lit(" "), F.array_join(fulltext.tokens(F.coalesce(f, F.lit("")), pattern), " "), F.lit(" "))
        docs = docs.where(joined("content").contains(f" {' '.join(ws)} ") | joined("summary").contains(f" {' '.join(ws)} "))
    return docs


def _hits(index: Index, s: Search, q: Query, fuzzy: bool) -> DataFrame:
    """doc_id, score of everything that fits, without order."""
    docs = index.documents()
    for f in filters(s, q):
        docs = docs.where(f)
    holds = lambda w: index.postings([w], ["content", "summary"]).select("doc_id").distinct()
    if not fuzzy:
        for w in dict.fromkeys(q.must):
            docs = docs.join(holds(w), "doc_id", "left_semi")
    for w in dict.fromkeys(q.must_not):
        docs = docs.join(holds(w), "doc_id", "left_anti")
    docs = _phrases(index, docs, q.phrases).select("doc_id")
    terms = [*q.should, *q.must, *[w for p in q.phrases for w in p]]
    text: DataFrame | None = None
    if terms and fuzzy:
        text = fuzzy_scores(index, terms, s.distance)
    elif terms:
        clauses = [(f, t, b) for t in terms for f, b in (("content", 1.0), ("summary", SUMMARY_BOOST))]
        clauses += [(k, w, 1.0) for k, v in q.fields.items() if k in TEXT_FIELDS for w in words_of(v)]
        text = scores(index, clauses)
    if s.code:
        more = scores(index, [("code_content", w, 1.0) for w in words_of(s.code)])
        text = more if text is None else text.unionByName(more).groupBy("doc_id").agg(F.sum("score").alias("score"))
    if s.like:
        more = scores(index, [("content", t, b) for t, b in similar_terms(index, s.like)])
        text = more if text is None else text.unionByName(more).groupBy("doc_id").agg(F.sum("score").alias("score"))
    found = docs.select("doc_id", F.lit(1.0 if s.error is not None else 0.0).alias("score")) if text is None else docs.join(text, "doc_id")
    if s.solution and terms:
        add = scores(index, [("solution_summary", t, 1.0) for t in terms]).withColumnRenamed("score", "more")
        found = found.join(add, "doc_id", "left").select("doc_id", F.round(F.col("score") + F.coalesce("more", F.lit(0.0)), 6).alias("score"))
    return found


_ORDER = {
    "relevance": lambda: [F.desc("score"), F.asc("doc_id")], "newest": lambda: [F.desc(F.coalesce("timestamp", F.lit("0001-01-01").cast("timestamp_ntz"))), F.asc("doc_id")],
    "oldest": lambda: [F.asc(F.coalesce("timestamp", F.lit("0001-01-01").cast("timestamp_ntz"))), F.asc("doc_id")], "turns": lambda: [F.desc(F.coalesce("turns", F.lit(0))), F.asc("doc_id")],
}
RESULT = ["session_id", "source_agent", "project", "timestamp", "turns", "outcome", "score", "summary", "snippet", "tags", "doc_type", "model", "token_count"]


def _best(index: Index, hits: DataFrame, s: Search) -> list[tuple[str, float]]:
    """(doc_id, score) of the page, five pages at most; without a text clause all scores tie, and the order asked for picks."""
    n = s.limit * 5 if s.token_budget else s.limit
    if not (s.query or s.code or s.like) and s.sort != "relevance":
        meta = index.documents().select("doc_id", "timestamp", F.col("turn_count").alias("turns"))
        best = hits.join(meta, "doc_id").orderBy(*_ORDER[s.sort]())
    else:
        best = hits.orderBy(F.desc("score"), "doc_id")
    return [(r.doc_id, r.score) for r in best.select("doc_id", "score").offset(s.offset).limit(n).collect()]


def _page(index: Index, best: list[tuple[str, float]], s: Search) -> DataFrame:
    """What a result shows of the documents of a page; only these are read."""
    scored = index.spark.createDataFrame(best, "doc_id string, score double")
    meta = index.documents().where(F.col("doc_id").isin([i for i, _ in best]))
    d = meta.join(F.broadcast(scored), "doc_id")  # a page
    d = d.select("doc_id", *RESULT[:3], "timestamp", F.col("turn_count").alias("turns"), "outcome", "score", "summary", T.snippet(F.coalesce("content", F.lit("")), s.snippet_length).alias("snippet"), "tags", "doc_type", "model")
    return d.withColumn("token_count", T.token_cost(F.col("snippet"), F.col("summary")).cast("bigint"))


def search(index: Index, s: Search) -> tuple[DataFrame, bool]:
    """The page of results (the columns of ``RESULT``) and whether it comes from the automatic second try.

    A plain query that finds nothing is asked again with one edit allowed.
    Re-sorting orders the page, not the corpus.  With a token budget five pages
    are fetched and packed.  Nothing asked for is an error; a session is looked
    up without scores.
    """
    if s.session is not None:
        one = index.documents().where((F.col("session_id") == s.session) & (F.col("doc_type") == "session")).select("doc_id").limit(1).collect()
        return _page(index, [(r.doc_id, 1.0) for r in one], s).select(*RESULT), False
    q = parse(s.query or "")
    if not any((s.query, s.error, s.code, s.like, s.file_path, s.git_commit)):
        raise ValueError("a search needs words, an error, code, a session or a filter by file or commit")
    best = _best(index, _hits(index, s, q, s.fuzzy), s)
    plain = s.query and not (s.fuzzy or s.error or s.code or s.like)
    second = bool(plain and (q.should or q.must) and not best)
    if second:
        best = _best(index, _hits(index, s, q, True), s)
    page = _page(index, best, s)
    if s.token_budget:
        rows = [r.asDict(recursive=True) for r in page.orderBy(F.desc("score"), "doc_id").collect()]  # five pages at most
        page = index.spark.createDataFrame(pack(rows, s.token_budget), page.schema)
    return page.orderBy(*_ORDER[s.sort]()).select(*RESULT), bool(second and best)


def _cut(text: str, limit: int) -> str:
    """A prefix of ``limit`` bytes (the cut moves on to the end of a character), cut back to a blank, three dots behind."""
    data = text.encode()
    if len(data) <= limit:
        return text
    while limit < len(data) and data[limit] & 0xC0 == 0x80:
        limit += 1
    head = data[:limit].decode()
    return (head[: head.rfind(" ")] if " " in head else head).strip() + "..."


def pack(rows: list[dict[str, Any]], budget: int) -> list[dict[str, Any]]:
    """Results, best first, into a token budget: whole, with a shorter snippet, with the summary alone, or not at all.

    A later, smaller result may still fit, so only an empty budget ends it.
    """
    cost = lambda *texts: -(-sum(len((t or "").encode()) for t in texts) // 4)
    out, left = [], budget
    for r in rows:
        if left <= 0:
            break
        snippet, summary = r["snippet"] or "", r["summary"] or ""
        room = max(max(left - cost(summary), 0) * 4 - 3, 0)
        for text in (snippet, _cut(snippet, room) if room else None, "" if summary else None):
            if text is not None and (c := cost(text, summary)) <= left:
                out.append({**r, "snippet": text, "token_count": c})
                left -= c
                break
    return out


def hint(query: str, found: int, best: str | None) -> str:
    """One line of at most 120 characters about a search."""
    line = f"{found} past sessions match {query!r}" + (f", best: {best}" if best else "") if found else f"nothing matches {query!r}"
    return line if len(line) <= 120 else line[:117] + "..."


def as_json(query: str, results: list[dict[str, Any]], searched: int, second: bool) -> str:
    """A search's outcome as JSON; ``fuzzy_fallback`` is there only where it is true."""
    out = {"query": query, "total_matches": len(results), "sessions_searched": searched, "results": results}
    return json.dumps({**out, "fuzzy_fallback": True} if second else out, default=str, ensure_ascii=False, sort_keys=True)


def shortened(text: str, chars: int) -> str:
    """A text cut to a number of characters at the end of a line, or at a blank."""
    if len(text) <= chars:
        return text
    head = text[:chars]
    at = head.rfind("\n") if "\n" in head else head.rfind(" ")
    return (head[:at] if at >= 0 else head).rstrip() + "..."


def fit(sections: dict[str, str], budget: int, per_token: int = 4) -> dict[str, str]:
    """Sections in order of priority within a budget of tokens: the first that does not fit is cut, those behind it are dropped."""
    out, left = {}, budget
    for name, text in sections.items():
        tokens = -(-len(text) // per_token)
        if left <= 0 or not text:
            out[name] = ""
        elif tokens > left:
            out[name], left = shortened(text, left * per_token), 0
        else:
            out[name], left = text, left - tokens
    return out


def context_pack(index: Index, task: str, token_budget: int, conventions: list[str] | None = None, notes: DataFrame | None = None) -> dict[str, str]:
    """Context for a task: past solutions (three fifths of the budget), a project's conventions, and what is known of the files it names.

    ``notes``: path, kind ('gotcha' or 'error'), note, n; three errors a file at most.  Of a page of
    results at most ten sessions come to the driver.
    """
    asked = replace(Search(), query=re.sub(r'[+:"-]', " ", task), solution=True, outcome="success", token_budget=token_budget * 3 // 5, limit=10, snippet_length=300)
    lines: list[str] = []
    if words_of(asked.query):
        for r in search(index, asked)[0].collect():
            lines += [f"- {r.summary}"] if r.summary else []
            lines += [f"  {x}" for x in (r.snippet or "").splitlines()[:3]]
    said: list[str] = []
    paths = T.task_paths(task)
    if notes is not None and paths:
        known: dict[str, dict[str, list[str]]] = {}
        ranked = notes.where(F.col("path").isin(*paths)).orderBy("path", "kind", F.desc("n"), "note")
        for r in ranked.limit(100 * len(paths)).collect():
            known.setdefault(r.path, {}).setdefault(r.kind, []).append(r.note)
        for p in paths:
            if p in known:
                said += [f"**{p}**", *[f"  - {x}" for x in known[p].get("gotcha", [])], *[f"  - Error: {x[:80]}" for x in known[p].get("error", [])[:3]]]
    return fit({"past_solutions": "\n".join(lines), "conventions": "\n".join(conventions or []), "file_notes": "\n".join(said)}, token_budget)


def documents_as_sessions(docs: DataFrame) -> DataFrame:
    """A table of texts (doc_id, text and facets) as documents of an index: each a session of its own, its first line the summary."""
    c = docs.columns
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("string").alias("session_id"), F.lit("session").alias("doc_type"),
        *[F.col(a).alias(b) for a, b in (("source", "source_agent"), ("project", "project"), ("model", "model"), ("collected_at", "timestamp"), ("lang", "code_language")) if a in c],
        F.col("text").alias("content"), F.regexp_extract("text", r"^[^\n]*", 0).alias("summary"))


