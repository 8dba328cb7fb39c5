"""Documents for the index: one a session, one a code artifact."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import blocks, enrich
from quern.session import shared_checkpoint

# What tells an error to the search for the solution, in a tool's result and in a user's message.
RESULT_ERRORS = ["error", "failed", "failure", "panic", "exception", "traceback", "fatal", "exit code", "segfault", "permission denied"]
USER_ERRORS = ["error", "doesn't work", "still broken", "failing"]
# How a file is named in a text with code.
CONTEXT_FILE = r"(?:File:|Path:|file |path |`)([/.\w-]+\.\w{1,10})"
SOLUTION_BYTES = 2000


def keywords(path: str | Path) -> list[str]:
    """A dictionary of tags: a word or phrase a line; blank lines and comments are none."""
    lines = (x.strip().lower() for x in Path(path).read_text(encoding="utf-8").splitlines())
    return sorted({x for x in lines if x and not x.startswith("#")})


def keyword_tags(text: Column, words: list[str]) -> Column:
    """The words of a dictionary that stand in a text between word boundaries, in one pass.

    At each place the longest is taken; those that stand in it between
    boundaries come along.
    """
    if not words:
        return F.array().cast("array<string>")
    inside = {w: [v for v in words if re.search(rf"\b{re.escape(v)}\b", w)] for w in words}
    either = "|".join(T.quoted(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    hits = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"\b(?=({either})\b)"), 1))
    of = F.create_map(*[x for w, vs in inside.items() for x in (F.lit(w), F.array(*map(F.lit, vs or [w])))])
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: of[h])))


def explicit_tags() -> Column:
    """Of an event: its tool if it calls one, and the languages of its code fences."""
    fences = F.transform(F.regexp_extract_all("content", F.lit(r"```([a-zA-Z0-9_+#-]+)"), 1), F.lower)
    return F.concat(F.array(F.when(F.col("role") == "tool_call", F.lower("tool"))), fences)


def shell_command() -> Column:
    """The first word of a shell call, a prompt before it left out; null for other events."""
    words = F.split(F.trim(F.coalesce("command", "content")), r"\s+")
    return F.when((F.col("role") == "tool_call") & (F.col("tool") == "Bash"), F.when(words[0].isin("$", "#"), F.get(words, F.lit(1))).otherwise(words[0]))


def structural_tags(prints: Column | None = None) -> Column:
    """Of an event: tags of its file's extension and its command, and its error fingerprints in lower case."""
    commands = F.create_map(*[F.lit(x) for kv in T.COMMAND_TAGS.items() for x in kv])
    own = F.array(T.extension_tag(F.col("path")), commands[shell_command()])
    return own if prints is None else F.concat(own, F.coalesce(F.transform(prints, F.lower), F.array().cast("array<string>")))


def own_tags(words: list[str] | None = None) -> dict[str, Column]:
    """Of an event: its tags of all tiers."""
    prints = T.error_fingerprints(F.col("content"))
    every = F.concat(explicit_tags(), structural_tags(prints), keyword_tags(F.col("content"), words or []))
    return {"own_tags": F.filter(F.array_distinct(every), lambda t: t.isNotNull())}


def tags(events: DataFrame, words: list[str] | None = None) -> DataFrame:
    """session_id, tags: the sorted union of explicit, structural and (with a dictionary) keyword tags."""
    e = events if "own_tags" in events.columns else events.withColumns(own_tags(words))
    each = e.select("session_id", F.explode("own_tags").alias("tag")).distinct()
    return each.groupBy("session_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def solution_lines() -> dict[str, Column]:
    """Of an event: whether it tells of an error, and the line that it would give a solution."""
    text, role = F.lower("content"), F.col("role")
    has = lambda words: text.rlike("|".join(T.quoted(w) for w in words))
    lines = F.split(F.coalesce("content", F.lit("")), r"\r?\n")
    named = F.filter(F.transform(lines, F.trim), lambda x: x.startswith("File: ") | x.startswith("Path: "))
    filled = F.filter(F.transform(lines, F.trim), lambda x: x != "")
    short = F.when(F.octet_length(F.get(filled, F.lit(0))) > 100, F.concat(enrich.byte_prefix(F.get(filled, F.lit(0)), 100), F.lit("..."))).otherwise(F.get(filled, F.lit(0)))
    what = F.coalesce(F.get(named, F.lit(0)), short, F.lit("(file operation)"))
    command = F.trim(enrich.byte_prefix(F.get(F.split(F.coalesce("command", "content", F.lit("")), r"\r?\n"), F.lit(0)), 120))
    return {
        "failed": ((role == "tool_result") & has(RESULT_ERRORS)) | ((role == "user") & has(USER_ERRORS)),
        "did": F.when((role == "tool_call") & F.col("tool").isin("Edit", "Write"), F.concat(F.lit("["), "tool", F.lit("] "), what)).when((role == "tool_call") & (F.col("tool") == "Bash"), F.concat(F.lit("[Bash] "), command)),
    }


def solutions(events: DataFrame, cap: int = SOLUTION_BYTES) -> DataFrame:
    """session_id, solution: what was edited, written and run from the last error on, or in the last two thirds where there was none.

    Lines beyond ``cap`` bytes are cut off with a mark; only those that reach
    into the cap are gathered.  Sessions without such calls give no row.
    """
    e = events if "did" in events.columns else events.withColumns(solution_lines())
    e = shared_checkpoint(blocks.running(e.select("session_id", "seq", "failed", "did", F.lit(1).alias("one")), "session_id", "seq", "one", "idx", total="n"))
    last = e.groupBy("session_id").agg(F.max(F.when(F.col("failed"), F.col("idx"))).alias("last_error"))
    e = e.where("did is not null").join(last, "session_id").where(F.col("idx") >= F.coalesce("last_error", F.floor(F.col("n") / 3)))
    e = blocks.running(e.select("session_id", "seq", "did", (F.octet_length("did") + 1).alias("size")), "session_id", "seq", "size", "head").where(F.col("head") <= cap)
    g = e.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "did"))), lambda x: x["did"]), "\n").alias("s"))
    return g.select("session_id", F.when(F.octet_length("s") > cap, F.concat(enrich.byte_prefix(F.col("s"), cap), F.lit("...\n(truncated)"))).otherwise(F.col("s")).alias("solution"))


def key_files(events: DataFrame, most: int = 3) -> DataFrame:
    """session_id, files: names of up to ``most`` touched files, those with an extension and a short path first, then in order of their first touch."""
    f = events.where("path is not null and path != ''").groupBy("session_id", "path").agg(F.min("seq").alias("at"))
    name = F.regexp_extract("path", r"[^/]*$", 0)
    f = f.select("session_id", "path", "at", name.alias("name"), (name.contains(".") & ~name.startswith(".")).alias("typed"))
    w = Window.partitionBy("session_id").orderBy(F.desc("typed"), F.when(F.col("typed"), F.octet_length("path")), "at", "path")
    first = f.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    g = first.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("x"))
    return g.select("session_id", F.transform("x", lambda v: v["name"]).alias("files"))


def summaries(events: DataFrame, limit: int = 80) -> DataFrame:
    """session_id, summary: the first prompt, cut, and the key files in parentheses; a fixed text without either."""
    return with_files(enrich.summary(events, limit, None), key_files(events))


def with_files(prompts: DataFrame, names: DataFrame) -> DataFrame:
    s = prompts.join(names, "session_id", "left")
    files = F.when(F.size("files") > 0, F.concat(F.lit("("), F.array_join("files", ", "), F.lit(")")))
    return s.select("session_id", F.coalesce(F.nullif(F.concat_ws(" ", "summary", files), F.lit("")), F.lit(enrich.NO_PROMPT)).alias("summary"))


def artifacts(events: DataFrame) -> DataFrame:
    """session_id, seq, block_no, language, file_path, code, is_final: fenced blocks of assistant messages, the last of a language and file in a session final.

    The file is the first that the message names, if it looks like one.
    """
    named = F.trim(F.regexp_extract("content", CONTEXT_FILE, 1))
    e = events.where((F.col("role") == "assistant") & F.col("content").contains("```"))
    e = e.select("session_id", "seq", "content", F.when((named != "") & named.rlike(r"[/.]"), named).alias("file_path"))
    langs, codes = F.regexp_extract_all("content", F.lit(enrich.FENCE), 1), F.regexp_extract_all("content", F.lit(enrich.FENCE), 2)
    b = e.select("session_id", "seq", "file_path", F.posexplode(F.arrays_zip(langs.alias("language"), codes.alias("code"))).alias("block_no", "b"))
    b = b.select("session_id", "seq", "block_no", F.lower("b.language").alias("language"), "file_path", "b.code").where(F.trim(F.regexp_replace("code", r"\s+", " ")) != "")
    # the last of a key is an aggregate, so that the key of a hot session is not sorted
    last = b.groupBy(F.col("session_id").alias("__s"), F.col("language").alias("__l"), F.col("file_path").alias("__f")).agg(F.max(F.struct("seq", "block_no")).alias("__last"))
    same = F.col("session_id").eqNullSafe(F.col("__s")) & F.col("language").eqNullSafe(F.col("__l")) & F.col("file_path").eqNullSafe(F.col("__f"))
    return b.join(last, same).select("session_id", "seq", "block_no", "language", "file_path", "code", (F.struct("seq", "block_no") == F.col("__last")).alias("is_final"))


def session_documents(events: DataFrame, words: list[str] | None = None, commits: DataFrame | None = None) -> DataFrame:
    """One document a session.  ``commits``: session_id, hash."""
    # what is told by the texts, without them, written once
    told = {"prints": T.error_fingerprints(F.col("content")), **enrich.signals(), **solution_lines(), **own_tags(words)}
    e = shared_checkpoint(events.withColumns(told).drop("content"))
    facts = enrich.facts(e)
    prints = e.select("session_id", F.explode("prints").alias("p")).distinct().groupBy("session_id").agg(F.array_sort(F.collect_list("p")).alias("error_fingerprint"))
    paths = e.where("path is not null").select("session_id", "path").distinct().groupBy("session_id").agg(F.array_sort(F.collect_list("path")).alias("file_paths"))
    summary = with_files(enrich.summary(events, missing=None), key_files(e))
    d = facts.join(enrich.content(events), "session_id").join(summary, "session_id").join(solutions(e).withColumnRenamed("solution", "solution_summary"), "session_id", "left")
    d = d.join(tags(e), "session_id", "left").join(prints, "session_id", "left").join(paths, "session_id", "left")
    if commits is not None:
        d = d.join(commits.groupBy("session_id").agg(F.array_sort(F.collect_set("hash")).alias("git_commits")), "session_id", "left")
    empty = F.array().cast("array<string>")
    lists = ["tags", "error_fingerprint", "file_paths", "git_commits"]
    return d.withColumns({c: F.coalesce(c, empty) if c in d.columns else empty for c in lists}).select(
        F.col("session_id").alias("doc_id"), "session_id", F.lit("session").alias("doc_type"), "source_agent", "project", "model", "outcome",
        T.session_type(F.col("content"), F.coalesce("unresolved", F.lit(False))).alias("session_type"), F.date_trunc("second", "started").cast("timestamp_ntz").alias("timestamp"),
        F.col("turns").alias("turn_count"), *lists, "content", "summary", "solution_summary")


def artifact_documents(events: DataFrame) -> DataFrame:
    """One document a code artifact; it goes with its session."""
    a = artifacts(events)
    head = enrich.manifest(events).select("session_id", "source_agent", "project", "model", "started")
    return a.join(head, "session_id").select(
        F.concat_ws("#", "session_id", "seq", "block_no").alias("doc_id"), "session_id", F.lit("code_artifact").alias("doc_type"), "source_agent", "project", "model",
        F.date_trunc("second", "started").cast("timestamp_ntz").alias("timestamp"), F.col("language").alias("code_language"), F.coalesce("file_path", F.lit("")).alias("code_file_path"),
        F.col("is_final").alias("code_is_final"), F.col("code").alias("content"), F.col("code").alias("code_content"))
