"""What many sessions together tell: failed attempts, notes on files, habits and rules of projects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import blocks, documents, enrich
from quern.session import shared_checkpoint

ALTERNATIVES = 5
# Commands that build, and folders of tests.
BUILD_TOOLS = ["cargo", "make", "cmake", "npm", "pnpm", "yarn", "bun", "go", "gcc", "clang"]
TEST_FOLDERS = ["tests", "__tests__", "spec", "specs"]
CATEGORIES = ["correction", "convention", "warning", "context"]  # in this order


def read() -> dict[str, Column]:
    """All that the operators here want to know of an event's text."""
    return {**enrich.signals(), **enrich.step(), **enrich.welcome(), "prints": T.error_fingerprints(F.col("content"))}


def antipatterns(events: DataFrame, most: int = ALTERNATIVES) -> DataFrame:
    """session_id, kind, n, n_events, fingerprints, alternatives of failed and abandoned sessions.

    ``rejection``: ``n`` attempts in vain; ``escalation``: ``n`` kinds of errors
    in tool results.  The fingerprints are those of all events in the span;
    alternatives are up to ``most`` sessions, by id, that met one of them and
    ended well.
    """
    e = events if "prints" in events.columns else events.withColumns(read())
    # flags and fingerprints without the texts, written once and read by all that follows
    e = shared_checkpoint(e.select("session_id", "seq", "role", "source_agent", "project", "model", "ts", "path", *read()))
    failed = enrich.outcome(e).where("outcome in ('failure', 'abandoned')").select("session_id")
    at = blocks.running(e.select("session_id", "seq", "role", "prints", F.lit(1).alias("one")), "session_id", "seq", "one", "idx")
    prints = at.where("size(prints) > 0").select("session_id", "idx", "role", F.explode("prints").alias("fingerprint"))
    rejected = enrich.rejection_windows(e).select("session_id", F.lit("rejection").alias("kind"), F.col("attempts").cast("bigint").alias("n"), F.col("start_idx").cast("bigint").alias("a"), (F.col("end_idx") - 1).cast("bigint").alias("b"))
    worse = prints.where("role = 'tool_result'").groupBy("session_id").agg(F.count_distinct("fingerprint").alias("n"), F.min("idx").alias("a"), F.max("idx").alias("b")).where("n >= 3")
    spans = rejected.unionByName(worse.withColumn("kind", F.lit("escalation"))).join(failed, "session_id", "left_semi")
    met = spans.select("session_id", "kind", "a", "b").join(prints, "session_id").where("idx between a and b").select("session_id", "kind", "fingerprint").distinct()
    # of the sessions that met an error and ended well no others than the first can be among the first of a union
    good = prints.select("session_id", "fingerprint").distinct().join(enrich.ended_well(e), "session_id", "left_semi")
    good = blocks.first_of(good.withColumnRenamed("session_id", "other"), ["fingerprint"], [F.asc("other")], most + 1)
    pairs = met.join(good, "fingerprint").where("session_id <> other").select("session_id", "kind", "other").distinct()
    few = blocks.first_of(pairs, ["session_id", "kind"], [F.asc("other")], most).groupBy("session_id", "kind").agg(F.array_sort(F.collect_list("other")).alias("alternatives"))
    named = met.groupBy("session_id", "kind").agg(F.array_sort(F.collect_list("fingerprint")).alias("fingerprints"))
    empty = F.array().cast("array<string>")
    out = spans.join(named, ["session_id", "kind"], "left").join(few, ["session_id", "kind"], "left")
    return out.select("session_id", "kind", "n", (F.col("b") - F.col("a") + 1).alias("n_events"), F.coalesce("fingerprints", empty).alias("fingerprints"), F.coalesce("alternatives", empty).alias("alternatives"))


def described() -> Column:
    """An anti-pattern in a sentence."""
    n, m = F.col("n").cast("string"), F.col("n_events").cast("string")
    return F.when(F.col("kind") == "rejection", F.concat(n, F.lit(" attempts in vain over "), m, F.lit(" events"))).otherwise(F.concat(n, F.lit(" kinds of errors within "), m, F.lit(" events")))


def touched(events: DataFrame) -> DataFrame:
    """path, session_id, each once."""
    return events.where("path is not null").select("path", "session_id").distinct()


def file_errors(touches: DataFrame, facts: DataFrame, prints: DataFrame) -> DataFrame:
    """path, fingerprint, sessions, last_seen: the errors of the sessions that touched a file.  ``prints``: session_id, fingerprint."""
    of = prints.select("session_id", "fingerprint").distinct().join(facts.select("session_id", "started"), "session_id")
    return touches.join(of, "session_id").groupBy("path", "fingerprint").agg(F.count("*").alias("sessions"), F.max("started").alias("last_seen"))


def file_gotchas(touches: DataFrame, patterns: DataFrame) -> DataFrame:
    """path, pattern, session_id, alternatives: what went wrong in sessions that touched a file; of equal descriptions the first session's."""
    t = touches.join(patterns.withColumn("pattern", described()), "session_id")
    g = t.groupBy("path", "pattern").agg(F.min(F.struct("session_id", "kind", "alternatives")).alias("x"))
    return g.select("path", "pattern", "x.session_id", "x.alternatives")


def file_samples(touches: DataFrame, facts: DataFrame, most: int = 5) -> DataFrame:
    """path, session_id, started: the most recent sessions of each file."""
    return blocks.first_of(touches.join(facts.select("session_id", "started"), "session_id"), ["path"], [F.desc("started"), F.asc("session_id")], most)


def shown() -> dict[str, Column]:
    """Of an event: what it shows of its project's habits (kind, value)."""
    prints = T.error_fingerprints(F.col("content"))
    one = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    each = lambda kind, vs: F.transform(vs, lambda v: one(kind, v))
    fences = F.filter(F.transform(F.regexp_extract_all("content", F.lit(r"```([a-zA-Z0-9_+#-]+)"), 1), F.lower), lambda x: ~x.isin("text", "plaintext"))
    parts = F.coalesce(F.split("path", "/"), F.array().cast("array<string>"))
    folders = F.filter(parts, lambda x: x.isin(*TEST_FOLDERS))
    named = F.transform(F.filter(parts, lambda x: x.startswith("test_") | x.endswith("_test")), lambda x: F.concat(x, F.lit("_files")))
    return {"shown": F.concat(
        F.array(one("command", documents.shell_command()), one("tool", F.when(F.col("role") == "tool_call", F.lower("tool"))), one("extension", F.lower(F.regexp_extract("path", r"[^.]*$", 0)))),
        each("fence", fences), each("error", prints), each("test", folders), each("test", named))}


def habits(events: DataFrame) -> DataFrame:
    """project, kind, value, n: how often a project's events show a command, tool, fence language, file extension, error or test folder.

    One pass: each event gives the few values it shows, counts are added up in
    the tasks.  Events without project show nothing.
    """
    e = events if "shown" in events.columns else events.withColumns(shown())
    rows = e.where("project is not null").select("project", F.inline("shown")).where("value is not null and value != ''")
    return rows.groupBy("project", "kind", "value").agg(F.count("*").alias("n"))


def shorten(fp: Column, limit: int = 100) -> Column:
    """A fingerprint of at most ``limit`` characters that keeps what stands before its first colon, three dots behind."""
    head = F.regexp_extract(fp, r"^[^:]*:", 0)
    room = limit - F.length(head) - 4
    cut = F.when((head != "") & (room > 10), F.concat(head, F.substring(fp, F.length(head) + 1, room), F.lit("..."))).otherwise(F.concat(F.left(fp, F.lit(limit - 3)), F.lit("...")))
    return F.when(F.length(fp) <= limit, fp).otherwise(cut)


def rules(counted: DataFrame, corrections: DataFrame) -> DataFrame:
    """project, category, rule, place: rules that a project's habits suggest, corrections by users first.

    ``counted``: of ``habits``; ``corrections``: project, correction, n.  All
    inputs are counts; a rank is only taken among a project's values of a kind.
    """
    of = lambda kind: counted.where(F.col("kind") == kind)
    say = lambda df, category, text: df.select("project", F.lit(category).alias("category"), text.alias("rule"), F.col("n"))
    s = lambda *xs: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs])
    top = lambda df, k: blocks.first_of(df, ["project"], [F.desc("n"), F.asc("value")], k)
    languages = say(top(of("fence"), 3).where("n >= 2"), "context", s("Main language: ", F.col("value")))
    pairs = counted.sparkSession.createDataFrame(T.COMPETING_TOOLS, "a string, b string")
    used = of("command").select("project", F.col("value").alias("a"), F.col("n").alias("n_a"))
    both = used.join(F.broadcast(pairs), "a").join(of("command").select("project", F.col("value").alias("b"), F.col("n").alias("n_b")), ["project", "b"], "left").na.fill(0, ["n_b"])  # nine pairs
    prefer = both.where("n_a > n_b").select("project", F.lit("convention").alias("category"), s("Use ", F.col("a"), ", not ", F.col("b"), " (", F.col("n_a"), " times against ", F.col("n_b"), ")").alias("rule"), F.col("n_a").alias("n"))
    builds = say(of("command").where(F.col("value").isin(*BUILD_TOOLS) & (F.col("n") >= 2)), "context", s("Built with ", F.col("value")))
    tests = top(of("test"), 1)
    tested = say(tests, "context", F.when(F.col("value").endswith("_files"), s("Test files are named like ", F.regexp_replace("value", "_files$", ""))).otherwise(s("Tests are in ", F.col("value"))))
    errors = say(top(of("error"), 5).where("n >= 2"), "warning", s("Comes back: ", shorten(F.col("value")), " (", F.col("n"), " times)"))
    told = say(corrections.where("project is not null"), "correction", F.col("correction"))
    every = reduce(DataFrame.unionByName, [told, prefer, errors, languages, builds, tested])
    once = every.groupBy("project", "category", "rule").agg(F.max("n").alias("n"))
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    w = Window.partitionBy("project").orderBy(rank, F.desc("n"), "rule")  # a project's rules are few: three, nine, ten, one, five and what users corrected
    return once.select("project", "category", "rule", F.row_number().over(w).alias("place"))


def of_project(df: DataFrame, project: str) -> DataFrame:
    """Rows of a project: its own and those of the folders below it."""
    p = project.rstrip("/")
    return df.where((F.col("project") == p) | F.col("project").startswith(p + "/"))


def narrowed(facts: DataFrame, agent: str | None = None, project: str | None = None, since: str | None = None) -> DataFrame:
    """Sessions of an agent, of a project, begun since a time (inclusive); what is not given narrows nothing."""
    out = facts
    for c, v in (("source_agent", agent), ("project", project)):
        out = out if v is None else out.where(F.col(c) == v)
    return out if since is None else out.where(F.col("started") >= F.lit(since).cast("timestamp_ntz"))
