"""Per-session enrichment: outcome, manifest, content, summary, artifacts, failed attempts.

Everything is conditional aggregation over ``seq``; only what a bounded window
lets through is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import blocks
from quern.session import shared_checkpoint

# Signals of the outcome and their weights.
SATISFACTION = r"(?i)\b(thanks|thank you|works? now|fixed|perfect|great|awesome|that worked|exactly what|helped|solved)\b"
FRUSTRATION = r"(?i)\b(still not working|doesn'?t work|still broken|gave up|never mind|forget it|too complicated|this is stupid|waste of time|frustrating)\b"
COMPLETION = r"(?i)\b(done|completed|finished|implemented|added|created|updated|removed|deleted|merged|deployed|pushed)\b"
TOOL_ERROR = r"(?i)\b(error|failed|exception|panic|fatal|timeout|refused|denied|invalid|not found|unexpected)\b"
TOOL_SUCCESS = r"(?i)\b(success\w*|ok|completed|done|passed)\b"
EDIT_TOOLS = ["Edit", "Write", "apply_edit"]
WEIGHTS = {
    "user_satisfaction": 30, "user_frustration": -25, "final_edit_write": 15, "final_error": -20, "unresolved_error": -15, "tool_success": 10,
    "tool_failure": -10, "very_short_session": -5, "task_completion": 25, "success_threshold": 20, "failure_threshold": -20, "min_turns": 3,
}
# Substrings that tell a failed and a welcome step.
ERROR_SIGNALS = "error|failed|exit code 1|panic|fatal|exception|traceback"
POSITIVE_SIGNALS = "thanks|works|great|perfect|done|looks good"
FENCE = r"```([a-zA-Z0-9_+#-]*)\n([\s\S]*?)```"


def signals() -> dict[str, Column]:
    """What an event's text tells of the outcome, and its size: columns to be worked out where the text is read."""
    c = F.col("content")
    user, result = F.col("role") == "user", F.col("role") == "tool_result"
    return {
        "edit": F.coalesce((F.col("role") == "tool_call") & F.col("tool").isin(*EDIT_TOOLS), F.lit(False)),
        "happy": user & c.rlike(SATISFACTION), "sad": user & c.rlike(FRUSTRATION), "complete": user & c.rlike(COMPLETION),
        "error": result & c.rlike(TOOL_ERROR), "fine": result & c.rlike(TOOL_SUCCESS), "n_bytes": F.octet_length(c),
    }


def _with(events: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return events.withColumns({k: v for k, v in columns.items() if k not in events.columns})


def _manifest() -> list[Column]:
    return [
        F.first("source_agent").alias("source_agent"), F.max("project").alias("project"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("seq"))).alias("model"),
        F.min_by("ts", "seq").alias("started"), F.max_by("ts", "seq").alias("ended"), F.count("*").alias("turns"),
        F.min_by("role", "seq").alias("first_role"), F.max_by("role", "seq").alias("last_role"), F.count_distinct("path").alias("n_files"), F.sum("n_bytes").alias("content_bytes")]


def manifest(events: DataFrame) -> DataFrame:
    """One row a session: start, end, all events counted as turns, first and last role, distinct files, first model."""
    return _with(events, {"n_bytes": F.octet_length("content")}).groupBy("session_id").agg(*_manifest())


def _outcome_parts() -> list[Column]:
    at = lambda cond: F.when(cond, F.col("seq"))
    return [
        F.count("*").alias("n_turns"), F.count_if("happy").alias("n_happy"), F.count_if("sad").alias("n_sad"), F.count_if("complete").alias("n_complete"),
        F.max(at(F.col("happy"))).alias("last_happy"), F.max(at(F.col("sad"))).alias("last_sad"), F.max("error").alias("any_error"),
        F.max_by("error", at(F.col("error") | F.col("fine"))).alias("last_tool_error"), F.max(F.col("role") == "user").alias("any_user"),
        F.max_by(F.struct("role", "edit", "error", "after_edit"), "seq").alias("end")]


def _score(w: dict[str, int]) -> tuple[Column, Column]:
    """Score and label from the parts."""
    short = F.col("n_turns") < w["min_turns"]
    satisfied = F.col("last_happy").isNotNull() & (F.col("last_sad").isNull() | (F.col("last_happy") > F.col("last_sad")))
    final_edit = F.when(F.col("end.role") == "tool_result", F.col("end.after_edit")).otherwise(F.col("end.edit"))
    score = (
        F.when(short, w["very_short_session"]).otherwise(0)
        + F.col("n_happy") * w["user_satisfaction"] + F.col("n_sad") * w["user_frustration"] + F.col("n_complete") * w["task_completion"]
        + F.when(final_edit, w["final_edit_write"]).otherwise(0) + F.when(F.col("end.error"), w["final_error"]).otherwise(0)
        + F.when(F.col("any_error") & ~satisfied, w["unresolved_error"]).otherwise(0)
        + F.when(F.col("last_tool_error").isNull(), 0).when(F.col("last_tool_error"), w["tool_failure"]).otherwise(w["tool_success"])
    )
    label = F.when(F.col("score") >= w["success_threshold"], "success").when(F.col("score") <= w["failure_threshold"], "failure").when(short & F.col("any_user"), "abandoned").otherwise("unknown")
    return score.cast("bigint"), label


def _marked(events: DataFrame) -> DataFrame:
    e = blocks.lag(_with(events, signals()), "session_id", "seq", ["edit"], "prev")
    return e.withColumn("after_edit", F.coalesce("prev.edit", F.lit(False))).drop("prev")


def outcome(events: DataFrame, w: dict[str, int] | None = None) -> DataFrame:
    """session_id, score, outcome.

    The event before the last is found by a window; everything else is one
    aggregation, in which a "last" is the value at the greatest matching seq.
    Events that bring the columns of ``signals`` need no text.
    """
    score, label = _score(WEIGHTS | (w or {}))
    return _marked(events).groupBy("session_id").agg(*_outcome_parts()).withColumn("score", score).select("session_id", "score", label.alias("outcome"))


def facts(events: DataFrame, w: dict[str, int] | None = None) -> DataFrame:
    """Manifest, score and outcome of each session, from one aggregation."""
    score, label = _score(WEIGHTS | (w or {}))
    g = _marked(events).groupBy("session_id").agg(*_manifest(), *_outcome_parts()).withColumn("score", score).withColumn("outcome", label)
    return g.select(
        "session_id", "source_agent", "project", "model", "started", "ended", "turns", "first_role", "last_role", "n_files", "content_bytes", "score", "outcome",
        (F.col("any_error") & ~(F.col("last_happy").isNotNull() & (F.col("last_sad").isNull() | (F.col("last_happy") > F.col("last_sad"))))).alias("unresolved"))


def byte_prefix(text: Column, n: int) -> Column:
    """The longest prefix of at most n bytes that cuts no character."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(cut, "�+$", ""))


def content(events: DataFrame, tool_bytes: int = 1000, cap: int = 500_000) -> DataFrame:
    """session_id, content: ``role: text`` of the events in order, a blank line between.

    Tool results are cut to ``tool_bytes``.  Of a session beyond ``cap`` bytes
    only the events that reach into its first or last half are collected, so
    what one group gathers is bounded; the middle gives way to a marker.
    """
    text = F.when(F.col("role") == "tool_result", byte_prefix(F.col("content"), tool_bytes)).otherwise(F.col("content"))
    e = events.select("session_id", "seq", F.concat(F.col("role"), F.lit(": "), text).alias("line"))
    e = blocks.running(e.withColumn("n", F.octet_length("line") + 2), "session_id", "seq", "n", "head", total="all").withColumn("tail", F.col("all") - F.col("head") - F.col("n"))
    half = cap // 2
    e = e.where((F.col("head") < half) | (F.col("tail") < half))
    whole = F.max(F.col("head") + F.octet_length("line"))
    g = e.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines"), whole.alias("bytes"))
    joined = F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")
    g = g.select("session_id", joined.alias("content"), F.col("bytes"))
    cut = F.concat(F.left("content", F.lit(half)), F.lit("\n\n[...]\n\n"), F.right("content", F.lit(half)))
    return g.select("session_id", F.when(F.col("bytes") > cap, cut).otherwise(F.col("content")).alias("content"))


NO_PROMPT = "Session with no user prompt"


def summary(events: DataFrame, limit: int = 80, missing: str | None = NO_PROMPT) -> DataFrame:
    """session_id, summary: the first user prompt on one line, cut at a blank, or ``missing``."""
    first = events.where("role = 'user'").groupBy("session_id").agg(F.min_by("content", "seq").alias("p"))
    clean = F.trim(F.regexp_replace("p", r"\s+", " "))
    cut = F.left(F.col("clean"), F.lit(limit))
    at_blank = F.concat(F.when(cut.contains(" "), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut), F.lit("..."))
    out = first.withColumn("clean", clean).select("session_id", F.when(F.length("clean") <= limit, F.col("clean")).otherwise(at_blank).alias("prompt"))
    every = events.select("session_id").distinct()
    return every.join(out, "session_id", "left").select("session_id", F.coalesce(F.nullif(F.col("prompt"), F.lit("")), F.lit(missing)).alias("summary"))


def solution_start(events: DataFrame) -> DataFrame:
    """session_id, from_idx: where the solution begins, at the last error of a tool or, without one, a third of the way in."""
    e = _with(events, {"error": signals()["error"]}).select("session_id", "seq", F.lit(1).alias("one"), "error")
    e = blocks.running(e, "session_id", "seq", "one", "idx")
    g = e.groupBy("session_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("error"), F.col("idx"))).alias("last_error"))
    return g.select("session_id", F.coalesce("last_error", F.floor(F.col("n") / 3)).cast("bigint").alias("from_idx"))


def step() -> dict[str, Column]:
    """What an event is to the search for failed attempts: 1 a failed result, 2 another result, 3 a call, 4 a welcome message, null nothing."""
    role, text = F.col("role"), F.lower("content")
    one = F.when((role == "tool_result") & text.rlike(ERROR_SIGNALS), 1).when(role == "tool_result", 2).when(role == "tool_call", 3)
    return {"step": one.when((role == "user") & text.rlike(POSITIVE_SIGNALS), 4).cast("int")}


def welcome() -> dict[str, Column]:
    return {"welcome": (F.col("role") == "user") & F.lower("content").rlike(POSITIVE_SIGNALS)}


def rejection_windows(events: DataFrame, block: int = blocks.BLOCK) -> DataFrame:
    """session_id, start_idx, end_idx, attempts of sessions that tried in vain (half-open).

    A welcome message resets everything, so a session falls into spans between
    such messages, and a span into the parts that lie in blocks.  All that a part
    needs of those before it is whether their last result failed: its calls are
    counted in two sums, and the parts' sums are put together.
    """
    e = _with(events, step())
    steps = blocks.running(e.select("session_id", "seq", F.lit(1).alias("one"), "step"), "session_id", "seq", "one", "idx").where("step is not null")
    # a few bytes a step, written once and read by the windows and sums below
    s = shared_checkpoint(steps.select("session_id", F.floor(F.col("idx") / block).alias("blk"), "idx", "step"))
    before = Window.partitionBy("session_id", "blk").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("part", F.coalesce(F.count_if(F.col("step") == 4).over(before), F.lit(0)))
    since = Window.partitionBy("session_id", "blk", "part").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("last_result", F.last(F.when(F.col("step").isin(1, 2), F.col("step")), ignorenulls=True).over(since))
    parts = s.groupBy("session_id", "blk", "part").agg(
        F.count_if((F.col("step") == 3) & (F.col("last_result") == 1)).alias("sure"),  # calls behind a failure of this part
        F.count_if((F.col("step") == 3) & F.col("last_result").isNull()).alias("carried"),  # calls before any result of this part
        F.min(F.when(F.col("step") == 1, F.col("idx"))).alias("first_error"), F.max(F.when(F.col("step") == 1, F.col("idx"))).alias("last_error"),
        F.max_by("step", F.when(F.col("step").isin(1, 2), F.col("idx"))).alias("end_result"), F.max(F.col("step") == 4).alias("welcomed"),
    )
    # what lies between two welcome messages is one span; its number is that of the messages before it
    welcomes = s.groupBy("session_id", "blk").agg(F.count_if(F.col("step") == 4).alias("n"))
    base = welcomes.select("session_id", "blk", F.coalesce(F.sum("n").over(Window.partitionBy("session_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    spans = parts.join(base, ["session_id", "blk"]).withColumn("span", F.col("base") + F.col("part"))
    w = Window.partitionBy("session_id", "span").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("pending", F.last("end_result", ignorenulls=True).over(w) == 1)
    g = spans.groupBy("session_id", "span").agg(
        F.sum(F.col("sure") + F.when(F.col("pending"), F.col("carried")).otherwise(0)).alias("attempts"), F.min("first_error").alias("first_error"), F.max("last_error").alias("last_error"), F.max("welcomed").alias("welcomed"))
    # out: a welcome message after two attempts; else the last span decides, while the last error of all is kept
    t = g.groupBy("session_id").agg(F.max(F.col("welcomed") & (F.col("attempts") >= 2)).alias("out"), F.max_by(F.struct("attempts", "first_error", "welcomed"), "span").alias("z"), F.max("last_error").alias("last_error"))
    t = t.where("not out and not z.welcomed and z.attempts >= 2 and z.first_error is not null")
    return t.select("session_id", F.greatest(F.col("z.first_error") - 5, F.lit(0)).cast("int").alias("start_idx"), (F.col("last_error") + 1).cast("int").alias("end_idx"), F.col("z.attempts").cast("int").alias("attempts"))


def escalations(prints: DataFrame, least: int = 3) -> DataFrame:
    """session_id, fingerprints, first_seq, last_seq of sessions whose tool results show several kinds of errors.

    ``prints``: session_id, seq, fingerprint (of tool results).
    """
    g = prints.groupBy("session_id").agg(F.count_distinct("fingerprint").alias("fingerprints"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return g.where(F.col("fingerprints") >= least)


def alternatives(prints: DataFrame, ended_well: DataFrame, failed: DataFrame, most: int = 5) -> DataFrame:
    """session_id, alternative: for each failed session up to ``most`` sessions, by id, that met a same error and ended well.

    Pairs through an error that very many sessions share would grow with their
    product, so per error only the ``most`` + 1 smallest well-ended sessions are
    kept: no others can be among the smallest of any union.
    """
    p = prints.select("session_id", "fingerprint").distinct()
    good = p.join(ended_well, "session_id", "left_semi").withColumnRenamed("session_id", "alternative")
    good = blocks.first_of(good, ["fingerprint"], [F.asc("alternative")], most + 1)
    pairs = p.join(failed, "session_id", "left_semi").join(good, "fingerprint").where("session_id <> alternative").select("session_id", "alternative").distinct()
    return blocks.first_of(pairs, ["session_id"], [F.asc("alternative")], most)


def ended_well(events: DataFrame, last: int = 5) -> DataFrame:
    """session_id of sessions with a welcome user message among the last events.

    The last events of each block are found first, those of the session among
    them, so that no session is sorted as a whole.
    """
    e = _with(events, welcome()).select("session_id", "seq", "welcome", F.floor(F.col("seq") / blocks.BLOCK).alias("blk"))
    near = e.withColumn("rn", F.row_number().over(Window.partitionBy("session_id", "blk").orderBy(F.desc("seq")))).where(F.col("rn") <= last)
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))  # a few rows a block
    return near.withColumn("rn", F.row_number().over(w)).where(f"rn <= {last} and welcome").select("session_id").distinct()
