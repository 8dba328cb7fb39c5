"""Conversations rebuilt from message rows (problem 1).

Message rows are nodes, the turn before is a node's parent.  Root-to-leaf paths
come out of iterative pointer jumping (:func:`resolve_threads`), which finds
orphans and cycles on the way.  Where the parents follow from an order, as in
session logs, up to ``RUN`` turns that follow each other are contracted to one
node first (:func:`contract`), so that the joins of the iteration touch one row
a run instead of one a message.  Every session, the short ones too, is resolved
by the iteration; what a turn's number is, it takes from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import shared_checkpoint

# Spellings of the four speakers, in lower case.
ROLE_SPELLINGS = {
    "user": ["user", "human"],
    "assistant": ["assistant", "ai"],
    "tool_call": ["tool_call", "toolcall", "tool-call", "tool call"],
    "tool_result": ["tool_result", "toolresult", "tool-result", "tool result"],
}
BOOKKEEPING = ["progress", "file-history-snapshot"]
RUN = 16  # turns that one node stands for, at most


def speaker(role: Column) -> Column:
    """One of the four speakers, null for any other role."""
    r = F.lower(F.trim(role))
    out = F.when(F.lit(False), "")
    for name, spellings in ROLE_SPELLINGS.items():
        out = out.when(r.isin(*spellings), name)
    return out


def resolve_threads(nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Resolve parent pointers by pointer jumping.

    ``nodes``: ``id`` (unique, not null), ``parent`` (null for a root) and
    ``weight`` (BIGINT; 1 gives depths).  Returns ``id, root, before, state``:
    the root of the node's path, the sum of the weights of the nodes before it
    on that path, and ``ok``, ``orphan`` (the path ends at a parent that is not
    there; ``root`` is the last node that is) or ``cycle`` (``root`` is null).

    Every round joins the unresolved nodes with all nodes and doubles the
    distance that a pointer spans, so a path of n nodes takes log2(n) rounds.
    As long as a path is unresolved each round resolves a node of it; a round
    that resolves none leaves only nodes on, or leading into, cycles.
    The side looked up has unique keys, so a pointer that most nodes share is
    split by the adaptive skew join.  An empty input gives an empty result.
    """
    known = nodes.select(F.col("id").alias("p"), F.lit(True).alias("there"))
    start = nodes.join(known, F.col("parent") == F.col("p"), "left").select(
        "id", F.when(F.col("there"), F.col("parent")).alias("ptr"), F.col("weight").alias("w"),
        F.when(F.col("parent").isNotNull() & F.col("there").isNull(), "orphan").alias("end"),
    )
    # hop: what lies between the node and its pointer, the pointer's weight included
    w = nodes.select(F.col("id").alias("ptr"), F.col("weight").alias("hop"))
    state = shared_checkpoint(start.join(w, "ptr", "left").select("id", "ptr", F.coalesce("hop", F.lit(0)).cast("bigint").alias("before"), "end"))
    left = -1
    for _ in range(max_rounds):
        now = state.where("ptr is not null").count()
        if now == 0 or now == left:
            break
        left = now
        other = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("before").alias("before2"), F.col("end").alias("end2"), F.col("root").alias("root2") if "root" in state.columns else F.lit(None).cast(nodes.schema["id"].dataType).alias("root2"))
        active = state.where("ptr is not null").drop("root").join(other, "ptr")
        jumped = active.select(
            "id", F.col("ptr2").alias("ptr"), (F.col("before") + F.col("before2")).alias("before"), F.col("end2").alias("end"),
            F.when(F.col("ptr2").isNull(), F.coalesce("root2", "ptr")).alias("root"),
        )
        rest = state.where("ptr is null")
        rest = rest if "root" in rest.columns else rest.withColumn("root", F.col("id"))
        state = shared_checkpoint(rest.select("id", "ptr", "before", "end", "root").unionByName(jumped))
    if "root" not in state.columns:
        state = state.withColumn("root", F.when(F.col("ptr").isNull(), F.col("id")))
    verdict = F.when(F.col("ptr").isNotNull(), "cycle").otherwise(F.coalesce("end", F.lit("ok")))
    return state.select("id", F.when(F.col("ptr").isNull(), F.col("root")).alias("root"), F.when(F.col("ptr").isNull(), F.col("before")).alias("before"), verdict.alias("state"))


def turns(messages: DataFrame) -> DataFrame:
    """The turns among message rows: session_id, msg_uuid, line_no, at, speaker.

    Expects ``session_id, msg_uuid, line_no, rec_type, msg_role, msg_content,
    msg_tool, utc_micros``; other columns are ignored.  Bookkeeping rows, rows
    with neither tool nor content, and rows without session or id are no turns.
    A msg_uuid counts once per session, at its smallest line_no (at the earliest
    instant, if two rows share it).  ``at`` is the instant in milliseconds,
    rounded down; without instant it is the last of all.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(r"(?U)\S")
    said = messages.where(~F.coalesce(F.col("rec_type"), F.lit("")).isin(*BOOKKEEPING) & (text("msg_content") | text("msg_tool")) & F.col("session_id").isNotNull() & F.col("msg_uuid").isNotNull())
    who = speaker(F.col("msg_role"))
    at = F.coalesce(F.floor(F.col("utc_micros") / 1000).cast("bigint"), F.lit((1 << 63) - 1))
    first = said.select("session_id", "msg_uuid", F.struct(F.col("line_no"), at.alias("at"), F.coalesce(who, F.lit("")).alias("speaker")).alias("m"))
    return first.groupBy("session_id", "msg_uuid").agg(F.min("m").alias("m")).select("session_id", "msg_uuid", "m.*")


def contract(ordered: DataFrame) -> DataFrame:
    """Sort turns over the cluster and contract those that follow each other to runs.

    session_id, part, no, id, turns (array of msg_uuid, speaker), first, last,
    bad (two turns that may not follow each other), answered.  A session is
    spread by instant over as many partitions as its size asks for; what a
    window sees is a session's turns of one partition, never a whole session.
    """
    key = ["session_id", "at", "line_no", "msg_uuid"]
    s = ordered.repartitionByRange(*key).sortWithinPartitions(*key).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    w = Window.partitionBy("session_id", "part").orderBy("place")
    s = s.select("session_id", "part", "place", "msg_uuid", "speaker", F.floor((F.row_number().over(w) - 1) / RUN).cast("int").alias("no"), F.lag("speaker").over(w).alias("prev"))
    return s.groupBy("session_id", "part", "no").agg(
        F.min("place").alias("id"),
        F.array_sort(F.collect_list(F.struct("place", "msg_uuid", "speaker"))).alias("turns"),  # at most RUN
        F.min_by("speaker", "place").alias("first"), F.max_by("speaker", "place").alias("last"),
        F.max(F.coalesce(_clash(F.col("prev"), F.col("speaker")), F.lit(False))).alias("bad"),
        F.max(F.col("speaker") == "assistant").alias("answered"),
    )


def _clash(a: Column, b: Column) -> Column:
    """Whether two turns may not follow each other."""
    call, result, user = "tool_call", "tool_result", "user"
    return ((a == user) & (b == user)) | ((a == call) & (b != result)) | ((b == result) & (a != call))


def linked(runs: DataFrame) -> DataFrame:
    """Runs with their parent: id, parent, weight and fault (what is wrong at the run, null if nothing).

    The run before lies in the same partition, or is the last one of the session
    in the partition before; only the latter asks for a window over a session,
    of one row a partition.
    """
    ends = runs.groupBy("session_id", "part").agg(F.max_by(F.struct("id", "last"), "no").alias("end"))
    w = Window.partitionBy("session_id").orderBy("part")
    ends = ends.select("session_id", "part", F.lag("end").over(w).alias("carried"), F.lead("part").over(w).isNull().alias("final"), F.col("end")["id"].alias("end_id"))
    near = Window.partitionBy("session_id", "part").orderBy("no")
    own = runs.select("session_id", "part", "no", "id", F.size("turns").cast("bigint").alias("weight"), "first", "last", "bad", "answered", F.lag(F.struct("id", "last")).over(near).alias("near"))
    at = own.join(ends, ["session_id", "part"]).withColumn("before", F.coalesce("near", "carried"))
    fault = (
        F.when(F.col("bad") | F.coalesce(_clash(F.col("before")["last"], F.col("first")), F.lit(False)), "turns_clash")
        .when(F.col("before").isNull() & (F.col("first") != "user"), "no_user_first")
        .when(F.col("final") & (F.col("id") == F.col("end_id")) & (F.col("last") == "tool_call"), "call_unanswered")
    )
    return at.select("session_id", "id", F.col("before")["id"].alias("parent"), "weight", "answered", fault.alias("fault"))


def judged(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The runs of all sessions, their resolved places, and per session its size, verdict and the states of its runs.

    Verdicts: ``orphan`` or ``cycle``, else the fault whose name comes first,
    else ``unanswered`` (no assistant turn), else ``kept``.
    """
    runs = shared_checkpoint(contract(turns(messages)))
    nodes = shared_checkpoint(linked(runs))
    places = shared_checkpoint(resolve_threads(nodes.select("id", "parent", "weight")))
    per = nodes.join(places.select("id", "state"), "id").groupBy("session_id").agg(
        F.sum("weight").alias("turns"), F.min("fault").alias("fault"), F.max("answered").alias("answered"),
        F.max(F.when(F.col("state") != "ok", F.col("state"))).alias("state"), F.count("*").alias("runs"),
    )
    verdict = F.coalesce("state", "fault", F.when(~F.col("answered"), "unanswered"), F.lit("kept"))
    return runs, places, per.select("session_id", "turns", "runs", verdict.alias("verdict"))


def conversations(messages: DataFrame) -> DataFrame:
    """Ordered turns of the sessions that are whole: session_id, turn_no, msg_uuid, speaker.

    A session is kept if it has an assistant turn, starts with a user turn, has
    no two user turns in succession, and tool_call and tool_result turns stand
    in directly successive pairs only.  Turns are ordered by instant, then
    line_no (then id); turns without instant come last.  A turn whose role is
    none of the four speakers breaks no rule by itself.
    """
    runs, places, sessions = judged(messages)
    whole = sessions.where("verdict = 'kept'").select("session_id")
    at = runs.select("session_id", "id", "turns").join(whole, "session_id", "left_semi").join(places.where("state = 'ok'").select("id", "before"), "id")
    return at.select("session_id", "before", F.posexplode("turns").alias("k", "t")).select("session_id", (F.col("before") + F.col("k") + 1).cast("int").alias("turn_no"), "t.msg_uuid", "t.speaker")


def report(messages: DataFrame) -> DataFrame:
    """Per verdict: sessions, turns, and the nodes that went through the iteration."""
    return judged(messages)[2].groupBy("verdict").agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns"), F.sum("runs").alias("nodes"))
