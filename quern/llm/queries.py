"""The pN_ queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import conversations, credentials, mixing, mojibake, tokenizer, truncation
from quern.operators import timestamps
from quern.session import shared_checkpoint, spread, table


def _messages_with_instants(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "session_messages").select("session_id", "msg_uuid", "line_no", "rec_type", "msg_role", "msg_content", "msg_tool", "ts_raw", "cwd", "collector")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(r"(?U)\S")
    m = m.withColumns({"msg_content": F.when(text("msg_content"), "x"), "msg_tool": F.when(text("msg_tool"), "x")})
    m = m.join(table(spark, d, "workspaces").select("cwd", "tz_name"), "cwd", "left").drop("cwd")
    return timestamps.normalise(m, "ts_raw", "tz_name", "collector")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(_messages_with_instants(spark, d)).select("session_id", "turn_no", "msg_uuid")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """How many sessions are kept, and why the others are not."""
    return conversations.report(_messages_with_instants(spark, d))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "session_messages").select(F.col("line_id").alias("row_id"), "collector", F.col("msg_role").alias("role"), F.col("msg_content").alias("text")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose content was cut off."""
    rows = _contents(spark, d)
    counts, model, _ = truncation.fit(rows)
    return truncation.cut_rows(truncation.score(rows, counts, model)).select(F.col("row_id").alias("line_id"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each collector cuts."""
    rows = _contents(spark, d)
    counts, model, _ = truncation.fit(rows)
    return truncation.rates(rows, truncation.score(rows, counts, model))


def _code(spark: SparkSession, d: str) -> DataFrame:
    """The three fields with code and commands; the owner of a line is the workspace, of a rollout line that of its file's header, without one the file."""
    said = table(spark, d, "session_messages").where("input_command is not null or input_new_str is not null")
    fields = F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("input_command", "input_new_str")]))
    a = said.select(F.lit("session_messages").alias("src_table"), F.col("line_id").alias("row_id"), F.coalesce("cwd", "session_id").alias("owner"), fields)
    rollouts = table(spark, d, "rollout_records")
    heads = rollouts.where("rec_type = 'Meta' and cwd is not null").groupBy("source_file").agg(F.min("cwd").alias("head_cwd"))
    b = rollouts.where("input_content is not null and input_content != ''").join(heads, "source_file", "left").select(
        F.lit("rollout_records").alias("src_table"), F.col("rec_id").alias("row_id"), F.coalesce("head_cwd", "source_file").alias("owner"),
        F.lit("input_content").alias("field_name"), F.col("input_content").alias("text"))
    return a.unionByName(b).where("text is not null and text != ''")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every credential of the three fields."""
    return credentials.find(_code(spark, d)).select("src_table", "row_id", "field_name", F.inline("places")).select("src_table", "row_id", "field_name", "secret_text").distinct()


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The fields with credentials, each replaced."""
    return credentials.find(_code(spark, d)).drop("places")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ids: the whole text of every document by byte_bpe_50k, without special tokens."""
    return tokenizer.encode(_documents(spark, d, "doc_id", "text"))


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The documents in as many partitions as the cores ask for: the work is in the workers, not in the reading."""
    return spread(table(spark, d, "documents").select(*columns))


def _counted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # doc_id, source and size only; written once, read for the rates and for the mix
    counted = shared_checkpoint(tokenizer.count_tokens(_documents(spark, d, "doc_id", "source", "text")))
    targets = table(spark, d, "mix_targets").select("source", "target_share", "max_repeats")
    return counted, mixing.rates(tokenizer.token_totals(counted, "source"), targets)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document in the mix."""
    return mixing.mix(*_counted(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mix reaches, per source."""
    return mixing.shares(*_counted(spark, d))


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with their text restored where possible."""
    docs = _documents(spark, d, "doc_id", "source", "text")
    return mojibake.repair(docs, mojibake.fit(docs))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_repaired(spark, d).select("doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_report": p1_report,
    "p2_found": p2_found, "p2_rates": p2_rates,
    "p7_found": p7_found, "p7_redacted": p7_redacted,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_repaired": p10_repaired,
}
SQL: dict[str, str] = {}
