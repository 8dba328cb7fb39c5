"""Mixing sources to target weights (problem 9).

Sizes are tokens of a public tokenizer.  Per source: the tokens it has, the
tokens its share asks for, and from both the rate at which its documents are
used, at most ``max_repeats``.  A document is emitted floor(rate) times, and
once more with probability rate - floor(rate), decided by a seeded hash of its
id, so that a rerun or a lost executor gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates(totals: DataFrame, targets: DataFrame, budget: float | None = None) -> DataFrame:
    """source, n_tokens, documents, target_share, max_repeats, rate.

    ``totals``: source, n_tokens, documents; ``targets``: source, target_share,
    max_repeats (one row a source).  ``budget`` is the size of the mix; by
    default all tokens of the sources that have a target.  A source whose cap
    keeps it below its share leaves the others at theirs of the budget.  Sources
    without target, null among them, are left out; targets without tokens have
    rate 0.  Every value is an aggregate of one row a source.
    """
    t = targets.where("source is not null").join(totals, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"))
    size = F.lit(float(budget)) if budget is not None else F.col("all_tokens")
    asked = t.crossJoin(t.agg(F.sum("n_tokens").alias("all_tokens"))) if budget is None else t  # the right side is one row
    share = F.col("target_share") * size / F.col("n_tokens")
    rate = F.when((F.col("n_tokens") > 0) & (F.col("target_share") > 0), F.least(share, F.col("max_repeats").cast("double"))).otherwise(0.0)
    return asked.select("source", "n_tokens", "documents", "target_share", "max_repeats", rate.alias("rate"))


def copies(rate: Column, key: Column, seed: int) -> Column:
    """floor(rate), plus one with probability of the fraction, by the key's hash."""
    u = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))
    whole = F.floor(rate)
    return (whole + F.when(u < rate - whole, 1).otherwise(0)).cast("int")


def mix(counted: DataFrame, rate_table: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, source, copy_no (from 1), n_tokens: a row for each use of a document.

    ``counted``: doc_id, source, n_tokens.  The rates are one row a target
    source; Spark decides by their size whether they are broadcast.
    """
    r = rate_table.where("rate > 0").select("source", "rate")
    n = copies(F.col("rate"), F.col("doc_id"), seed)
    used = counted.join(r, "source").withColumn("n", n).where("n > 0")
    return used.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"), "n_tokens")


def shares(counted: DataFrame, rate_table: DataFrame, seed: int = 42) -> DataFrame:
    """Per source: its target, cap, rate, and the documents, tokens and share that the mix has of it."""
    r = rate_table.select("source", "target_share", "max_repeats", "rate")
    used = counted.join(r.select("source", "rate"), "source").withColumn("n", copies(F.col("rate"), F.col("doc_id"), seed))
    got = used.groupBy("source").agg(F.sum("n").alias("mixed_documents"), F.sum(F.col("n") * F.col("n_tokens")).alias("mixed_tokens"))
    full = r.join(got, "source", "left").na.fill(0, ["mixed_documents", "mixed_tokens"])
    total = full.agg(F.sum("mixed_tokens").alias("all_mixed"))
    share = F.when(F.col("all_mixed") > 0, F.col("mixed_tokens") / F.col("all_mixed")).otherwise(0.0)
    return full.crossJoin(total).select("source", "target_share", "max_repeats", "rate", "mixed_documents", "mixed_tokens", share.alias("actual_share"))
