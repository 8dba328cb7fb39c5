"""Usage meters: trailing windows, burn rate and forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a token of each kind weighs.
TOKEN_WEIGHTS = {"input_tokens": 1.0, "cache_read": 0.10, "cache_write": 0.25, "output_tokens": 5.0}
HOUR = 3600


def cost_tokens() -> Column:
    return sum((F.col(c) * w for c, w in TOKEN_WEIGHTS.items()), F.lit(0.0)).cast("bigint")


def first_copies(turns: DataFrame) -> DataFrame:
    """The first row of a message id in a file; rows without id are all kept.  Rows are chosen before any is filtered."""
    w = Window.partitionBy("file", "message_id").orderBy("seq")
    named = turns.where("message_id is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return named.unionByName(turns.where("message_id is null"))


def billable(turns: DataFrame) -> DataFrame:
    used = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read") + F.col("cache_write")
    return first_copies(turns).where((F.col("model") != "<synthetic>") & (used > 0)).withColumn("cost", cost_tokens())


def horizons(turns: DataFrame, as_of: str, limit_5h: int, limit_7d: int) -> DataFrame:
    """Per account: cost in the hour, 5 hours and 7 days up to ``as_of`` (strictly after each cutoff), utilisation and minutes left."""
    now = F.lit(as_of).cast("timestamp_ntz")
    t = billable(turns)
    after = lambda s: F.col("ts") > now - F.expr(f"interval {s} seconds")
    g = t.groupBy("account").agg(*[F.coalesce(F.sum(F.when(after(s), F.col("cost"))), F.lit(0)).alias(n) for n, s in (("cost_1h", HOUR), ("cost_5h", 5 * HOUR), ("cost_7d", 7 * 24 * HOUR))], F.count_if(after(5 * HOUR)).alias("turns_5h"))
    use = F.round(F.least(F.lit(100.0), F.col("cost_5h") * 100.0 / limit_5h), 6)
    week = F.round(F.least(F.lit(100.0), F.col("cost_7d") * 100.0 / limit_7d), 6)
    burn = F.col("cost_1h") / 60.0
    left = F.when(F.col("cost_5h") >= limit_5h, F.lit(0.0)).when(burn > 0, F.round((limit_5h - F.col("cost_5h")) / burn, 6))
    return g.select("*", use.alias("use_5h"), week.alias("use_7d"), F.round(burn, 6).alias("burn_per_minute"), left.alias("minutes_left"))


def rolling(turns: DataFrame, seconds: int = 5 * HOUR) -> DataFrame:
    """Every billable turn with the cost of its account in the window that ends with it, the start excluded.

    Time is cut into blocks as long as the window; a turn counts in its own
    block and as a forerunner in the next, so no task sees more of an account
    than two blocks.
    """
    us = seconds * 1_000_000
    t = billable(turns).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("own", F.floor(F.col("at") / us))
    dealt = t.select("account", "seq", "cost", "at", "own", F.explode(F.array("own", F.col("own") + 1)).alias("block"))
    w = Window.partitionBy("account", "block").orderBy("at").rangeBetween(-us + 1, 0)
    return dealt.withColumn("cost_window", F.sum("cost").over(w)).where("block = own").select("account", "seq", "cost_window")
