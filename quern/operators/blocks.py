"""Windows over groups of any size.

A window function sorts a whole group in one task; a session, file or account
that holds a third of all rows would make that task the whole job.  Here a group
is cut along its order into blocks, the window runs within the blocks, and what
crosses a block's edge is worked out on one summary row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import shared_checkpoint

BLOCK = 4096


def lag(df: DataFrame, part: str, seq: str, columns: list[str], out: str, block: int | Column = BLOCK) -> DataFrame:
    """Add ``out``: the struct of the columns in the row before, null in a group's first row.

    ``seq`` orders a group and is unique in it; a block spans ``block`` values
    of it (or is the given monotone expression).
    """
    blk = block if isinstance(block, Column) else F.floor(F.col(seq) / block)
    d = df.withColumn("__blk", blk).withColumn("__now", F.struct(*columns))
    inner = Window.partitionBy(part, "__blk").orderBy(seq)
    ends = d.groupBy(part, "__blk").agg(F.max_by("__now", seq).alias("__end"))
    before = ends.withColumn("__carried", F.lag("__end").over(Window.partitionBy(part).orderBy("__blk"))).drop("__end")
    return d.withColumn("__prev", F.lag("__now").over(inner)).join(before, [part, "__blk"], "left").withColumn(out, F.coalesce("__prev", "__carried")).drop("__blk", "__now", "__prev", "__carried")


def running(df: DataFrame, part: str, seq: str, value: str, out: str, block: int | Column = BLOCK, total: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before in the group (this row not included), and the group's sum as ``total``."""
    blk = block if isinstance(block, Column) else F.floor(F.col(seq) / block)
    d = df.withColumn("__blk", blk)
    inner = Window.partitionBy(part, "__blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(part, "__blk").agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(part).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(w), F.lit(0)))
    if total:
        base = base.withColumn(total, F.sum("__sum").over(Window.partitionBy(part)))
    return d.withColumn("__own", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(base.drop("__sum"), [part, "__blk"], "left").withColumn(out, F.col("__own") + F.col("__base")).drop("__blk", "__own", "__base")


def numbered(df: DataFrame, by: str, order: list[Column | str], out: str) -> DataFrame:
    """Add ``out``: the place of a row in its group by an order, from 1.

    Rows are sorted over the cluster; what a window sees is a group's rows of
    one partition, and one row a partition of the group.
    """
    keys = [F.col(by), *[F.col(o) if isinstance(o, str) else o for o in order]]
    s = shared_checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}))
    sizes = s.groupBy(by, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.withColumn("__base", before).drop("__n")
    own = F.row_number().over(Window.partitionBy(by, "__part").orderBy("__place"))
    return s.withColumn("__own", own).join(base, [by, "__part"]).withColumn(out, (F.col("__own") + F.col("__base")).cast("bigint")).drop("__own", "__base", "__part", "__place")


def first_of(rows: DataFrame, by: list[str], order: list[Column], most: int, salt: int = 64) -> DataFrame:
    """The first ``most`` rows of each group: the first of salted parts, then of these, so that no group is sorted whole."""
    w = Window.partitionBy(*by, "__part").orderBy(*order)
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(salt))
    near = rows.withColumn("__part", part).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__part", "__k")
    return near.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= most).drop("__k")
