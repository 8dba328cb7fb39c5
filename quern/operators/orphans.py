"""References to records that do not exist (problem 6).

Keys of both sides get integer codes from one dictionary; bits are set in
compressed bitmaps per key range (32,768 codes) and period; reference AND NOT
parent leaves the orphans, whose bits are decoded through the dictionary.  A
bitmap is held as a sorted list, as runs or as plain bits, whichever is
smallest, so that a month with three keys of a range takes seven bytes and not
four thousand; a range in which a table and period have no key has none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import shared_checkpoint


def dictionary(keys: DataFrame) -> DataFrame:
    """key -> code for the distinct non-null keys of a one-column table.

    Codes are dense within a range of sorted keys; ranges start at multiples of
    2**33, so that a bitmap never spans two ranges.  The table is written, for
    codes depend on where the sort drew its bounds.
    """
    named = keys.toDF("key").where("key is not null").distinct()
    return shared_checkpoint(named.repartitionByRange("key").sortWithinPartitions("key").withColumn("code", F.monotonically_increasing_id()))


RANGE = 32_768
LIST, RUNS, BITS = b"\x00", b"\x01", b"\x02"


def compress(bits: np.ndarray) -> bytes:
    """The smallest form of a set of places below ``RANGE``: a byte that names it, then unsigned 16-bit places, pairs of first and last place, or bits."""
    at = np.unique(np.asarray(bits, np.uint16))
    cut = np.flatnonzero(np.diff(at.astype(np.int32)) != 1)
    first, last = at[np.r_[0, cut + 1]] if len(at) else at, at[np.r_[cut, len(at) - 1]] if len(at) else at
    forms = [(len(at) * 2, LIST), (len(first) * 4, RUNS), (RANGE // 8, BITS)]
    form = min(forms)[1]
    if form == LIST:
        return LIST + at.tobytes()
    if form == RUNS:
        return RUNS + np.column_stack([first, last]).astype(np.uint16).tobytes()
    return BITS + np.packbits(expand_list(at), bitorder="little").tobytes()


def expand_list(at: np.ndarray) -> np.ndarray:
    out = np.zeros(RANGE, bool)
    out[at] = True
    return out


def expand(data: bytes) -> np.ndarray:
    """The set of places as a mask."""
    form, body = data[:1], data[1:]
    if form == BITS:
        return np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little").astype(bool)
    at = np.frombuffer(body, np.uint16)
    if form == LIST:
        return expand_list(at)
    step = np.zeros(RANGE + 1, np.int32)
    step[at[0::2]] += 1
    np.add.at(step, at[1::2].astype(np.int32) + 1, -1)
    return np.cumsum(step)[:RANGE] > 0


def and_not(reference: bytes, parent: bytes | None) -> np.ndarray:
    """The places of the one that the other lacks."""
    if reference[:1] == LIST:  # few: look them up
        at = np.frombuffer(reference[1:], np.uint16)
        return (at if parent is None else at[~expand(parent)[at]]).astype(np.int32)
    return np.flatnonzero(expand(reference) & ~(expand(parent) if parent is not None else np.zeros(RANGE, bool))).astype(np.int32)


@F.pandas_udf(T.BinaryType())
def _bitmap(bits: pd.Series) -> pd.Series:
    return bits.map(compress)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _and_not(reference: pd.Series, parent: pd.Series) -> pd.Series:
    return pd.Series([and_not(a, b) for a, b in zip(reference, parent)])


def orphan_bits(references: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orphans as (ref_table, period, code) and the dictionary.

    ``references``: ref_table, period, key; ``parents``: key.  Null keys are no
    reference.  A key that most references share is one bit: references are made
    distinct before they meet the dictionary.
    """
    refs = references.where("key is not null").select("ref_table", "period", "key").distinct()
    live = parents.where("key is not null").select("key").distinct()
    words = dictionary(refs.select("key").union(live))
    bucket = F.shiftright("code", 15).alias("bucket")
    bit = (F.col("code") % RANGE).cast("int").alias("bit")
    # keys are distinct: a group has at most RANGE places
    of_refs = refs.join(words, "key").select("ref_table", "period", bucket, bit).groupBy("ref_table", "period", "bucket").agg(_bitmap(F.collect_list("bit")).alias("bits"))
    of_live = live.join(words, "key").select(bucket, bit).groupBy("bucket").agg(_bitmap(F.collect_list("bit")).alias("live"))
    left = of_refs.join(of_live, "bucket", "left").select("ref_table", "period", "bucket", F.explode(_and_not("bits", "live")).alias("bit"))
    return left.select("ref_table", "period", (F.shiftleft(F.col("bucket"), 15) + F.col("bit")).alias("code")), words


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The distinct references (ref_table, row_key, key) to keys that no parent has.

    ``references``: ref_table, period, row_key, key.  Keys are compared exactly.
    Empty tables of either kind give their natural result: no parent makes every
    reference an orphan.
    """
    bits, words = orphan_bits(references, parents)
    lost = bits.select("ref_table", "code").distinct().join(words, "code").select("ref_table", "key")
    return references.where("key is not null").join(lost, ["ref_table", "key"], "left_semi").select("ref_table", "row_key", "key").distinct()


def orphan_report(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Per ref_table and period: distinct keys referred to, distinct missing keys, and references that lead nowhere (rows)."""
    bits, words = orphan_bits(references, parents)
    lost = bits.join(words, "code").select("ref_table", "period", "key", F.lit(1).alias("gone"))
    per_key = references.where("key is not null").groupBy("ref_table", "period", "key").agg(F.count("*").alias("n"))
    seen = per_key.join(lost, ["ref_table", "period", "key"], "left")
    return seen.groupBy("ref_table", "period").agg(
        F.count("*").alias("keys"), F.count("gone").alias("missing_keys"), F.sum("n").alias("refs"),
        F.sum(F.when(F.col("gone") == 1, F.col("n")).otherwise(0)).alias("missing_refs"))
