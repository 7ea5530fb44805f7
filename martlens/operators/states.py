"""Distinct counts that merge (A2, A7, A11): bitmaps over densely numbered ids.

A load's ids are numbered once in a dictionary that only grows, so states of
earlier loads stay valid.  The state of a group is a set of bitmaps, one per 32,768
numbers; states of several loads are united bit by bit and counted without the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .kernels import global_row_number, one_row


def number_ids(rows: DataFrame, col: str, known: DataFrame | None = None) -> DataFrame:
    """(id, number): the dictionary ``known`` and the new ids of ``rows``, numbered on from its greatest number."""
    ids = rows.where(F.col(col).isNotNull()).select(F.col(col).alias("id")).distinct()
    if known is None:
        return cut_lineage(global_row_number(ids, ["id"], "number"), "ids")
    fresh = global_row_number(ids.join(known, "id", "left_anti"), ["id"], "number")
    top = one_row(known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("top")))
    return cut_lineage(known.unionByName(fresh.withColumn("number", F.col("number") + top["top"])), "ids")


def distinct_states(rows: DataFrame, by: Sequence[str], col: str, ids: DataFrame) -> DataFrame:
    """(by, bucket, bits): the ids of each group as bitmaps; null ids count nowhere."""
    numbered = rows.select(*by, F.col(col).alias("id")).distinct().join(ids, "id")
    return numbered.groupBy(*by, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def merge_states(states: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """The states of several loads as one."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_states(states: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """(by, out): exact distinct ids per group."""
    return states.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias(out))
