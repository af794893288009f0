"""Equi-join that splits keys holding too many rows for one task.

Adaptive execution already splits join partitions that are large in bytes. That
is not enough where a join multiplies rows: a bucket of modest size can produce
quadratically many pairs in one task. This join bounds the rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 20_000


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Inner join on ``keys``; keys that make more than ``rows_per_task`` squared pairs are salted.

    A hot key's left rows are dealt out by a hash of ``spread``, and its right
    rows are copied once per salt; there are as many salts as make the pairs of
    one task that square. Which keys are hot is a join with their short list,
    not a decision taken while the plan is built.
    """
    hot = hot_keys(left, right, keys, rows_per_task)
    parts = F.coalesce("_parts", F.lit(1))
    salt = F.pmod(F.xxhash64(*spread), parts).cast("int")
    dealt = left.join(hot, list(keys), "left").withColumn("_salt", salt).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), parts - 1))
    copied = right.join(hot, list(keys), "left").withColumn("_salt", copies).drop("_parts")
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")


def hot_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys whose pairs are too many for one task, and into how many ``_parts`` their left rows go."""
    counts = (
        left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
        .unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
        .groupBy(*keys)
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    )
    pairs = F.col("_l").cast("double") * F.col("_r")
    return counts.filter(pairs > float(rows_per_task) ** 2).select(
        *keys, F.least(F.ceil(pairs / float(rows_per_task) ** 2), F.col("_l")).cast("int").alias("_parts")
    )
