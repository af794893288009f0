"""Audits of registries and references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dups(df: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """Keys that occur more than once, and whether their payload agrees.

    Least and greatest payload decide agreement, so a key held by a third of
    the rows is combined before the shuffle and needs no distinct.
    """
    nulls = F.count_if(F.col(payload).isNull())
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(payload).alias("_lo"),
            F.max(payload).alias("_hi"),
            nulls.alias("_nulls"),
        )
        .filter(F.col("n") > 1)
        .withColumn(
            "agrees", (F.col("_nulls") == F.col("n")) | ((F.col("_nulls") == 0) & (F.col("_lo") == F.col("_hi")))
        )
        .drop("_lo", "_hi", "_nulls")
    )


def dangling(refs: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Referenced keys without a target, with the number of references.

    References are counted per key before the anti join, so the join sees each
    key once.
    """
    counted = refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_refs"))
    return counted.join(targets.select(*keys).distinct(), list(keys), "left_anti")
