"""Comparison of runs by digests: whether fields are equal, and where not, without shuffling the rows of those that are.

A range of keys of a field has a digest that does not depend on the order of its rows: how many there are, and two sums
of 64-bit hashes of key and value. Both runs are digested in one aggregation, which shuffles a row a range from each
task. Only ranges whose digests differ are descended into, and only their rows meet key by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.compare import compare_rows
from fieldloom.session import materialize

#: Ranges of a field's keys.
RANGES = 4096


def _range(keys: Sequence[str], ranges: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int")


def range_digests(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, by: Sequence[str] = ("field",), ranges: int = RANGES) -> DataFrame:
    """``by, range, n_left, n_right, same`` of every range of keys that either run has.

    Rows are compared as multisets: a key may repeat, and a null equals a null. Every column of ``by`` is one of ``keys``.
    """
    stacked = a.select(*keys, F.col(value).alias("_v"), F.lit(0).alias("_side")).unionByName(b.select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_side")))
    sides = [F.col("_side") == side for side in (0, 1)]
    # a null and a zero have other hashes by the flag beside them
    hashes = [F.xxhash64(F.lit(salt), *keys, F.col("_v").isNull(), "_v").cast("decimal(38,0)") for salt in (1, 2)]
    sums = [F.coalesce(F.sum(F.when(side, h)), F.lit(0)).alias(f"_{i}{j}") for i, side in enumerate(sides) for j, h in enumerate(hashes)]
    counts = [F.count_if(side).alias(name) for side, name in zip(sides, ("n_left", "n_right"))]
    digests = stacked.groupBy(*by, _range(keys, ranges).alias("range")).agg(*counts, *sums)
    same = (F.col("n_left") == F.col("n_right")) & (F.col("_00") == F.col("_10")) & (F.col("_01") == F.col("_11"))
    return digests.select(*by, "range", "n_left", "n_right", same.alias("same"))


def differing_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, by: Sequence[str] = ("field",), ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``by, n_left, n_right, n_ranges, n_differing`` of each field, and the keys that differ as
    :func:`fieldloom.operators.compare.compare_rows` gives them, found in the ranges that differ alone."""
    digests = materialize(range_digests(a, b, keys, value, by, ranges), "digests")
    fields = digests.groupBy(*by).agg(
        F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"), F.count(F.lit(1)).alias("n_ranges"), F.count_if(~F.col("same")).alias("n_differing")
    )
    named = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    differing = digests.filter(~F.col("same")).select(*named, F.col("range").alias("_range"))

    def kept(df: DataFrame) -> DataFrame:
        met = fold(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], _range(keys, ranges) == F.col("_range"))
        return df.join(differing, met, "left_semi")

    return fields, compare_rows(kept(a), kept(b), keys, value).filter("state <> 'equal'")
