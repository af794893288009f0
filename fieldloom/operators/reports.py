"""Throughput and resource reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.codes import extract_cost
from fieldloom.operators.ordered import nearest, number_steps
from fieldloom.session import materialize

HOURS_PER_DAY = 24


def with_cost(df: DataFrame, note: str) -> DataFrame:
    """Numbers of a free-text cost note: ``ypd`` and ``pe_hours``; null when not stated."""
    cost = extract_cost(F.col(note))
    return df.withColumn("ypd", cost["ypd"]).withColumn("pe_hours", cost["pe_hours"])


def footprint(parts: DataFrame, notes: DataFrame, by: Sequence[str] = ("layout",), tol: float = 0.02) -> DataFrame:
    """Resources of a layout = max(root + ntasks), and its recomputed cost against the stated one.

    ``notes`` holds one cost note per layout; it is read after the parts have
    been reduced to one row per layout.
    """
    rows = parts.groupBy(*by).agg(F.max(F.col("root") + F.col("ntasks")).alias("footprint"))
    rows = with_cost(rows.join(notes.select(*by, "note"), list(by), "left"), "note").drop("note")
    cost = F.col("footprint") * HOURS_PER_DAY / F.nullif(F.col("ypd"), F.lit(0.0))
    return rows.withColumn("recomputed", cost).withColumn(
        "agrees", F.abs(F.col("recomputed") - F.col("pe_hours")) <= F.col("pe_hours") * tol
    )


#: Parts of a group that are compared with each other in one row, and parts of a larger group that lie in a block.
GROUP_ROWS, BLOCK = 512, 64


def overlaps(
    parts: DataFrame,
    group: Sequence[str],
    lo: str,
    hi: str,
    part_id: str,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Pairs of parts of one group whose whole-numbered ranges [lo, hi) overlap, each pair once.

    A group of up to ``group_rows`` parts is one row and compared there: one shuffle, and the input is read once
    beside a count of the groups. In larger groups a sweep over the ends in order numbers the parts as they open, and
    tells each part how many have opened before it closes; its partners are the numbers between. The work there
    follows the result, whatever the lengths. A null group, an empty range and a part with its own id make no pair.
    """
    base = parts.filter(F.col(lo) < F.col(hi)).select(
        *group, F.col(part_id).alias("_id"), F.col(lo).cast("bigint").alias("_lo"), F.col(hi).cast("bigint").alias("_hi")
    )
    base = base.dropna(subset=list(group))
    large = base.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > group_rows).drop("_n")
    if large.isEmpty():
        return _pairs(_together(base, group), group)
    large = materialize(large, "groups")
    small = _together(base.join(large, list(group), "left_anti"), group)
    return _pairs(small.unionByName(_swept(base.join(large, list(group), "left_semi"), group)), group)


def _together(base: DataFrame, group: Sequence[str]) -> DataFrame:
    """``group, x, y``: overlapping parts of groups that are one row each; x opens first."""
    rows = base.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_lo", "_id", "_hi"))).alias("_xs"))

    def partners(x, i):
        later = F.slice("_xs", i + 2, F.size("_xs"))
        return F.transform(F.filter(later, lambda y: (y["_lo"] < x["_hi"]) & (y["_id"] != x["_id"])), lambda y: F.struct(x.alias("x"), y.alias("y")))

    return rows.filter(F.size("_xs") > 1).select(*group, F.inline(F.flatten(F.transform("_xs", partners))))


def _swept(base: DataFrame, group: Sequence[str]) -> DataFrame:
    """``group, x, y`` of groups of any size."""
    numbered = materialize(number_steps(base, group, ["_lo", "_id", "_hi"], "_number"), "opened")
    # how many parts have opened up to a place, and what each part finds just before its end
    opened = numbered.groupBy(*group, F.col("_lo").alias("_at")).agg(F.max("_number").alias("_opened"))
    ends = numbered.withColumn("_at", F.col("_hi") - 1).withColumn("_kind", F.lit(1))
    both = ends.unionByName(opened.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    known = nearest(both, group, ["_at", "_kind", "_number"], F.col("_kind") == 0, "_opened").filter("_kind = 1")
    part = F.struct("_lo", "_id", "_hi")
    first, last = F.col("_number") + 1, F.col("before.value")
    seekers = known.filter(last >= first).select(*group, part.alias("x"), first.alias("_first"), last.alias("_last"))
    seekers = seekers.withColumn("_block", F.explode(F.expr(f"sequence(_first div {BLOCK}, _last div {BLOCK})")))
    blocks = numbered.groupBy(*group, F.expr(f"_number div {BLOCK}").alias("_block")).agg(F.collect_list(F.struct("_number", part.alias("y"))).alias("_ys"))
    met = seekers.join(blocks, [*group, "_block"])
    fits = F.filter("_ys", lambda m: m["_number"].between(F.col("_first"), F.col("_last")) & (m["y"]["_id"] != F.col("x._id")))
    return met.select(*group, "x", F.explode(fits).alias("_m")).select(*group, "x", F.col("_m.y").alias("y"))


def _pairs(found: DataFrame, group: Sequence[str]) -> DataFrame:
    return found.select(
        *group,
        F.least("x._id", "y._id").alias("part_a"),
        F.greatest("x._id", "y._id").alias("part_b"),
        F.col("y._lo").alias("shared_lo"),
        F.least("x._hi", "y._hi").alias("shared_hi"),
    )
