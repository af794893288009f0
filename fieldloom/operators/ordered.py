"""Ordered operations over any number of rows, without one task per key.

A window ``PARTITION BY field ORDER BY ts`` sends a whole field to one task, which fails as soon as one field
holds a large share of the rows. Here the order is cut into buckets that follow from the value alone, and a
window works within (key, bucket). What has to cross a bucket's border (a running count, the last sample) is one
small row per (key, bucket), scanned on two levels. Rows are shuffled once, and nothing is written before the result.

An order that is no number has no such buckets; its rows are range-partitioned instead, and the slice numbers frozen
by writing the table to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.exact import micros
from fieldloom.session import materialize

SLICE, BUCKET = "_slice", "_bucket"

# The key columns as one struct. Structs compare null-safely, so rows without a
# key stay together, and windows and joins on it share one partitioning.
KEY = "_key"

#: Rows that a bucket has on average, and buckets of a key whose summaries are scanned in one task.
BUCKET_ROWS, FAN = 50_000, 512

#: Whole numbers that grow with a value, by the type of the value.
SCALES = {
    "timestamp_ntz": micros,
    "timestamp": F.unix_micros,
    "date": lambda c: F.unix_date(c).cast("bigint"),
    **{name: (lambda c: c.cast("bigint")) for name in ("byte", "short", "integer", "long")},
}


def bucketed(df: DataFrame, col: str, rows: int | None = None) -> DataFrame:
    """``df`` with a bucket number that grows with ``col``, -1 where it is null.

    Buckets are equally wide, as many as give them ``rows`` rows on average; the number of rows, the least and the
    greatest value are looked up for that. A row's number follows from its value, so it is the same whenever a part
    of the table is computed again.
    """
    at = SCALES[df.schema[col].dataType.typeName()](F.col(col))
    known = df.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high")).first()
    if known.low is None:
        return df.withColumn(BUCKET, F.lit(-1).cast("bigint"))
    width = -(-(known.high - known.low + 1) // -(-known.n // (rows or BUCKET_ROWS)))
    return df.withColumn(BUCKET, at - F.lit(known.low)).withColumn(BUCKET, F.coalesce(F.expr(f"{BUCKET} div {width}L"), F.lit(-1).cast("bigint")))


def scanned(summaries: DataFrame, col: str, out: str, total: bool, forward: bool = True) -> DataFrame:
    """``KEY, BUCKET`` and ``out``: the sum of ``col`` in the buckets before, or its last value there that is not null.

    ``summaries`` has one row per (key, bucket). ``FAN`` buckets make a group; a bucket needs those before it in its
    group and one row for each group before that. Not ``forward`` means the buckets after it.
    """
    way, pick = (F.asc, F.max_by) if forward else (F.desc, F.min_by)
    whole = F.sum(col) if total else F.last(col, ignorenulls=True)
    top = F.sum(col) if total else pick(col, F.when(F.col(col).isNotNull(), F.col(BUCKET)))
    grouped = summaries.withColumn("_fan", F.floor(F.col(BUCKET) / FAN))
    inside = W.partitionBy(KEY, "_fan").orderBy(way(BUCKET)).rowsBetween(W.unboundedPreceding, -1)
    beyond = W.partitionBy(KEY).orderBy(way("_fan")).rowsBetween(W.unboundedPreceding, -1)
    tops = grouped.groupBy(KEY, "_fan").agg(top.alias(col)).select(KEY, "_fan", whole.over(beyond).alias("_top"))
    both = grouped.select(KEY, BUCKET, "_fan", whole.over(inside).alias("_near")).join(tops, [KEY, "_fan"])
    near, far = F.col("_near"), F.col("_top")
    joined = F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0)) if total else F.coalesce(near, far)
    return both.select(KEY, BUCKET, joined.alias(out))


def number_steps(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "step", rows: int | None = None) -> DataFrame:
    """Exact ``row_number() over (partition by keys order by order)`` as BIGINT; buckets of ``order``'s first column."""
    if df.schema[order[0]].dataType.typeName() not in SCALES:
        return _number_slices(df, keys, order, out)
    marked = bucketed(df, order[0], rows).withColumn(KEY, F.struct(*keys))
    counts = marked.groupBy(KEY, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    numbered = marked.withColumn("_inside", F.row_number().over(W.partitionBy(KEY, BUCKET).orderBy(*order)))
    return (
        numbered.join(scanned(counts, "_n", "_before", total=True), [KEY, BUCKET])
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_before", "_inside", KEY, BUCKET)
    )


def ordered_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str = "slices") -> DataFrame:
    """``df`` with a frozen slice number that grows with (keys, order).

    (keys, order) should identify a row; only then can every hot key be split.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    return materialize(ranged.withColumn(SLICE, F.spark_partition_id()), label)


def _number_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    sliced = ordered_slices(df, keys, order, "steps").withColumn(KEY, F.struct(*keys))
    earlier = W.partitionBy(KEY).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(KEY, SLICE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(KEY, SLICE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = W.partitionBy(KEY, SLICE).orderBy(*order)
    numbered = sliced.withColumn("_in_slice", F.row_number().over(inside))
    return (
        numbered.join(offsets, [KEY, SLICE])
        .withColumn(out, (F.col("_before") + F.col("_in_slice")).cast("bigint"))
        .drop("_before", "_in_slice", KEY, SLICE)
    )


def nearest(
    timeline: DataFrame, keys: Sequence[str], order: Sequence[str], is_sample: Column, value: str, sides: Sequence[str] = ("before",), rows: int | None = None
) -> DataFrame:
    """``timeline`` with the nearest sample at or before each row (``before``), at or after it (``after``), or both.

    Samples are the rows where ``is_sample`` holds and the time, which is first in ``order``, is known; the new columns
    are structs (ts, value), null where there is none or the row's time is unknown. A bucket is joined by the sample nearest to its border on either
    side as one more row, so the rows themselves are shuffled once.
    """
    time = order[0]
    sample = is_sample & F.col(time).isNotNull()
    marked = bucketed(timeline, time, rows).withColumn(KEY, F.struct(*keys)).withColumn("_sample", F.when(sample, F.struct(F.col(time).alias("ts"), F.col(value).alias("value"))))
    at = F.when(sample, F.col(time))
    edges = marked.groupBy(KEY, BUCKET).agg(F.max_by("_sample", at).alias("_last"), F.min_by("_sample", at).alias("_first"))
    whole = marked.withColumn("_carried", F.lit(False))
    for side, edge in (("before", "_last"), ("after", "_first")):
        if side in sides:
            carried = scanned(edges, edge, "_sample", total=False, forward=side == "before").filter("_sample IS NOT NULL")
            there = {KEY, BUCKET, "_sample"}
            filled = [F.lit(True).alias("_carried") if c == "_carried" else F.col("_sample.ts").alias(c) if c == time else F.col(c) if c in there else F.lit(None).cast(whole.schema[c].dataType).alias(c) for c in whole.columns]
            whole = whole.unionByName(carried.select(*filled))
    # looking back in reversed order is linear; a frame that reaches forward to the end would be evaluated anew for every row
    out = whole
    for side, way in (("before", F.asc), ("after", F.desc)):
        if side in sides:
            inside = W.partitionBy(KEY, BUCKET).orderBy(*(way(c) for c in order)).rowsBetween(W.unboundedPreceding, 0)
            out = out.withColumn(side, F.when(F.col(time).isNotNull(), F.last("_sample", ignorenulls=True).over(inside)))
    return out.filter(~F.col("_carried")).select(*timeline.columns, *sides)
