"""Field mapping and forcing: regrid, merge, interpolate, look up, cycle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.exact import exact_sum, micros
from fieldloom.operators.ordered import nearest


def remap(
    field: DataFrame,
    weights: DataFrame,
    by: Sequence[str] = ("field", "ts"),
    norm: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """Destination value = sum of w * source value, divided by the sum of w when ``norm``.

    Samples of the same (by, cell) are summed before they meet the weights, so
    a cell with a third of all samples enters the join with one row per
    ``by``. The join is followed by a grouping on other keys, which leaves
    adaptive execution free to split what is still uneven.
    """
    v = F.col("value")
    summed = field.withColumn("src_cell", F.col("cell")).groupBy(*by, "src_cell").agg(
        exact_sum(v, digits).alias("_v"), F.count(v).alias("_n")
    )
    joined = summed.join(weights, "src_cell")
    more = None if digits is None else digits + 2
    value = exact_sum(F.col("w") * F.col("_v"), more)
    if norm:
        value = value / exact_sum(F.col("w") * F.col("_n"), more)
    return joined.groupBy(*by, F.col("dst_cell").alias("cell")).agg(value.alias("value"))


def weights_check(weights: DataFrame, src: DataFrame, dst: DataFrame, tol: float = 1e-9, digits: int | None = None) -> DataFrame:
    """Findings (problem, cell, amount): unknown cells with their number of weights, row sums off 1."""
    unknown_src = (
        weights.groupBy(F.col("src_cell").alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("amount"))
        .join(src.select("cell").distinct(), "cell", "left_anti")
        .select(F.lit("unknown source").alias("problem"), "cell", "amount")
    )
    per_dst = weights.groupBy(F.col("dst_cell").alias("cell")).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), exact_sum(F.col("w"), digits).alias("_sum")
    )
    unknown_dst = (
        per_dst.join(dst.select("cell").distinct(), "cell", "left_anti")
        .select(F.lit("unknown destination").alias("problem"), "cell", F.col("_n").alias("amount"))
    )
    off = per_dst.filter(F.abs(F.col("_sum") - 1.0) > tol).select(
        F.lit("row sum").alias("problem"), "cell", F.col("_sum").alias("amount")
    )
    return unknown_src.unionByName(unknown_dst).unionByName(off)


def merge_fields(
    sources: dict[str, DataFrame], fractions: DataFrame, by: Sequence[str] = ("cell", "ts"), digits: int | None = None
) -> DataFrame:
    """Combine several sources per cell by area fraction (cell, source, f)."""
    stacked = fold(
        DataFrame.unionByName,
        [df.select(*by, "value").withColumn("source", F.lit(name)) for name, df in sources.items()],
    )
    weighted = stacked.join(fractions, ["cell", "source"])
    f, v = F.col("f"), F.col("value")
    total = exact_sum(F.when(v.isNotNull(), f), digits)
    return weighted.groupBy(*by).agg((exact_sum(f * v, digits) / F.nullif(total, F.lit(0.0))).alias("value"))


def _timeline(requests: DataFrame, series: DataFrame, keys: Sequence[str]) -> DataFrame:
    asked = requests.select(*keys, "ts", F.lit(1).alias("_asked"), "req_id", F.lit(None).cast("double").alias("_value"))
    known = series.select(
        *keys, "ts", F.lit(0).alias("_asked"), F.lit(None).cast(requests.schema["req_id"].dataType).alias("req_id"), F.col("value").cast("double").alias("_value")
    )
    return asked.unionByName(known)


ORDER = ("ts", "_asked", "req_id")


def asof(requests: DataFrame, series: DataFrame, keys: Sequence[str] = ("field",), rows: int | None = None) -> DataFrame:
    """Latest sample not after each request: (keys, req_id, ts, lo_ts, lo_value).

    ``requests`` holds (keys, ts, req_id) with unique req_id, ``series`` one value per (keys, ts). Time is cut into
    buckets of about ``rows`` rows, so any number of rows per key is spread. A time that is unknown meets nothing.
    """
    found = nearest(_timeline(requests, series, keys), keys, ORDER, F.col("_asked") == 0, "_value", rows=rows)
    return found.filter(F.col("_asked") == 1).select(
        *keys, "req_id", "ts", F.col("before.ts").alias("lo_ts"), F.col("before.value").alias("lo_value")
    )


def interp(requests: DataFrame, series: DataFrame, keys: Sequence[str] = ("field",), rows: int | None = None) -> DataFrame:
    """Linear in time between the bracketing samples; null outside the series, and for a time that is unknown."""
    both = nearest(_timeline(requests, series, keys), keys, ORDER, F.col("_asked") == 0, "_value", ("before", "after"), rows)
    both = both.filter(F.col("_asked") == 1)
    t, t0, t1 = micros(F.col("ts")), micros(F.col("before.ts")), micros(F.col("after.ts"))
    v0, v1 = F.col("before.value"), F.col("after.value")
    value = F.when(t == t0, v0).otherwise(v0 + (v1 - v0) * ((t - t0) / F.nullif(t1 - t0, F.lit(0).cast("bigint"))))
    return both.select(
        *keys, "req_id", "ts", v0.alias("lo_value"), v1.alias("hi_value"), value.alias("value")
    )


def cycle(requests: DataFrame, series: DataFrame, first_year: int, years: int, keys: Sequence[str] = ("field",)) -> DataFrame:
    """Re-use a finite daily series for later (or earlier) years; 29 February reads 28 February.

    ``series`` holds (keys, date, value) for ``years`` years from ``first_year``.
    """
    d = F.col("date")
    year = F.lit(first_year) + F.pmod(F.year(d) - first_year, F.lit(years))
    day = F.when((F.month(d) == 2) & (F.dayofmonth(d) == 29), 28).otherwise(F.dayofmonth(d))
    asked = requests.withColumn("source_date", F.make_date(year.cast("int"), F.month(d), day.cast("int")))
    known = series.select(*keys, F.col("date").cast("date").alias("source_date"), "value")
    return asked.join(known, [*keys, "source_date"], "left")
