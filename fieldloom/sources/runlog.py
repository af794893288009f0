"""Run logs: did the run end well?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def runlog_success(
    lines: DataFrame,
    marker: str,
    tail_n: int = 20,
    by: Sequence[str] = ("path",),
    line_no: str = "line_no",
    text: str = "value",
) -> DataFrame:
    """A run succeeded when one of the last ``tail_n`` lines of its log holds ``marker``.

    ``last_line`` and ``marker_line`` are the last line and the last one holding the marker. The tail is counted in
    lines, so numbers may have gaps; a line without a number is no line. Two combinable aggregations, no sort of a
    log that may be a third of the table.
    """
    numbered = lines.filter(F.col(line_no).isNotNull()).select(*by, F.col(line_no).alias("_no"), F.col(text).contains(marker).alias("_hit"))
    marked = numbered.filter("_hit").groupBy(*(F.col(c).alias(f"_by_{c}") for c in by)).agg(F.max("_no").alias("marker_line"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    found = numbered.join(marked, same, "left").groupBy(*by).agg(
        F.max("_no").alias("last_line"), F.max("marker_line").alias("marker_line"), F.count_if(F.col("_no") > F.col("marker_line")).alias("_after")
    )
    return found.withColumn("success", F.col("marker_line").isNotNull() & (F.col("_after") < tail_n)).drop("_after")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, value`` of text files, lines counted from 1 also where a file is read in several splits.

    A split's lines are counted where they are read; how many stand before it in its file is a running sum over the
    file's splits, one row each.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_order"), "value"
    )
    splits = lines.groupBy("path", "_split").agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("path", "_split", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = lines.join(offsets, ["path", "_split"])
    return numbered.select("path", (F.col("_before") + F.col("_order") - F.col("_first") + 1).alias("line_no"), "value")
