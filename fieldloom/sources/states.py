"""Reduction states of run segments, saved at their stops and merged later.

A state table is a folder: ``states/segment=<name>/attempt=<id>`` has the states, and ``ledger/segment=<name>`` one row
that says which times of the run they cover and which attempt counts. The ledger's row is written last and once, so a
segment that failed half-way is not read, and one that is saved again changes nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.operators.reduce import merge_partials

LEDGER = "segment string, run string, begin timestamp_ntz, end timestamp_ntz, attempt string"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """``segment, run, begin, end, attempt`` of the saved segments."""
    if not _exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger")


def save_states(states: DataFrame, path: str, segment: str, begin: str, end: str, run: str = "run") -> bool:
    """Saves the states of the times ``[begin, end)`` of a run as a segment; whether they were new.

    The same segment again, over the same times, is not saved twice. Times that another segment of the run covers, the
    same name over other times, and segments that end before they begin raise ValueError. One writer at a time.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", segment):
        raise ValueError(f"a segment's name has letters, digits and _.- only, not {segment!r}")
    spark = states.sparkSession
    times = [F.to_timestamp_ntz(F.lit(t)) for t in (begin, end)]
    known = ledger(spark, path)
    mine = (F.col("segment") == segment) & (F.col("run") == run)
    same = mine & (F.col("begin") == times[0]) & (F.col("end") == times[1])
    overlaps = (F.col("run") == run) & (F.col("begin") < times[1]) & (F.col("end") > times[0])
    found = known.agg(
        F.coalesce(F.bool_or(same), F.lit(False)).alias("same"), F.coalesce(F.bool_or(F.col("segment") == segment), F.lit(False)).alias("named"), F.min(F.when(overlaps, F.col("segment"))).alias("other"),
        F.lit(begin < end).alias("forward"),
    ).first()
    if found.same:
        return False
    if found.named or found.other is not None:
        raise ValueError(f"segment {segment!r} covers times of segment {found.other!r}" if found.other else f"segment {segment!r} was saved over other times")
    if not spark.range(1).select((times[0] < times[1]).alias("forward")).first().forward:
        raise ValueError(f"segment {segment!r} ends before it begins")
    attempt = uuid.uuid4().hex
    states.write.parquet(f"{path}/states/segment={segment}/attempt={attempt}")
    row = spark.range(1).select(F.lit(segment).alias("segment"), F.lit(run).alias("run"), times[0].alias("begin"), times[1].alias("end"), F.lit(attempt).alias("attempt"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    return True


def load_states(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """States of all segments that the ledger names, with ``segment``; other folders are not read."""
    counted = ledger(spark, path).filter(F.lit(True) if run is None else F.col("run") == run).select("segment", "attempt")
    states = spark.read.option("basePath", f"{path}/states").parquet(f"{path}/states")
    named = states.withColumn("segment", F.col("segment").cast("string")).withColumn("attempt", F.col("attempt").cast("string"))
    return named.join(counted, ["segment", "attempt"], "left_semi").drop("attempt")


def merged_states(spark: SparkSession, path: str, by: Sequence[str] = ("member", "cell"), run: str | None = None) -> DataFrame:
    """States of the whole run, from those of its segments."""
    return merge_partials(load_states(spark, path, run).drop("segment"), by=by)


def gaps(spark: SparkSession, path: str) -> DataFrame:
    """``run, after, before, begin, end``: times of a run that no segment covers, between two that follow each other."""
    order = Window.partitionBy("run").orderBy("begin")
    known = ledger(spark, path).select("run", "segment", "begin", "end", F.lag("segment").over(order).alias("after"), F.lag("end").over(order).alias("from"))
    return known.filter(F.col("from") < F.col("begin")).select("run", "after", F.col("segment").alias("before"), F.col("from").alias("begin"), F.col("begin").alias("end"))
