"""The tape reduction over an unbounded stream of samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.exact import clock, micros
from fieldloom.operators.reduce import Hours, finalize, select_fields, state_columns


def history_reduce_stream(
    samples: DataFrame,
    spec: dict[str, str],
    freq: Hours,
    delay: str,
    by: Sequence[str] = ("member", "cell"),
    digits: int | None = None,
) -> DataFrame:
    """Same tapes as ``history_reduce`` with windows of n hours, for append mode.

    A window is emitted once the watermark (latest time seen minus ``delay``)
    passes its end; samples later than that are dropped. The state per open
    window is the mergeable one, not the samples. Watermarks need a TIMESTAMP,
    so the sample's clock is read as UTC and turned back for the label; windows
    then start where the batch ones do in any session time zone.
    """
    timed = select_fields(samples, spec).withColumn("_at", F.timestamp_micros(micros(F.col("ts"))))
    window = F.window("_at", f"{freq.n} hours")
    state = timed.withWatermark("_at", delay).groupBy("field", *by, window).agg(*state_columns(digits))
    labelled = state.withColumn("win", clock(F.unix_seconds(F.col("window.start"))))
    return finalize(labelled, spec, by, digits)


def run_available(result: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is there now into Parquet below ``path``, then stop."""
    query = (
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
