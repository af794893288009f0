"""Tapes of several output streams that follow an unbounded input, kept as mergeable states.

Every micro-batch adds its own states below ``path/states/batch=<id>`` and then a mark, the latest time it has
seen, below ``path/marks/batch=<id>``. A batch that is run again after a failure replaces its folders, so replays
change nothing, and a batch without a mark is not read. What is read is the merge of all states, whatever the window:
hours, calendar units, model steps, or the 365-day calendar. Samples older than the watermark go to ``path/late``
instead. ``compact`` merges the batches so far into one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import calendar as cal
from fieldloom.functions.exact import clock, micros
from fieldloom.operators.reduce import Cal, Frequency, Hours, Steps, finalize, merge_partials, select_fields, state_columns, window_key


@dataclass(frozen=True)
class Stream:
    """An output stream's windows and the calendar that they follow."""

    freq: Frequency
    calendar: str = "gregorian"


def _window(name: str, stream: Stream) -> Column:
    """The window of a sample: ``win`` is a time, ``win_number`` counts the windows of steps."""
    key = window_key(stream.freq, stream.calendar)
    by_step = isinstance(stream.freq, Steps)
    win, number = (F.lit(None).cast("timestamp_ntz"), key) if by_step else (key, F.lit(None).cast("bigint"))
    return F.struct(F.lit(name).alias("stream"), win.alias("win"), number.alias("win_number"))


def stream_states(samples: DataFrame, spec: dict[str, str], streams: Mapping[str, Stream], by: Sequence[str] = ("member", "cell"), digits: int | None = None) -> DataFrame:
    """States by (stream, field, by, window) of some samples, in one aggregation over all streams.

    A micro-batch may be a file or two: its samples are dealt to all tasks before they are copied into the windows.
    """
    windows = F.array(*(_window(name, s) for name, s in streams.items()))
    each = select_fields(samples, spec).repartition("field", *by, "ts", "step").select("*", F.inline(windows))
    return each.groupBy("stream", "field", *by, "win", "win_number").agg(*state_columns(digits))


def window_end(stream: Stream, win: Column) -> Column:
    """Where a window of hours or calendar units ends."""
    freq = stream.freq
    if isinstance(freq, Steps):
        return F.lit(None).cast("timestamp_ntz")
    if isinstance(freq, Cal) and freq.unit in "my":
        return cal.add_months(win, freq.n * (12 if freq.unit == "y" else 1), stream.calendar).cast("timestamp_ntz")
    hours = freq.n if isinstance(freq, Hours) else freq.n * (24 if freq.unit == "d" else 1)
    if stream.calendar == "noleap":
        return cal.noleap_timestamp(cal.noleap_hour(win) + hours)
    return clock(F.floor(micros(win) / 1_000_000) + hours * 3600)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """A table of folders ``key=<number>``, or nothing where none was written yet."""
    return spark.read.option("basePath", path).parquet(f"{path}/{key}=*").withColumn(key, F.col(key).cast("long")) if _there(spark, path) else None


def _latest(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """Microseconds of the latest sample of the batches that are done, those before one alone if it is given."""
    marks = _read(spark, f"{path}/marks", "batch")
    if marks is None:
        return None
    return marks.filter(F.lit(True) if before is None else F.col("batch") < before).agg(F.max("latest").alias("latest")).first().latest


def add_batch(batch: DataFrame, batch_id: int, path: str, spec: dict[str, str], streams: Mapping[str, Stream], delay_seconds: int, by: Sequence[str] = ("member", "cell"), digits: int | None = None) -> None:
    """Adds one micro-batch to the states below ``path``; adding it again replaces what it added.

    Samples older than the latest one of all batches before, less the delay, are late. Samples without a time are not.
    The mark comes last.
    """
    latest = _latest(batch.sparkSession, path, batch_id)
    late = F.lit(False) if latest is None else F.coalesce(micros(F.col("ts")) < latest - delay_seconds * 1_000_000, F.lit(False))
    for kind, rows in (("late", batch.filter(late)), ("states", stream_states(batch.filter(~late), spec, streams, by, digits))):
        rows.write.mode("overwrite").parquet(f"{path}/{kind}/batch={batch_id}")
    batch.agg(F.max(micros(F.col("ts"))).alias("latest"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")


def follow(samples: DataFrame, path: str, checkpoint: str, spec: dict[str, str], streams: Mapping[str, Stream], delay_seconds: int, by: Sequence[str] = ("member", "cell"), digits: int | None = None):
    """Starts a query that adds what a stream of samples has now, batch by batch, and stops; run again, it goes on after that."""
    return (
        samples.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, path, spec, streams, delay_seconds, by, digits))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _states(spark: SparkSession, path: str) -> DataFrame | None:
    """States of the compacted batches, and of the batches after them that are done."""
    done = _read(spark, f"{path}/marks", "batch")
    if done is None:
        return None
    states = _read(spark, f"{path}/states", "batch").join(done.select("batch"), "batch", "left_semi")
    base = _read(spark, f"{path}/base", "upto")
    if base is None:
        return states.drop("batch")
    upto = base.agg(F.max("upto").alias("upto")).first().upto
    return states.filter(F.col("batch") > upto).drop("batch").unionByName(base.filter(F.col("upto") == upto).drop("upto"))


def stored_tapes(spark: SparkSession, path: str, spec: dict[str, str], streams: Mapping[str, Stream], delay_seconds: int, by: Sequence[str] = ("member", "cell"), digits: int | None = None, with_late: bool = False) -> DataFrame:
    """``stream, field, by, win, win_number, flag, value, n, closed`` of all batches that are done.

    ``closed`` says whether the watermark has passed a window's end, so that no later sample can change it; windows of
    steps, which have no time, and samples of 29 February in the 365-day calendar have null there. ``with_late`` adds
    the late samples to the windows they belong to.
    """
    states = _states(spark, path)
    if states is None:
        raise ValueError(f"nothing was written below {path} yet")
    keys = ("stream", *by, "win_number")
    parts = [states]
    if with_late:
        done = _read(spark, f"{path}/marks", "batch").select("batch")
        late = _read(spark, f"{path}/late", "batch").join(done, "batch", "left_semi").drop("batch")
        parts.append(stream_states(late, spec, streams, by, digits).select(*states.columns))
    tapes = finalize(merge_partials(*parts, by=keys), spec, keys, digits)
    latest = _latest(spark, path)
    passed = F.lit(None).cast("boolean")
    for name, stream in streams.items():
        over = micros(window_end(stream, F.col("win"))) <= F.lit(latest).cast("bigint") - delay_seconds * 1_000_000
        passed = F.when(F.col("stream") == name, over).otherwise(passed)
    return tapes.withColumn("closed", passed)


def late_samples(spark: SparkSession, path: str) -> DataFrame:
    """The late samples of the batches that are done, with their batch."""
    done = _read(spark, f"{path}/marks", "batch")
    if done is None:
        raise ValueError(f"nothing was written below {path} yet")
    return _read(spark, f"{path}/late", "batch").join(done.select("batch"), "batch", "left_semi")


def compact(spark: SparkSession, path: str, by: Sequence[str] = ("member", "cell")) -> None:
    """Merges the states of all batches that are done into one table, which readers take instead of theirs.

    The table gets its name when it is whole; a compaction that fails leaves nothing that is read.
    """
    states, done = _states(spark, path), _read(spark, f"{path}/marks", "batch")
    if states is None:
        return
    upto = done.agg(F.max("batch").alias("batch")).first().batch
    whole = merge_partials(states, by=("stream", *by, "win_number")).select(*states.columns)
    made, named = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{x}") for x in (f"_base-{upto}", f"base/upto={upto}"))
    whole.write.mode("overwrite").parquet(f"{path}/_base-{upto}")
    files = named.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(named.getParent())
    if not files.exists(named):
        files.rename(made, named)
