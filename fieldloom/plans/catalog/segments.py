"""Queries over runs that stop and go on: streams with all kinds of windows, saved states, segments of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import reduce as R
from fieldloom.plans.catalog.adapters import EVENTS, TAPE, Query, events_history, sql_avg
from fieldloom.session import scratch_path
from fieldloom.sources import states as S
from fieldloom.streaming import tapes as T

STREAMS = {"month": T.Stream(R.Cal("m")), "nine": T.Stream(R.Steps(9)), "week": T.Stream(R.Hours(168), "noleap")}
#: Seconds that a sample may come late.
DELAY = 5 * 86_400
STOP = "2024-01-20"


def _followed(spark: SparkSession, sf_dir: str) -> str:
    """The events in two deliveries: up to a day, of which every tenth event comes with the rest; the run stops between them."""
    history = events_history(spark, sf_dir).select("field", "member", "cell", "ts", "step", "value")
    path = scratch_path(spark, "follow")
    first = (F.col("ts") < F.lit(STOP).cast("timestamp_ntz")) & (F.col("step") % 10 != 7)
    for number, part in enumerate((first, ~first)):
        history.filter(part).write.parquet(f"{path}/in/{number}")
        samples = spark.readStream.schema(history.schema).parquet(f"{path}/in/*")
        T.follow(samples, f"{path}/out", f"{path}/checkpoint", TAPE, STREAMS, DELAY, by=["member"], digits=2).awaitTermination()
    return f"{path}/out"


def stream_tapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly, nine-step and weekly tapes of a stream that was stopped and taken up again."""
    return T.stored_tapes(spark, _followed(spark, sf_dir), TAPE, STREAMS, DELAY, by=["member"], digits=2)


FLAG = "CASE field WHEN 'click' THEN 'A' WHEN 'view' THEN 'I' WHEN 'purchase' THEN 'X' WHEN 'error' THEN 'M' END"
BY_FLAG = f"CASE field WHEN 'click' THEN {sql_avg('value')} WHEN 'view' THEN arg_max(value, (ts, step)) WHEN 'purchase' THEN max(value) WHEN 'error' THEN min(value) END"
IN_TIME = f"""f AS (SELECT max(ts) AS t FROM h WHERE ts < TIMESTAMP '{STOP}' AND step % 10 <> 7),
g AS (SELECT h.*, NOT (ts < TIMESTAMP '{STOP}' AND step % 10 <> 7) AND ts < t - INTERVAL {DELAY} SECOND AS late FROM h CROSS JOIN f)"""
# hours since the year 0 of the 365-day calendar; 2024 begins at 2024 * 8760 and January has no leap day
WEEK = "TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * CAST((2024 * 8760 + CAST(floor(epoch(ts - TIMESTAMP '2024-01-01' + TIMESTAMP '1970-01-01') / 3600) AS BIGINT)) // 168 * 168 - 2024 * 8760 AS INTEGER)"

STREAM_TAPES = f"""
WITH {EVENTS}, {IN_TIME},
w AS (SELECT 'month' AS stream, date_trunc('month', ts)::TIMESTAMP AS win, CAST(NULL AS BIGINT) AS win_number, date_trunc('month', ts)::TIMESTAMP + INTERVAL 1 MONTH AS till, * FROM g WHERE NOT late
  UNION ALL SELECT 'nine', NULL, CAST((step - 1) // 9 AS BIGINT), NULL, * FROM g WHERE NOT late
  UNION ALL SELECT 'week', {WEEK}, NULL, CASE WHEN {WEEK} + INTERVAL 168 HOUR < TIMESTAMP '2024-02-29' THEN {WEEK} + INTERVAL 168 HOUR END, * FROM g WHERE NOT late),
newest AS (SELECT max(ts) AS t FROM h)
SELECT stream, field, member, win, win_number, {FLAG} AS flag, {BY_FLAG} AS value, count(value) AS n, any_value(till) <= any_value(t) - INTERVAL {DELAY} SECOND AS closed
FROM w CROSS JOIN newest WHERE field <> 'signup' GROUP BY stream, field, member, win, win_number"""


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that came too late for the tapes of that stream."""
    return T.late_samples(spark, _followed(spark, sf_dir)).select("field", "member", "cell", "ts", "step", "value", "batch")


STREAM_LATE = f"WITH {EVENTS}, {IN_TIME} SELECT field, member, cell, ts, step, value, CAST(1 AS BIGINT) AS batch FROM g WHERE late"

SEGMENTS = [("first", "2024-01-01", "2024-01-09 06:00:00"), ("second", "2024-01-09 06:00:00", "2024-01-17"), ("third", "2024-01-17", "2024-02-01")]


def stored_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three run segments whose states are saved at their stops, one of them twice, and merged into tapes of three days."""
    history = R.select_fields(events_history(spark, sf_dir), TAPE)
    path = scratch_path(spark, "segments")
    for name, begin, end in (*SEGMENTS, SEGMENTS[1]):
        times = [F.lit(t).cast("timestamp_ntz") for t in (begin, end)]
        part = history.filter((F.col("ts") >= times[0]) & (F.col("ts") < times[1]))
        S.save_states(R.partial_reduce(part, R.Cal("d", 3), by=["member"], digits=2), path, name, begin, end)
    return R.finalize(S.merged_states(spark, path, by=["member"]), TAPE, by=["member"], digits=2)


STORED = f"""
WITH {EVENTS}
SELECT field, member, TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * CAST(CAST(floor(epoch(ts) / 259200) AS BIGINT) * 3 AS INTEGER) AS win,
       {FLAG} AS flag, {BY_FLAG} AS value, count(value) AS n
FROM h WHERE field <> 'signup' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY 1, 2, 3"""


def run_window_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thousand steps of every member from the middle of the run on."""
    return R.run_window(events_history(spark, sf_dir), "2024-01-12 08:00:00", "nsteps", 2000).select("member", "field", "ts", "step", "cell", "value")


RUN_STEPS = f"""
WITH {EVENTS}, r AS (SELECT *, min(step) OVER (PARTITION BY member) AS begins FROM h WHERE ts >= TIMESTAMP '2024-01-12 08:00:00')
SELECT member, field, ts, step, cell, value FROM r WHERE step < begins + 2000"""

QUERIES: dict[str, Query] = {
    "stream_tapes": (stream_tapes, STREAM_TAPES),
    "stream_late": (stream_late, STREAM_LATE),
    "stored_states": (stored_states, STORED),
    "run_window_steps": (run_window_steps, RUN_STEPS),
}
