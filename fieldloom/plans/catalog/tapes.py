"""Queries over the history reductions and their streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import reduce as R
from fieldloom.operators.ordered import number_steps
from fieldloom.plans.catalog.adapters import (
    ALL_TYPES,
    EVENTS,
    TAPE,
    Query,
    events_history,
    lineitem_history,
    sql_avg,
    table,
)
from fieldloom.session import scratch_path
from fieldloom.streaming.reduce import history_reduce_stream, run_available

DAY = R.Hours(24)


def history_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: daily tapes, every field reduced by its own flag."""
    return R.history_reduce(events_history(spark, sf_dir), TAPE, DAY, by=[], digits=2)


BY_FLAG = f"""CASE field WHEN 'click' THEN {sql_avg("value")} WHEN 'view' THEN arg_max(value, (ts, step))
      WHEN 'purchase' THEN max(value) ELSE min(value) END"""
FLAG = "CASE field WHEN 'click' THEN 'A' WHEN 'view' THEN 'I' WHEN 'purchase' THEN 'X' ELSE 'M' END"

HISTORY_REDUCE = f"""
WITH {EVENTS}
SELECT field, date_trunc('day', ts)::TIMESTAMP AS win, {FLAG} AS flag, {BY_FLAG} AS value, count(value) AS n
FROM h WHERE field <> 'signup' GROUP BY 1, 2"""


def _one_flag(flag: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = dict.fromkeys(ALL_TYPES, flag)
        return R.history_reduce(events_history(spark, sf_dir), spec, DAY, by=["member", "cell"], digits=2)

    return run


def _one_flag_sql(flag: str, value: str) -> str:
    return f"""
WITH {EVENTS}
SELECT field, member, cell, date_trunc('day', ts)::TIMESTAMP AS win, '{flag}' AS flag, {value} AS value,
       count(value) AS n FROM h GROUP BY ALL"""


def tape_spec_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spec text per order; every third lacks a comma and holds a malformed item."""
    key = F.col("o_orderkey")
    letter = F.substring(F.lit("AIXMQ"), (key % 5 + 1).cast("int"), F.lit(1))
    text = F.concat(
        F.lit("'F"), key % 7, F.lit(":"), letter, F.lit("',\n 'G"), key % 11, F.lit("'"),
        F.when(key % 3 == 0, F.lit("'H:A'")).otherwise(""),
    )
    return R.tape_spec(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("spec")), "spec")


TAPE_SPEC = """
WITH items AS (
  SELECT o_orderkey, 0 AS pos, 'F' || (o_orderkey % 7) || ':' || substr('AIXMQ', CAST(o_orderkey % 5 + 1 AS BIGINT), 1) AS item,
         'F' || (o_orderkey % 7) AS f, substr('AIXMQ', CAST(o_orderkey % 5 + 1 AS BIGINT), 1) AS g,
         o_orderkey % 5 <> 4 AS ok FROM orders
  UNION ALL
  SELECT o_orderkey, 1, 'G' || (o_orderkey % 11) || CASE WHEN o_orderkey % 3 = 0 THEN '''H:A' ELSE '' END,
         'G' || (o_orderkey % 11), 'A', o_orderkey % 3 <> 0 FROM orders)
SELECT o_orderkey, CAST(pos AS INTEGER) AS pos, item, CASE WHEN ok THEN f END AS field, CASE WHEN ok THEN g END AS flag,
       CASE WHEN NOT ok THEN 'malformed' END AS reject FROM items"""


def tape_field_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.select_fields(events_history(spark, sf_dir), TAPE).select("field", "cell", "ts", "value")


FIELD_SELECT = f"""
WITH {EVENTS}, spec(field) AS (VALUES ('click'), ('view'), ('purchase'), ('error'))
SELECT field, cell, ts, value FROM h SEMI JOIN spec USING (field)"""


def window_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.history_reduce(events_history(spark, sf_dir), TAPE, R.frequency(-6), by=["member"], digits=2)


WINDOW_HOURS = f"""
WITH {EVENTS}
SELECT field, member, time_bucket(INTERVAL '6 hours', ts)::TIMESTAMP AS win, {FLAG} AS flag, {BY_FLAG} AS value,
       count(value) AS n FROM h WHERE field <> 'signup' GROUP BY 1, 2, 3"""


def window_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nine steps, steps numbered per field in time order."""
    history = events_history(spark, sf_dir).withColumnRenamed("step", "event_step")
    numbered = number_steps(history, ["field"], ["ts", "event_step"])
    return R.history_reduce(numbered, dict.fromkeys(ALL_TYPES, "I"), R.frequency(9), by=[])


WINDOW_STEPS = f"""
WITH {EVENTS}, numbered AS (SELECT field, ts, step, value, row_number() OVER (PARTITION BY field ORDER BY ts, step) AS k FROM h)
SELECT field, CAST((k - 1) // 9 AS BIGINT) AS win, 'I' AS flag, arg_max(value, k) AS value, count(value) AS n
FROM numbered GROUP BY ALL"""


def window_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"A": "A", "N": "X", "R": "M"}
    return R.history_reduce(lineitem_history(spark, sf_dir), spec, R.Cal("m", 3), by=["cell"], digits=2)


WINDOW_CALENDAR = f"""
SELECT l_returnflag AS field, CAST(l_linenumber AS BIGINT) AS cell, date_trunc('quarter', l_shipdate)::TIMESTAMP AS win,
       CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'X' ELSE 'M' END AS flag,
       CASE l_returnflag WHEN 'A' THEN {sql_avg("l_extendedprice")} WHEN 'N' THEN max(l_extendedprice)
            ELSE min(l_extendedprice) END AS value, count(l_extendedprice) AS n
FROM lineitem GROUP BY 1, 2, 3"""


def stream_code_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    code = F.concat(
        F.substring(F.lit("dxmd"), (key % 4 + 1).cast("int"), F.lit(1)),
        F.substring(F.lit("xmy"), (key % 3 + 1).cast("int"), F.lit(1)),
        F.lit("xxd"),
    )
    fields = table(spark, sf_dir, "part").select(key.alias("field"), code.alias("code"))
    return R.expand_streams(fields, "code", ["d", "m", "x", "x", "x"], [1, 2, 1, 1, 1])


STREAM_CODE = """
SELECT p_partkey AS field, CAST(0 AS INTEGER) AS stream, 'd' AS freq, CAST(1 AS INTEGER) AS freq_n FROM part WHERE p_partkey % 4 IN (0, 3)
UNION ALL
SELECT p_partkey, 1, 'm', 2 FROM part WHERE p_partkey % 3 = 1"""


def run_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven days from 25 February of a leap year, counted in the 365-day calendar."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_shipdate").alias("ts"))
    return R.run_window(items, "1996-02-25", "ndays", 11, calendar="noleap")


RUN_WINDOW = """
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate AS ts FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-02-25' AND l_shipdate < TIMESTAMP '1996-03-08'"""


def month_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.climatology(lineitem_history(spark, sf_dir, "l_quantity"), by=["cell"], digits=2)
    return out.withColumn("value", F.round("value", 6))


CLIMATOLOGY = f"""
WITH monthly AS (
  SELECT l_returnflag AS field, CAST(l_linenumber AS BIGINT) AS cell, date_trunc('month', l_shipdate) AS win,
         {sql_avg("l_quantity")} AS v FROM lineitem GROUP BY ALL)
SELECT field, cell, CAST(month(win) AS INTEGER) AS month, round(avg(v), 6) AS value, count(v) AS years
FROM monthly GROUP BY ALL"""


def mergeable_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two run segments reduced apart, cut within a window, and merged."""
    history = R.select_fields(events_history(spark, sf_dir), TAPE)
    stop = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    parts = [
        R.partial_reduce(history.filter(side), R.Cal("d", 3), by=["member"], digits=2)
        for side in (F.col("ts") < stop, F.col("ts") >= stop)
    ]
    return R.finalize(R.merge_partials(*parts, by=["member"]), TAPE, by=["member"], digits=2)


MERGEABLE = f"""
WITH {EVENTS}
SELECT field, member, TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * CAST(CAST(floor(epoch(ts) / 259200) AS BIGINT) * 3 AS INTEGER) AS win,
       {FLAG} AS flag, {BY_FLAG} AS value, count(value) AS n
FROM h WHERE field <> 'signup' GROUP BY 1, 2, 3"""


# Which of a daily and a monthly stream each event type goes to, and the reductions of the tapes.
CODES = {"click": "dm", "view": "dx", "purchase": "xm", "error": "dm", "signup": "xx"}
STREAM_SPEC = "'click:A', 'click:X', 'view:I', 'purchase:X', 'error', 'signup:M', 'other:A'"


def tape_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily and a monthly stream from one scan; clicks have two reductions and are in both streams."""
    pairs = [F.lit(x) for pair in CODES.items() for x in pair]
    types = table(spark, sf_dir, "events").select(F.col("event_type").alias("field")).distinct()
    coded = types.withColumn("code", F.element_at(F.create_map(*pairs), F.col("field")))
    spec = R.tape_spec(spark.range(1).select(F.lit(STREAM_SPEC).alias("spec")), "spec")
    streams = R.expand_streams(coded, "code", ["d", "m"], [1, 1])
    return R.reduce_streams(events_history(spark, sf_dir), spec, streams, by=["member"], digits=2)


TAPE_STREAMS = f"""
WITH {EVENTS},
w AS (SELECT 0 AS stream, 'd' AS freq, date_trunc('day', ts)::TIMESTAMP AS win, * FROM h WHERE field IN ('click', 'view', 'error')
      UNION ALL SELECT 1, 'm', date_trunc('month', ts)::TIMESTAMP, * FROM h WHERE field IN ('click', 'purchase', 'error')),
s AS (SELECT CAST(stream AS INTEGER) AS stream, field, member, freq, CAST(1 AS INTEGER) AS freq_n, win, {sql_avg("value")} AS a,
        arg_max(value, (ts, step)) AS i, max(value) AS x, count(value) AS n FROM w GROUP BY 1, 2, 3, 4, 5, 6)
SELECT s.* EXCLUDE (a, i, x), flag, CASE flag WHEN 'A' THEN a WHEN 'I' THEN i ELSE x END AS value
FROM s JOIN (VALUES ('click', 'A'), ('click', 'X'), ('view', 'I'), ('purchase', 'X'), ('error', 'A')) AS f(field, flag) USING (field)"""


def reduce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily tapes from a stream over the events file, with one hour of patience."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    samples = stream.select(
        F.col("event_type").alias("field"), "ts", (F.col("event_id") + 1).alias("step"), "value"
    )
    path = scratch_path(spark, "stream")
    tapes = history_reduce_stream(samples, TAPE, DAY, "1 hour", by=[], digits=2)
    run_available(tapes, f"{path}/out", f"{path}/state")
    return spark.read.schema(tapes.schema).parquet(f"{path}/out")


REDUCE_STREAM = f"""
WITH {EVENTS}, newest AS (SELECT max(ts) AS t FROM h WHERE field <> 'signup')
SELECT field, date_trunc('day', ts)::TIMESTAMP AS win, {FLAG} AS flag, {BY_FLAG} AS value, count(value) AS n
FROM h WHERE field <> 'signup'
  AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT t - INTERVAL 1 HOUR FROM newest)
GROUP BY 1, 2"""

QUERIES: dict[str, Query] = {
    "history_reduce": (history_reduce, HISTORY_REDUCE),
    "history_avg_window": (_one_flag("A"), _one_flag_sql("A", sql_avg("value"))),
    "history_instant": (_one_flag("I"), _one_flag_sql("I", "arg_max(value, (ts, step))")),
    "history_max": (_one_flag("X"), _one_flag_sql("X", "max(value)")),
    "history_min": (_one_flag("M"), _one_flag_sql("M", "min(value)")),
    "tape_spec_parse": (tape_spec_parse, TAPE_SPEC),
    "tape_field_select": (tape_field_select, FIELD_SELECT),
    "window_hours": (window_hours, WINDOW_HOURS),
    "window_steps": (window_steps, WINDOW_STEPS),
    "window_calendar": (window_calendar, WINDOW_CALENDAR),
    "stream_code_expand": (stream_code_expand, STREAM_CODE),
    "run_window_filter": (run_window_filter, RUN_WINDOW),
    "month_climatology": (month_climatology, CLIMATOLOGY),
    "mergeable_reduce": (mergeable_reduce, MERGEABLE),
    "tape_streams": (tape_streams, TAPE_STREAMS),
    "history_reduce_stream": (reduce_stream, REDUCE_STREAM),
}
