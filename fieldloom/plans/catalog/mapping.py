"""Queries over field mapping and forcing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.exact import exact_avg
from fieldloom.operators import fields as M
from fieldloom.operators.reduce import Hours, window_key
from fieldloom.plans.catalog.adapters import EVENTS, Query, events_history, sql_avg, table


def _weights(cells: DataFrame) -> DataFrame:
    """Cell c feeds c div 2 with 0.25 and its right neighbour with 0.75; row sums are not 1."""
    half = F.floor(F.col("cell") / 2).cast("bigint")
    targets = F.array(
        F.struct(half.alias("dst_cell"), F.lit(0.25).alias("w")), F.struct((half + 1).alias("dst_cell"), F.lit(0.75).alias("w"))
    )
    return cells.select(F.col("cell").alias("src_cell"), F.inline(targets))


def _cells(spark: SparkSession, sf_dir: str, condition: str = "true") -> DataFrame:
    events = table(spark, sf_dir, "events").filter(condition)
    return events.select(F.col("user_id").alias("cell")).distinct()


WEIGHTS = """weights AS (
  SELECT src_cell, src_cell // 2 AS dst_cell, 0.25::DOUBLE AS w FROM (SELECT DISTINCT user_id AS src_cell FROM events)
  UNION ALL
  SELECT src_cell, src_cell // 2 + 1, 0.75::DOUBLE FROM (SELECT DISTINCT user_id AS src_cell FROM events))"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_history(spark, sf_dir).withColumn("win", window_key(Hours(24)))


def remap_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.remap(_daily(spark, sf_dir), _weights(_cells(spark, sf_dir)), by=["field", "win"], norm=True, digits=2)


REMAP = f"""
WITH {EVENTS}, {WEIGHTS}
SELECT field, date_trunc('day', ts)::TIMESTAMP AS win, dst_cell AS cell,
       (CAST(sum(CAST(round(w * value * 10000.0) AS BIGINT)) AS BIGINT)::DOUBLE / 10000.0)
         / (CAST(sum(CAST(round(w * 10000.0) AS BIGINT)) AS BIGINT)::DOUBLE / 10000.0) AS value
FROM h JOIN weights ON src_cell = cell GROUP BY 1, 2, 3"""


def weights_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all users against the users seen clicking (sources) and failing (destinations)."""
    weights = _weights(_cells(spark, sf_dir))
    src = _cells(spark, sf_dir, "event_type = 'click' AND value > 20")
    dst = _cells(spark, sf_dir, "event_type = 'error' AND value > 20")
    return M.weights_check(weights, src, dst, digits=2)


VALIDATE = f"""
WITH {WEIGHTS}, src AS (SELECT user_id FROM events WHERE event_type = 'click' AND value > 20),
dst AS (SELECT user_id FROM events WHERE event_type = 'error' AND value > 20)
SELECT 'unknown source' AS problem, src_cell AS cell, count(*)::DOUBLE AS amount FROM weights
WHERE src_cell NOT IN (SELECT user_id FROM src) GROUP BY src_cell
UNION ALL
SELECT 'unknown destination', dst_cell, count(*)::DOUBLE FROM weights WHERE dst_cell NOT IN (SELECT user_id FROM dst) GROUP BY dst_cell
UNION ALL
SELECT 'row sum', dst_cell, sum(w) FROM weights GROUP BY dst_cell HAVING abs(sum(w) - 1) > 1e-9"""


def merge_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views per user and day, merged with a third of the area swapped between the two."""
    daily = _daily(spark, sf_dir)
    sources = {name: daily.filter(F.col("field") == name) for name in ("click", "view")}
    major = F.when(F.col("cell") % 3 == 0, F.lit("click")).otherwise(F.lit("view"))
    shares = F.array(
        *[F.struct(F.lit(n).alias("source"), F.when(major == n, F.lit(0.75)).otherwise(F.lit(0.25)).alias("f")) for n in sources]
    )
    fractions = _cells(spark, sf_dir).select("cell", F.inline(shares))
    return M.merge_fields(sources, fractions, by=["cell", "win"], digits=4)


MERGE_FRACTION = f"""
WITH {EVENTS}, x AS (
  SELECT cell, date_trunc('day', ts)::TIMESTAMP AS win, value,
         CASE WHEN (cell % 3 = 0) = (field = 'click') THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS f FROM h WHERE field IN ('click', 'view'))
SELECT cell, win, (CAST(sum(CAST(round(f * value * 10000.0) AS BIGINT)) AS BIGINT)::DOUBLE / 10000.0)
  / (CAST(sum(CAST(round(f * 10000.0) AS BIGINT)) AS BIGINT)::DOUBLE / 10000.0) AS value FROM x GROUP BY cell, win"""


def time_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily mean of views at the time of every error."""
    daily = _daily(spark, sf_dir)
    series = (
        daily.filter("field = 'view'").groupBy("field", F.col("win").alias("ts")).agg(exact_avg(F.col("value"), 2).alias("value"))
    )
    requests = daily.filter("field = 'error'").select(F.lit("view").alias("field"), "ts", F.col("step").alias("req_id"))
    return M.interp(requests, series)


INTERPOLATE = f"""
WITH {EVENTS}, s AS (SELECT date_trunc('day', ts)::TIMESTAMP AS t, {sql_avg("value")} AS v FROM h WHERE field = 'view' GROUP BY 1),
r AS (SELECT step AS req_id, ts FROM h WHERE field = 'error'),
lo AS (SELECT r.req_id, r.ts, s.t AS t0, s.v AS v0 FROM r ASOF LEFT JOIN s ON r.ts >= s.t),
hi AS (SELECT lo.*, s.t AS t1, s.v AS v1 FROM lo ASOF LEFT JOIN s ON lo.ts < s.t)
SELECT 'view' AS field, req_id, ts, v0 AS lo_value, v1 AS hi_value,
       CASE WHEN ts = t0 THEN v0 ELSE v0 + (v1 - v0) * ((epoch_us(ts) - epoch_us(t0))::DOUBLE / (epoch_us(t1) - epoch_us(t0))::DOUBLE) END AS value
FROM hi"""


def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click of the same user before every purchase."""
    history = events_history(spark, sf_dir)
    series = history.filter("field = 'click'").select("cell", "ts", "value")
    requests = history.filter("field = 'purchase'").select("cell", "ts", F.col("step").alias("req_id"))
    return M.asof(requests, series, keys=["cell"])


ASOF = f"""
WITH {EVENTS}, c AS (SELECT cell, ts, value FROM h WHERE field = 'click'), p AS (SELECT cell, ts, step AS req_id FROM h WHERE field = 'purchase')
SELECT p.cell, p.req_id, p.ts, c.ts AS lo_ts, c.value AS lo_value FROM p ASOF LEFT JOIN c ON p.cell = c.cell AND p.ts >= c.ts"""


def cycle_forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates read the daily mean quantity of 1996 and 1997, over and over."""
    day = F.col("l_shipdate")
    begin, end = (F.lit(f"{year}-01-01").cast("timestamp_ntz") for year in (1996, 1998))
    items = table(spark, sf_dir, "lineitem").filter((day >= begin) & (day < end))
    series = items.groupBy(F.col("l_linestatus").alias("field"), F.col("l_shipdate").alias("date")).agg(
        exact_avg(F.col("l_quantity"), 2).alias("value")
    )
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("field"), F.col("o_orderdate").alias("date"))
    return M.cycle(requests, series, 1996, 2).withColumn("source_date", F.col("source_date").cast("timestamp_ntz"))


CYCLE = f"""
WITH s AS (SELECT l_linestatus AS field, l_shipdate AS source_date, {sql_avg("l_quantity")} AS value FROM lineitem
           WHERE year(l_shipdate) IN (1996, 1997) GROUP BY 1, 2),
r AS (SELECT o_orderkey, o_orderstatus AS field, o_orderdate AS date,
        make_date(CASE WHEN year(o_orderdate) % 2 = 0 THEN 1996 ELSE 1997 END, month(o_orderdate),
                  CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN 28 ELSE day(o_orderdate) END)::TIMESTAMP AS source_date FROM orders)
SELECT * FROM r LEFT JOIN s USING (field, source_date)"""

QUERIES: dict[str, Query] = {
    "remap_sparse": (remap_sparse, REMAP),
    "weights_validate": (weights_validate, VALIDATE),
    "merge_fraction": (merge_fraction, MERGE_FRACTION),
    "time_interpolate": (time_interpolate, INTERPOLATE),
    "asof_lookup": (asof_lookup, ASOF),
    "cycle_forcing": (cycle_forcing, CYCLE),
}
