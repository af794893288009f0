"""Queries over resource reports and calendar scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import calendar as cal
from fieldloom.operators import reduce as R
from fieldloom.operators import reports as P
from fieldloom.plans.catalog.adapters import Query, lineitem_history, noleap_date_sql, noleap_day_sql, sql_avg, table


def _note(key):
    """Cost note of an order: most state both numbers, some one, some none."""
    ypd = F.concat(key % 19 + 1, F.when(key % 4 == 0, ".25").otherwise(""))
    return (
        F.when(key % 10 == 0, F.lit("none"))
        .when(key % 10 == 1, F.concat(ypd, F.lit(" ypd expected")))
        .otherwise(F.concat(ypd, F.lit(" ypd/ "), key % 900 + 100, F.lit(" pe-hrs/simyr expected")))
    )


YPD = "CASE WHEN {k} % 10 <> 0 THEN {k} % 19 + 1 + CASE WHEN {k} % 4 = 0 THEN 0.25::DOUBLE ELSE 0::DOUBLE END END"
PE_HOURS = "CASE WHEN {k} % 10 > 1 THEN ({k} % 900 + 100)::DOUBLE END"


def throughput_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "orders").select("o_orderkey", _note(F.col("o_orderkey")).alias("note"))
    return P.with_cost(notes, "note").drop("note")


THROUGHPUT = f"SELECT o_orderkey, {YPD.format(k='o_orderkey')} AS ypd, {PE_HOURS.format(k='o_orderkey')} AS pe_hours FROM orders"


def layout_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as layouts: line items are parts that start at ten times their number."""
    parts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("layout"),
        (F.col("l_linenumber") * 10).alias("root"),
        F.col("l_quantity").cast("int").alias("ntasks"),
    )
    key = F.col("o_orderkey")
    return P.footprint(parts, table(spark, sf_dir, "orders").select(key.alias("layout"), _note(key).alias("note")))


FOOTPRINT = f"""
WITH f AS (SELECT l_orderkey AS layout, CAST(max(l_linenumber * 10 + CAST(l_quantity AS INTEGER)) AS INTEGER) AS footprint,
             {YPD.format(k='l_orderkey')} AS ypd, {PE_HOURS.format(k='l_orderkey')} AS pe_hours FROM lineitem GROUP BY l_orderkey)
SELECT *, footprint * 24 / ypd AS recomputed, abs(footprint * 24 / ypd - pe_hours) <= pe_hours * 0.02::DOUBLE AS agrees FROM f"""


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts of an order that share resources, summed up per order."""
    lo = F.col("l_linenumber") * 10
    parts = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("part"),
        lo.cast("bigint").alias("lo"),
        (lo + F.col("l_quantity").cast("bigint")).alias("hi"),
    )
    pairs = P.overlaps(parts, ["l_orderkey"], "lo", "hi", "part")
    return pairs.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("shared_hi") - F.col("shared_lo")).alias("shared")
    )


OVERLAP = """
WITH p AS (SELECT l_orderkey, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS part, l_linenumber * 10 AS lo,
             l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS hi FROM lineitem)
SELECT a.l_orderkey, count(*) AS n_pairs, CAST(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS BIGINT) AS shared
FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.part < b.part AND a.lo < b.hi AND b.lo < a.hi GROUP BY a.l_orderkey"""


def noleap_daynum(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", cal.noleap_daynum(date).alias("day_number"), cal.noleap_hour(date).alias("hour_number")
    )


DAYNUM = f"""
SELECT o_orderkey, {noleap_day_sql("o_orderdate")} AS day_number, ({noleap_day_sql("o_orderdate")} - 1) * 24 + hour(o_orderdate) AS hour_number
FROM orders"""


def noleap_add_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = cal.noleap_add_days(F.col("o_orderdate"), F.col("o_orderkey") % 800 - 400)
    return table(spark, sf_dir, "orders").select("o_orderkey", moved.cast("string").alias("moved"))


ADD_DAYS = f"""
WITH n AS (SELECT o_orderkey, {noleap_day_sql("o_orderdate")} + o_orderkey % 800 - 400 AS n FROM orders)
SELECT o_orderkey, CASE WHEN n IS NOT NULL THEN CAST({noleap_date_sql("n")} AS VARCHAR) END AS moved FROM n"""


def calendar_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity over five-day windows, once in each calendar."""
    history = lineitem_history(spark, sf_dir, "l_quantity")
    spec = dict.fromkeys("ANR", "A")
    tapes = [
        R.history_reduce(history, spec, R.Hours(120), by=[], calendar=c, digits=2).withColumn("calendar", F.lit(c))
        for c in cal.CALENDARS
    ]
    return tapes[0].unionByName(tapes[1])


N5 = f"(({noleap_day_sql('l_shipdate')} - 1) // 5 * 5 + 1)"
SWITCH = f"""
WITH x AS (
  SELECT l_returnflag AS field, l_quantity AS v, 'gregorian' AS calendar,
         TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * CAST(CAST(floor(epoch(l_shipdate) / 432000) AS BIGINT) * 5 AS INTEGER) AS win FROM lineitem
  UNION ALL
  SELECT l_returnflag, l_quantity, 'noleap', CASE WHEN {N5} IS NOT NULL THEN {noleap_date_sql(N5)}::TIMESTAMP END FROM lineitem)
SELECT field, win, 'A' AS flag, {sql_avg("v")} AS value, count(v) AS n, calendar FROM x GROUP BY field, win, calendar"""

QUERIES: dict[str, Query] = {
    "throughput_extract": (throughput_extract, THROUGHPUT),
    "layout_footprint": (layout_footprint, FOOTPRINT),
    "interval_overlap": (interval_overlap, OVERLAP),
    "noleap_daynum": (noleap_daynum, DAYNUM),
    "noleap_add_days": (noleap_add_days, ADD_DAYS),
    "calendar_switch": (calendar_switch, SWITCH),
}
