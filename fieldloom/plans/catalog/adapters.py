"""The given tables seen as the library's canonical tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.consistency import global_mean
from fieldloom.sources.history import history_scan

# A registered query: how to run it, and the SQL that must give the same rows
# (None where the operator has no SQL form).
Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]

# Reduction flag per event type in the sample tapes.
TAPE = {"click": "A", "view": "I", "purchase": "X", "error": "M"}
ALL_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_history(spark: SparkSession, sf_dir: str, **kwargs) -> DataFrame:
    """Events as history samples; the event number is the model step."""
    return history_scan(
        spark,
        f"{sf_dir}/events.parquet",
        columns={
            "member": "cast(event_id % 4 as int)",
            "field": "event_type",
            "ts": "ts",
            "step": "event_id + 1",
            "cell": "user_id",
            "value": "value",
        },
        **kwargs,
    )


EVENTS = """h AS (
  SELECT CAST(event_id % 4 AS INTEGER) AS member, event_type AS field, ts,
         event_id + 1 AS step, user_id AS cell, value FROM events)"""


def lineitem_history(spark: SparkSession, sf_dir: str, value: str = "l_extendedprice") -> DataFrame:
    """Line items as history samples over several years: field = return flag, cell = line number."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("member"),
        F.col("l_returnflag").alias("field"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("step"),
        F.col("l_linenumber").cast("bigint").alias("cell"),
        F.col(value).alias("value"),
    )


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def supplier_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble of suppliers: (member, field, value), field = measure and return flag.

    Weighted by part size. All four measures are reduced in one pass; only the
    small result is unpivoted.
    """
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("member"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_partkey").alias("cell"),
        *MEASURES,
    )
    area = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), F.col("p_size").alias("w"))
    means = global_mean(items, area, MEASURES, ["member", "flag"], digits=2)
    long = means.unpivot(["member", "flag"], MEASURES, "measure", "value")
    return long.select("member", F.concat_ws("_", "measure", "flag").alias("field"), "value")


def _mean(column: str) -> str:
    return (
        f"(CAST(sum(CAST(round({column} * p_size * 100.0) AS BIGINT)) AS BIGINT)::DOUBLE / 100.0)"
        f" / (CAST(sum(CAST(round(p_size * 100.0) AS BIGINT)) AS BIGINT)::DOUBLE / 100.0)"
    )


MEANS = f"""gm AS (
  SELECT member, measure || '_' || flag AS field, value FROM (
    SELECT l_suppkey AS member, l_returnflag AS flag,
           {", ".join(f"{_mean(c)} AS {c}" for c in MEASURES)}
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
  UNPIVOT (value FOR measure IN ({", ".join(MEASURES)})))"""


def sql_avg(column: str, digits: int = 2) -> str:
    scale = f"{10**digits}.0"
    return f"(CAST(sum(CAST(round({column} * {scale}) AS BIGINT)) AS BIGINT)::DOUBLE / {scale}) / count({column})"


def noleap_day_sql(d: str) -> str:
    """365-day-calendar day number of a date in SQL; null on 29 February."""
    return (
        f"(CASE WHEN month({d}) = 2 AND day({d}) = 29 THEN NULL ELSE year({d}) * 365 + dayofyear({d}) - "
        f"CASE WHEN month({d}) > 2 AND ((year({d}) % 4 = 0 AND year({d}) % 100 <> 0) OR year({d}) % 400 = 0) "
        f"THEN 1 ELSE 0 END END)"
    )


def noleap_date_sql(n: str) -> str:
    """Date of a 365-day-calendar day number, by way of the equal day in a common year."""
    return (
        f"make_date(CAST(({n} - 1) // 365 AS BIGINT), "
        f"month(DATE '2001-01-01' + CAST(({n} - 1) % 365 AS INTEGER)), "
        f"day(DATE '2001-01-01' + CAST(({n} - 1) % 365 AS INTEGER)))"
    )
