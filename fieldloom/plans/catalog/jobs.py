"""Queries over whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.reduce import Hours, window_key
from fieldloom.operators.reduce import frequency
from fieldloom.operators.rules import WildcardRule
from fieldloom.plans import jobs
from fieldloom.plans.catalog.adapters import (
    EVENTS,
    Query,
    events_history,
    lineitem_history,
    noleap_day_sql,
    sql_avg,
    supplier_means,
    table,
)
from fieldloom.plans.catalog.ensembles import NEW_RUNS, pertlim_sql
from fieldloom.plans.catalog.mapping import WEIGHTS, _cells, _weights
from fieldloom.session import materialize


def tape_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly tapes of three model years per supplier, stamped with the supplier's nation."""
    runs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member"), F.col("s_nationkey").alias("machine"))
    return jobs.tape_job(
        lineitem_history(spark, sf_dir),
        {"A": "A", "N": "X", "R": "M"},
        frequency(-8760),
        jobs.Segment("1996-01-01", "nyears", 3),
        runs,
        by=["member"],
        calendar="noleap",
        digits=2,
    )


TAPE_JOB = f"""
WITH t AS (
  SELECT l_returnflag AS field, l_suppkey AS member,
         CASE WHEN {noleap_day_sql("l_shipdate")} IS NOT NULL THEN date_trunc('year', l_shipdate)::TIMESTAMP END AS win,
         {sql_avg("l_extendedprice")} AS a, max(l_extendedprice) AS x, min(l_extendedprice) AS m, count(l_extendedprice) AS n
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1, 2, 3)
SELECT field, member, win, CASE field WHEN 'A' THEN 'A' WHEN 'N' THEN 'X' ELSE 'M' END AS flag,
       CASE field WHEN 'A' THEN a WHEN 'N' THEN x ELSE m END AS value, n, s_nationkey AS machine
FROM t LEFT JOIN supplier ON s_suppkey = member"""


def replicate_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers replicated for members 998 to 1001."""
    base = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(".0000")).alias("base"), F.col("c_acctbal").alias("value")
    )
    return jobs.replicate_job(base, "base", "value", "c_custkey", 1002, start=998).drop("base")


REPLICATE_JOB = f"""
WITH m AS (SELECT CAST(i AS INTEGER) AS member, {pertlim_sql("i")} AS pertlim FROM generate_series(998, 1001) AS g(i)),
p AS (SELECT *, CAST(replace(pertlim, 'd', 'e') AS DOUBLE) AS pertlim_num FROM m)
SELECT c_custkey, member, pertlim, pertlim_num, c_name || '.' || lpad(CAST(member AS VARCHAR), 4, '0') AS "case",
       c_acctbal * (pertlim_num * (((('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT
           + member::BIGINT * 2654435769) % 4294967296)::DOUBLE / 4294967296.0 * 2.0 - 1.0) + 1.0) AS value
FROM customer CROSS JOIN p"""


def consistency_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as ensemble, the first three as new runs: scores and verdict in one table."""
    means = materialize(supplier_means(spark, sf_dir), "means")
    new = F.col("member") < NEW_RUNS
    scores, verdict = jobs.consistency_of_means(means.filter(~new), means.filter(new))
    found = verdict.select(F.lit(None).cast("bigint").alias("member"), F.lit(None).cast("int").alias("pc"), F.lit(None).cast("double").alias("score"), "verdict")
    return scores.select("member", "pc", F.round("score", 6).alias("score"), F.lit(None).cast("string").alias("verdict")).unionByName(found)


def release_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results per month, rich customers as expected failures."""
    price, day = F.col("o_totalprice"), F.dayofmonth("o_orderdate")
    status = F.when(price > 490000, "FAIL2").when(price > 470000, "FAIL1").when(price < 5000, "FAIL").otherwise("PASS")
    results = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("tag"),
        F.when(day <= 15, "regression").otherwise("restart").alias("suite"),
        F.concat(F.lit("T"), F.col("o_custkey") % 97).alias("test"),
        F.col("o_orderstatus").alias("phase"),
        status.alias("status"),
    )
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 5000")
    expected = rich.select(F.concat(F.lit("T"), F.col("c_custkey") % 97).alias("test"), F.lit("F").alias("phase"), F.lit("FAIL2").alias("status"))
    return jobs.release_job(results, expected)


RELEASE_JOB = """
WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS tag, CASE WHEN day(o_orderdate) <= 15 THEN 'regression' ELSE 'restart' END AS suite,
  'T' || (o_custkey % 97) AS test, o_orderstatus AS phase,
  CASE WHEN o_totalprice > 490000 THEN 'FAIL2' WHEN o_totalprice > 470000 THEN 'FAIL1' WHEN o_totalprice < 5000 THEN 'FAIL' ELSE 'PASS' END AS status
  FROM orders),
x AS (SELECT DISTINCT 'T' || (c_custkey % 97) AS test FROM customer WHERE c_acctbal > 5000),
c AS (SELECT *, NOT (status = 'FAIL2' AND phase = 'F' AND test IN (SELECT test FROM x)) AS counted FROM r),
k AS (SELECT *, counted AND ((suite = 'regression' AND status = 'FAIL2') OR (suite = 'restart' AND status <> 'PASS')) AS blocked FROM c)
SELECT tag, count(*) FILTER (WHERE counted) AS n_results, count(*) FILTER (WHERE blocked) AS n_blocking,
       count(*) FILTER (WHERE counted AND suite = 'regression' AND status = 'FAIL1') AS n_answer_changes, NOT bool_or(blocked) AS allowed FROM k GROUP BY tag"""


def enrich_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders refer to a code by alias (their customer's nation) or in full."""
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("alias"),
        F.concat(F.col("n_regionkey") * 1000, F.lit("_CAM%M"), F.col("n_nationkey") % 4, F.lit("_OCN_R%x")).alias("lname"),
    )
    key = F.col("o_orderkey")
    code = F.when(key % 4 == 0, F.concat(key % 7, F.lit("_CAM_OCN"))).otherwise(F.concat(F.lit("NATION_"), key % 25))
    records = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", code.alias("code"))
    dates = [("^0_", "0001-01-01"), ("^[12]000_", "1850-01-01"), ("_R%", "2005-01-01")]
    layouts = [
        WildcardRule({"o_orderstatus": "any"}, "any", {"ntasks": -1}),
        WildcardRule({"o_orderstatus": "F"}, "any", {"ntasks": 64}),
        WildcardRule({"o_orderstatus": "any"}, "CAM%M[12]", {"ntasks": 128}),
        WildcardRule({"o_orderstatus": "F"}, "CAM%M2", {"ntasks": 512}),
    ]
    out = jobs.enrich_job(records, "code", nation, ["atm", "ocn"], dates, layouts)
    atm = F.element_at("parsed.comps", 1)
    return out.select(
        "o_orderkey", "lname", F.col("parsed.time").alias("time"), F.array_join(atm["phys"], "%").alias("atm_phys"), "value", "rule_id", "ntasks"
    )


ENRICH_JOB = """
WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderkey % 4 = 0 AS own, CAST(o_orderkey % 25 AS INTEGER) AS k FROM orders),
n AS (SELECT r.*, CASE WHEN own THEN CAST(o_orderkey % 7 AS VARCHAR) ELSE CAST(n_regionkey * 1000 AS VARCHAR) END AS time,
        CASE WHEN own THEN '' ELSE 'M' || (n_nationkey % 4) END AS phys FROM r JOIN nation ON n_nationkey = k),
l AS (SELECT *, time || CASE WHEN own THEN '_CAM_OCN' ELSE '_CAM%' || phys || '_OCN_R%x' END AS lname FROM n),
m AS (SELECT *, CASE WHEN o_orderstatus = 'F' AND phys = 'M2' THEN 3 WHEN phys IN ('M1', 'M2') THEN 2 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS rule FROM l)
SELECT o_orderkey, lname, time, phys AS atm_phys,
       CASE WHEN time = '0' THEN '0001-01-01' WHEN time IN ('1000', '2000') THEN '1850-01-01' WHEN NOT own THEN '2005-01-01' END AS value,
       CAST(rule AS INTEGER) AS rule_id, CAST([-1, 64, 128, 512][rule + 1] AS INTEGER) AS ntasks FROM m"""


def fields_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views per day, regridded and merged three to one."""
    daily = events_history(spark, sf_dir).withColumn("win", window_key(Hours(24)))
    return jobs.fields_job(daily, _weights(_cells(spark, sf_dir)), {"click": 0.75, "view": 0.25}, digits=2)


FIELDS_JOB = f"""
WITH {EVENTS}, {WEIGHTS}, g AS (
  SELECT field, date_trunc('day', ts)::TIMESTAMP AS win, dst_cell AS cell,
         (CAST(sum(CAST(round(w * value * 10000.0) AS BIGINT)) AS BIGINT)::DOUBLE / 10000.0)
           / (CAST(sum(CAST(round(w * 10000.0) AS BIGINT)) AS BIGINT)::DOUBLE / 10000.0) AS v,
         CASE field WHEN 'click' THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS f
  FROM h JOIN weights ON src_cell = cell WHERE field IN ('click', 'view') GROUP BY 1, 2, 3)
SELECT cell, win, sum(f * v) / sum(f) AS value FROM g GROUP BY cell, win"""

QUERIES: dict[str, Query] = {
    "tape_job": (tape_job, TAPE_JOB),
    "replicate_job": (replicate_job, REPLICATE_JOB),
    "consistency_job": (consistency_job, None),
    "release_job": (release_job, RELEASE_JOB),
    "enrich_job": (enrich_job, ENRICH_JOB),
    "fields_job": (fields_job, FIELDS_JOB),
}
