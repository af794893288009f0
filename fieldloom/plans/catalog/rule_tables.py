"""Queries over rules that are tables themselves, as many as there are orders or customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.rule_tables import match_table, specific_table
from fieldloom.plans.catalog.adapters import Query, table


def rule_table_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order makes a rule from its customer's number; pages take the first and the last that fits their address.

    Four kinds of expressions, one of which has no literal.
    """
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pattern = (
        F.when(key % 1000 == 3, F.concat(F.lit("["), key % 7, F.lit("-9]{2}[?]")))
        .when(key % 3 == 0, F.concat(F.lit("/"), cust, F.lit("[?]")))
        .when(key % 3 == 1, F.concat(F.lit("page="), cust % 10, F.lit("&.*"), cust))
        .otherwise(F.concat(F.lit(r"^http://[a-z]+\.example\.com/[a-z]{2}/"), cust, F.lit("$")))
    )
    rules = table(spark, sf_dir, "orders").select(key.alias("seq"), pattern.alias("pattern"), F.concat_ws(":", "o_orderpriority", "o_orderkey").alias("value"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = match_table(pages, "url", rules, "first", "first_rule")
    return match_table(out, "url", rules, "last", "last_rule").drop("url")


FIRST = r"""
WITH r AS (SELECT o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS c, CAST(o_custkey % 10 AS VARCHAR) AS d, o_orderpriority || ':' || o_orderkey AS value FROM orders),
p AS (SELECT page_id, url, regexp_extract(url, '^http://[a-z]+[.]example[.]com/[a-z][a-z]/([0-9]+)$', 1) AS tail FROM pages),
m AS (
  SELECT page_id, seq, value FROM p JOIN r ON seq % 1000 = 3 AND regexp_matches(url, '[' || (seq % 7) || '-9][' || (seq % 7) || '-9][?]')
  UNION ALL SELECT page_id, seq, value FROM p JOIN r ON seq % 1000 <> 3 AND seq % 3 = 0 AND contains(url, '/' || c || '?')
  UNION ALL SELECT page_id, seq, value FROM p JOIN r ON seq % 1000 <> 3 AND seq % 3 = 1 AND contains(url, 'page=' || d || '&')
      AND contains(substr(url, strpos(url, 'page=' || d || '&') + 7), c)
  UNION ALL SELECT page_id, seq, value FROM p JOIN r ON seq % 1000 <> 3 AND seq % 3 = 2 AND tail = c)
SELECT page_id, first_rule, last_rule FROM pages LEFT JOIN (SELECT page_id, arg_min(value, seq) AS first_rule, arg_max(value, seq) AS last_rule FROM m GROUP BY page_id) USING (page_id)"""


def rule_table_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer makes a rule for orders by status, priority and customer, some with an expression."""
    cust = F.col("c_custkey")
    status = F.element_at(F.array(*map(F.lit, ("any", "F", "O", "P"))), (cust % 4 + 1).cast("int"))
    priority = F.element_at(F.array(*map(F.lit, ("any", "1-URGENT", "5-LOW"))), (cust % 3 + 1).cast("int"))
    pattern = F.element_at(F.array(*map(F.lit, ("any", "URG|LOW", "^[1-3]-", "SPEC", "NOT.*FIED"))), (cust % 5 + 1).cast("int"))
    rules = table(spark, sf_dir, "customer").select(
        status.alias("o_orderstatus"), priority.alias("o_orderpriority"), F.when(cust % 7 == 0, "any").otherwise(cust.cast("string")).alias("o_custkey"),
        pattern.alias("pattern"), cust.alias("rule_id"), "c_mktsegment", "c_nationkey",
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    return specific_table(orders, rules, ["o_orderstatus", "o_orderpriority", "o_custkey"], ["c_mktsegment", "c_nationkey"], code="o_orderpriority")


SPECIFIC = """
WITH r AS (SELECT ['any', 'F', 'O', 'P'][c_custkey % 4 + 1] AS st, ['any', '1-URGENT', '5-LOW'][c_custkey % 3 + 1] AS pr,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS cu, c_custkey % 5 AS re, c_custkey AS rule_id, c_mktsegment, c_nationkey FROM customer),
o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey, [true, regexp_matches(o_orderpriority, 'URG|LOW'), regexp_matches(o_orderpriority, '^[1-3]-'),
    contains(o_orderpriority, 'SPEC'), regexp_matches(o_orderpriority, 'NOT.*FIED')] AS fits FROM orders),
m AS (SELECT o_orderkey, r.*, (st <> 'any')::INT + (pr <> 'any')::INT + (cu IS NOT NULL)::INT + (re > 0)::INT AS score FROM o JOIN r ON cu = o_custkey
    WHERE st IN ('any', o_orderstatus) AND pr IN ('any', o_orderpriority) AND fits[re + 1]
  UNION ALL SELECT o_orderkey, r.*, (st <> 'any')::INT + (pr <> 'any')::INT + (re > 0)::INT FROM o JOIN r ON cu IS NULL
    WHERE st IN ('any', o_orderstatus) AND pr IN ('any', o_orderpriority) AND fits[re + 1]),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, rule_id DESC) AS k FROM m)
SELECT o.o_orderkey, o_orderstatus, o_orderpriority, o_custkey, rule_id, c_mktsegment, c_nationkey FROM o LEFT JOIN k ON k.o_orderkey = o.o_orderkey AND k = 1"""

QUERIES: dict[str, Query] = {
    "rule_table_first": (rule_table_first, FIRST),
    "rule_table_specific": (rule_table_specific, SPECIFIC),
}
