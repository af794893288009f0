"""Queries over run comparison and release bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import compare as K
from fieldloom.operators.digests import differing_rows
from fieldloom.plans.catalog.adapters import Query, table


def _two_runs(spark: SparkSession, sf_dir: str, field) -> tuple[DataFrame, DataFrame]:
    """Orders as one run, and a second run with tiny, large, null and missing values; some keys repeat, on one side or both."""
    key = F.col("o_orderkey")
    first = table(spark, sf_dir, "orders").select(field.alias("field"), key.alias("cell"), F.col("o_totalprice").alias("value"))
    cell, value = F.col("cell"), F.col("value")
    changed = F.when(cell % 11 == 0, value + 1.0).when(cell % 7 == 0, value * (1.0 + 1e-13)).when(cell % 17 != 0, value)
    second = first.filter(cell % 13 != 0).withColumn("value", changed)
    again = first.filter(cell % 19 == 0).withColumn("value", value / 2)
    once_more = again.filter(cell % 38 == 0).unionByName(again.filter(cell % 57 == 0).withColumn("value", F.lit(0.5)))
    return first.unionByName(again), second.unionByName(once_more)


TWO_RUNS = """a AS (SELECT {field} AS field, o_orderkey AS cell, o_totalprice AS v FROM orders),
b AS (SELECT field, cell, CASE WHEN cell % 11 = 0 THEN v + 1.0 WHEN cell % 7 = 0 THEN v * (1.0::DOUBLE + 1e-13) WHEN cell % 17 <> 0 THEN v END AS v
      FROM a WHERE cell % 13 <> 0),
s AS (SELECT 0 AS side, field, cell, v FROM a UNION ALL SELECT 0, field, cell, v / 2 FROM a WHERE cell % 19 = 0
      UNION ALL SELECT 1, field, cell, v FROM b UNION ALL SELECT 1, field, cell, v / 2 FROM a WHERE cell % 38 = 0
      UNION ALL SELECT 1, field, cell, 0.5 FROM a WHERE cell % 57 = 0),
k AS (SELECT field, cell, count(*) FILTER (WHERE side = 0) AS nl, count(*) FILTER (WHERE side = 1) AS nr,
        max(v) FILTER (WHERE side = 0) AS l, max(v) FILTER (WHERE side = 1) AS r,
        coalesce(list_sort(list(v) FILTER (WHERE side = 0)), []) = coalesce(list_sort(list(v) FILTER (WHERE side = 1)), []) AS same FROM s GROUP BY 1, 2),
e AS (SELECT *, CASE WHEN nl = 1 AND nr = 1 THEN r - l END AS d FROM k),
d AS (SELECT field, count(*) FILTER (WHERE nr = 0) AS only_left, count(*) FILTER (WHERE nl = 0) AS only_right,
        count(*) FILTER (WHERE nl > 0 AND nr > 0 AND same) AS equal, count(*) FILTER (WHERE nl > 0 AND nr > 0 AND NOT same) AS different,
        count(*) FILTER (WHERE nl > 0 AND nr > 0 AND NOT same AND d IS NULL) AS unmeasured,
        count(*) FILTER (WHERE nl > 1 OR nr > 1) AS repeated_keys, max(abs(d)) AS max_abs,
        sqrt(sum(d * d) / count(d)) AS rms, sqrt(avg(CASE WHEN d IS NOT NULL THEN l * l END)) AS rms_left
      FROM e GROUP BY field)"""

PRIORITY = "o_orderpriority"
CLASS = "'F' || (o_orderkey % 1001)"


def dataset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_runs(spark, sf_dir, F.col("o_orderpriority"))
    diff = K.dataset_diff(a, b, ["field", "cell"], "value")
    return diff.withColumn("rms", F.round("rms", 6)).withColumn("rms_left", F.round("rms_left", 3))


DATASET_DIFF = f"""
WITH {TWO_RUNS.format(field=PRIORITY)}
SELECT * REPLACE (round(rms, 6) AS rms, round(rms_left, 3) AS rms_left) FROM d"""


def digest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which priorities differ between two runs that have two in common, and how many of their keys."""
    a, b = _two_runs(spark, sf_dir, F.col("o_orderpriority"))
    common = F.col("field").isin("4-NOT SPECIFIED", "5-LOW")
    fields, rows = differing_rows(a, b.filter(~common).unionByName(a.filter(common)), ["field", "cell"], "value")
    counts = rows.groupBy("field").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("only_left", "only_right", "different")))
    shown = [F.coalesce(s, F.lit(0)).alias(s) for s in ("only_left", "only_right", "different")]
    return fields.join(counts, "field", "left").select("field", (F.col("n_differing") == 0).alias("same"), "n_left", "n_right", *shown)


DIGEST_DIFF = f"""
WITH {TWO_RUNS.format(field=PRIORITY)}
SELECT field, field IN ('4-NOT SPECIFIED', '5-LOW') AS same, CAST(sum(nl) AS BIGINT) AS n_left, CAST(sum(CASE WHEN field IN ('4-NOT SPECIFIED', '5-LOW') THEN nl ELSE nr END) AS BIGINT) AS n_right,
       count(*) FILTER (WHERE nr = 0 AND field NOT IN ('4-NOT SPECIFIED', '5-LOW')) AS only_left, count(*) FILTER (WHERE nl = 0 AND field NOT IN ('4-NOT SPECIFIED', '5-LOW')) AS only_right,
       count(*) FILTER (WHERE nl > 0 AND nr > 0 AND NOT same AND field NOT IN ('4-NOT SPECIFIED', '5-LOW')) AS different FROM k GROUP BY field"""


def change_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_runs(spark, sf_dir, F.concat(F.lit("F"), F.col("o_orderkey") % 1001))
    diff = K.dataset_diff(a, b, ["field", "cell"], "value")
    return K.change_class(diff).select("field", "change")


CHANGE_CLASS = f"""
WITH {TWO_RUNS.format(field=CLASS)}
SELECT field, CASE WHEN only_left + only_right + different = 0 THEN 'bit-for-bit'
                   WHEN only_left + only_right + unmeasured = 0 AND rms <= rms_left * 1e-12 THEN 'roundoff'
                   ELSE 'larger than roundoff' END AS change FROM d"""


def expected_fail_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as test results, rich customers as the list of expected failures; counted per outcome."""
    results = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("T"), F.col("o_custkey") % 50).alias("test"),
        F.col("o_orderstatus").alias("phase"),
        F.when(F.col("o_totalprice") > 250000, "FAIL").otherwise("PASS").alias("status"),
    )
    expected = table(spark, sf_dir, "customer").filter("c_acctbal > 8000").select(
        F.concat(F.lit("T"), F.col("c_custkey") % 60).alias("test"),
        F.substring(F.lit("FOP"), (F.col("c_nationkey") % 3 + 1), F.lit(1)).alias("phase"),
        F.lit("FAIL").alias("status"),
    )
    return K.reconcile(results, expected).groupBy("outcome", "test", "phase").agg(F.count(F.lit(1)).alias("n"))


RECONCILE = """
WITH r AS (SELECT 'T' || (o_custkey % 50) AS test, o_orderstatus AS phase,
             CASE WHEN o_totalprice > 250000 THEN 'FAIL' ELSE 'PASS' END AS status FROM orders),
x AS (SELECT DISTINCT 'T' || (c_custkey % 60) AS test, substr('FOP', c_nationkey % 3 + 1, 1) AS phase, 'FAIL' AS expected
      FROM customer WHERE c_acctbal > 8000)
SELECT CASE WHEN status IS NULL THEN 'stale' WHEN status = 'PASS' AND expected IS NULL THEN 'PASS'
            WHEN status = 'PASS' THEN 'unexpected pass' WHEN expected IS NULL THEN 'unexpected fail' ELSE 'expected fail' END AS outcome,
       test, phase, count(*) AS n FROM r FULL JOIN x USING (test, phase) GROUP BY 1, 2, 3"""

TAG = "concat('v', date_format(o_orderdate, 'yyyy_MM'))"


def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, day = F.col("o_totalprice"), F.dayofmonth("o_orderdate")
    status = F.when(price > 499000, "FAIL2").when(price > 480000, "FAIL1").when(price < 2500, "FAIL").otherwise("PASS")
    results = table(spark, sf_dir, "orders").select(
        F.expr(TAG).alias("tag"), F.when(day <= 15, "regression").otherwise("restart").alias("suite"), status.alias("status")
    )
    return K.gate(results)


GATE = """
WITH r AS (SELECT 'v' || strftime(o_orderdate, '%Y_%m') AS tag, CASE WHEN day(o_orderdate) <= 15 THEN 'regression' ELSE 'restart' END AS suite,
  CASE WHEN o_totalprice > 499000 THEN 'FAIL2' WHEN o_totalprice > 480000 THEN 'FAIL1' WHEN o_totalprice < 2500 THEN 'FAIL' ELSE 'PASS' END AS status
  FROM orders),
b AS (SELECT *, (suite = 'regression' AND status = 'FAIL2') OR (suite = 'restart' AND status <> 'PASS') AS blocked FROM r)
SELECT tag, count(*) AS n_results, count(*) FILTER (WHERE blocked) AS n_blocking,
       count(*) FILTER (WHERE suite = 'regression' AND status = 'FAIL1') AS n_answer_changes,
       NOT bool_or(blocked) AS allowed FROM b GROUP BY tag"""


def release_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months as tags, whose numbers jump from year to year, and customer groups as components: some are not part of every
    tag, and some have several versions at one."""
    date = F.col("o_orderdate")
    tags = table(spark, sf_dir, "orders").groupBy(
        (F.year(date) * 100 + F.month(date)).alias("tag_seq"),
        F.concat_ws("_", "o_orderpriority", F.col("o_custkey") % 50).alias("component"),
    ).agg(F.max("o_orderstatus").alias("version"), F.min("o_orderstatus").alias("other"))
    both = tags.select("tag_seq", "component", F.explode(F.array(F.nullif("version", F.lit("F")), F.when(F.col("tag_seq") % 5 == 0, F.nullif("other", F.lit("F"))))).alias("version"))
    return K.release_delta(both)


DELTA = """
WITH g AS (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS tag_seq, o_orderpriority || '_' || (o_custkey % 50) AS component,
             nullif(max(o_orderstatus), 'F') AS a, nullif(min(o_orderstatus), 'F') AS b FROM orders GROUP BY 1, 2),
t AS (SELECT tag_seq, component, CASE WHEN tag_seq % 5 <> 0 OR b IS NULL OR a = b THEN a WHEN a IS NULL THEN b ELSE least(a, b) || ',' || greatest(a, b) END AS version FROM g),
o AS (SELECT tag_seq, lead(tag_seq) OVER (ORDER BY tag_seq) AS later FROM (SELECT DISTINCT tag_seq FROM t)),
p AS (SELECT later AS tag_seq, component, version FROM t JOIN o USING (tag_seq) WHERE later IS NOT NULL),
j AS (SELECT coalesce(n.tag_seq, p.tag_seq) AS tag_seq, coalesce(n.component, p.component) AS component, n.component IS NOT NULL AS here, p.component IS NOT NULL AS there,
        n.version AS version, p.version AS previous
      FROM t n FULL JOIN p ON n.component = p.component AND n.tag_seq = p.tag_seq)
SELECT component, tag_seq, version, previous,
       CASE WHEN NOT there THEN 'added' WHEN NOT here THEN 'removed' ELSE 'changed' END AS change
FROM j WHERE NOT here OR NOT there OR version IS DISTINCT FROM previous"""


def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tags: plain X.Y.Z, staged and release ones, some of no known shape; latest per line within each part type."""
    key = F.col("p_partkey")
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1)
    staged = F.concat(
        F.lit("core"), F.col("p_size") % 4, F.lit("_"), F.col("p_size") % 3, F.lit("_"),
        F.when(key % 3 == 0, "alpha").otherwise("beta"), F.lpad(brand, 2, "0"),
    )
    plain = F.concat_ws(".", F.col("p_size") % 4, F.col("p_size") % 3, brand)
    odd = F.concat(F.lit("draft-"), "p_brand")
    shaped = F.when(key % 10 == 0, F.concat(F.lit("release-"), plain)).when(key % 2 == 0, plain).otherwise(staged)
    tags = table(spark, sf_dir, "part").select("p_type", F.when(key % 7 == 0, odd).otherwise(shaped).alias("tag"))
    return K.latest_per_line(tags, by=["p_type"])


VERSION_ORDER = r"""
WITH p AS (SELECT p_type, p_brand, p_partkey % 7 = 0 AS odd, p_partkey % 2 = 0 AS plain, CASE WHEN p_partkey % 10 = 0 THEN 'release-' ELSE '' END AS kind,
             CAST(p_size % 4 AS BIGINT) AS major, CAST(p_size % 3 AS BIGINT) AS minor,
             regexp_extract(p_brand, '(\d+)$', 1) AS b, p_partkey % 3 = 0 AS early FROM part),
t AS (SELECT p_type, odd, p_brand, CASE WHEN plain THEN kind ELSE 'core' END AS line, major, minor,
        CASE WHEN plain THEN kind || major || '.' || minor || '.' || b
             ELSE 'core' || major || '_' || minor || '_' || CASE WHEN early THEN 'alpha' ELSE 'beta' END || lpad(b, 2, '0') END AS tag,
        CASE WHEN plain THEN CAST(b AS INTEGER) ELSE (CASE WHEN early THEN 0 ELSE 1000 END) + CAST(b AS INTEGER) END AS k FROM p)
SELECT p_type, line, major, minor, arg_max(tag, k) AS latest, count(DISTINCT tag) AS n_tags, NULL::VARCHAR AS reject FROM t WHERE NOT odd GROUP BY 1, 2, 3, 4
UNION ALL SELECT DISTINCT p_type, NULL, NULL, NULL, 'draft-' || p_brand, 1, 'unknown shape' FROM t WHERE odd"""

QUERIES: dict[str, Query] = {
    "dataset_diff": (dataset_diff, DATASET_DIFF),
    "digest_diff": (digest_diff, DIGEST_DIFF),
    "change_class": (change_class, CHANGE_CLASS),
    "expected_fail_reconcile": (expected_fail_reconcile, RECONCILE),
    "release_gate": (release_gate, GATE),
    "release_delta": (release_delta, DELTA),
    "version_order": (version_order, VERSION_ORDER),
}
