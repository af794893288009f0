"""Queries over ensemble generation and consistency testing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import codes
from fieldloom.operators import consistency as C
from fieldloom.operators import eigen
from fieldloom.operators import ensemble as E
from fieldloom.operators.reduce import Cal
from fieldloom.operators.reduce import history_reduce as reduce_tape
from fieldloom.plans.catalog.adapters import (
    ALL_TYPES,
    EVENTS,
    MEANS,
    Query,
    events_history,
    sql_avg,
    supplier_means,
    table,
)
from fieldloom.session import materialize

NEW_RUNS = 3  # The consistency test compares three new runs with the ensemble.

# The perturbation of member number {i}, written out as SQL.
DIGITS = """CASE
    WHEN {i} <= 900  THEN 101 + 2 * (({i} - 1) // 100)        + 18 * ((({i} - 1) % 100) // 2)
    WHEN {i} <= 1000 THEN 100 + 2 * (({i} - 1) // 100)        + 18 * ((({i} - 1) % 100) // 2)
    WHEN {i} <= 1800 THEN 102 + 2 * (({i} - 1001) // 100)     + 18 * ((({i} - 1) % 100) // 2)
    WHEN {i} <= 1900 THEN 1 + 2 * ((({i} - 1) % 100) // 2)
    WHEN {i} <= 2000 THEN 2 + 2 * ((({i} - 1) % 100) // 2) END"""


def pertlim_sql(i: str) -> str:
    digits = DIGITS.format(i=i)
    return (
        f"CASE WHEN {i} = 0 THEN '0' ELSE CASE WHEN {i} % 2 = 0 THEN '-' ELSE '' END || '0.' || "
        f"CASE WHEN ({digits}) < 100 THEN lpad(CAST({digits} AS VARCHAR), 3, '0') ELSE CAST({digits} AS VARCHAR) END || 'd-13' END"
    )


def perturbation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order belongs to one of 2001 members; what it costs and the member's perturbation."""
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % (E.MAX_MEMBERS + 1)).cast("int").alias("member"), "o_totalprice"
    )
    return E.with_perturbation(
        orders.groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("hi"))
    )


PERTURBATION = f"""
WITH m AS (SELECT CAST(o_orderkey % 2001 AS INTEGER) AS member, count(*) AS n, max(o_totalprice) AS hi FROM orders GROUP BY 1),
p AS (SELECT *, {pertlim_sql("member")} AS pertlim FROM m)
SELECT *, CAST(replace(pertlim, 'd', 'e') AS DOUBLE) AS pertlim_num FROM p"""


def draw_without_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 of the customers in a reproducible random order."""
    return E.draw(table(spark, sf_dir, "customer").select("c_custkey"), 150, seed=7, id_col="c_custkey")


DRAW = "SELECT c_custkey FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':7'), c_custkey LIMIT 150"


def ensemble_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that delivered samples (suppliers of line items), from member 5 on.

    Those beyond the generator's limit keep their row, without a case.
    """
    delivered = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") * 3).cast("int").alias("member")).agg(
        F.count(F.lit(1)).alias("n_samples")
    )
    known = E.members(spark, "ens/run.0000", E.MAX_MEMBERS, start=5)
    return delivered.filter("member >= 5").join(known, "member", "left").select("member", "n_samples", "case", "pertlim", "pertlim_num")


MEMBERS = f"""
WITH m AS (SELECT CAST(l_suppkey * 3 AS INTEGER) AS member, count(*) AS n_samples FROM lineitem WHERE l_suppkey * 3 >= 5 GROUP BY 1),
p AS (SELECT member, n_samples, CASE WHEN member < 2000 THEN 'ens/run.' || lpad(CAST(member AS VARCHAR), 4, '0') END AS "case",
        CASE WHEN member < 2000 THEN {pertlim_sql("member")} END AS pertlim FROM m)
SELECT *, CAST(replace(pertlim, 'd', 'e') AS DOUBLE) AS pertlim_num FROM p"""


def member_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events replicated for twelve members; range and changed values per member and field."""
    base = events_history(spark, sf_dir).drop("member").withColumn("base", F.col("value"))
    copies = E.fanout(base, 12, "value", cell="step")
    return copies.groupBy("member", "field").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.count_if(F.col("value") != F.col("base")).alias("n_changed"),
    )


FANOUT = f"""
WITH {EVENTS}, m AS (SELECT CAST(i AS INTEGER) AS member, CAST(replace({pertlim_sql("i")}, 'd', 'e') AS DOUBLE) AS p
                     FROM generate_series(0, 11) AS g(i)),
copies AS (
  SELECT m.member, field, value AS base,
         CASE WHEN m.member = 0 THEN value ELSE value * (p * (((('0x' || substr(md5(CAST(step AS VARCHAR)), 1, 8))::BIGINT
           + m.member::BIGINT * 2654435769) % 4294967296)::DOUBLE / 4294967296.0 * 2.0 - 1.0) + 1.0) END AS value
  FROM h CROSS JOIN m)
SELECT member, field, count(*) AS n, min(value) AS lo, max(value) AS hi,
       count(*) FILTER (WHERE value <> base) AS n_changed FROM copies GROUP BY member, field"""


def member_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat("c_name", F.when(F.col("c_custkey") % 4 == 3, ".000").otherwise(".0000"))
    return table(spark, sf_dir, "customer").select("c_custkey", codes.member_key(named, F.col("c_custkey")).alias("key"))


MEMBER_KEY = """
SELECT c_custkey, CASE WHEN c_custkey % 4 <> 3 THEN c_name || '.' ||
  CASE WHEN c_custkey < 10000 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END END AS "key"
FROM customer"""


def setting_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("scope"),
        F.col("turn").alias("seq"),
        F.concat(F.col("role"), F.lit("_n = "), F.length("text").cast("string")).alias("line"),
    )
    return E.replace_setting(lines, "user", "9")


SETTING_REPLACE = """
SELECT conv_id AS scope, turn AS seq, role || '_n = ' || CAST(length(text) AS VARCHAR) AS line FROM conversations
WHERE role <> 'user'
UNION ALL
SELECT conv_id, max(turn) + 1, 'user = 9' FROM conversations GROUP BY conv_id"""


def ensemble_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as members; a run succeeded when one of their orders is finished."""
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member"))
    status = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("member"), (F.col("o_orderstatus") == "F").alias("success")
    )
    ok, missing = E.complete(members, status)
    return ok.withColumn("complete", F.lit(True)).unionByName(missing.withColumn("complete", F.lit(False)))


COMPLETE = """
SELECT c_custkey AS member, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS complete
FROM customer"""


def summary_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("member"), F.concat_ws("_", "l_returnflag", "l_linestatus", "l_linenumber").alias("field")
    )
    return C.precheck(history)


PRECHECK = """
SELECT count(DISTINCT l_suppkey) AS n_members, count(DISTINCT (l_returnflag, l_linestatus, l_linenumber)) AS n_fields,
       count(DISTINCT l_suppkey) > count(DISTINCT (l_returnflag, l_linestatus, l_linenumber)) AS ok FROM lineitem"""

member_global_mean = supplier_means
GLOBAL_MEAN = f"WITH {MEANS} SELECT * FROM gm"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def ensemble_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.ensemble_stats(supplier_means(spark, sf_dir)), "mean", "std")


STATS = f"""
WITH {MEANS}
SELECT field, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       min(value) = max(value) AS constant FROM gm GROUP BY field"""


def _settled_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means written once: what follows uses them several times."""
    return materialize(supplier_means(spark, sf_dir), "means")


def _z(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _settled_means(spark, sf_dir)
    return C.standardize(means, C.ensemble_stats(means)).select("member", "field", "z")


def ensemble_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_z(spark, sf_dir), "z")


Z = f"""{MEANS}, z AS (
  SELECT member, field, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM gm
  WINDOW w AS (PARTITION BY field))"""
STANDARDIZE = f"WITH {Z} SELECT member, field, round(z, 6) AS z FROM z"


def ensemble_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.covariance(_z(spark, sf_dir)), "cov")


COVARIANCE = f"""
WITH {Z}
SELECT a.field AS f1, b.field AS f2, round(covar_samp(a.z, b.z), 6) AS cov
FROM z a JOIN z b USING (member) GROUP BY 1, 2"""


def ensemble_pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every supplier on the three leading components."""
    z = _z(spark, sf_dir)
    return _rounded(C.pca_scores(z, C.pca_fit(z, 3)), "score")


def ensemble_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of the suppliers by orthogonal iteration: what they explain, and how exact they are."""
    x = eigen.centred(_z(spark, sf_dir))
    found = materialize(eigen.components(x, 12), "components")
    row = eigen.checks(x, found)
    rounded = [F.round(c, 6).alias(c) for c in ("total", "explained", "squares")]
    exact = [(F.col(c) < 1e-6).alias(c.replace("worst", "small")) for c in ("worst_residual", "worst_product")]
    return row.select("n_fields", "n_components", *rounded, *exact)


COMPONENTS = f"""
WITH {Z}, w AS (SELECT member FROM z GROUP BY member HAVING count(z) = (SELECT count(DISTINCT field) FROM z)),
u AS (SELECT z.* FROM z JOIN w USING (member)),
c AS (SELECT a.field AS f1, b.field AS f2, covar_samp(a.z, b.z) AS cov FROM u a JOIN u b USING (member) GROUP BY 1, 2)
SELECT count(*) FILTER (f1 = f2) AS n_fields, count(*) FILTER (f1 = f2) AS n_components, round(sum(cov) FILTER (f1 = f2), 6) AS total,
       round(sum(cov) FILTER (f1 = f2), 6) AS explained, round(sum(cov * cov), 6) AS squares, true AS small_residual, true AS small_product FROM c"""


def _new_and_trusted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    new = F.col("member") < NEW_RUNS
    return df.filter(new), df.filter(~new)


def _with_gaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fields beside the measured ones that the ensemble has, and of the new runs the first alone."""
    new, trusted = _new_and_trusted(_settled_means(spark, sf_dir))
    lone = F.concat("field", F.lit("_lone")).alias("field")
    more = [df.filter(F.col("field").endswith("_N")).select("member", lone, "value") for df in (new.filter("member = 0"), trusted)]
    return new.unionByName(more[0]), trusted.unionByName(more[1])


def ect_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three suppliers as new runs against all others, per field; some fields have too few new runs."""
    new, trusted = _with_gaps(spark, sf_dir)
    return C.ect_features(new, C.limits_from(trusted, "field", "value"), "field", "value", m=0.5)


FEATURES = f"""{MEANS}, fm AS (SELECT member, field, value FROM gm UNION ALL SELECT member, field || '_lone', value FROM gm WHERE suffix(field, '_N') AND (member = 0 OR member >= 3)),
lim AS (SELECT field, avg(value) AS mean, stddev_samp(value) AS std FROM fm WHERE member >= 3 GROUP BY field),
features AS (
  SELECT field, CAST(sum(CASE WHEN abs(value - mean) > std * 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fail_runs,
         count(value) AS n_runs, count(std) > 0 AND count(value) >= 2 AS judged
  FROM lim FULL JOIN (SELECT * FROM fm WHERE member < 3) USING (field) GROUP BY field)"""


def ect_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, trusted = _with_gaps(spark, sf_dir)
    return C.ect_verdict(new, C.limits_from(trusted, "field", "value"), "field", "value", m=0.5, p=8, r=2)


VERDICT = f"""
WITH {FEATURES}
SELECT count(*) AS n_features, count(*) FILTER (WHERE fail_runs >= 2) AS n_failing,
       count(*) FILTER (WHERE NOT judged) AS n_unjudged,
       CASE WHEN count(*) FILTER (WHERE fail_runs >= 2) >= 8 THEN 'FAIL'
            WHEN bool_and(judged) THEN 'PASS' ELSE 'INCOMPLETE' END AS verdict FROM features"""


def pointwise_zscore_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly means per user: member 3 against members 0 to 2."""
    monthly = reduce_tape(events_history(spark, sf_dir), dict.fromkeys(ALL_TYPES, "A"), Cal("m"), digits=2)
    points = monthly.select("field", "member", "cell", "win", "value")
    return C.zpf(points.filter("member < 3"), points.filter("member = 3"), tol=1.0, threshold=0.6)


ZPF = f"""
WITH {EVENTS}, p AS (SELECT field, member, cell, date_trunc('month', ts) AS win, {sql_avg("value")} AS v FROM h GROUP BY 1, 2, 3, 4),
s AS (SELECT field, cell, win, avg(v) AS mean, stddev_samp(v) AS std FROM p WHERE member < 3 GROUP BY 1, 2, 3),
t AS (SELECT field, mean, CASE WHEN std > 0 THEN abs(v - mean) <= std ELSE abs(v - mean) = 0 END AS good
      FROM p LEFT JOIN s USING (field, cell, win) WHERE member = 3)
SELECT field, count(*) AS points, count(*) FILTER (WHERE good) AS passing, count(*) FILTER (WHERE mean IS NULL) AS unknown,
       count(*) FILTER (WHERE good)::DOUBLE / count(*) AS fraction,
       count(*) FILTER (WHERE good)::DOUBLE / count(*) >= 0.6 AS passes FROM t GROUP BY field"""


def config_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs whose set-up must equal their customer's; some name a customer that there isn't."""
    segments = F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    key = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(
        F.when(key % 97 == 0, -key).otherwise(F.col("o_custkey")).alias("ensemble"),
        key.alias("run"),
        F.element_at(segments, (key % 5 + 1).cast("int")).alias("compset"),
        (key % 25).cast("int").alias("grid"),
    )
    summary = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ensemble"), F.col("c_mktsegment").alias("compset"), F.col("c_nationkey").alias("grid")
    )
    return C.compat(runs, summary)


COMPAT = """
WITH r AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN -o_orderkey ELSE o_custkey END AS ensemble, o_orderkey AS run,
  ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][o_orderkey % 5 + 1] AS compset,
  CAST(o_orderkey % 25 AS INTEGER) AS grid FROM orders)
SELECT r.*, CASE WHEN c_custkey IS NULL THEN 'ensemble' WHEN compset <> c_mktsegment AND grid <> c_nationkey THEN 'compset,grid'
            WHEN compset <> c_mktsegment THEN 'compset' ELSE 'grid' END AS mismatch
FROM r LEFT JOIN customer ON c_custkey = ensemble WHERE c_custkey IS NULL OR compset <> c_mktsegment OR grid <> c_nationkey"""

STOP_OPTION = "CASE o_orderstatus WHEN 'F' THEN 'nmonths' WHEN 'O' THEN 'nyears' ELSE 'nsteps' END"
TESTTYPE = "CASE o_orderstatus WHEN 'F' THEN 'ECT' WHEN 'O' THEN 'POP-ECT' ELSE 'UF-ECT' END"


def stamp_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as samples of the run given by their order; totals per stamped attribute."""
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case"),
        F.col("o_orderpriority").alias("compset"),
        codes.classify_testtype(F.expr(STOP_OPTION)).alias("testtype"),
    )
    samples = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case"), "l_quantity")
    return C.stamp(samples, runs).groupBy("compset", "testtype").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )


STAMP = f"""
SELECT o_orderpriority AS compset, {TESTTYPE} AS testtype, count(*) AS n, sum(l_quantity) AS quantity
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL"""


def classify_testtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(STOP_OPTION).alias("stop_option"))
    return rows.withColumn("testtype", codes.classify_testtype(F.col("stop_option")))


CLASSIFY = f"SELECT o_orderkey, {STOP_OPTION} AS stop_option, {TESTTYPE} AS testtype FROM orders"


def default_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as run requests with gaps."""
    key = F.col("c_custkey")
    ect = F.when(F.col("c_nationkey") % 2 == 0, "pop").otherwise("cam")
    return table(spark, sf_dir, "customer").select(
        key,
        codes.default_compset(F.when(key % 3 == 0, "NONE").otherwise(F.col("c_mktsegment")), ect).alias("compset"),
        codes.default_res(F.when(key % 4 != 0, F.concat(F.lit("r"), key % 9)), ect).alias("res"),
        codes.default_walltime(F.when(key % 5 == 0, "01:15").otherwise("00:00"), ect, F.col("c_acctbal") < 0).alias("walltime"),
    )


DEFAULT_FILL = """
SELECT c_custkey,
  CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment WHEN c_nationkey % 2 = 0 THEN 'G' ELSE 'F2000climo' END AS compset,
  CASE WHEN c_custkey % 4 <> 0 THEN 'r' || (c_custkey % 9) WHEN c_nationkey % 2 = 0 THEN 'T62_g17' ELSE 'f19_f19' END AS res,
  CASE WHEN c_custkey % 5 = 0 THEN '01:15' WHEN c_acctbal < 0 THEN '00:10' WHEN c_nationkey % 2 = 0 THEN '02:00' ELSE '04:30' END AS walltime
FROM customer"""

QUERIES: dict[str, Query] = {
    "perturbation_table": (perturbation_table, PERTURBATION),
    "draw_without_replacement": (draw_without_replacement, DRAW),
    "ensemble_members": (ensemble_members, MEMBERS),
    "member_fanout": (member_fanout, FANOUT),
    "member_key": (member_key, MEMBER_KEY),
    "setting_replace": (setting_replace, SETTING_REPLACE),
    "ensemble_complete": (ensemble_complete, COMPLETE),
    "summary_precheck": (summary_precheck, PRECHECK),
    "member_global_mean": (member_global_mean, GLOBAL_MEAN),
    "ensemble_stats": (ensemble_stats, STATS),
    "ensemble_standardize": (ensemble_standardize, STANDARDIZE),
    "ensemble_covariance": (ensemble_covariance, COVARIANCE),
    "ensemble_pca_scores": (ensemble_pca_scores, None),
    "ensemble_components": (ensemble_components, COMPONENTS),
    "ect_features": (ect_features, f"WITH {FEATURES} SELECT *, fail_runs >= 2 AS fails FROM features"),
    "ect_verdict": (ect_verdict, VERDICT),
    "pointwise_zscore_pass": (pointwise_zscore_pass, ZPF),
    "config_compat": (config_compat, COMPAT),
    "stamp_metadata": (stamp_metadata, STAMP),
    "classify_testtype": (classify_testtype, CLASSIFY),
    "default_fill": (default_fill, DEFAULT_FILL),
}
