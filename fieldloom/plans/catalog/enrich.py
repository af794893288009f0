"""Queries over rules, registries, settings and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import codes
from fieldloom.operators import audits, cycles, rules, settings
from fieldloom.plans.catalog.adapters import Query, table


def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers refer to nations by alias or by another name; the registry lists every alias twice."""
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("alias"), F.concat_ws("_REGION_", "n_name", "n_regionkey").alias("lname")
    )
    code = F.concat(F.when(F.col("c_custkey") % 3 == 0, "LAND_").otherwise("NATION_"), F.col("c_nationkey"))
    people = table(spark, sf_dir, "customer").select("c_custkey", code.alias("code"))
    return rules.resolve(people, "code", nation.unionAll(nation))


ALIAS = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'LAND_' ELSE 'NATION_' END || c_nationkey AS code,
       CASE WHEN c_custkey % 3 = 0 THEN 'LAND_' || c_nationkey ELSE n_name || '_REGION_' || n_regionkey END AS lname
FROM customer JOIN nation ON n_nationkey = c_nationkey"""


def code_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(
        F.col("p_size"), F.lit("_"), F.col("p_type"), F.lit("%"), F.replace(F.col("p_name"), F.lit(" "), F.lit("%")),
        F.lit("_"), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("_BGC%"), F.col("p_partkey") % 5)).otherwise(""),
    )
    parsed = table(spark, sf_dir, "part").select("p_partkey", codes.parse_code(code, ["atm", "lnd"]).alias("c"))
    comp = F.col("c.comps")
    return parsed.select(
        "p_partkey",
        F.col("c.time").alias("time"),
        F.try_element_at(comp, F.lit(1))["model"].alias("atm_model"),
        F.array_join(F.try_element_at(comp, F.lit(1))["phys"], "|").alias("atm_phys"),
        F.try_element_at(comp, F.lit(2))["model"].alias("lnd_model"),
        F.size(F.try_element_at(comp, F.lit(2))["phys"]).alias("lnd_n_phys"),
        F.try_element_at(F.col("c.tail"), F.lit(1))["model"].alias("tail_model"),
        F.array_join(F.try_element_at(F.col("c.tail"), F.lit(1))["phys"], "|").alias("tail_phys"),
    )


CODE_PARSE = """
SELECT p_partkey, CAST(p_size AS VARCHAR) AS time, p_type AS atm_model, replace(p_name, ' ', '|') AS atm_phys,
       p_brand AS lnd_model, CAST(0 AS INTEGER) AS lnd_n_phys,
       CASE WHEN p_partkey % 2 = 0 THEN 'BGC' END AS tail_model,
       CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 5 AS VARCHAR) END AS tail_phys FROM part"""

URL_RULES = [("^http://", "plain"), ("/en/", "english"), ("[?]", "query"), ("[.]example[.]net", "net")]


def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = rules.rule_match(pages, "url", URL_RULES, "first", "first_rule")
    return rules.rule_match(out, "url", URL_RULES, "last", "last_rule").drop("url")


def _case(order) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{v}'" for p, v in order) + " END"


FIRST_MATCH = f"SELECT page_id, {_case(URL_RULES)} AS first_rule, {_case(URL_RULES[::-1])} AS last_rule FROM pages"

LAYOUTS = [
    rules.WildcardRule({"o_orderstatus": "any", "o_orderpriority": "any"}, "any", {"ntasks": -3, "label": "default"}),
    rules.WildcardRule({"o_orderstatus": "F", "o_orderpriority": "any"}, "any", {"ntasks": 104, "label": "finished"}),
    rules.WildcardRule({"o_orderstatus": "any", "o_orderpriority": "5-LOW"}, "any", {"ntasks": 8, "label": "low"}),
    rules.WildcardRule({"o_orderstatus": "any", "o_orderpriority": "any"}, "URG|HIGH", {"ntasks": 640}),
    rules.WildcardRule({"o_orderstatus": "O", "o_orderpriority": "any"}, "^[1-3]-", {"ntasks": 5400, "label": "open"}),
    rules.WildcardRule({"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}, "any", {"ntasks": 6400, "label": "open urgent"}),
]


def rule_most_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return rules.specific_match(orders, LAYOUTS, code="o_orderpriority")


MOST_SPECIFIC = """
WITH r(rule_id, st, pr, re, ntasks, label) AS (VALUES
  (0, 'any', 'any', 'any', -3, 'default'), (1, 'F', 'any', 'any', 104, 'finished'), (2, 'any', '5-LOW', 'any', 8, 'low'),
  (3, 'any', 'any', 'URG|HIGH', 640, NULL), (4, 'O', 'any', '^[1-3]-', 5400, 'open'), (5, 'O', '1-URGENT', 'any', 6400, 'open urgent')),
m AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, r.*,
        row_number() OVER (PARTITION BY o_orderkey ORDER BY (st <> 'any')::INT + (pr <> 'any')::INT + (re <> 'any')::INT DESC, rule_id DESC) AS k
      FROM orders JOIN r ON st IN ('any', o_orderstatus) AND pr IN ('any', o_orderpriority) AND (re = 'any' OR regexp_matches(o_orderpriority, re)))
SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(rule_id AS INTEGER) AS rule_id, CAST(ntasks AS INTEGER) AS ntasks, label FROM m WHERE k = 1"""


def rule_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with two attributes; large parts get text appended, small ones a new brand, some a new attribute."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size")
    base = part.unpivot(["id"], ["p_brand", "p_type"], "attr", "value")
    size = F.col("p_size")

    def change(attr: str, value: str, append: bool):
        return F.struct(F.lit(attr).alias("attr"), F.lit(value).alias("value"), F.lit(append).alias("append"))

    changes = F.array_compact(
        F.array(
            F.when(size > 40, change("p_type", "-pcols 9", True)),
            F.when(size < 5, change("p_brand", "Brand#0", False)),
            F.when(size == 7, change("p_note", "new", True)),
        )
    )
    return rules.apply_overrides(base, part.select("id", F.inline(changes)))


OVERRIDE = """
SELECT p_partkey AS id, 'p_brand' AS attr, CASE WHEN p_size < 5 THEN 'Brand#0' ELSE p_brand END AS value, p_size < 5 AS overridden FROM part
UNION ALL
SELECT p_partkey, 'p_type', CASE WHEN p_size > 40 THEN p_type || ' -pcols 9' ELSE p_type END, p_size > 40 FROM part
UNION ALL
SELECT p_partkey, 'p_note', 'new', TRUE FROM part WHERE p_size = 7"""


def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assignments: users are scopes, days are layers."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("scope"), F.dayofmonth("ts").alias("layer"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("key"), F.col("props").alias("value"),
    )
    return settings.merge_settings(rows)


MERGE = """
SELECT scope, "key", value, n AS n_assignments FROM (
  SELECT user_id AS scope, event_type AS "key", props AS value, count(*) OVER (PARTITION BY user_id, event_type) AS n,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY day(ts) DESC, event_id DESC) AS k FROM events)
WHERE k = 1"""


def settings_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as values appended per conversation and role; a long turn starts the list anew."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("scope"), F.lit(0).alias("layer"), F.col("turn").alias("seq"), F.col("role").alias("key"),
        F.col("text").alias("value"), F.when(F.length("text") > 300, "set").otherwise("append").alias("op"),
    )
    return settings.append_settings(rows)


APPEND = """
WITH c AS (SELECT *, length(text) > 300 AS is_set FROM conversations),
live AS (SELECT *, max(CASE WHEN is_set THEN turn END) OVER (PARTITION BY conv_id, role) AS reset FROM c)
SELECT conv_id AS scope, role AS "key", count(text) AS n_values, string_agg(text, ' ' ORDER BY turn) AS value
FROM live WHERE reset IS NULL OR turn >= reset GROUP BY conv_id, role"""


def include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part includes the part of half its number; part 0 includes itself, and some parts also one that there isn't."""
    part = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    edges = parts.select(part.alias("src"), F.floor(part / 2).cast("bigint").alias("dst"))
    lost = parts.filter(part % 50 == 7).select(part.alias("src"), (-part).alias("dst"))
    return settings.include_report(edges.unionByName(lost), parts.select(part.alias("node")))


CLOSURE = """
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part UNION ALL SELECT p_partkey, -p_partkey FROM part WHERE p_partkey % 50 = 7),
walk(root, node, depth) AS (
  SELECT src, dst, 1 FROM e
  UNION ALL
  SELECT root, dst, depth + 1 FROM walk JOIN e ON src = node WHERE node <> 0)
SELECT root, node, CAST(min(depth) AS INTEGER) AS depth, root = node AS is_cycle, node < 0 AS is_leaf, node < 0 AS missing FROM walk GROUP BY root, node"""


def include_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that include each other by tens, and the tens below; every eighth ten includes no other, part 0 also itself."""
    part = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    around = parts.select(part.alias("src"), F.when(part % 10 == 9, part - 9).otherwise(part + 1).alias("dst"))
    down = parts.select(part.alias("src"), F.when((part % 10 == 3) & (F.floor(part / 10) % 8 > 0), part - 10).when(part == 0, part).alias("dst"))
    members, between = cycles.condensed(around.unionByName(down).filter("dst IS NOT NULL"))
    below = between.groupBy(F.col("root").alias("component")).agg(F.count(F.lit(1)).alias("n_below"))
    return members.join(below, "component", "left").select("node", "component", "n_members", "is_cycle", F.coalesce("n_below", F.lit(0)).alias("n_below"))


CYCLES = """
WITH RECURSIVE e AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 9 ELSE p_partkey + 1 END AS dst FROM part
  UNION SELECT p_partkey, p_partkey - 10 FROM part WHERE p_partkey % 10 = 3 AND (p_partkey // 10) % 8 > 0 UNION SELECT 0, 0),
walk(root, node) AS (SELECT src, dst FROM e UNION SELECT root, dst FROM walk JOIN e ON src = node),
own AS (SELECT a.root AS node, a.node AS other FROM walk a JOIN walk b ON a.root = b.node AND a.node = b.root),
every AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
c AS (SELECT v.node, least(v.node, coalesce(min(other), v.node)) AS component, CASE WHEN count(other) = 0 THEN 1 ELSE count(other) END AS n_members, count(other) > 0 AS is_cycle
  FROM every v LEFT JOIN own USING (node) GROUP BY v.node),
r AS (SELECT x.component, count(DISTINCT y.component) AS n_below FROM walk JOIN c x ON x.node = walk.root JOIN c y ON y.node = walk.node WHERE x.component <> y.component GROUP BY x.component)
SELECT node, component, CAST(n_members AS BIGINT) AS n_members, is_cycle, coalesce(n_below, 0) AS n_below FROM c LEFT JOIN r USING (component)"""


def settings_of_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part's settings come to with those it includes: set and appended, the deepest first."""
    part = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    reach = settings.closure(parts.select(part.alias("src"), F.floor(part / 2).cast("bigint").alias("dst")))
    rows = parts.select(
        part.alias("scope"), F.lit(1).alias("seq"), F.concat(F.lit("k"), F.col("p_size") % 3).alias("key"), F.col("p_brand").alias("value"),
        F.when(part % 4 == 0, "set").otherwise("append").alias("op"),
    )
    return settings.append_settings(settings.layered_settings(reach, rows))


OF_INCLUDES = """
WITH RECURSIVE walk(root, node, depth) AS (
  SELECT p_partkey, p_partkey, 0 FROM part
  UNION ALL
  SELECT root, node // 2, depth + 1 FROM walk WHERE node <> 0),
s AS (SELECT root AS scope, -depth AS layer, 'k' || (p_size % 3) AS "key", p_brand AS value, p_partkey % 4 = 0 AS is_set
      FROM walk JOIN part ON p_partkey = node),
live AS (SELECT *, max(CASE WHEN is_set THEN layer END) OVER (PARTITION BY scope, "key") AS reset FROM s)
SELECT scope, "key", count(value) AS n_values, string_agg(value, ' ' ORDER BY layer) AS value FROM live WHERE reset IS NULL OR layer >= reset GROUP BY 1, 2"""


def matrix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("machine"),
        F.when(F.col("o_custkey") % 2 == 0, "gnu").otherwise("intel").alias("compiler"),
    )
    return rules.matrix(tests, category="1-URGENT", machine="F", compiler="gnu")


MATRIX = """
SELECT o_orderkey, o_orderpriority AS category, o_orderstatus AS machine, 'gnu' AS compiler FROM orders
WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_custkey % 2 = 0"""


def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    mods = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("all/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/"))))
    key = codes.make_key(
        F.col("p_type"), F.concat(F.lit("g"), F.col("p_size")), F.col("p_brand"), F.lit("big_box"), F.lit("gnu"), mods
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", key.alias("key"))
    return rows.select("p_partkey", "key", codes.parse_key(F.col("key")).alias("k")).select("p_partkey", "key", "k.*")


COMPOSITE = """
SELECT p_partkey, p_type || '.g' || p_size || '.' || p_brand || '.big_box_gnu' ||
         CASE WHEN p_partkey % 4 <> 0 THEN '.all-' || replace(p_name, ' ', '-') ELSE '' END AS "key",
       p_type AS name, 'g' || p_size AS grid, p_brand AS compset, 'big_box' AS machine, 'gnu' AS compiler,
       CASE WHEN p_partkey % 4 <> 0 THEN 'all-' || replace(p_name, ' ', '-') END AS mods FROM part"""


def modifier_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(
        F.lit("SMS"),
        F.when(key % 2 == 0, "_D").otherwise(""),
        F.when(key % 3 == 0, F.concat(F.lit("_Ld"), size)).otherwise(""),
        F.when(key % 5 == 0, F.concat(F.lit("_P"), size, F.lit("x"), size % 4)).otherwise(""),
        F.when(key % 7 == 0, "_Mmpi-serial").otherwise(""),
        F.when(key % 11 == 0, "_PM").otherwise(""),
        F.when(key % 13 == 0, F.concat(F.lit("_C"), size)).otherwise(""),
        F.when(key % 17 == 0, "_Zq").otherwise(""),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", codes.parse_modifiers(name).alias("m"))
    return rows.select("p_partkey", "m.*")


MODIFIERS = """
SELECT p_partkey, 'SMS' AS base, CASE WHEN p_partkey % 3 = 0 THEN 'd' END AS length_unit,
       CASE WHEN p_partkey % 3 = 0 THEN p_size END AS length_n, p_partkey % 2 = 0 AS debug,
       CASE WHEN p_partkey % 5 = 0 THEN p_size END AS ntasks, CASE WHEN p_partkey % 5 = 0 THEN p_size % 4 END AS nthrds,
       CASE WHEN p_partkey % 7 = 0 THEN 'mpi-serial' END AS mpilib, p_partkey % 11 = 0 AS mixed_threads,
       CASE WHEN p_partkey % 13 = 0 THEN p_size END AS instances,
       CASE WHEN p_partkey % 17 = 0 THEN 'Zq' ELSE '' END AS rest FROM part"""


def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    raw = (
        F.when(key % 5 == 0, F.date_format("ts", "HH:mm"))
        .when(key % 5 == 1, F.concat(F.lit(" "), F.date_format("ts", "HH:mm:ss"), F.lit(" ")))
        .when(key % 5 == 2, F.date_format("ts", "HHmmss"))
        .when(key % 5 == 3, F.concat(F.date_format("ts", "HH"), F.lit(":75")))
        .otherwise(F.date_format("ts", "HH:mm:ss"))
    )
    return table(spark, sf_dir, "events").select("event_id", codes.parse_duration(raw).alias("seconds"))


DURATION = """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN hour(ts) * 3600 + minute(ts) * 60 WHEN 2 THEN NULL WHEN 3 THEN NULL
                 ELSE hour(ts) * 3600 + minute(ts) * 60 + second(ts) END AS seconds FROM events"""


def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts that occur more than once, and whether their source agrees."""
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("digest"), "source")
    return audits.dups(docs, ["digest"], "source")


DUPLICATES = """
SELECT md5(text) AS digest, count(*) AS n, count(DISTINCT source) = 1 AS agrees FROM documents GROUP BY 1 HAVING count(*) > 1"""


def dangling_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events refer to customers by user number, seen as documents: those without a label."""
    refs = table(spark, sf_dir, "events").select((F.col("user_id") * 7).alias("doc_id"))
    return audits.dangling(refs, table(spark, sf_dir, "labels"), ["doc_id"])


DANGLING = """
SELECT user_id * 7 AS doc_id, count(*) AS n_refs FROM events
WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = user_id * 7) GROUP BY 1"""


def designation_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("alias"))
    return rules.decode_letter(parts).select(
        "p_partkey", "alias", F.array_join("active", ",").alias("active"), F.array_join("data", ",").alias("data")
    )


DESIGNATION = """
WITH d(letter, active, data) AS (VALUES ('S', '', ''), ('E', 'atm,lnd,ice', 'ocn'), ('P', 'atm', ''))
SELECT p_partkey, p_type AS alias, active, data FROM part LEFT JOIN d ON letter = substr(p_type, 1, 1)"""

LINE_RULES = {
    "more than one": "l_quantity > 1",
    "discount below ten percent": "l_discount < 0.095",
    "open and returned": "NOT (l_returnflag = 'R' AND l_linestatus = 'O' AND l_tax > 0.07)",
}


def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.violations(table(spark, sf_dir, "lineitem"), LINE_RULES)
    return found.select("rule", "l_orderkey", "l_linenumber", "l_partkey")


CONSTRAINTS = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS rule, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT ({sql})" for name, sql in LINE_RULES.items()
)

QUERIES: dict[str, Query] = {
    "alias_resolve": (alias_resolve, ALIAS),
    "code_parse": (code_parse, CODE_PARSE),
    "rule_first_match": (rule_first_match, FIRST_MATCH),
    "rule_most_specific": (rule_most_specific, MOST_SPECIFIC),
    "rule_override": (rule_override, OVERRIDE),
    "settings_merge": (settings_merge, MERGE),
    "settings_append": (settings_append, APPEND),
    "include_closure": (include_closure, CLOSURE),
    "include_cycles": (include_cycles, CYCLES),
    "settings_of_includes": (settings_of_includes, OF_INCLUDES),
    "matrix_filter": (matrix_filter, MATRIX),
    "composite_key": (composite_key, COMPOSITE),
    "modifier_parse": (modifier_parse, MODIFIERS),
    "duration_parse": (duration_parse, DURATION),
    "duplicate_audit": (duplicate_audit, DUPLICATES),
    "dangling_audit": (dangling_audit, DANGLING),
    "designation_decode": (designation_decode, DESIGNATION),
    "constraint_check": (constraint_check, CONSTRAINTS),
}
