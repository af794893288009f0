"""Queries over scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.reduce import Hours, history_reduce
from fieldloom.plans.catalog.adapters import EVENTS, TAPE, Query, events_history, sql_avg, table
from fieldloom.session import scratch_path
from fieldloom.sources.history import history_write
from fieldloom.sources.records import flatten_records, parse_ragged, parse_xml
from fieldloom.sources.runlog import read_log, runlog_success
from fieldloom.sources.settings import settings_rows


def history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_history(spark, sf_dir, fields=["view", "error"], members=[1, 2])


HISTORY_SCAN = f"WITH {EVENTS} SELECT * FROM h WHERE field IN ('view', 'error') AND member IN (1, 2)"


def settings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as settings files: a line whose first word is plain letters assigns to it."""
    text = F.regexp_replace("text", r"(?m)^([A-Za-z]+) ", "$1 = ")
    return settings_rows(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))


SETTINGS_SCAN = r"""
WITH files AS (
  SELECT doc_id, string_split_regex(regexp_replace(text, '(?m)^([A-Za-z]+) ', '\1 = ', 'g'), '\r?\n') AS parts FROM documents),
lines AS (SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS line FROM files),
clean AS (
  SELECT doc_id, i, trim(regexp_replace(line,
    '(?s)^((?:[^''"!]|''[^'']*(?:''|\z)|"[^"]*(?:"|\z))*).*\z', '\1'), ' ' || chr(9)) AS s FROM lines),
starts AS (
  SELECT doc_id, i, s, regexp_matches(s, '^[A-Za-z_][A-Za-z0-9_%()]*[ \t]*=') AS is_start FROM clean WHERE s <> ''),
grouped AS (
  SELECT doc_id, i, s, sum(CASE WHEN is_start THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM starts),
joined AS (SELECT doc_id, g, string_agg(s, ' ' ORDER BY i) AS s FROM grouped WHERE g > 0 GROUP BY doc_id, g)
SELECT doc_id, CAST(g - 1 AS INTEGER) AS seq,
       trim(substr(s, 1, instr(s, '=') - 1), ' ' || chr(9)) AS "key",
       trim(substr(s, instr(s, '=') + 1), ' ' || chr(9)) AS value FROM joined"""


def nested_records_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_records(table(spark, sf_dir, "embeddings"), ["embedding"], position=True)


NESTED = """
SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS embedding_pos, unnest(embedding) AS embedding
FROM embeddings"""


def nested_structs_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records with a list of turns, beside records whose list is empty or null, laid flat again."""
    turn = F.struct("turn", "role", F.length("text").alias("size"))
    records = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    empty = F.when(F.col("conv_id") % 2 == 0, F.array().cast(records.schema["turns"].dataType)).alias("turns")
    more = records.select((-1 - F.col("conv_id")).alias("conv_id"), empty)
    return flatten_records(records.unionByName(more), ["turns"], position=True)


NESTED_STRUCTS = """
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turns_pos, turn, role,
       CAST(length(text) AS INTEGER) AS size FROM conversations
UNION ALL SELECT DISTINCT -1 - conv_id, NULL, NULL, NULL, NULL FROM conversations"""


def xml_records_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as XML records, with comments in them and some cut off, read and laid flat again.

    A record that is broken keeps one row with the reason.
    """
    turn = F.concat(F.lit('<turn n="'), "turn", F.lit('" role="'), "role", F.lit('"> '), F.length("text"), F.lit(" </turn><!-- <turn n='9'>no</turn> -->"))
    one = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("xml")))), lambda x: x["xml"]), "\n").alias("body"))
    whole = F.concat(F.lit("<conversation>"), "body", F.when(F.col("conv_id") % 11 != 4, "</conversation>").otherwise(""))
    records = one.select("conv_id", whole.alias("record"))
    good, bad = parse_xml(records, "record", "turn array<struct<_VALUE: int, _n: bigint, _role: string>>")
    flat = flatten_records(good, ["turn"]).select("conv_id", F.col("n").alias("turn"), "role", F.col("VALUE").alias("size"), F.lit(None).cast("string").alias("reject"))
    return flat.unionByName(bad.drop("record"), allowMissingColumns=True)


XML_RECORDS = """
SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS size, NULL::VARCHAR AS reject FROM conversations WHERE conv_id % 11 <> 4
UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, 'not well-formed' FROM conversations WHERE conv_id % 11 = 4"""


def runlog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs written as files, one of each group of users, read with their line numbers; did they end with a purchase?"""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("run"), "event_id", F.concat_ws(" ", "event_type", "value").alias("value"))
    path = scratch_path(spark, "logs")
    events.repartition("run").sortWithinPartitions("run", "event_id").select("run", "value").write.partitionBy("run").text(path)
    lines = read_log(spark, path).withColumn("run", F.regexp_extract("path", "/run=([0-9]+)/", 1).cast("long"))
    return runlog_success(lines, "purchase", 3, by=["run"])


RUNLOG_FILES = """
WITH l AS (SELECT user_id % 12 AS run, row_number() OVER (PARTITION BY user_id % 12 ORDER BY event_id) AS n, event_type FROM events),
r AS (SELECT run, max(n) AS last_line, max(n) FILTER (event_type = 'purchase') AS marker_line FROM l GROUP BY run)
SELECT run, last_line, marker_line, coalesce(marker_line > last_line - 3, false) AS success FROM r"""

PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def ragged_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as delimited text with short, long, shifted and untyped rows."""
    kind = F.col("p_partkey") % 10
    size = F.col("p_size").cast("string")
    line = (
        F.when(kind == 3, F.concat_ws(",", "p_brand", "p_type"))
        .when(kind == 5, F.concat_ws(",", "p_type", "p_brand", size))
        .when(kind == 7, F.concat_ws(", ", "p_brand", "p_type", size, F.lit("more")))
        .when(kind == 9, F.concat_ws(",", "p_brand", "p_type", F.lit("large")))
        .otherwise(F.concat(F.lit('"'), "p_brand", F.lit('", '), "p_type", F.lit(" , "), size))
    )
    lines = table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))
    good, bad = parse_ragged(lines, "line", "brand string, kind string, size int", {"kind": PART_TYPES})
    good = good.select("p_partkey", "brand", "kind", "size", F.lit(None).cast("string").alias("reject"))
    bad = bad.select("p_partkey", *[F.lit(None).cast(t).alias(c) for c, t in (("brand", "string"), ("kind", "string"), ("size", "int"))], "reject")
    return good.unionByName(bad)


RAGGED = """
SELECT p_partkey, CASE WHEN ok THEN p_brand END AS brand, CASE WHEN ok THEN p_type END AS kind,
       CASE WHEN ok THEN p_size END AS size,
       CASE WHEN p_partkey % 10 = 5 THEN 'kind outside its domain' WHEN NOT ok THEN 'malformed' END AS reject
FROM (SELECT *, p_partkey % 10 NOT IN (3, 5, 7, 9) AS ok FROM part)"""


def runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return runlog_success(logs, "ou", tail_n=2, by=["conv_id"], line_no="turn", text="text").select("conv_id", "success")


RUNLOG = """
SELECT conv_id, bool_or(contains(text, 'ou')) AS success FROM (
  SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
WHERE back <= 2 GROUP BY conv_id"""


def history_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily tapes written seven samples to a file in single precision, then read again."""
    tape = history_reduce(events_history(spark, sf_dir), TAPE, Hours(24), by=["cell"], digits=2)
    path = scratch_path(spark, "tape")
    history_write(tape, path, samples_per_file=7, dtype="float")
    back = spark.read.schema("cell bigint, win timestamp_ntz, flag string, value float, n bigint, field string, file_id bigint").parquet(path)
    return back.groupBy("field", "file_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("win").alias("n_windows"),
        F.min("win").alias("first_win"),
        F.min(F.col("value").cast("double")).alias("lo"),
        F.max(F.col("value").cast("double")).alias("hi"),
    )


HISTORY_WRITE = f"""
WITH {EVENTS}, tape AS (
  SELECT field, cell, date_trunc('day', ts) AS win,
    CASE field WHEN 'click' THEN {sql_avg("value")} WHEN 'view' THEN arg_max(value, (ts, step))
      WHEN 'purchase' THEN max(value) WHEN 'error' THEN min(value) END AS value
  FROM h WHERE field <> 'signup' GROUP BY 1, 2, 3),
ranked AS (SELECT *, (dense_rank() OVER (PARTITION BY field ORDER BY win) - 1) // 7 AS file_id FROM tape)
SELECT field, CAST(file_id AS BIGINT) AS file_id, count(*) AS n_rows, count(DISTINCT win) AS n_windows,
       CAST(min(win) AS TIMESTAMP) AS first_win,
       min(CAST(CAST(value AS FLOAT) AS DOUBLE)) AS lo, max(CAST(CAST(value AS FLOAT) AS DOUBLE)) AS hi
FROM ranked GROUP BY field, file_id"""

QUERIES: dict[str, Query] = {
    "history_scan": (history_scan, HISTORY_SCAN),
    "settings_scan": (settings_scan, SETTINGS_SCAN),
    "nested_records_flatten": (nested_records_flatten, NESTED),
    "nested_structs_flatten": (nested_structs_flatten, NESTED_STRUCTS),
    "xml_records_flatten": (xml_records_flatten, XML_RECORDS),
    "runlog_files": (runlog_files, RUNLOG_FILES),
    "ragged_csv_scan": (ragged_csv_scan, RAGGED),
    "runlog_success": (runlog, RUNLOG),
    "history_write": (history_write_back, HISTORY_WRITE),
}
