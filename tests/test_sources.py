"""Readers and writers on small files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldloom.sources import records, runlog
from fieldloom.sources.history import HISTORY_SCHEMA, history_scan, history_write
from fieldloom.sources.records import flatten_records, name_list, options_map, read_ragged, read_records
from fieldloom.sources.runlog import runlog_success
from fieldloom.sources.settings import settings_scan

KITCHEN = """&oven
! nothing yet
 heat = 2.5E2
 fan=.false.
 tray(1:2) = 4, 5
 shelf(3)%name = 'top!'
steps='mix','rest!',
  'fold', ! by hand

  'bake'
/
&sink
heat  =  20
label = "hot ! cold"
heat = 30
/
"""


def test_settings(spark, tmp_path):
    (tmp_path / "one.nl").write_text(KITCHEN)
    (tmp_path / "two.nl").write_text("\n\n  ! nothing\n")
    rows = settings_scan(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.key, r.value) for r in rows] == [
        ("heat", "2.5E2"),
        ("fan", ".false."),
        ("tray(1:2)", "4, 5"),
        ("shelf(3)%name", "'top!'"),
        ("steps", "'mix','rest!', 'fold', 'bake'"),
        ("heat", "20"),
        ("label", '"hot ! cold"'),
        ("heat", "30"),
    ]
    assert rows[0].scope.endswith("one.nl")


def test_settings_of_a_very_long_line(spark, tmp_path):
    (tmp_path / "long.nl").write_text("x = " + ",".join(f"'f{i}'" for i in range(50000)) + " ! end")
    row = settings_scan(spark, str(tmp_path)).first()
    assert row.value.count("'") == 100000 and row.value.endswith("'f49999'")


ORDERS = """<?xml version="1.0"?>
<book>
  <order name="first" table="t4" notes="no salt,
    extra lime ">
    <plates>
      <plate name="soup" size="l" course="one"/>
      <plate name="soup" size="s" course="one"/>
    </plates>
    <extras><extra name="until"> 19:30 </extra></extras>
  </order>
<!-- sent back
  <order name="gone" table="t9"><plates><plate name="pie"/></plates></order>
-->
  <order table="t2" name="second"><plates><plate name="cake" size="m" course="two"/></plates></order>
  <order name="empty" table="t1"/>
</book>
"""
ORDER_SCHEMA = (
    "_name string, _table string, _notes string, "
    "plates struct<plate: array<struct<_name: string, _size: string, _course: string>>>, "
    "extras struct<extra: array<struct<_name: string, _VALUE: string>>>"
)


def test_nested_records(spark, tmp_path):
    (tmp_path / "t.xml").write_text(ORDERS)
    records = read_records(spark, str(tmp_path / "t.xml"), "order", ORDER_SCHEMA).select(
        F.col("_name").alias("who"), name_list(F.col("_notes")).alias("notes"),
        F.col("plates.plate").alias("plate"), options_map(F.col("extras.extra")).alias("extras"),
    )
    rows = flatten_records(records, ["plate"]).collect()
    assert sorted((r.who, r.name or "", r.size or "") for r in rows) == [("empty", "", ""), ("first", "soup", "l"), ("first", "soup", "s"), ("second", "cake", "m")]
    first = next(r for r in rows if r.who == "first")
    assert first.notes == ["no salt", "extra lime"] and first.extras == {"until": "19:30"}
    assert flatten_records(records, ["plate"], outer=False).count() == 3


SHELF = """7,apple,"red, shiny",2.50
8,pear
9,plum,blue,1.10,extra
10,fig,cheap,soon
x,kiwi,green,0.40
11, lime ,green, 0.30
"""


def test_ragged_table(spark, tmp_path):
    (tmp_path / "c.csv").write_text(SHELF)
    schema = "nr int, fruit string, look string, price decimal(10,2)"
    good, bad = read_ragged(spark, str(tmp_path / "c.csv"), schema, {"look": ["red, shiny", "blue", "cheap", "yellow"]})
    assert [(r.nr, r.fruit, str(r.price)) for r in good.collect()] == [(7, "apple", "2.50")]
    assert sorted(r.reject for r in bad.collect()) == ["look outside its domain", *["malformed"] * 4]


def test_log_tail(spark):
    rows = [("ok", i, "SUCCESSFUL END" if i == 45 else "x") for i in range(1, 51)]
    rows += [("early", i, "SUCCESSFUL END" if i == 5 else "x") for i in range(1, 51)] + [("none", 1, None)]
    got = {r.path: r.success for r in runlog_success(spark.createDataFrame(rows, "path string, line_no int, value string"), "SUCCESSFUL").collect()}
    assert got == {"ok": True, "early": False, "none": False}


def test_scan_takes_member_from_file_name(spark, tmp_path):
    for member in (1, 12):
        spark.range(3).select(F.lit("T").alias("field"), "id").toPandas().to_parquet(tmp_path / f"run.air.h0.{member:04d}.parquet")
    df = history_scan(spark, str(tmp_path), fields=["T"], members=[12])
    assert [r.member for r in df.collect()] == [12, 12, 12]
    pruned = df._jdf.queryExecution().executedPlan().toString()
    assert "file_name" in pruned


def test_scan_by_the_canonical_schema(spark, tmp_path):
    rows = spark.range(4).select(F.lit(7).alias("member"), F.lit("T").alias("field"), F.lit("2001-01-01").cast("timestamp_ntz").alias("ts"), "id")
    rows.select("member", "field", "ts", F.col("id").alias("step"), F.col("id").alias("cell"), F.lit(None).cast("int").alias("lev"), F.lit(1.5).alias("value")).write.parquet(str(tmp_path / "h"))
    df = history_scan(spark, str(tmp_path / "h"), schema=HISTORY_SCHEMA, fields=["T"])
    assert df.columns == ["member", "field", "ts", "step", "cell", "lev", "value"] and df.count() == 4


def test_write_groups_samples_into_files(spark, tmp_path):
    tape = spark.range(40).select(
        F.when(F.col("id") < 25, "a").otherwise("b").alias("field"),
        F.when(F.col("id") < 39, F.timestamp_add("DAY", (F.col("id") / 5).cast("int"), F.lit("2001-01-01").cast("timestamp_ntz"))).alias("win"),
        (F.col("id") / 3).alias("value"),
    )
    history_write(tape, str(tmp_path / "t"), samples_per_file=2, dtype="float")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert dict(back.dtypes)["value"] == "float" and back.count() == 40
    got = back.groupBy("field", "file_id").agg(F.count_distinct("win").alias("n")).collect()
    assert sorted((r.field, r.file_id, r.n) for r in got) == [("a", 0, 2), ("a", 1, 2), ("a", 2, 1), ("b", 0, 1), ("b", 1, 2)]
    with pytest.raises(ValueError):
        history_write(tape, str(tmp_path / "u"), dtype="half")


def test_lines_of_logs_larger_than_a_split(spark, tmp_path):
    """Numbers run through all splits of a file; empty lines count."""
    want = set()
    for name, n in (("a", 4000), ("b", 1), ("c", 900)):
        lines = [f"{name} line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(n)]
        (tmp_path / f"{name}.log").write_text("\n".join(lines) + "\n")
        want |= {(f"{name}.log", i + 1, x) for i, x in enumerate(lines)}
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = runlog.read_log(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        rows = [(r.path.rsplit("/", 1)[1], r.line_no, r.value) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert set(rows) == want and len(rows) == len(want)


def test_tail_of_a_log_with_gaps(spark):
    lines = [("a", n * 100, "DONE" if n == 8 else "x") for n in range(10)] + [("b", n, "DONE" if n == 2 else "x") for n in range(10)] + [("c", 1, "x"), ("c", None, "DONE"), (None, 5, "DONE")]
    df = spark.createDataFrame(lines, "path string, line_no long, value string")
    got = {r.path: (r.last_line, r.marker_line, r.success) for r in runlog.runlog_success(df, "DONE", 3).collect()}
    assert got == {"a": (900, 800, True), "b": (9, 2, False), "c": (1, None, False), None: (5, 5, True)}


def test_broken_xml_records_keep_a_reason(spark):
    texts = {
        1: "<r><m name='x'>1</m><!-- <m name='no'>9</m> --><m name='y'>2</m></r>", 2: "<r><m name='x'>1</m>", 3: None, 4: "  <!-- nothing --> ", 5: "<r><m name='x'>one</m></r>",
        6: "<r></r>", 7: "<r><m name='z'>3</m></r>", 8: "not xml",
    }
    df = spark.createDataFrame(list(texts.items()), "id int, record string")
    good, bad = records.parse_xml(df, "record", "m array<struct<_VALUE: int, _name: string>>")
    rows = {r.id: [(m["_name"], m["_VALUE"]) for m in r.m or []] for r in good.collect()}
    assert rows == {1: [("x", 1), ("y", 2)], 6: [], 7: [("z", 3)]}
    assert {r.id: (r.record, r.reject) for r in bad.collect()} == {2: (texts[2], "not well-formed"), 3: (None, "empty"), 4: (texts[4], "empty"), 5: (texts[5], "not of the schema"), 8: (texts[8], "not well-formed")}
