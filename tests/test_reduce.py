"""Tape specs, windows, reductions, segments, streaming."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import exact
from fieldloom.operators import reduce as R
from fieldloom.operators.ordered import number_steps
from fieldloom.streaming.reduce import history_reduce_stream, run_available

SCHEMA = "member int, field string, ts timestamp_ntz, step bigint, cell bigint, lev int, value double"


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def frame(spark, rows):
    return spark.createDataFrame([(0, f, at(t), s, 1, None, v) for f, t, s, v in rows], SCHEMA)


def test_spec_with_missing_comma(spark):
    text = "'RAIN:X','DEW:M','FOG','HAIL:X''SNOW:I', 'MIST:q'"
    rows = R.tape_spec(spark.createDataFrame([(text,)], "spec string"), "spec").orderBy("pos").collect()
    assert [(r.field, r.flag, r.reject) for r in rows] == [
        ("RAIN", "X", None),
        ("DEW", "M", None),
        ("FOG", "A", None),
        (None, None, "malformed"),
        (None, None, "malformed"),
    ]
    assert rows[3].item == "HAIL:X'SNOW:I"


def test_a_field_listed_under_two_flags_has_two_rows(spark):
    rows = [("RAIN", "2000-01-01T00:00", 1, 1.0), ("RAIN", "2000-01-01T05:00", 2, 4.0)]
    spec = spark.createDataFrame([("RAIN", "X"), ("RAIN", "A"), ("RAIN", "A")], "field string, flag string")
    got = R.history_reduce(frame(spark, rows), spec, R.Hours(24)).collect()
    assert sorted((r.flag, r.value) for r in got) == [("A", 2.5), ("X", 4.0)]


def test_samples_without_a_time_keep_a_window_and_leap_day_starts_are_refused(spark):
    rows = frame(spark, [("RAIN", "2000-01-01T05:30", 1, 1.0)])
    rows = rows.unionByName(rows.withColumn("ts", F.lit(None).cast("timestamp_ntz")).withColumn("value", F.lit(7.0)))
    for freq in (R.Hours(6), R.Cal("d"), R.Cal("h", 5)):
        got = {r.win: r.value for r in R.history_reduce(rows, {"RAIN": "X"}, freq).collect()}
        assert len(got) == 2 and got[None] == 7.0
    assert R.history_reduce(rows, {"RAIN": "X"}, R.Hours(6)).filter("win is not null").first().win == at("2000-01-01T00:00")
    with pytest.raises(ValueError, match="29 February"):
        R.run_window(rows, "2004-02-29", "ndays", 1, calendar="noleap")


def test_unknown_flag_is_refused(spark):
    with pytest.raises(ValueError):
        R.history_reduce(frame(spark, [("T", "2000-01-01T00:00", 1, 1.0)]), {"T": "Z"}, R.Hours(24))


def test_no_fields_no_tape(spark):
    assert R.history_reduce(frame(spark, [("T", "2000-01-01T00:00", 1, 1.0)]), {}, R.Hours(24)).isEmpty()


def test_each_field_by_its_own_flag(spark):
    rows = [(f, f"2000-01-01T{h:02d}:00", h + 1, float(v)) for f in "AIXM" for h, v in enumerate([3, 9, 1])]
    out = R.history_reduce(frame(spark, rows), {f: f for f in "AIXM"}, R.Hours(24))
    got = {r.field: r.value for r in out.collect()}
    assert got == {"A": pytest.approx(13 / 3), "I": 1.0, "X": 9.0, "M": 1.0}


def test_instant_breaks_ties_by_step_and_keeps_null(spark):
    rows = [("I", "2000-01-01T12:00", 2, 5.0), ("I", "2000-01-01T12:00", 3, 7.0), ("I", "2000-01-01T11:00", 9, 1.0)]
    assert R.history_reduce(frame(spark, rows), {"I": "I"}, R.Hours(24)).first().value == 7.0
    rows.append(("I", "2000-01-01T13:00", 1, None))
    last = R.history_reduce(frame(spark, rows), {"I": "I"}, R.Hours(24)).first()
    assert last.value is None and last.n == 3


def test_window_of_nulls_only(spark):
    out = R.history_reduce(frame(spark, [("A", "2000-01-01T12:00", 1, None)]), {"A": "A"}, R.Hours(24)).first()
    assert out.value is None and out.n == 0


def test_spec_table_equals_spec_dict(spark):
    rows = [(f, f"2000-01-0{d}T00:00", d, float(d)) for f in "ab" for d in range(1, 6)]
    table = spark.createDataFrame([("a", "X"), ("a", "X"), ("c", "A")], "field string, flag string")
    by_table = R.history_reduce(frame(spark, rows), table, R.Hours(48)).collect()
    by_dict = R.history_reduce(frame(spark, rows), {"a": "X"}, R.Hours(48)).collect()
    assert sorted(by_table) == sorted(by_dict)


def test_steps_and_signed_frequency(spark):
    assert R.frequency(-24) == R.Hours(24) and R.frequency(9) == R.Steps(9)
    with pytest.raises(ValueError):
        R.frequency(0)
    rows = [("I", "2000-01-01T00:00", s, float(s)) for s in range(1, 20)]
    out = R.history_reduce(frame(spark, rows), {"I": "I"}, R.Steps(9)).orderBy("win").collect()
    assert [(r.win, r.value, r.n) for r in out] == [(0, 9.0, 9), (1, 18.0, 9), (2, 19.0, 1)]


def test_annual_hours_are_model_years_in_noleap(spark):
    days = ["0001-01-01", "0001-12-31", "2003-12-31", "2004-01-01", "2004-02-28", "2004-02-29", "2004-03-01", "2004-12-31", "2005-01-01"]
    rows = [("A", f"{d}T23:00", i + 1, 1.0) for i, d in enumerate(days)]
    out = R.history_reduce(frame(spark, rows), {"A": "A"}, R.frequency(-8760), calendar="noleap")
    got = {str(r.win)[:10]: r.n for r in out.select(F.col("win").cast("string").alias("win"), "n").collect()}
    assert got == {"0001-01-01": 2, "2003-01-01": 1, "2004-01-01": 4, "2005-01-01": 1, "None": 1}


def test_calendar_units(spark):
    rows = [("X", f"{y}-{m:02d}-15T05:30", y * 12 + m, float(m)) for y in (2001, 2002) for m in range(1, 13)]
    h = frame(spark, rows)

    def wins(freq):
        return [(str(r.win)[:13], r.n) for r in R.history_reduce(h, {"X": "X"}, freq).orderBy("win").collect()]

    assert wins(R.Cal("y")) == [("2001-01-01 00", 12), ("2002-01-01 00", 12)]
    assert wins(R.Cal("y", 2)) == [("2000-01-01 00", 12), ("2002-01-01 00", 12)]
    assert wins(R.Cal("m", 6))[1] == ("2001-07-01 00", 6)
    assert wins(R.Cal("h"))[0] == ("2001-01-15 05", 1)
    with pytest.raises(ValueError):
        R.window_key(R.Cal("w"))


@pytest.mark.parametrize(
    "start, option, n, calendar, inside, outside",
    [
        ("2004-02-28", "ndays", 2, "gregorian", "2004-02-29T23:00", "2004-03-01T00:00"),
        ("2004-02-28", "ndays", 2, "noleap", "2004-03-01T23:00", "2004-03-02T00:00"),
        ("2001-12-30", "ndays", 5, "noleap", "2002-01-03T23:59", "2002-01-04T00:00"),
        ("2001-12-30", "nmonths", 12, "gregorian", "2002-12-29T00:00", "2002-12-30T00:00"),
        ("0001-01-01", "nyears", 1, "noleap", "0001-12-31T00:00", "0002-01-01T00:00"),
    ],
)
def test_run_window(spark, start, option, n, calendar, inside, outside):
    h = frame(spark, [("T", inside, 1, 1.0), ("T", outside, 2, 2.0), ("T", "0001-01-01T00:00", 3, 3.0)])
    got = {r.value for r in R.run_window(h, start, option, n, calendar).collect()}
    assert 1.0 in got and 2.0 not in got


def test_run_window_reaches_the_scan(spark, tmp_path):
    h = frame(spark, [("T", "2004-03-01T00:00", 1, 1.0)])
    h.write.parquet(str(tmp_path / "h"))
    plan = R.run_window(spark.read.parquet(str(tmp_path / "h")), "2004-02-28", "ndays", 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2004-02-28T00:00)" in plan and "LessThan(ts,2004-03-04T00:00)" in plan


def test_field_selection_prunes_directories(spark, tmp_path):
    rows = [(f, "2004-03-01T00:00", 1, 1.0) for f in "abc"]
    frame(spark, rows).write.partitionBy("field").parquet(str(tmp_path / "h"))
    df = R.history_reduce(spark.read.parquet(str(tmp_path / "h")), {"a": "A", "b": "X"}, R.Hours(24))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [field" in plan and "HashAggregate" in plan and "SortAggregate" not in plan
    assert df.count() == 2


def test_streams(spark):
    fields = spark.createDataFrame([("hi", "dxxxx"), ("hs", "xmxxx"), ("off", "xxxxx"), ("odd", "mxxxx")], "field string, code string")
    out = R.expand_streams(fields, "code", ["d", "m", "x", "x", "x"], [1, 2, 1, 1, 1]).collect()
    assert sorted((r.field, r.stream, r.freq, r.freq_n) for r in out) == [("hi", 0, "d", 1), ("hs", 1, "m", 2)]


def test_segments_merge_to_the_same_bits(spark):
    """Cut anywhere, in any number of segments: exact integers make the means identical."""
    rows = [("A", f"2000-01-01T{i % 24:02d}:00", i, 0.1 * ((i * 7919) % 1000)) for i in range(1, 400)]
    rows = [(f, t, s, round(v, 1)) for f, t, s, v in rows]
    h, by = frame(spark, rows), ["cell"]
    whole = R.history_reduce(h, {"A": "A"}, R.Hours(24), by, digits=2).first().value
    for cuts in ([200], [1, 77, 399]):
        edges = [0, *cuts, 10**6]
        parts = [
            R.partial_reduce(h.filter((F.col("step") > lo) & (F.col("step") <= hi)), R.Hours(24), by, digits=2)
            for lo, hi in zip(edges, edges[1:])
        ]
        assert R.finalize(R.merge_partials(*parts, by=by), {"A": "A"}, by, digits=2).first().value == whole


def test_climatology_is_a_mean_of_means(spark):
    rows = [("T", "2001-01-01T00:00", 1, 1.0), ("T", "2001-01-02T00:00", 2, 3.0), ("T", "2002-01-01T00:00", 3, 10.0)]
    out = R.climatology(frame(spark, rows)).first()
    assert (out.month, out.value, out.years) == (1, 6.0, 2)


def test_numbering_with_one_huge_key(spark):
    """A third and more of the rows in one key and many equal times still number exactly."""
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("field"),
        (F.col("id") * 7919 % 101).alias("t"),
        "id",
    )
    out = number_steps(rows, ["field"], ["t", "id"])
    again = out.groupBy("field").agg(F.count("*").alias("n"), F.min("step").alias("lo"), F.max("step").alias("hi"), F.count_distinct("step").alias("d"))
    assert again.filter("lo <> 1 or hi <> n or d <> n").isEmpty()
    pairs = out.filter("field = 'hot'").orderBy("step").select("t", "id").collect()
    assert pairs == sorted(pairs)


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    rows = [(f, f"2000-01-{d:02d}T{h:02d}:00", d * 24 + h, float((d * h) % 11)) for f in "AIXM" for d in range(1, 6) for h in range(24)]
    spec = {f: f for f in "AIXM"}
    h = frame(spark, rows)
    for day in range(1, 6):
        h.filter(F.dayofmonth("ts") == day).coalesce(1).write.parquet(str(tmp_path / "in" / f"d{day}"))
    stream = spark.readStream.schema(h.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    tapes = history_reduce_stream(stream, spec, R.Hours(24), "2 hours", digits=2)
    run_available(tapes, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = R.history_reduce(h, spec, R.Hours(24), digits=2).filter(F.col("win") < F.lit("2000-01-05").cast("timestamp_ntz"))
    columns = ["field", "member", "cell", "win", "flag", "value", "n"]
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())


def test_clock_changes_do_not_matter(spark, tmp_path):
    """Model time has no time zone: 02:30 stays before 03:00 and windows keep their start."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [("I", f"2024-03-{d:02d}T{t}", d * 100 + i, float(i)) for d in (9, 10, 11, 13) for i, t in enumerate(["01:30", "02:30", "03:00"])]
        h = frame(spark, rows)

        def tape(df):
            return sorted((str(r.win), r.value, r.n) for r in df.select(F.col("win").cast("string").alias("win"), "value", "n").collect())

        want = [(f"2024-03-{d:02d} 00:00:00", 2.0, 3) for d in (9, 10, 11, 13)]
        assert tape(R.history_reduce(h, {"I": "I"}, R.Hours(24))) == want
        assert tape(R.history_reduce(h, {"I": "I"}, R.Cal("d"))) == want
        hourly = [w for w, _, _ in tape(R.history_reduce(h, {"I": "X"}, R.Cal("h")))]
        assert "2024-03-10 02:00:00" in hourly and len(hourly) == 12
        h.write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(h.schema).parquet(str(tmp_path / "in"))
        run_available(history_reduce_stream(stream, {"I": "I"}, R.Hours(24), "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
        assert tape(spark.read.parquet(str(tmp_path / "out"))) == want[:3]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_exact_sums_of_large_values(spark):
    big = spark.range(400).select(F.when(F.col("id") % 2 == 0, 1e14).otherwise(-1e11).alias("v"))
    total = big.agg(exact.exact_sum(F.col("v"), 6).alias("s")).first().s
    assert total == 200 * 1e14 - 200 * 1e11
    mixed = spark.createDataFrame([(0.1,), (-0.3,), (1e12 + 0.5,), (None,), (-1e12,)], "v double")
    assert mixed.agg(exact.exact_sum(F.col("v"), 2).alias("s")).first().s == pytest.approx(0.3)


def test_streams_share_one_scan(spark):
    rows = frame(spark, [("RAIN", "2000-01-01T05:00", 1, 1.0), ("RAIN", "2000-01-20T05:00", 2, 4.0), ("DEW", "2000-01-01T05:00", 1, 9.0), ("FOG", "2000-01-01T05:00", 1, 2.0)])
    spec = spark.createDataFrame([("RAIN", "X"), ("RAIN", "A"), ("DEW", "M"), ("FOG", "A"), (None, None)], "field string, flag string")
    streams = spark.createDataFrame([("RAIN", 0, "d", 1), ("RAIN", 3, "m", 1), ("DEW", 3, "m", 1), ("ICE", 3, "m", 1)], "field string, stream int, freq string, freq_n int")
    tapes = R.reduce_streams(rows, spec, streams)
    got = sorted((r.stream, r.field, r.flag, str(r.win)[:10], r.value) for r in tapes.collect())
    assert got == [
        (0, "RAIN", "A", "2000-01-01", 1.0), (0, "RAIN", "A", "2000-01-20", 4.0), (0, "RAIN", "X", "2000-01-01", 1.0), (0, "RAIN", "X", "2000-01-20", 4.0),
        (3, "DEW", "M", "2000-01-01", 9.0), (3, "RAIN", "A", "2000-01-01", 2.5), (3, "RAIN", "X", "2000-01-01", 4.0),
    ]
    with pytest.raises(ValueError, match="no streams"):
        R.reduce_streams(rows, spec, streams.filter("false"))
