"""Comparison, rules, settings, audits, fields, reports."""

from __future__ import annotations

import datetime as dt
import itertools
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import calendar as cal
from fieldloom.functions import codes
from fieldloom.operators import audits, compare, fields, reports, rules, settings
from fieldloom.operators.ordered import number_steps
from fieldloom.operators.skew import hot_keys, spread_join
from fieldloom.session import shared_dir


def day(text):
    return dt.datetime.fromisoformat(text)


# ------------------------------------------------------------------ comparison


def test_diff_with_itself_is_empty(spark):
    a = spark.createDataFrame([("T", i, None if i == 3 else float(i)) for i in range(10)], "field string, cell int, value double")
    r = compare.dataset_diff(a, a, ["field", "cell"], "value").first()
    assert (r.equal, r.different, r.only_left, r.only_right, r.max_abs) == (10, 0, 0, 0, 0.0)
    assert compare.change_class(compare.dataset_diff(a, a, ["field", "cell"], "value")).first().change == "bit-for-bit"


def test_change_classes(spark):
    a = spark.createDataFrame([(f, i, float(i + 1)) for f in "abcde" for i in range(9)], "field string, cell int, value double")
    v = F.col("value")
    b = a.withColumn("value", F.when(F.col("field") == "b", v * (1 + 1e-14)).when(F.col("field").isin("c", "d", "e"), v + 1).otherwise(v))
    verdicts = spark.createDataFrame([("c", "PASS"), ("d", "FAIL")], "field string, verdict string")
    got = {r.field: r.change for r in compare.change_class(compare.dataset_diff(a, b, ["field", "cell"], "value"), verdicts=verdicts).collect()}
    assert got == {"a": "bit-for-bit", "b": "roundoff", "c": "same climate", "d": "new climate", "e": "larger than roundoff"}


def test_reconcile_all_outcomes(spark):
    results = spark.createDataFrame([("a", "RUN", "PASS"), ("b", "RUN", "FAIL"), ("c", "RUN", "FAIL"), ("d", "RUN", "PASS"), ("b", "RUN", "FAIL")], "test string, phase string, status string")
    expected = spark.createDataFrame([("b", "RUN", "FAIL"), ("d", "RUN", "FAIL"), ("e", "RUN", "FAIL"), ("e", "RUN", "FAIL")], results.schema)
    got = sorted((r.test, r.outcome) for r in compare.reconcile(results, expected).collect())
    assert got == [("a", "PASS"), ("b", "expected fail"), ("b", "expected fail"), ("c", "unexpected fail"), ("d", "unexpected pass"), ("e", "stale")]


def test_gate(spark):
    rows = [("t1", "regression", "FAIL1"), ("t2", "regression", "FAIL2"), ("t3", "restart", "FAIL"), ("t4", "restart", "PASS"), ("t4", "regression", "PASS")]
    got = {r.tag: r.allowed for r in compare.gate(spark.createDataFrame(rows, "tag string, suite string, status string")).collect()}
    assert got == {"t1": True, "t2": False, "t3": False, "t4": True}


def test_delta_against_previous_tag(spark):
    rows = [(1, "air", "1"), (2, "air", "1"), (3, "air", "2"), (1, "sea", "1"), (3, "sea", "1"), (1, "tool", "1"), (2, "tool", "1")]
    got = compare.release_delta(spark.createDataFrame(rows, "tag_seq int, component string, version string")).collect()
    assert sorted((r.component, r.tag_seq, r.change) for r in got) == [
        ("air", 1, "added"), ("air", 3, "changed"), ("sea", 1, "added"), ("sea", 2, "removed"), ("sea", 3, "added"), ("tool", 1, "added"), ("tool", 3, "removed"),
    ]


def test_versions_sort_by_meaning(spark):
    tags = ["4.0.0", "3.7.12", "3.7.8", "3.7.1000001", "3.7.20240815", "oven5_2_beta03", "oven5_2_beta11", "oven5_2_alpha88", "oven5_2_rel02", "release-3.7.1", "draft", "1.2.1234567890123456789"]
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    keyed = df.select("tag", codes.version_key(codes.version_parts(F.col("tag"))).alias("k"))
    assert {r.tag for r in keyed.filter("k is null").collect()} == {"draft", "1.2.1234567890123456789"}
    assert [r.tag for r in keyed.filter("tag like 'oven%'").orderBy("k").collect()] == ["oven5_2_alpha88", "oven5_2_beta03", "oven5_2_beta11", "oven5_2_rel02"]
    rows = compare.latest_per_line(df).collect()
    latest = {(r.line, r.major, r.minor): r.latest for r in rows if r.reject is None}
    assert latest == {("", 4, 0): "4.0.0", ("", 3, 7): "3.7.20240815", ("oven", 5, 2): "oven5_2_rel02", ("release-", 3, 7): "release-3.7.1"}
    assert {r.latest for r in rows if r.reject} == {"draft", "1.2.1234567890123456789"}


# ----------------------------------------------------------------------- rules

COLOURS = [("red$", "warm"), ("dark-.*", "night"), ("[bg]lue", "sticky"), ("ue", "end")]


@pytest.mark.parametrize("branches", [2, 200])
def test_first_and_last_rule(spark, monkeypatch, branches):
    monkeypatch.setattr(rules, "BRANCHES", branches)
    df = spark.createDataFrame([("dark-red",), ("blue",), ("glue",), ("ochre",)], "c string")
    out = rules.rule_match(rules.rule_match(df, "c", COLOURS, "first", "a"), "c", COLOURS, "last", "b")
    assert {r.c: (r.a, r.b) for r in out.collect()} == {
        "dark-red": ("warm", "night"), "blue": ("sticky", "end"), "glue": ("sticky", "end"), "ochre": (None, None),
    }
    table = spark.createDataFrame([(2, "b", "y"), (1, "a", "x")], "seq int, pattern string, value string")
    assert rules.rules_from(table) == [("a", "x"), ("b", "y")]
    with pytest.raises(ValueError):
        rules.rules_from(table, limit=1)


def test_most_specific_with_look_ahead(spark):
    some = [
        rules.WildcardRule({"shop": "any", "day": "any"}, "any", {"price": 9, "note": "list"}),
        rules.WildcardRule({"shop": "north", "day": "any"}, "bread(?! stale)", {"price": 4}),
        rules.WildcardRule({"shop": "any", "day": "sun"}, "bread", {"price": 6}),
        rules.WildcardRule({"shop": "north", "day": "sun"}, "rye bread(?=.*seeds)", {"price": 7}),
    ]
    rows = [("north", "sun", "rye bread with seeds"), ("north", "sun", "bread stale"), ("north", "mon", "bread"), ("north", "mon", "bread stale"), ("south", "sun", "bread roll")]
    df = spark.createDataFrame(rows, "shop string, day string, code string")
    got = [(r.price, r.note) for r in rules.specific_match(df, some, "code").collect()]
    assert got == [(7, None), (6, None), (4, None), (9, "list"), (6, None)]


def test_overrides_and_registry(spark):
    base = spark.createDataFrame([(1, "tags", "new"), (1, "size", "3"), (2, "tags", None)], "id int, attr string, value string")
    rows = [(1, "tags", "hot", True, 1), (1, "size", "5", False, 1), (1, "size", "+2", True, 2), (2, "tags", "cold", True, 1), (2, "tags", None, False, 9), (3, "size", "8", False, 1)]
    over = spark.createDataFrame(rows, "id int, attr string, value string, append boolean, seq int")
    got = {(r.id, r.attr): r.value for r in rules.apply_overrides(base, over, order="seq").collect()}
    assert got == {(1, "tags"): "new hot", (1, "size"): "5 +2", (2, "tags"): "cold", (3, "size"): "8"}
    registry = spark.createDataFrame([("ny", "new york"), ("ny", "new york")], "alias string, lname string")
    cities = spark.createDataFrame([("ny",), ("new york",), ("rome",)], "city string")
    assert sorted(r.lname for r in rules.resolve(cities, "city", registry).collect()) == ["new york", "new york", "rome"]


def test_letters_and_violations(spark):
    df = spark.createDataFrame([("B1850",), ("A",), ("Z9",)], "alias string")
    got = {r.alias: (r.active, r.data) for r in rules.decode_letter(df).collect()}
    assert got == {"B1850": (["atm", "lnd", "ice", "ocn"], []), "A": ([], None), "Z9": (None, None)}
    rows = spark.createDataFrame([(1, "g", "g"), (2, "g", "h"), (3, None, "h")], "id int, ocn string, ice string")
    assert [(r.id, r.rule) for r in rules.violations(rows, {"same grid": "ocn = ice", "positive": "id > 0"}).collect()] == [(2, "same grid")]


def test_codes(spark):
    one = spark.range(1)
    names = ["base", "filling", "top"]
    c = one.select(codes.parse_code(F.lit("0042_DOUGH7%RYE%DARK_PLUM_CREAM%OAT-MILK_BOX%RED"), names).alias("c")).first().c
    assert c.time == "0042" and [(x.name, x.model, x.phys) for x in c.comps] == [("base", "DOUGH7", ["RYE", "DARK"]), ("filling", "PLUM", []), ("top", "CREAM", ["OAT-MILK"])]
    assert [(t.model, t.phys) for t in c.tail] == [("BOX", ["RED"])]
    short = one.select(codes.parse_code(F.lit("7_PLAIN"), names).alias("c")).first().c
    assert [x.model for x in short.comps] == ["PLAIN"] and short.tail == []
    m = one.select(codes.parse_modifiers(F.lit("BAKE_P3x2_Mmpi-fast")).alias("m")).first().m
    assert (m.base, m.ntasks, m.nthrds, m.mpilib, m.debug, m.rest) == ("BAKE", 3, 2, "mpi-fast", False, "")
    m = one.select(codes.parse_modifiers(F.lit("RISE_D_Lm7")).alias("m")).first().m
    assert (m.base, m.debug, m.length_unit, m.length_n) == ("RISE", True, "m", 7)
    k = one.select(codes.parse_key(F.lit("RISE_Lm7.coarse_v4.PLUM.oven_two_gas.mods-late")).alias("k")).first().k
    assert tuple(k) == ("RISE_Lm7", "coarse_v4", "PLUM", "oven_two", "gas", "mods-late")
    raw = [" 02:10:05 ", "00:00:09", "11:45", "soon", "3:88", None]
    got = [r.s for r in spark.createDataFrame([(r,) for r in raw], "d string").select(codes.parse_duration(F.col("d")).alias("s")).collect()]
    assert got == [7805, 9, 42300, None, None, None]
    notes = [("3.5 ypd/ 120 pe-hrs/simyr guessed",), ("free",), ("",)]
    cost = [tuple(r.c) for r in spark.createDataFrame(notes, "n string").select(codes.extract_cost(F.col("n")).alias("c")).collect()]
    assert cost == [(3.5, 120.0), (None, None), (None, None)]


# -------------------------------------------------------------------- settings


def test_last_assignment_and_appends(spark):
    rows = [
        ("c", 0, 0, "opts", "-a", "append"), ("c", 0, 1, "opts", "-b", "set"), ("c", 1, 0, "opts", "-c", "append"),
        ("c", 1, 1, "opts", "-d", "append"), ("c", 0, 2, "n", "1", "set"), ("c", 1, 2, "n", "2", "set"),
    ]
    df = spark.createDataFrame(rows, "scope string, layer int, seq int, key string, value string, op string")
    assert {r.key: r.value for r in settings.merge_settings(df).collect()} == {"opts": "-d", "n": "2"}
    joined = {r.key: (r.value, r.n_values) for r in settings.append_settings(df).collect()}
    assert joined["opts"] == ("-b -c -d", 3)


def test_closure_against_breadth_first_search(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(55)} | {(i, i + 1) for i in range(100, 170)}
    got = {(r.root, r.node): r.depth for r in settings.closure(spark.createDataFrame(sorted(edges), "src int, dst int")).collect()}
    want = {}
    for root in {a for a, _ in edges}:
        level, seen, depth = {root}, set(), 0
        while level:
            depth += 1
            level = {b for a, b in edges if a in level} - seen
            seen |= level
            want.update({(root, n): depth for n in level})
    assert got == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(1500)], "src int, dst int")
    with pytest.raises(ValueError, match="deeper"):
        settings.closure(chain.filter("src < 20"), max_depth=5)
    assert settings.closure(chain.filter("src < 20"), max_depth=20).count() == 210


def test_missing_includes_are_told_from_leaves(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "leaf"), ("a", "lost"), ("c", "c")], "src string, dst string")
    existing = spark.createDataFrame([("a",), ("b",), ("leaf",)], "node string")
    got = {(r.root, r.node): (r.is_cycle, r.is_leaf, r.missing) for r in settings.include_report(edges, existing).collect()}
    assert got[("a", "leaf")] == (False, True, False) and got[("a", "lost")] == (False, True, True) and got[("c", "c")] == (True, False, False)
    assert not any(r.missing for r in settings.include_report(edges).collect())


def test_audits(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", None), ("c", None), ("d", None), ("d", "x"), ("e", "x")], "k string, p string")
    assert {r.k: (r.n, r.agrees) for r in audits.dups(df, ["k"], "p").collect()} == {"a": (2, True), "b": (2, False), "c": (2, True), "d": (2, False)}
    targets = spark.createDataFrame([("a",), ("b",)], "k string")
    assert {r.k: r.n_refs for r in audits.dangling(df, targets, ["k"]).collect()} == {"c": 2, "d": 2, "e": 1}


# ---------------------------------------------------------------------- fields


def test_remap_conserves_when_weights_sum_to_one(spark):
    field = spark.createDataFrame([("T", 1, c, float(c)) for c in range(10)] + [("T", 1, 3, 5.0)], "field string, ts int, cell int, value double")
    weights = spark.createDataFrame([(c, d, w) for c in range(10) for d, w in ((c // 2, 0.25), (c // 2 + 1, 0.75))], "src_cell int, dst_cell int, w double")
    out = fields.remap(field, weights, digits=2)
    assert out.agg(F.sum("value")).first()[0] == pytest.approx(45.0 + 5.0)


def test_weights_findings(spark):
    weights = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5), (9, 2, 1.0), (1, 7, 0.4)], "src_cell int, dst_cell int, w double")
    cells = spark.createDataFrame([(1,), (2,)], "cell int")
    got = sorted((r.problem, r.cell, r.amount) for r in fields.weights_check(weights, cells, cells).collect())
    assert got == [("row sum", 7, 0.4), ("unknown destination", 7, 1.0), ("unknown source", 9, 1.0)]


def test_merge_by_fraction(spark):
    a = spark.createDataFrame([(1, 1, 10.0), (2, 1, 1.0)], "cell int, ts int, value double")
    b = spark.createDataFrame([(1, 1, 20.0), (3, 1, None)], a.schema)
    f = spark.createDataFrame([(1, "a", 0.25), (1, "b", 0.75), (2, "a", 0.5), (3, "b", 1.0)], "cell int, source string, f double")
    got = {r.cell: r.value for r in fields.merge_fields({"a": a, "b": b}, f).collect()}
    assert got == {1: 17.5, 2: 1.0, 3: None}


@pytest.mark.parametrize("n", [1, 40])
def test_lookup_and_interpolation_against_brute_force(spark, n):
    """One key holds most rows; n slices by way of the partition setting."""
    rng = random.Random(3)
    base = day("2001-01-01")
    times = {k: sorted(rng.sample(range(0, 5000), 120 if k == "hot" else 3)) for k in ("hot", "a", "b")}
    series = [(k, base + dt.timedelta(minutes=t), float(t * t % 97)) for k, ts in times.items() for t in ts]
    asks = [(k, base + dt.timedelta(minutes=rng.randrange(-50, 5050)), i) for i, k in enumerate(["hot"] * 400 + ["a"] * 5 + ["none"] * 3)]
    asks += [("hot", series[0][1], 1000)]
    req = spark.createDataFrame(asks, "field string, ts timestamp_ntz, req_id long")
    ser = spark.createDataFrame(series, "field string, ts timestamp_ntz, value double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        low = {r.req_id: (r.lo_ts, r.lo_value) for r in fields.asof(req, ser).collect()}
        mid = {r.req_id: r.value for r in fields.interp(req, ser).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(low) == len(mid) == len(asks)
    for k, t, i in asks:
        lo = max(((s, v) for f, s, v in series if f == k and s <= t), default=(None, None))
        hi = min(((s, v) for f, s, v in series if f == k and s > t), default=(None, None))
        assert low[i] == lo
        if lo[0] == t:
            want = lo[1]
        elif None in (lo[0], hi[0]):
            want = None
        else:
            want = lo[1] + (hi[1] - lo[1]) * ((t - lo[0]) / (hi[0] - lo[0]))
        assert mid[i] == (want if want is None else pytest.approx(want))


def test_null_keys_are_a_key(spark):
    """Rows without a key are neither lost nor left without their lookup."""
    rows = spark.range(200).select(F.when(F.col("id") % 2 == 0, "a").alias("field"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), "id")
    numbered = number_steps(rows, ["field"], ["id"])
    assert numbered.groupBy("field").agg(F.count("*"), F.max("step")).filter("`count(1)` = 100 and `max(step)` = 100").count() == 2
    found = fields.asof(rows.withColumnRenamed("id", "req_id"), rows.select("field", "ts", F.col("id").cast("double").alias("value")))
    assert found.filter("field is null and lo_value = req_id").count() == 100


def test_cycling(spark):
    series = spark.range(730).select(F.lit("s").alias("field"), F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("value"))
    asked = spark.createDataFrame([("s", dt.date(2004, 2, 29)), ("s", dt.date(1999, 1, 2)), ("s", dt.date(2002, 12, 31))], "field string, date date")
    got = {str(r.date): (str(r.source_date), r.value) for r in fields.cycle(asked, series, 2001, 2).collect()}
    assert got == {"2004-02-29": ("2002-02-28", 365.0 + 58), "1999-01-02": ("2001-01-02", 1.0), "2002-12-31": ("2002-12-31", 729.0)}


# --------------------------------------------------------------------- reports


def test_footprint_flags_the_note_that_disagrees(spark):
    parts = spark.createDataFrame([("wide", 0, 300), ("wide", 310, 90), ("slim", 0, 40), ("slim", 25, 35)], "layout string, root int, ntasks int")
    notes = spark.createDataFrame([("wide", "about 12 ypd/ 801 pe-hrs/simyr"), ("slim", "about 5 ypd/ 350 pe-hrs/simyr")], "layout string, note string")
    got = {r.layout: (r.footprint, round(r.recomputed), r.agrees) for r in reports.footprint(parts, notes).collect()}
    assert got == {"wide": (400, 800, True), "slim": (60, 288, False)}


@pytest.mark.parametrize("rows_per_task", [3, 20_000])
def test_overlaps_against_brute_force(spark, rows_per_task):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, lo, lo + rng.choice([0, 1, 2, 3, 9, 30, 64, 200])) for i in range(150) for lo in [rng.randrange(-40, 200)]]
    df = spark.createDataFrame(rows, "g string, id int, lo int, hi int")
    got = sorted((r.g, r.part_a, r.part_b, r.shared_lo, r.shared_hi) for r in reports.overlaps(df, ["g"], "lo", "hi", "id", rows_per_task).collect())
    want = [
        (a[0], a[1], b[1], max(a[2], b[2]), min(a[3], b[3]))
        for a, b in itertools.combinations(rows, 2)
        if a[0] == b[0] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3]
    ]
    assert got == sorted(want)


def test_spread_join_is_the_plain_join(spark):
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(60).select((F.col("id") - 5).alias("k"), F.col("id").alias("v"))
    twice = right.unionAll(right.withColumn("k", F.lit(-1)))
    assert sorted(spread_join(left, twice, ["k"], ["id"], 10).collect()) == sorted(left.join(twice, ["k"]).collect())


# -------------------------------------------------------------------- calendar


def test_noleap_round_trip(spark):
    days = spark.sql("select explode(sequence(date'0001-01-01', date'0009-12-31')) d union all select explode(sequence(date'1999-01-01', date'2005-12-31'))")
    n = cal.noleap_daynum(F.col("d"))
    rows = days.select("d", n.alias("n"), cal.noleap_date(n).alias("back"), cal.noleap_add_days(F.col("d"), F.lit(1)).alias("next"))
    leap = "month(d) = 2 and day(d) = 29"
    assert rows.filter(f"(n is null) <> ({leap})").isEmpty()
    assert rows.filter("n is not null and back <> d").isEmpty()
    assert rows.filter("next <> d + 1 and not (month(d) = 2 and day(d) = 28 and month(next) = 3 and day(next) = 1)").isEmpty()
    years = rows.filter("n is not null and year(d) between 2000 and 2004").groupBy(F.year("d")).count().collect()
    assert {r["count"] for r in years} == {365}


def test_a_key_with_few_right_and_many_left_rows_is_split(spark):
    left = spark.range(4000).select(F.lit(1).alias("k"), "id").unionByName(spark.range(100).select(F.lit(2).alias("k"), "id"))
    right = spark.range(20).select(F.lit(1).alias("k"), F.col("id").alias("v")).unionByName(spark.range(20).select(F.lit(2).alias("k"), F.col("id").alias("v")))
    assert {(r.k, r._parts) for r in hot_keys(left, right, ["k"], 100).collect()} == {(1, 8)}
    assert spread_join(left, right, ["k"], ["id"], 100).count() == 4100 * 20


def test_settings_of_included_files_come_first(spark):
    edges = spark.createDataFrame([("case", "mid"), ("mid", "base"), ("base", "case")], "src string, dst string")
    rows = [("base", 0, "a", "1", "set"), ("base", 1, "b", "x", "append"), ("mid", 0, "a", "2", "append"), ("case", 0, "a", "3", "append"), ("mid", 1, "c", "m", "set"), ("case", 5, "c", "n", "set")]
    own = spark.createDataFrame(rows, "scope string, seq int, key string, value string, op string")
    got = {(r.scope, r.key): r.value for r in settings.append_settings(settings.layered_settings(settings.closure(edges), own)).collect()}
    assert got[("case", "a")] == "1 2 3" and got[("case", "b")] == "x" and got[("case", "c")] == "n"
    assert got[("mid", "a")] == "1 2" and got[("mid", "c")] == "m"


def plain_nearest(requests, series):
    """(req_id, latest time not after it, earliest one after it) by looking at every sample."""
    found = set()
    for key, ts, req in requests:
        known = [t for k, t, _ in series if k == key and t is not None]
        found.add((req, max((t for t in known if ts is not None and t <= ts), default=None), min((t for t in known if ts is not None and t > ts), default=None)))
    return found


@pytest.mark.parametrize("rows", [1, 7, 100_000])
def test_nearest_samples_across_buckets(spark, rows):
    """Keys that are null, samples and requests in bursts, without a time, and outside the series."""
    rng = random.Random(rows)
    begin = dt.datetime(2024, 1, 1)
    times = [begin + dt.timedelta(seconds=rng.choice([rng.randrange(10**6), 5])) for _ in range(120)]
    series = [(k, t, float(n)) for k in ("a", None) for n, t in enumerate(sorted(set(times[:60])))] + [("a", None, -1.0)]
    requests = [(rng.choice(["a", "b", None]), rng.choice([*times, None]), n) for n in range(150)]
    asked = spark.createDataFrame(requests, "field string, ts timestamp_ntz, req_id long")
    known = spark.createDataFrame(series, "field string, ts timestamp_ntz, value double")
    want = plain_nearest(requests, series)
    got = fields.asof(asked, known, rows=rows).collect()
    assert {(r.req_id, r.lo_ts) for r in got} == {(q, lo) for q, lo, _ in want} and len(got) == len(requests)
    value = {(k, t): v for k, t, v in series}
    both = fields.interp(asked, known, rows=rows).collect()
    at = {q: k for k, _, q in requests}
    assert {(r.req_id, r.lo_value, r.hi_value) for r in both} == {(q, value.get((at[q], lo)) if lo else None, value.get((at[q], hi)) if hi else None) for q, lo, hi in want}


@pytest.mark.parametrize("kind", ["timestamp_ntz", "date", "long", "string"])
def test_numbers_across_buckets(spark, kind):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None]), None if n % 20 == 0 else rng.randrange(300), n) for n in range(400)]
    base = spark.createDataFrame(rows, "field string, at int, id long")
    at = {"timestamp_ntz": "timestamp_ntz'2024-01-01' + make_dt_interval(at)", "date": "date_add(date'2024-01-01', at)", "long": "cast(at as bigint)", "string": "lpad(at, 5, '0')"}[kind]
    got = {r.id: r.step for r in number_steps(base.withColumn("t", F.expr(at)), ["field"], ["t", "id"], rows=9).collect()}
    for key in ("a", None):
        own = sorted(((a is not None, a or 0, n) for k, a, n in rows if k == key))
        assert [got[n] for *_, n in own] == list(range(1, len(own) + 1))


def test_one_key_of_ten_million_rows(spark):
    """No task gets the key as a whole, and nothing is written before the result."""
    rows = spark.range(10_000_000).select(F.lit("hot").alias("field"), F.expr("timestamp_ntz'2000-01-01' + make_dt_interval(0, 0, 0, id * 7919 % 10000000)").alias("ts"), "id")
    before = len(list(pathlib.Path(shared_dir(spark)).rglob("part-*")))
    known = rows.filter("id % 10 = 0").select("field", "ts", F.col("id").cast("double").alias("value"))
    asked = rows.filter("id % 10 <> 0").select("field", "ts", F.col("id").alias("req_id"))
    found = fields.asof(asked, known)
    assert len(list(pathlib.Path(shared_dir(spark)).rglob("part-*"))) == before
    largest, n, wrong = found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_if(F.expr("lo_ts > ts OR ts - lo_ts >= interval 10 minutes")).alias("wrong")).agg(F.max("n"), F.sum("n"), F.sum("wrong")).first()
    assert n == 9_000_000 and largest < 4_000_000
    assert wrong == 0


@pytest.mark.parametrize("group_rows", [2, 512])
def test_nested_and_very_long_ranges(spark, group_rows):
    """Ranges within ranges, one over everything, repeated places, empty ranges, null groups, equal ids."""
    rng = random.Random(6)
    rows = [("a", 0, 0, 10**9), ("a", 1, -(10**12), 10**12), ("a", 2, 5, 5), ("a", 3, 9, 2), (None, 4, 0, 9), (None, 5, 0, 9), ("b", 6, 0, 9), ("b", 6, 3, 5)]
    for n in range(7, 160):
        lo = rng.choice([rng.randrange(400), 50])
        rows.append((rng.choice("ab"), n, lo, lo + rng.choice([1, 2, 3, 30, 1000])))
    df = spark.createDataFrame(rows, "g string, id long, lo long, hi long")
    want = []
    for x, y in itertools.combinations([r for r in rows if r[0] and r[2] < r[3]], 2):
        if x[0] == y[0] and x[1] != y[1] and x[2] < y[3] and y[2] < x[3]:
            want.append((x[0], min(x[1], y[1]), max(x[1], y[1]), max(x[2], y[2]), min(x[3], y[3])))
    got = [tuple(r) for r in reports.overlaps(df, ["g"], "lo", "hi", "id", group_rows).collect()]
    assert sorted(got) == sorted(want)


def test_overlaps_of_a_group_with_all_the_rows(spark):
    """Half a million short ranges under a few long ones: as many rows as overlap, and no others."""
    rows = spark.range(500_000).select(F.lit(1).alias("g"), "id", (F.col("id") * 3).alias("lo"), F.when(F.col("id") % 100_000 == 7, F.col("id") * 3 + 200_000).otherwise(F.col("id") * 3 + 4).alias("hi"))
    found = reports.overlaps(rows, ["g"], "lo", "hi", "id")
    long = 5 * ((200_000 - 1) // 3)
    last = sum(min(499_999, i + 66_666) - i for i in range(7, 500_000, 100_000))
    assert found.count() == (500_000 - 1 - 5) + last and long >= last
    assert found.filter("shared_lo >= shared_hi").isEmpty()


def test_delta_of_conflicting_and_unknown_versions(spark):
    rows = [(1, "atm", "1"), (1, "atm", "2"), (4, "atm", "2"), (9, "atm", None), (9, "ice", "5"), (1, "ocn", None), (4, "ocn", None), (9, "ocn", "3"), (4, "rof", "1"), (4, "rof", "1")]
    got = {(r.component, r.tag_seq): (r.version, r.previous, r.change) for r in compare.release_delta(spark.createDataFrame(rows, "tag_seq int, component string, version string")).collect()}
    assert got == {
        ("atm", 1): ("1,2", None, "added"), ("atm", 4): ("2", "1,2", "changed"), ("atm", 9): (None, "2", "changed"), ("ice", 9): ("5", None, "added"),
        ("ocn", 1): (None, None, "added"), ("ocn", 9): ("3", None, "changed"), ("rof", 4): ("1", None, "added"), ("rof", 9): (None, "1", "removed"),
    }
