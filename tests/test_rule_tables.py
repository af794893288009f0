"""Rules that are tables against every rule tried on every code."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import rule_tables as R


def test_literals(spark):
    cases = {
        "abc": ["abc"], "ab": None, "abcd?": ["abc"], "abc+d": ["abc"], "ab{0,2}cdef": ["cdef"], "abc|xyz": None, "(abc|xyz)defg": ["defg"], "(?i)abc": None,
        r"abc\.def": ["abc", "def"], "[abc]defg": ["defg"], r"[\]x]hello": ["hello"], "x*abc.*efg$": ["abc", "efg"], r"\Qabc\E*": None, r"\x41bcd": None, "((a)(b(c)))wxyz?": ["wxy"],
        "(abc)*def": ["def"], "[[:alpha:]]abc": None, "(?:abc)def": ["def"], r"a\dbcd": ["bcd"], "abc**": None, "": None, "é日本x": ["é日本x"],
    }
    usable = {p: w for p, w in cases.items() if p != "abc**"}
    df = spark.createDataFrame([(p,) for p in usable], "pattern string").withColumn("runs", R.literals(F.col("pattern")))
    assert {r.pattern: r.runs for r in df.collect()} == usable


def some_pattern(rng, depth=0):
    parts = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.randrange(9)
        part = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
        if kind == 0:
            part = "[" + "".join(rng.sample("abc-", 2)).strip("-") + "]"
        elif kind == 1 and depth < 2:
            part = "(" + some_pattern(rng, depth + 1) + rng.choice(["", "|" + some_pattern(rng, depth + 1)]) + ")"
        elif kind == 2:
            part = rng.choice([".", r"\.", r"\w", ".*", "a{1,2}", "(?:b)"])
        parts.append(part + rng.choice(["", "", "", "?", "*", "+", "{2}", "+?"]) if not part.endswith(("*", "}")) else part)
    return "".join(parts)


def test_random_expressions(spark):
    rng = random.Random(11)
    patterns = {some_pattern(rng) for _ in range(700)} | {"a|b", "^$", "(?i)ABC", "c$"}
    codes = {"".join(rng.choice("abc.") for _ in range(rng.randrange(14))) for _ in range(150)}
    got = R.pattern_matches(spark.createDataFrame([(c,) for c in codes] + [(None,)], "code string"), spark.createDataFrame([(p,) for p in patterns] + [(None,)], "pattern string"))
    want = {(c, p) for c in codes for p in patterns if re.search(p, c)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize("mode", ["first", "last"])
def test_ordered_rules(spark, mode):
    rules = [(3, "abc", "three"), (1, "bcd", "one"), (1, "abc", "also one"), (9, "zzz", "nine"), (5, "a", "five"), (7, None, "never")]
    df = spark.createDataFrame([(1, "xabcd"), (2, "bcd"), (3, "zzz"), (4, "q"), (5, None), (2, "bcd")], "id long, code string")
    table = spark.createDataFrame(rules, "seq long, pattern string, value string")
    out = sorted((r.id, r.value) for r in R.match_table(df, "code", table, mode).collect())
    want = {"first": {1: "also one", 2: "one", 3: "nine", 4: None, 5: None}, "last": {1: "five", 2: "one", 3: "nine", 4: None, 5: None}}[mode]
    assert out == sorted((i, want[i]) for i in (1, 2, 2, 3, 4, 5))
    assert R.match_table(df, "code", table.filter("false"), mode).filter("value IS NOT NULL").count() == 0
    assert R.match_table(df.filter("false"), "code", table, mode).count() == 0


def test_wildcard_rules(spark):
    """Random rules over keys with odd values, against all of them."""
    rng = random.Random(4)
    values, patterns = ["x", "y", "1;=1:x", "*;", "", None, "any"], ["any", None, "abc", "^b", "[0-9]"]
    rules = [(rng.choice(values), rng.choice(values), rng.choice(patterns), i, f"t{i}") for i in range(60)]
    rows = [(i, rng.choice(values), rng.choice(values), rng.choice(["abc", "bcd", "a1", "", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a string, b string, code string")
    table = spark.createDataFrame(rules, "a string, b string, pattern string, rule_id long, label string")
    got = {r.id: (r.rule_id, r.label) for r in R.specific_table(df, table, ["a", "b"], ["label"], code="code").collect()}

    def free(x):
        return x is None or x == "any"

    for i, a, b, code in rows:
        fits = [
            ((not free(ra)) + (not free(rb)) + (not free(p)), n, label)
            for ra, rb, p, n, label in rules
            if (free(ra) or ra == a) and (free(rb) or rb == b) and (free(p) or code is not None and re.search(p, code))
        ]
        assert got[i] == (max(fits)[1:] if fits else (None, None)), (a, b, code)
    without = R.specific_table(df, table.drop("pattern"), ["a"], ["label"]).count()
    assert without == len(rows)


def test_fifty_thousand_rules(spark):
    """Rules and codes that share long beginnings meet through their rare parts, without pairs of all with all."""
    rules = spark.range(50_000).select(F.col("id").alias("seq"), F.concat(F.lit("^https://www\\.example\\.org/run/"), F.col("id") * 7919 % 100_003, F.lit("/[a-z]+$")).alias("pattern"), F.col("id").cast("string").alias("value"))
    codes = spark.range(20_000).select("id", F.concat(F.lit("https://www.example.org/run/"), F.col("id") * 3 % 100_003, F.lit("/log")).alias("code"))
    out = R.match_table(codes, "code", rules)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {i * 7919 % 100_003: i for i in range(50_000)}
    assert {r.id: r.value for r in out.collect()} == {i: (str(want[k]) if (k := i * 3 % 100_003) in want else None) for i in range(20_000)}


def test_pieces_are_not_broadcast(spark):
    """A code has dozens of pieces; however few the codes are, their pieces never go to the driver."""
    codes = spark.range(300).select(F.concat(F.lit("https://www.example.org/"), F.sha2(F.col("id").cast("string"), 512)).alias("code")).distinct()
    patterns = spark.range(300).select(F.concat(F.lit("/"), F.substring(F.sha2(F.col("id").cast("string"), 512), 1, 12), F.lit(".*[0-9]")).alias("pattern"))
    out = R.pattern_matches(codes, patterns)
    assert len(out.collect()) == 300
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert [line for line in plan.splitlines() if "SortMergeJoin [piece" in line and "Inner" in line]


def test_nodes_of_many_rows_are_dealt(spark, monkeypatch):
    """Keys and conditions that most rows share are dealt over several tasks and give what they give in one."""
    rules = [("any", "any", "any", 1, "all"), ("x", "any", "any", 2, "x"), ("any", "7", "any", 3, "seven"), ("any", "any", "^a", 4, "a"), ("y", "9", "b", 5, "y9b")]
    rules += [("any", str(i), "any", 100 + i, f"own {i}") for i in range(1000, 1040)]
    table = spark.createDataFrame(rules, "a string, b string, pattern string, rule_id long, label string")
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("a"), (F.col("id") % 1100).cast("string").alias("b"), F.when(F.col("id") % 2 == 0, "abc").alias("code"))
    want = sorted(map(tuple, R.specific_table(df, table, ["a", "b"], ["label"], code="code").collect()))
    monkeypatch.setattr(R, "ROWS", 50)
    monkeypatch.setattr(R, "FEW", 3)
    out = R.specific_table(df, table, ["a", "b"], ["label"], code="code")
    assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # as many tasks as there are rows of keys, whatever the number of partitions is set to
    assert ", 60), REPARTITION_BY_NUM" in plan and "_salt" in plan
