"""Rule tables: aliases, ordered regex rules, wildcard rules, overrides, constraints.

Rules are configuration: a Python sequence, compiled into CASE expressions with
constant patterns. Each row is matched inside the scan stage; there is no theta
join, no broadcast and no shuffle however large the fact table is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = "any"

# Branches per CASE expression; longer rule lists are chained exactly.
BRANCHES = 200


def _first_true(conditions: Sequence[tuple[Column, Column]]) -> Column:
    """Value of the first true condition; any number of conditions."""
    parts = []
    for at in range(0, len(conditions), BRANCHES):
        chunk = conditions[at : at + BRANCHES]
        case = F.when(*chunk[0])
        for condition, value in chunk[1:]:
            case = case.when(condition, value)
        parts.append(case)
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def rule_match(df: DataFrame, col: str, rules: Sequence[tuple[str, str]], mode: str = "first", out: str = "value") -> DataFrame:
    """Value of the first (or last) rule whose pattern occurs in ``col``; null if none does."""
    if mode not in ("first", "last"):
        raise ValueError("mode must be 'first' or 'last'")
    ordered = list(rules) if mode == "first" else list(rules)[::-1]
    return df.withColumn(out, _first_true([(F.col(col).rlike(p), F.lit(v)) for p, v in ordered]))


def rules_from(table: DataFrame, limit: int = 10_000) -> list[tuple[str, str]]:
    """Ordered (pattern, value) rules of a small table (seq, pattern, value); refuses a large one."""
    rows = table.orderBy("seq").select("pattern", "value").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"rule table has more than {limit} rows")
    return [(r["pattern"], r["value"]) for r in rows]


@dataclass(frozen=True)
class WildcardRule:
    """Key conditions (``any`` matches all), an optional regex on a code, and attributes."""

    keys: Mapping[str, str]
    pattern: str = ANY
    attrs: Mapping[str, str | int] = field(default_factory=dict)

    def score(self) -> int:
        return sum(v != ANY for v in self.keys.values()) + (self.pattern != ANY)


def specific_match(df: DataFrame, rules: Sequence[WildcardRule], code: str | None = None) -> DataFrame:
    """Attributes of the most specific matching rule; ties go to the later rule.

    How specific a rule is does not depend on the row, so the rules are sorted
    once and the first match wins. ``rule_id`` is the position in ``rules``.
    """
    ranked = sorted(enumerate(rules), key=lambda r: (r[1].score(), r[0]), reverse=True)
    cases = []
    for number, rule in ranked:
        if rule.pattern != ANY and code is None:
            raise ValueError("rules with a pattern need the code column")
        condition = F.lit(True)
        for key, wanted in rule.keys.items():
            if wanted != ANY:
                condition = condition & (F.col(key) == wanted)
        if rule.pattern != ANY:
            condition = condition & F.col(code).rlike(rule.pattern)
        cases.append((condition, F.lit(number)))
    out = df.withColumn("rule_id", _first_true(cases).cast("int"))
    for name in dict.fromkeys(a for r in rules for a in r.attrs):
        having = [(i, r.attrs[name]) for i, r in enumerate(rules) if name in r.attrs]
        pairs = [F.lit(x) for pair in having for x in pair]
        out = out.withColumn(name, F.try_element_at(F.create_map(*pairs), F.col("rule_id")))
    return out


def apply_overrides(
    base: DataFrame, overrides: DataFrame, keys: Sequence[str] = ("id", "attr"), order: str | None = None
) -> DataFrame:
    """Override rows replace a value, or append to it when ``append`` is true.

    Several overrides of a key are applied one after the other, by ``order`` and
    then by their text; null values change nothing. Attributes they add are kept.
    """
    at = F.lit(0) if order is None else F.col(order)
    one = F.struct(at.alias("at"), F.col("value").alias("v"), F.coalesce("append", F.lit(False)).alias("append"))
    ov = overrides.filter("value IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_all"))
    value = F.aggregate(
        F.coalesce("_all", F.array().cast(ov.schema["_all"].dataType)),
        F.col("value"),
        lambda done, o: F.when(o["append"], F.concat_ws(" ", done, o["v"])).otherwise(o["v"]),
    )
    return base.join(ov, list(keys), "full").select(*keys, value.alias("value"), F.col("_all").isNotNull().alias("overridden"))


def resolve(df: DataFrame, col: str, registry: DataFrame, out: str = "lname") -> DataFrame:
    """Replace an alias by its long name; keep the value when it is none.

    The registry (alias, lname) is de-duplicated first, else a repeated alias
    would double the rows.
    """
    names = registry.groupBy(F.col("alias").alias(col)).agg(F.min("lname").alias("_lname"))
    return df.join(names, col, "left").withColumn(out, F.coalesce("_lname", col)).drop("_lname")


def matrix(df: DataFrame, category: str | None = None, machine: str | None = None, compiler: str | None = None) -> DataFrame:
    """Rows of an exploded test matrix for the given category, machine and compiler."""
    for name, wanted in (("category", category), ("machine", machine), ("compiler", compiler)):
        if wanted is not None:
            df = df.filter(F.col(name) == wanted)
    return df


# First letter of an alias -> (active parts, data parts). None means
# "various" (any mixture), an empty list means none.
DESIGNATIONS: dict[str, tuple[list[str], list[str] | None]] = {
    "A": ([], None),
    "B": (["atm", "lnd", "ice", "ocn"], []),
    "C": (["ocn"], ["atm", "ice", "rof"]),
    "D": (["ice"], ["atm", "ocn", "rof"]),
    "E": (["atm", "lnd", "ice"], ["ocn"]),
    "F": (["atm", "lnd"], ["ice", "ocn"]),
    "G": (["ice", "ocn"], ["atm", "rof"]),
    "I": (["lnd"], ["atm"]),
    "J": (["lnd", "ice", "ocn"], ["atm"]),
    "P": (["atm"], []),
    "Q": (["atm"], ["ocn"]),
    "S": ([], []),
    "T": (["glc"], ["lnd"]),
    "X": ([], []),
}


def decode_letter(df: DataFrame, alias: str = "alias") -> DataFrame:
    """Add ``active`` and ``data`` part lists by the alias's first letter; null when unknown or various."""
    letter = F.substring(F.col(alias), 1, 1)

    def lists(which: int) -> Column:
        cases = []
        for key, parts in DESIGNATIONS.items():
            if parts[which] is not None:
                cases.append((letter == key, F.array(*[F.lit(p) for p in parts[which]]).cast("array<string>")))
        return _first_true(cases)

    return df.withColumn("active", lists(0)).withColumn("data", lists(1))


def violations(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """One row per (row, broken rule); a rule is a SQL condition that should hold.

    All rules are checked in one scan. A condition that is null is not broken.
    """
    broken = F.array(*[F.when(~F.expr(condition), F.lit(name)) for name, condition in rules.items()])
    return df.withColumn("rule", F.explode(F.array_compact(broken)))
