"""Secrets in texts: regular expressions behind an inverted index of trigrams.

Each rule's expression is turned into a Boolean query over trigrams that every match must contain.
The index has a posting (trigram, row) for the trigrams that some query names; intersecting the
postings of a query's clauses leaves the rows that can match, and only those are searched with the
rule's expression. A rule without mandatory trigrams searches every row. All work on rows is DataFrame
expressions; only the few rules are looked at in Python, on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.text import fresh, row_key

#: Strings of a part of an expression that are told apart; beyond that the part has no mandatory trigrams.
EXACT = 64


@dataclass(frozen=True)
class Rule:
    """``pattern``'s leftmost matches that do not overlap, if ``group`` has at least ``least`` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Trigrams of a clause that are indexed, the rarer ones: fewer still leave every row that can match.
CLAUSE = 3

#: The three rules that every scan has.
BASE = (
    Rule("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Spans that are added: formats of keys whose makers publish them.
ADDED = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", "AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED


def _minimal(clauses: set[frozenset]) -> set[frozenset]:
    """Clauses without those that another one makes needless; no clause at all if an empty one says yes."""
    return {c for c in clauses if not any(d < c for d in clauses)}


def _and(a: set[frozenset], b: set[frozenset]) -> set[frozenset]:
    return _minimal({x | y for x in a for y in b}) if len(a) * len(b) <= EXACT**2 else min(a, b, key=len)


def _strings_query(strings: set[str]) -> set[frozenset]:
    return _minimal({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


YES = {frozenset()}


def _part(op, argument) -> tuple[set[str] | None, set[frozenset]]:
    """Of a part of an expression: the strings that match it, in lower case (None: too many), and clauses of
    trigrams, all of one of which a match contains."""
    name = str(op)
    if name == "LITERAL":
        return {chr(argument).lower()}, YES
    if name == "IN":
        return _members(argument), YES
    if name == "AT":
        return {""}, YES
    if name == "SUBPATTERN":
        return _sequence(argument[-1])
    if name == "BRANCH":
        parts = [_sequence(t) for t in argument[1]]
        clauses = _minimal(set().union(*(q for _, q in parts)))
        exact = None if any(e is None for e, _ in parts) else set().union(*(e for e, _ in parts))
        return (exact if exact and len(exact) <= EXACT else None), clauses
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, part = int(argument[0]), int(argument[1]), argument[2]
        exact, clauses = _sequence(part)
        if exact is not None and high <= 4 and len(exact) ** high <= EXACT:
            return {"".join(x) for n in range(low, high + 1) for x in product(exact, repeat=n)}, clauses if low else YES
        return None, clauses if low else YES
    return None, YES


def _sequence(tree) -> tuple[set[str] | None, set[frozenset]]:
    run, query, whole = {""}, YES, True
    for exact, clauses in (_part(*x) for x in tree):
        if exact is not None and len(run) * len(exact) <= EXACT:
            run = {a + b for a in run for b in exact}
            continue
        whole = False
        query = _and(query, _strings_query(run))
        query, run = (_and(query, clauses), {""}) if exact is None else (query, exact)
    return (run if whole else None), _and(query, _strings_query(run))


def _members(items) -> set[str] | None:
    """Characters of a set in lower case; None if it is negated, has classes or is large."""
    found: set[str] = set()
    for op, argument in items:
        if str(op) == "LITERAL":
            found.add(chr(argument).lower())
        elif str(op) == "RANGE" and argument[1] - argument[0] < EXACT // 4:
            found.update(chr(c).lower() for c in range(argument[0], argument[1] + 1))
        else:
            return None
    return found if len(found) <= EXACT // 4 else None


def trigram_query(pattern: str) -> list[list[str]]:
    """Clauses of trigrams; text in which ``pattern`` matches has, in lower case, all of some clause.

    Without a clause that says anything the list is empty: such a pattern must be tried on every text.
    """
    _, clauses = _sequence(re._parser.parse(pattern))
    return [] if frozenset() in clauses else sorted(sorted(c) for c in clauses)


def _common(trigram: str) -> tuple[int, str]:
    return sum(c in "etaoinshrdlu" for c in trigram), trigram


SPANS = "array<struct<start:int,place:int,end:int>>"


def spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of a rule's matches in a text, as structs of start, the rule's place, and end, in code points.

    The matches and what lies between them alternate; their lengths add up to the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    steps = F.zip_with(
        F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("match"))),
        judged,
        lambda x, j: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), F.length(j).alias("judged")),
    )

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + F.coalesce(x["match"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"))
        more = F.when(x["judged"] >= rule.least, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(end.alias("at"), more.alias("spans"))

    none = F.array().cast(SPANS)
    walked = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda done: done["spans"])
    return F.when(text.rlike(rule.pattern), walked).otherwise(none)


def candidates(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """``key`` and ``rules`` (kinds) of the rows that, by the index, can hold matches of indexed rules."""
    clauses = [(r.kind, i, sorted(c, key=_common)[:CLAUSE]) for r in rules for i, c in enumerate(trigram_query(r.pattern))]
    named = sorted({t for _, _, c in clauses for t in c})
    if not named:
        return docs.select(key, F.array().cast("array<string>").alias("rules")).filter("false")
    low = F.lower(F.col(text))
    held = F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in named))
    # two steps: the lower case is then taken once for all trigrams
    postings = docs.select(key, held.alias("held")).select(key, F.explode("held").alias("trigram")).filter("trigram IS NOT NULL")

    def uses(trigram: str) -> Column:
        """The clauses that name a trigram, and its bit in each."""
        return F.array(
            *(
                F.struct(
                    F.lit(kind).alias("kind"),
                    F.lit(i).alias("clause"),
                    F.lit(1 << c.index(trigram)).cast("long").alias("bit"),
                    F.lit((1 << len(c)) - 1).cast("long").alias("full"),
                )
                for kind, i, c in clauses
                if trigram in c
            )
        )

    by_trigram = F.create_map(*(x for t in named for x in (F.lit(t), uses(t))))
    met = postings.select(key, F.inline(F.element_at(by_trigram, F.col("trigram"))))
    whole = met.groupBy(key, "kind", "clause", "full").agg(F.bit_or("bit").alias("bits")).filter("bits = full")
    return whole.groupBy(key).agg(F.collect_set("kind").alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned too: the spans of all rules.

    Spans are structs of start, place (of the rule in ``rules``) and end, by start and then place.
    Null and empty texts have none; rows that repeat have theirs each. Spans of different rules may overlap.
    """
    key, may, out = fresh(docs, "secret_key"), fresh(docs, "secret_rules"), fresh(docs, "secret_spans")
    keyed = docs.withColumn(key, row_key(doc_id, text))
    chosen = candidates(keyed, key, text, rules).withColumnRenamed("rules", may)
    whole = F.coalesce(F.col(text), F.lit(""))
    found = []
    for place, rule in enumerate(rules):
        made = spans(whole, rule, place)
        found.append(F.when(F.array_contains(may, rule.kind), made).otherwise(F.array().cast(SPANS)) if trigram_query(rule.pattern) else made)
    joined = keyed.join(chosen, key, "left")
    return joined.select(*docs.columns, F.array_sort(F.concat(*found)).alias(out)), out


def described(spans_column: str, rules: tuple[Rule, ...], only: int | None = None) -> Column:
    """``kind:start:end`` of the spans (of the first ``only`` rules), joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    chosen = F.col(spans_column) if only is None else F.filter(spans_column, lambda s: s["place"] < only)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the matches of each base rule, ``base_sha256`` and ``spans``."""
    found, out = scan(docs, rules, doc_id, text)
    places = F.transform(out, lambda s: s["place"])
    counts = [F.size(F.filter(places, lambda p: p == F.lit(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules[: len(BASE)])]
    return found.select(doc_id, *counts, F.sha2(described(out, rules, len(BASE)), 256).alias("base_sha256"), described(out, rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]", doc_id: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with each secret, overlapping ones together, replaced by ``mask``; ``length`` follows the text if present.

    Texts without secrets, null ones too, stay as they are.
    """
    found, out = scan(docs, rules, doc_id, text)

    def step(done: Column, span: Column) -> Column:
        # a span that begins within the one before belongs to its mask
        before = F.when(span["start"] >= done["at"], F.concat(F.substring(text, done["at"] + 1, span["start"] - done["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), F.concat(done["made"], before).alias("made"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("made"))
    masked = F.aggregate(out, start, step, lambda done: F.concat(done["made"], F.substring(text, done["at"] + 1, F.length(text) - done["at"])))
    some = F.size(out) > 0
    found = found.withColumn(text, F.when(some, masked).otherwise(F.col(text)))
    if length in docs.columns:
        found = found.withColumn(length, F.when(some, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return found.select(*docs.columns)


def report_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The SQL that gives ``report`` of ``documents``: every rule tried on every text, offsets from lengths."""
    parts = []
    for place, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT row, id, {place} AS place, '{r.kind}' AS kind, "
            f"string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS found, "
            f"regexp_extract_all(t, '{pattern}', {r.group}) AS judged, {r.least} AS least FROM d"
        )
    base = ", ".join(f"'{r.kind}'" for r in rules[: len(BASE)])
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules[: len(BASE)])
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place){}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id AS id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
x AS (SELECT row, place, kind, least, gaps, found, judged, unnest(range(1, len(found) + 1)) AS i FROM m WHERE len(found) > 0),
s AS (SELECT row, place, kind, length(judged[i]) >= least AS ok, length(found[i]) AS n,
  CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS s FROM x),
f AS (SELECT row, place, kind, s, s + n AS e FROM s WHERE ok)
SELECT d.id AS doc_id, {counts},
  sha256({listed.format(f" FILTER (kind IN ({base}))")}) AS base_sha256, {listed.format("")} AS spans
FROM d LEFT JOIN f ON d.row = f.row GROUP BY d.row, d.id"""
