"""Conversation repair against all ways to edit, plain Python over rows, and SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import cache

import pytest

from fieldloom.llm import repair
from fieldloom.llm.queries import QUERIES
from oracle import compare, connect

NAMES = {"s": "system", "u": "user", "a": "assistant", "?": "tool"}


def cheapest(rows):
    """(cost, letters, repaired rows) by trying every edit of (role, text, fault) rows, by cost and then letters."""

    @cache
    def best(i, roles):
        ways = [(0, "", ())] if i == len(rows) and roles in ("", "a") else []
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[roles]
        if i < len(rows):
            role, text, fault = rows[i]
            cost, letters, made = best(i + 1, roles)
            ways.append((cost + 3, "D" + letters, made))
            more = 1 if fault == "truncated" else 0
            for r in follow if fault not in ("blank", "duplicate") else "":
                if role[:1] == r:
                    cost, letters, made = best(i + 1, r)
                    ways.append((cost + more, "K" + letters, ((role, text), *made)))
                elif r != "s":
                    cost, letters, made = best(i + 1, r)
                    ways.append((cost + 2 + more, "R" + letters, ((NAMES[r], text), *made)))
        for r in follow.replace("s", ""):
            # never more than two rows are worth inserting at one place
            for cost, letters, made in inserted(i, r):
                ways.append((cost, letters, made))
        return min(ways)

    def inserted(i, r):
        found = []
        after = plain(i, r)
        if after:
            found.append((after[0] + 2, "I" + after[1], ((NAMES[r], ""), *after[2])))
        other = "a" if r == "u" else "u"
        after = plain(i, other)
        if after:
            found.append((after[0] + 4, "II" + after[1], ((NAMES[r], ""), (NAMES[other], ""), *after[2])))
        return found

    @cache
    def plain(i, roles):
        """Best without an insertion first."""
        if i == len(rows):
            return (0, "", ()) if roles in ("", "a") else None
        role, text, fault = rows[i]
        cost, letters, made = best(i + 1, roles)
        ways = [(cost + 3, "D" + letters, made)]
        more = 1 if fault == "truncated" else 0
        for r in {"": "su", "s": "u", "u": "a", "a": "u"}[roles] if fault not in ("blank", "duplicate") else "":
            cost, letters, made = best(i + 1, r)
            if role[:1] == r:
                ways.append((cost + more, "K" + letters, ((role, text), *made)))
            elif r != "s":
                ways.append((cost + 2 + more, "R" + letters, ((NAMES[r], text), *made)))
        return min(ways)

    return best(0, "")


def faults(rows):
    """(role, text, fault) of a conversation's (role, text) rows in order."""
    found, seen = [], set()
    for role, text in rows:
        letters = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
        seen.add((role, text))
        found.append((role, text, fault))
    return found


def damage(conv, turn, role, text):
    def plain(x):
        return " " if x is None else str(x)

    kind = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
    role, text = plain(role), plain(text)
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def expected(table, hurt=damage):
    """Counter of the report's rows for (conv, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in table:
        convs.setdefault(conv, []).extend(hurt(conv, turn, role, text))
    made = Counter()
    for conv, rows in convs.items():
        def place(r):
            digest = hashlib.md5((hashlib.md5(r[1].encode()).hexdigest() + hashlib.md5(r[2].encode()).hexdigest()).encode()).hexdigest()
            return (r[0] is not None, r[0] or 0, digest)

        rows.sort(key=place)
        named = faults([r[1:] for r in rows])
        count = Counter(f for *_, f in named)
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, done = cheapest(tuple(named)) if rows else (0, "", ())
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        made[conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest] += 1
    return made


COLUMNS = ["conv_id", *repair.NAMES, "repaired_sha256"]


def rows_of(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def random_codes(rng, n):
    return bytes(3 * rng.choice([0, 1, 1, 1, 2, 2, 2, 3]) + rng.choice([0, 0, 0, 1, 1, 2]) for _ in range(n))


def as_rows(codes):
    return tuple((NAMES["sua?"[c // 3]], f"t{i}", ("", "truncated", "blank")[c % 3]) for i, c in enumerate(codes))


def test_edits_against_all_ways():
    rng = random.Random(3)
    for _ in range(1500):
        codes = random_codes(rng, rng.randrange(12))
        assert repair.cheapest_edits(codes) == cheapest(as_rows(codes))[:2], as_rows(codes)


@pytest.mark.parametrize("look", [1, 2, 64])
def test_blocks_give_what_one_block_gives(monkeypatch, look):
    monkeypatch.setattr(repair, "LOOK", look)
    rng = random.Random(4)
    for trial in range(300):
        codes = random_codes(rng, rng.randrange(60)) if trial % 3 else bytes(rng.choice([(3, 6), (3, 3), (4, 7), (6, 6, 3)])) * rng.randrange(20)
        whole = repair.cheapest_edits(codes, 10_000)
        assert all(repair.cheapest_edits(codes, size) == whole for size in (1, 2, 3, 7, 16)), codes


def test_very_long_conversation_in_blocks():
    rng = random.Random(5)
    codes = random_codes(rng, 30_000)
    cost, audit = repair.cheapest_edits(codes)
    assert (cost, audit) == repair.cheapest_edits(codes, 4096)
    assert sum(x in "KRD" for x in audit) == len(codes)


AWKWARD = [
    (1, 0, "user", "One."), (1, 1, "assistant", "Two!"), (1, 3, "user", "Three"), (1, 7, "assistant", "  \t\n"),
    (2, 0, "system", "Be kind."), (2, 1, "assistant", "Hello?"), (2, 1, "assistant", "Hello?"), (2, None, "user", "No turn."),
    (3, None, None, None), (3, None, "user", None), (None, 0, "user", "No id."), (None, 0, "user", "No id."), (None, None, None, "x"),
    (4, 0, "", "Empty role."), (4, 1, "usher", "Begins with u."), (4, 2, "Über", "ü?"), (5, -3, "user", "long " * 40_000 + "end."),
    (5, 9, "assistant", "日本。"), (6, 0, "user", "A.\n"), (6, 1, "assistant", "B. "), (7, 5, "tool", "x.y"), (8, 1, "user", "Ok."), (8, 1, "assistant", "Ok."),
]
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def same_rows(conv, turn, role, text):
    return [(turn, " " if role is None else role, " " if text is None else text)]


@pytest.mark.parametrize("clashes", [False, True])
def test_awkward_conversations(spark, clashes):
    table = spark.createDataFrame(AWKWARD, CONVERSATIONS)
    if clashes:
        for name in ("conv", "dropped", "digest", "kind", "copy", "audit", "initial", "Again"):
            table = table.selectExpr("*", f"'x' AS {name}")
    assert rows_of(repair.repair_report(repair.damaged(table))) == expected(AWKWARD)
    assert rows_of(repair.repair_report(repair.rows_of(table))) == expected(AWKWARD, same_rows)


def test_repaired_rows_alternate(spark):
    rows = repair.rows_of(spark.createDataFrame(AWKWARD, CONVERSATIONS))
    reports = repair.judged(rows)
    made = {}
    for r in repair.repaired_rows(rows, reports).orderBy("place").collect():
        made.setdefault(r.conv, []).append((r.place, r.role, r.text))
    for found in made.values():
        assert [p for p, _, _ in found] == list(range(len(found)))
        assert re.fullmatch("s?(ua)+", "".join(r[0] for _, r, _ in found))


def test_empty_table(spark):
    assert repair.repair_report(repair.damaged(spark.createDataFrame([], CONVERSATIONS))).count() == 0


def test_one_conversation_of_very_many_rows(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i % 1700}." if i % 5 else "") for i in range(6000)] + [(2, 0, "user", "Ok.")]
    got = rows_of(repair.repair_report(repair.rows_of(spark.createDataFrame(rows, CONVERSATIONS))))
    import sys

    sys.setrecursionlimit(60_000)
    audits = {c: r for r in got for c in [r[0]]}
    assert audits[2][6:8] == (2, "KI")
    named = faults([r[2:] for r in rows[:6000]])
    codes = bytes(3 * "sua".index(r[0]) + (0 if not f else 1 if f == "truncated" else 2) for r, _, f in named)
    assert audits[1][6:8] == repair.cheapest_edits(codes, 700)
    assert audits[1][2:5] == tuple(sum(f == k for *_, f in named) for k in ("blank", "duplicate", "truncated"))


def test_query_against_rows(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op13_conversation_repair"][0](spark, sf_dir)) == expected(table)


def test_query_against_sql(spark, sf_dir):
    run, sql = QUERIES["op13_conversation_repair"]
    assert compare(spark, sf_dir, run, sql, connect(sf_dir)) == []
