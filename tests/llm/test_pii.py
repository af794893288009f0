"""Personal data: patterns against plain regular expressions, disclosure against plain counts, and SQL."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

from cases import awkward_rows, frame

from fieldloom.llm import pii
from fieldloom.llm.queries import QUERIES
from oracle import compare, connect

SPACES = "[\x20\x09-\x0d]"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    """(start, place, end, value, before, after) by the plain patterns."""
    found = []
    for place, (kind, pattern) in enumerate(pii.PLAIN.items()):
        matches = list(re.finditer(pattern, text))
        for k, m in enumerate(matches):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            value = m.group().lower() if kind == "email" else ".".join(str(int(x)) for x in m.group().split(".")) if kind == "ip" else digits
            low = matches[k - 1].end() if k else 0
            high = matches[k + 1].start() if k + 1 < len(matches) else len(text)
            found.append((m.start(), place, m.end(), value, text[max(low, m.start() - pii.REACH - 1) : m.start()], text[m.end() : min(high, m.end() + pii.REACH + 1)]))
    return sorted(found)


def words_near(m):
    """(term, start, end) of the whole words of a mention's context."""
    start, _, end, _, before, after = m
    found = []
    for chunk, at, last in ((before, start - len(before), False), (after, end, True)):
        pieces, places = [], []
        for p in re.split(SPACES, chunk):
            pieces.append(p)
            places.append(at)
            at += len(p) + 1
        if len(chunk) > pii.REACH:
            cut = -1 if last else 0
            del pieces[cut], places[cut]
        for p, place in zip(pieces, places):
            lead = len(p) - len(p.lstrip(pii.MARKS))
            word = p.strip(pii.MARKS)
            if is_term(word.lower()):
                found.append((word.lower(), place + lead, place + lead + len(word)))
    return found


def is_term(word):
    return all(p.isalpha() for p in re.split("['’-]", word))


def spans(docs, support=pii.SUPPORT, alpha=pii.ALPHA):
    """Spans (start, name, end) of each (id, text)."""
    texts = [t or "" for _, t in docs]
    found = [base(t) for t in texts]
    contexts, with_term, n_t = defaultdict(set), defaultdict(set), Counter()
    for t, ms in zip(texts, found):
        n_t.update({w for p in re.split(SPACES, t.lower()) for w in [p.strip(pii.MARKS)] if is_term(w)})
        for m in ms:
            contexts[m[1], m[3]].add(m[4:])
            for term, _, _ in words_near(m):
                with_term[m[1], m[3], term].add(m[4:])
    n = len(docs)

    def disclosed(n_e, both, alone):
        return n_e < n and both >= support and both >= alone * (n_e / n) ** (1 - alpha)

    action = {}
    for (place, value, term), c in with_term.items():
        n_e = len(contexts[place, value])
        if n_e < support or not disclosed(n_e, len(c), n_t[term]):
            continue
        head = term[: pii.CLASS]
        inside = sum(len(x) for (p, v, t), x in with_term.items() if (p, v) == (place, value) and len(t) > pii.CLASS and t[: pii.CLASS] == head)
        whole = sum(k for t, k in n_t.items() if len(t) > pii.CLASS and t[: pii.CLASS] == head)
        general = len(term) > pii.CLASS and not disclosed(n_e, inside, whole)
        action[place, value, term] = 4 if general else 5
    made = []
    for ms in found:
        added = defaultdict(int)
        for m in ms:
            for term, s, e in words_near(m):
                if (m[1], m[3], term) in action:
                    added[s, e] = max(added[s, e], action[m[1], m[3], term])
        made.append(sorted({(s, p, e) for s, p, e, *_ in ms} | {(s, p, e) for (s, e), p in added.items()}))
    return made


def described(found):
    return ",".join(f"{pii.NAMES[p]}:{s}:{e}" for s, p, e in found)


def expected(docs, **settings):
    made = Counter()
    for (i, _), found in zip(docs, spans(docs, **settings)):
        own = [x for x in found if x[1] < 4]
        counts = [sum(p == k for _, p, _ in own) for k in range(4)]
        made[(i, *counts, hashlib.sha256(described(own).encode()).hexdigest(), described(found))] += 1
    return made


COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def rows(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


PEOPLE = [
    *(f"Please write to Brigitte, at ann.{'x' if i % 2 else 'X'}@mail.example.com about case w{i}" for i in range(5)),
    *(f"call dentist Quorl or +1 (974) 555-3436 (extension k{i}) before noon" for i in range(6)),
    *(f"the dentist of {x} is away" for x in ("Rome", "Oslo", "Bern", "Kyiv")),
    "see the dental notes", "Brigittine nuns", "Brisk walk " * 20, "dentist " * 30, "Quorn", "Brigade brim brick", "dental dent denture",
    *(["please write to the people at noon and call about a case before extension or away"] * 40),
    *(["mirror copy ip 10.0.0.7 of the Zebedee node"] * 6),
    *(f"ip 10.0.0.{i} then 010.0.0.{i}; x Node{i} +{i}0 12 34 56 78 90 " + "y" * 90 for i in range(3)),
]
HARD = [
    "a@b.c@d.e", "a@b.com._x@c.d", "x@y", "@a.b", "a@@b.c", "a@b..c a@b.c.", "a@-.-", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1 1.1.1.256 0255.0.0.01", "999999999999.1.1.1", "01.02.03.004",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "0000 0000 0000 00", "1" * 19, "1" * 20, "49927398716 49927398716", "+1 (974) 555-3436.", "+1-2-3", "++12345678901", "+1((((((", "+123 456 7890 ) ( -",
    "+1 234 567 8901+1 234 567 8901", "mail:x@y.zz;+44 20 7946 0958,192.168.0.1", "é4111111111111111é", "\U0001f600 a.b@c.de \U0001f600 +1 974 555 3436", "a@b.c\n1.2.3.4\t5", "(x@y.z)", "x%y+z_-@q-.r--.s",
]


def as_rows(texts):
    return [(i, t, "en", "a", 0) for i, t in enumerate(texts)]


def pairs(made):
    return [(r[0], r[1]) for r in made]


def test_query_against_sql(spark, sf_dir):
    run, sql = QUERIES["op11_personal_data"]
    assert compare(spark, sf_dir, run, sql, connect(sf_dir)) == []


def test_query_against_plain_expressions(spark):
    small = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert rows(QUERIES["op11_personal_data"][0](spark, small)) == expected(docs)


def test_hard_and_random_texts(spark):
    rng = random.Random(2)
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for alphabet in ("a.@-+", "1.2", "1 -4", "+1 ().-2a", "a1@. +-") for _ in range(300)]
    made = as_rows(HARD + some)
    assert rows(pii.report(frame(spark, made))) == expected(pairs(made))


def test_terms_that_disclose(spark):
    """Words that stand with an entity alone are generalised or removed; common ones and copies' words stay."""
    made = as_rows(PEOPLE)
    got = rows(pii.report(frame(spark, made)))
    assert got == expected(pairs(made))
    listed = {(PEOPLE[r[0]][int(s) : int(e)], kind) for r in got for x in r[6].split(",") if x for kind, s, e in [x.split(":")] if kind in pii.ADDED}
    assert ("Quorl", "generalise") in listed or ("Quorl", "remove") in listed
    words = {w for w, _ in listed}
    assert "Brigitte" in words and not words & {"Zebedee", "to", "the"}
    for settings in ({"support": 2, "alpha": 0.5}, {"support": 1, "alpha": 0.99}):
        assert rows(pii.report(frame(spark, made), **settings)) == expected(pairs(made), **settings)


def test_sql_where_terms_disclose(spark, tmp_path):
    frame(spark, as_rows(PEOPLE + HARD)).write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    run, sql = QUERIES["op11_personal_data"]
    assert compare(spark, str(tmp_path), run, sql, con) == []
    assert any("generalise" in r[6] or "remove" in r[6] for r in con.execute(sql).fetchall())


def test_awkward_rows(spark):
    made = [*awkward_rows(), *((i, t, None, None, None) for i, t in enumerate(PEOPLE)), (1, PEOPLE[0], "en", "a", 1), (None, PEOPLE[0], "en", "a", 1)]
    for clashes in (False, True):
        docs = frame(spark, made, clashes)
        if clashes:
            docs = docs.selectExpr("*", "'x' AS mentions", "1 AS whole", "'y' AS term", "2 AS spans", "3 AS place")
        assert rows(pii.report(docs)) == expected(pairs(made))
        clean = pii.sanitise(docs)
        assert clean.columns == docs.columns and clean.count() == len(made)
    assert pii.report(frame(spark, [])).count() == 0
    assert pii.sanitise(frame(spark, [])).count() == 0


def test_sanitised_texts(spark):
    made = as_rows(PEOPLE + HARD)
    got = {r.doc_id: r.text for r in pii.sanitise(frame(spark, made)).collect()}
    for (i, text), found in zip(pairs(made), spans(pairs(made))):
        want, at = "", 0
        for s, p, e in found:
            if s >= at:
                mark = f"[{pii.NAMES[p].upper()}]" if p < 4 else text[s : s + pii.CLASS] + "*" if p == 4 else "[...]"
                want += text[at:s] + mark
            at = max(at, e)
        assert got[i] == want + text[at:]


def test_long_texts(spark):
    """Runs that patterns could read again and again, and very many mentions in one text."""
    made = as_rows(["a" * 400_000, "7" * 400_000, "1." * 200_000, "+1" + "(" * 400_000, "a@" * 200_000, ", ".join(f"u{i}@x.example" for i in range(20_000)), ",".join(map(str, range(10, 30_000)))])
    got = {r.doc_id: r for r in pii.report(frame(spark, made)).collect()}
    assert got[5].n_email == 20_000 and got[2].n_ip == 50_000
    assert Counter(tuple(got[5][c] for c in COLUMNS[:6]) for _ in "x") == Counter(r[:6] for r in expected(pairs(made[5:6])).elements() for r in [(5, *r[1:])])


def test_plan_is_native(spark, sf_dir):
    plan = QUERIES["op11_personal_data"][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
