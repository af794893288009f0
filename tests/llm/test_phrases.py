"""Phrase mining against plain counts and SQL."""

from __future__ import annotations

import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import awkward_rows, frame, rows_of
from pyspark.sql import functions as F

from fieldloom.llm import phrases
from fieldloom.llm.queries import QUERIES
from oracle import compare, connect

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def listed(docs, support=10, max_words=3, within=50, first=2000):
    """The rows of ``collocations`` of (lang, text) rows, counted phrase by phrase."""
    counts, made = defaultdict(Counter), []
    for lang, text in docs:
        found = counts[lang or "und"]
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LETTERS)):
            w = re.findall("[^\x20\x09]+", piece)
            for n in range(1, max_words + 1):
                found.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for lang, f in counts.items():
        total = sum(c for p, c in f.items() if len(p) == 1)
        frequent = {p: c for p, c in f.items() if len(p) > 1 and c >= support}
        longer = Counter()
        for p, c in frequent.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    longer[p[s : s + m]] = max(longer[p[s : s + m]], c)
        rows = []
        for p, a in frequent.items():
            if p in longer and 100 * longer[p] >= within * a:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:first], 1):
            made.append((lang, rank, p.decode(), -a, left, right, total, -score))
    return Counter(made)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_query(spark, sf_dir):
    run, sql = QUERIES["op12_collocations"]
    assert compare(spark, sf_dir, run, sql, connect(sf_dir)) == []


def test_query_on_the_smallest_tables_against_plain_counts(spark):
    small = "/root/testdata/sf0.001"
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert rows_of(QUERIES["op12_collocations"][0](spark, small), *COLUMNS) == listed(docs)


@pytest.mark.parametrize("settings", [{}, {"support": 3, "max_words": 4, "within": 80}, {"support": 2, "max_words": 2, "listed": 5}, {"support": 5, "shards": 5, "max_words": 5}])
def test_awkward_rows(spark, settings):
    want = listed([(r[2], r[1]) for r in awkward_rows()], *(settings.get(k, d) for k, d in (("support", 10), ("max_words", 3), ("within", 50), ("listed", 2000))))
    assert want
    for clashes in (False, True):
        docs = frame(spark, clashes=clashes).repartition(7)
        assert rows_of(phrases.collocations(docs, **settings), *COLUMNS) == want
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [(1, "no phrase twice here", "en", "a", 1)])).count() == 0


def test_hot_phrases_and_odd_separators(spark):
    """One phrase in every row, all partings, bytes beyond ASCII, and words that differ in case beyond A-Z."""
    rows = [(i, f"The Same OLD line\x0b{i % 3} à  la\tcarte;À la carte\r\nx\xa0y z{i % 7} . x\xa0y z{i % 7}", ["en", None, "fr"][i % 3], "a", 0) for i in range(900)]
    assert rows_of(phrases.collocations(frame(spark, rows)), *COLUMNS) == listed([(r[2], r[1]) for r in rows])


def test_words_that_are_names_of_languages(spark):
    rows = [(i, "en en en. es es" if i % 2 else "es es es. en en", "en" if i % 2 else "es", "a", 0) for i in range(24)]
    assert rows_of(phrases.collocations(frame(spark, rows)), *COLUMNS) == listed([(r[2], r[1]) for r in rows])


def test_texts_in_parts(monkeypatch):
    """Parts of a text have its phrases, each once, whatever their size."""
    text = ("one two three four five, six seven " * 9 + "averylongwordwithoutanend" * 4 + " x y z. " + "a b " * 30).encode()
    for size in (1, 2, 5, 17, 64, 10_000):
        for n in (2, 3, 4):
            found = Counter()
            for raw, carried in phrases.parts_of(text, n, size):
                w = phrases.Words(raw, "en", carried)
                for i in range(len(w) - n + 1):
                    if w.piece[i] == w.piece[i + n - 1] and w.fresh[i + n - 1]:
                        found[tuple(w.phrase(i, n).split())] += 1
            whole = Counter()
            for p in re.split(rb"[.,;:!?\x0a-\x0d]", text):
                p = p.split()
                whole.update(tuple(p[i : i + n]) for i in range(len(p) - n + 1))
            assert found == whole, (size, n)


def test_long_texts_are_read_in_parts(spark):
    rows = [(1, " ".join(f"w{i % 11} v{i % 7}" for i in range(900_000)), "en", "a", 0), (2, "w1 v1 w2 v2", "en", "a", 0)]
    assert rows_of(phrases.collocations(frame(spark, rows)), *COLUMNS) == listed([(r[2], r[1]) for r in rows])


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    """With bitmaps of 256 bits nearly everything is a candidate."""
    monkeypatch.setattr(phrases, "BITMAP_BITS", 8)
    docs = [(r[2], r[1]) for r in awkward_rows()]
    assert rows_of(phrases.collocations(frame(spark)), *COLUMNS) == listed(docs)


def test_shards_beyond_the_support_are_harmless(spark):
    docs = [(r[2], r[1]) for r in awkward_rows()]
    assert rows_of(phrases.collocations(frame(spark).repartition(9), shards=40), *COLUMNS) == listed(docs)


def test_scores_are_exact_beyond_64_bits(spark):
    row = spark.sql("SELECT (cast(1000000 AS decimal(38,0)) * cast(a AS decimal(38,0)) * cast(a AS decimal(38,0))) div (cast(l AS decimal(38,0)) * cast(r AS decimal(38,0))) AS s FROM VALUES (3000000000001L, 3000000000007L, 6000000000011L) t(a, l, r)").first()
    assert row.s == 1_000_000 * 3000000000001**2 // (3000000000007 * 6000000000011)


def test_numbers_of_words():
    """Words that differ have other numbers, in one language and in another; where they stand changes nothing."""
    words = sorted({f"{a}{b}{c}" for a in "abz" for b in "abzé\x00" for c in ["", "a", "aa", "ab" * 40]})
    w = phrases.Words(" ".join(words).encode(), "en")
    back = phrases.Words("\n  ".join(words[::-1]).encode(), "en")
    other = phrases.Words(" ".join(words).encode(), "fr")
    for lane in (0, 1):
        numbers = w.numbers()[:, lane].tolist()
        assert numbers == back.numbers()[:, lane].tolist()[::-1] and len({*numbers, *other.numbers()[:, lane].tolist()}) == 2 * len(words)
    assert (w.numbers(1)[:, 0] == w.numbers()[:, 0]).all()


def test_memory_of_numbers():
    """The letters of a part are not worked on all at once: numbers take a few times their own size and the part's."""
    raw = b" ".join(b"word%d" % (i % 5000) for i in range(400_000))
    words = phrases.Words(raw, "en")
    tracemalloc.start()
    numbers = words.numbers()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20 and len({tuple(x) for x in numbers[:5000].tolist()}) == 5000 and (numbers[:5000] == numbers[-5000:]).all()


def test_counts_are_handed_on_in_parts():
    found = {b"%d" % i: i for i in range(2 * phrases.HANDED + 5)}
    parts = list(phrases._handed(found))
    assert [len(p) for p, _ in parts] == [phrases.HANDED, phrases.HANDED, 5]
    assert {p: n for ps, ns in parts for p, n in zip(ps, ns)} == found


def test_tasks_hand_on_words_and_numbers_only(spark, monkeypatch):
    """No task spells the phrases it has found, which are more in each task the larger the corpus: frequent ones are spelled by joins."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(60)), "en", "a", 0) for i in range(160)]
    docs = frame(spark, rows).repartition(16)
    made, plain = [], type(docs).mapInArrow

    def noted(self, func, schema, *rest, **named):
        made.append(schema)
        return plain(self, func, schema, *rest, **named)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    assert rows_of(phrases.collocations(docs), *COLUMNS) == listed([(r[2], r[1]) for r in rows])
    assert [x for x in made if "phrase" in x] == ["lang string, phrase string, number long, n long"]


def test_tallies_of_phrases_that_share_a_number():
    """Where two phrases have one number their words count them apart."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 500).astype(np.uint64), rng.integers(0, 9, 500).astype(np.uint64)
    want = Counter(zip(a.tolist(), b.tolist()))
    for numbers in (a * np.uint64(16) + b, a, np.zeros(500, np.uint64)):
        (x, y), n = phrases.tallied(numbers, [a, b])
        assert dict(zip(zip(x.tolist(), y.tolist()), n.tolist())) == want and len(n) == len(want)
    assert len(phrases.tallied(a[:0], [a[:0], b[:0]])[1]) == 0


def test_words_that_share_a_number_get_others(spark, monkeypatch):
    """Where all words have one number at first, the next seed tells them apart."""
    plain = phrases.word_counts

    def clashing(texts, seed=0):
        return plain(texts, seed) if seed else plain(texts).withColumn("number", F.lit(7).cast("long"))

    monkeypatch.setattr(phrases, "word_counts", clashing)
    rows = [(i, "one two three. two one", "en", "a", 0) for i in range(12)]
    words, seed = phrases.numbered_words(frame(spark, rows).select("lang", "text"))
    assert seed == 1 and {(r.phrase, r.n) for r in words.collect()} == {("one", 24), ("two", 24), ("three", 12)}
    assert rows_of(phrases.collocations(frame(spark, rows)), *COLUMNS) == listed([(r[2], r[1]) for r in rows])
