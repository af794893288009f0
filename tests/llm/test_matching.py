"""Near duplicates, repeated passages, contamination and secrets against plain Python."""

from __future__ import annotations

import pathlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward_rows, classes, fingerprint, frame, kept_by_jaccard, lowered, overlaps, rows_of

import corpus_pipeline
from fieldloom.llm import components, decontaminate, line_dedup, near_copies, secrets, simhash
from fieldloom.llm.queries import QUERIES
from fieldloom.session import scratch_path
from oracle import compare, connect


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def near(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count() <= 2


def component_ids(rows):
    """Counter of (id, fingerprint, component id) by comparing every fingerprint with every other."""
    prints = [fingerprint(t) for _, t in rows]
    root = classes(set(prints), near)
    smallest = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            smallest[root[p]] = min(smallest.get(root[p], i), i)
    return Counter((i, f"{p:016x}", smallest.get(root[p])) for (i, _), p in zip(rows, prints))


def test_simhash_query(spark, sf_dir, documents):
    got = QUERIES["op3_simhash"][0](spark, sf_dir)
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == component_ids(documents)


def test_simhash_of_awkward_rows(spark):
    rows = awkward_rows()
    for clashes in (False, True):
        docs = frame(spark, clashes=clashes)
        got = simhash.near_duplicates(docs)
        assert rows_of(got, "doc_id", "fingerprint", "component_id") == component_ids([r[:2] for r in rows])
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        best = {}
        for i, mark, component in component_ids([r[:2] for r in rows]):
            best.setdefault(component, []).append((i is None, i or 0, mark))
        assert Counter(r.doc_id for r in kept.collect()) == Counter(None if min(x)[0] else min(x)[1] for x in best.values())
    empty = frame(spark, [])
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("bucket", [2, 10_000])
def test_links_of_crowded_and_plain_buckets(spark, bucket):
    """Dense clusters and chains; a bucket limit of 2 sends nearly all through the values between."""
    rng = np.random.default_rng(8)
    bits = set()
    for _ in range(12):
        at = int(rng.integers(0, 2**63))
        for _ in range(25):
            for _ in range(int(rng.integers(1, 4))):
                at ^= 1 << int(rng.integers(0, 64))
            bits.add(at)
    signed = [b - 2**64 if b >= 2**63 else b for b in bits]
    nodes = spark.createDataFrame([(b,) for b in signed], "bits long")
    got = {r.node: r.root for r in components.components(simhash.near_links(nodes, bucket)).collect()}
    want = classes(set(signed), near)
    assert {n: got.get(n, n) for n in signed} == want


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2**63, 200, dtype=np.uint64)
    bits[1::2] = bits[::2] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64)) ^ np.uint64(1 << 63)
    vertical = simhash.planes(bits)
    for shift in (1, 2, 65):
        alive = (1 << (200 - shift)) - 1
        got = simhash.from_lanes(simhash.within(vertical, shift, alive), 200).tolist()
        assert got == [i for i in range(200 - shift) if near(int(bits[i]), int(bits[i + shift]))]


def test_blocks_hold_whole_buckets():
    key = np.repeat(np.arange(100), np.random.default_rng(2).integers(1, 9, 100))
    made = pa.RecordBatch.from_arrays([pa.array(key % 3), pa.array(key), pa.array(np.arange(len(key)))], names=["band", "key", "bits"])
    order = np.lexsort((key, key % 3))
    made = made.take(pa.array(order))
    blocks = list(simhash.sorted_blocks(iter([made.slice(i, 7) for i in range(0, made.num_rows, 7)]), lanes=10))
    assert np.concatenate([b for _, b in blocks]).tolist() == made.column(2).to_pylist()
    seen = [set(k.tolist()) for k, _ in blocks]
    assert sum(map(len, seen)) == len(set().union(*seen)) and len(blocks) > 5


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 30)} | {201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_stage_against_jaccard(spark, sf_dir, documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == kept_by_jaccard(documents)


def test_near_dedup_of_chains_templates_and_awkward_rows(spark):
    """Edited copies on both sides of 0.8, chains of them, and texts that share a long common part only."""
    rng = np.random.default_rng(3)
    rows, common = [], [f"c{k}" for k in range(80)]
    for group in range(12):
        w = [f"g{group}w{k}" for k in range(120)]
        for _ in range(12):
            rows.append((len(rows), " ".join(w)))
            for _ in range(int(rng.integers(1, 5))):
                w[int(rng.integers(0, 120))] = f"n{rng.integers(0, 10**9)}"
    for group in range(60):
        rows.append((len(rows), " ".join(common + [f"t{group}x{k}" for k in range(40)])))
    order = rng.permutation(len(rows))
    rows = [rows[k] for k in order] + [(1000 + i if i is not None else None, t) for i, t, *_ in awkward_rows()]
    docs = frame(spark, [(i, t, "en", "a", 1) for i, t in rows], clashes=True)
    want = kept_by_jaccard(rows)
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == want
    assert 75 < sum(want.values()) < 200
    assert near_copies.keep_one(frame(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 100, 375, 1000])
def test_lanes_within_a_radius(radius):
    """Carry-save counters against the count of differing bits, for lanes that share most bits or few."""
    rng = np.random.default_rng(radius)
    bits = rng.integers(0, 1 << 64, (90, near_copies.BITS // 64), np.uint64)
    for i in range(1, 60):
        bits[i] = bits[i - 1]
        for k in rng.integers(0, near_copies.BITS, int(rng.integers(0, 2 * radius + 2))):
            bits[i, k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    vertical = near_copies.planes(bits)
    for shift in (1, 2, 7, 50):
        alive = rng.random(90 - shift) < 0.8
        got = simhash.from_lanes(near_copies.within(vertical, shift, simhash.to_lanes(alive), radius), 90)
        apart = np.bitwise_count(bits[:-shift] ^ bits[shift:]).sum(1)
        assert got.tolist() == np.flatnonzero(alive & (apart <= radius)).tolist()


@pytest.mark.parametrize("bucket", [near_copies.BUCKET, 300])
def test_templates_make_no_rows_of_pairs(spark, bucket):
    """2000 texts that have 200 of 260 words in common, no two of them similar enough: candidates stay few."""
    rng = np.random.default_rng(8)
    common, rows = [f"c{k}" for k in range(200)], []
    for i in range(2000):
        own = [f"t{i}x{k}" for k in range(60)]
        at = int(rng.integers(0, 5)) * 40
        rows.append((i, " ".join(common[:at] + own + common[at:]), "en", "a", 1))
    docs = frame(spark, rows).repartition(8)
    sets = [near_copies.shingles_of(r[1].encode(), 5) for r in rows]
    schema = "key long, node binary, size long, root binary, bits array<long>, keys array<long>"
    nodes = [near_copies._node(x) for x in sets]
    met = spark.createDataFrame([(1, bytearray(n), len(x), bytearray(n), near_copies.fingerprint_of(x).view(np.int64).tolist(), [1] * 32) for n, x in zip(nodes, sets)], schema)
    assert near_copies.met_pairs(met, 0.8, bucket).count() <= 2 * len(rows)
    assert near_copies.keep_one(docs, bucket=bucket).count() == 2000


def test_recall_of_candidates_by_similarity():
    """Of pairs of each band of similarity from 0.8 on, nearly all share a key and lie within the radius."""
    rng = np.random.default_rng(9)
    for size in (6, 20, 60, 200, 3000):
        tried = found = 0
        for _ in range(250 if size < 1000 else 40):
            share = rng.uniform(0.8, 0.98)
            common = int(np.ceil(2 * share / (1 + share) * size))
            x = rng.integers(0, 1 << 64, 2 * size - common, np.uint64)
            a, b = np.sort(x[:size]), np.sort(x[size - common :])
            both = len(np.intersect1d(a, b))
            if both < 0.8 * (len(a) + len(b) - both):
                continue
            tried += 1
            apart = int(np.bitwise_count(near_copies.fingerprint_of(a) ^ near_copies.fingerprint_of(b)).sum())
            shared = (near_copies.band_keys(a) == near_copies.band_keys(b)).any()
            found += bool(shared and apart <= near_copies.radius_of(0.8, min(len(a), len(b)) < near_copies.SMALL))
        assert tried and found >= 0.99 * tried, (size, found, tried)


def plain_passages(rows, min_words):
    """(doc_id, start, end) by walking documents in the order of their ids."""
    first, found, cut = {}, set(), {}
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for i, text in distinct:
        units = line_dedup.units_of(text or "")
        counts = [len(u[2]) for u in units]
        spans = set()
        for a in range(len(units)):
            reached = [b for b in range(a, len(units)) if sum(counts[a : b + 1]) >= min_words][:1]
            spans.update((a, b) for b in reached)
            reached = [b for b in range(a, -1, -1) if sum(counts[b : a + 1]) >= min_words][:1]
            spans.update((b, a) for b in reached)
        if units and not spans:
            spans = {(0, len(units) - 1)}
        cut[i, text] = [(a, b, tuple(w for u in units[a : b + 1] for w in u[2])) for a, b in sorted(spans)]
        for *_, words in cut[i, text]:
            first.setdefault(words, i)
    for i, text in distinct:
        units, seen, gone = line_dedup.units_of(text or ""), set(), set()
        for a, b, words in cut[i, text]:
            if first[words] != i or words in seen:
                gone.update(range(a, b + 1))
            seen.add(words)
        for a in sorted(gone):
            if a - 1 not in gone:
                b = a
                while b + 1 in gone:
                    b += 1
                found.add((i, units[a][0], units[b][1]))
    return found


def test_repeated_passages_query(spark, sf_dir, documents):
    got = QUERIES["op5_line_dedup"][0](spark, sf_dir).collect()
    assert {(r.doc_id, r.start, r.end) for r in got} == plain_passages(documents, line_dedup.MIN_WORDS)
    assert len(got) > 50


def test_later_exact_copies_go_whole(spark, documents):
    """Copies in the given table, and made ones: with a short last sentence, short as a whole, spliced with a short end."""
    long = " ".join(f"tok{i}" for i in range(25)) + "."
    made = [(0, f"{long} Short end."), (1, f"{long} Short end."), (2, "Six words stand in here. Only."), (3, "Six words stand in here. Only."), (4, f"Before it. {long} Short end. After it."), (5, "")]
    for rows in (made, documents):
        got = {}
        for r in line_dedup.repeated_passages(frame(spark, [(i, t, "en", "a", 1) for i, t in rows])).collect():
            got.setdefault(r.doc_id, []).append((r.start, r.end))
        seen, copies = set(), 0
        for i, text in sorted(rows):
            units = line_dedup.units_of(text or "")
            if units and tuple(tuple(u[2]) for u in units) in seen:
                copies += 1
                assert got[i] == [(units[0][0], units[-1][1])]
            seen.add(tuple(tuple(u[2]) for u in units))
        assert copies == 2 if rows is made else copies > 50
        if rows is made:
            assert [made[4][1][a:b] for a, b in got[4]] == [f"{long} Short end."] and not {0, 2, 5} & set(got)


def test_passage_spliced_into_the_middle_of_lines(spark):
    passage = "alpha beta gamma delta. " + " ".join(f"tok{i}" for i in range(15)) + ". " + " ".join(f"more{i}" for i in range(15)) + ". tail end here"
    rows = [(1, f"own start of one {passage} and so on.", "en", "a", 1), (2, f"different beginning {passage} other end.\nlast line.", "en", "a", 1), (3, "clean text. nothing here. at all.", "en", "a", 1)]
    docs = frame(spark, rows)
    got = line_dedup.repeated_passages(docs).collect()
    assert [(r.doc_id, r.n_words, r.kept_doc_id) for r in got] == [(2, 30, 1)]
    removed = rows[1][1][got[0].start : got[0].end]
    assert removed.startswith("tok0 ") and removed.endswith("more14.")
    left = {r.doc_id: r.text for r in line_dedup.remove_repeats(docs).collect()}
    assert left[2] == rows[1][1].replace(removed, "") and left[1] == rows[0][1] and left[3] == rows[2][1]


def test_passages_of_awkward_rows(spark):
    for clashes in (False, True):
        docs = frame(spark, clashes=clashes)
        got = {(r.doc_id, r.start, r.end) for r in line_dedup.repeated_passages(docs, 5).collect()}
        assert got == plain_passages([r[:2] for r in awkward_rows()], 5)
        assert line_dedup.remove_repeats(docs).columns == docs.columns
    assert line_dedup.repeated_passages(frame(spark, [])).count() == 0


def test_decontamination_query(spark, sf_dir, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontamination"][0](spark, sf_dir).collect()}
    # every document against every item is slow in plain Python: a quarter of them, and every pair that is found
    assert {p for p in got if p[0] % 4 == 0} == overlaps([(i, t) for i, t in documents if i % 4 == 0], items)
    texts, of_item = dict(documents), dict(items)
    assert all(overlaps([(i, texts[i])], [(j, of_item[j])]) for i, j in got if i % 4)
    assert len(got) > 10


def test_seeds_of_all_allowed_replacements():
    """Whatever words of an item are replaced, as many as an overlap allows, some seed of it stays."""
    for n in range(decontaminate.LEAST_WORDS, 21):
        window = min(n, decontaminate.OVERLAP)
        masks = decontaminate.MASKS if n >= decontaminate.OVERLAP else (*decontaminate.MASKS, decontaminate.SHORT_MASK)
        replaced = window - int(np.ceil(window * decontaminate.AGREE))
        for gone in itertools.combinations(range(window), replaced):
            assert any(all(at + k not in gone for k, bit in enumerate(m) if bit == "1") for m in masks for at in range(window - len(m) + 1)), (n, gone)


def test_short_items_with_replacements(spark):
    rng = random.Random(7)
    items, docs = [], []
    for n in range(5, 16):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        window = min(n, decontaminate.OVERLAP)
        for trial in range(6):
            copy = list(words)
            for k in rng.sample(range(window), window - int(np.ceil(window * decontaminate.AGREE)) + trial % 2):
                copy[k] = f"other{trial}x{k}"
            docs.append((n * 10 + trial, " ".join(["before"] * 9 + copy + ["after"] * 9)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, [(i, t, "en", "a", 1) for i, t in docs]), bench).collect()}
    assert got == overlaps(docs, items) and len(got) >= 30


def test_overlaps_with_words_replaced(spark):
    base = [f"w{i}" for i in range(30)]
    every_fifth = [x if i % 5 else "other" for i, x in enumerate(base)]
    rows = [
        (1, "lead in " + " ".join(every_fifth).upper() + "! trailing", "en", "a", 1),
        (2, " ".join(base[:8]), "en", "a", 1),
        (3, " ".join(x if i % 3 else "other" for i, x in enumerate(base)), "en", "a", 1),
        (4, "short item of six words all", "en", "a", 1),
    ]
    items = spark.createDataFrame([(10, " ".join(base)), (11, "Short, item of six words all."), (12, "too short"), (13, None), (11, "Short, item of six words all."), (14, " ".join(base))], "item_id long, text string")
    for blocks in (10, 500_000):
        got = decontaminate.contaminated(frame(spark, rows), items, block_rows=blocks)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 10), (1, 14), (4, 11)}
    best = got.filter("doc_id = 1 AND item_id = 10").first()
    assert (best.doc_word, best.item_word, best.n_words, best.n_equal) == (2, 0, 30, 24)
    left = decontaminate.drop_contaminated(frame(spark, rows), items)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3]


def test_decontamination_of_awkward_rows(spark):
    items = spark.createDataFrame([(1, awkward_rows()[0][1]), (None, "another text with the same id")], "item_id long, text string")
    for clashes in (False, True):
        docs = frame(spark, clashes=clashes)
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
        assert got == {(1, 1), (2, 1), (None, 1), (5, None)}
        left = decontaminate.drop_contaminated(docs, items)
        assert left.columns == docs.columns and left.count() == len(awkward_rows()) - 5
    assert decontaminate.contaminated(frame(spark, []), items).count() == 0
    assert decontaminate.drop_contaminated(frame(spark), items.filter("false")).count() == len(awkward_rows())


def test_secrets_query_against_sql(spark, sf_dir):
    assert compare(spark, sf_dir, *QUERIES["op7_secrets"], connect(sf_dir)) == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op6_decontamination", "op7_secrets"])
def test_native_queries_run_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name][0](spark, sf_dir))
    assert not any(x in text for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


HARD = [
    ("secret=token:abcdefgh", "", ""),
    ("password = 'hunter22' and Api_Key:\"abcdef123\"", "assign:0:20,assign:26:44", None),
    ("naïve 日本 😀 AKIA" + "A1" * 10 + " " + "0af" * 9, "access:11:35,hex:36:63", None),
    ("AKIASHORT AKIA" + "B" * 16, "access:10:30", None),
    ("ghp_" + "a1B2" * 9 + " eyJabcdefghi.eyJabcdefghi.sig-12345", "", "git_token:0:40,web_token:41:76"),
    ("", "", ""),
]


def test_spans_of_secrets(spark):
    rows = [(i, t, "en", "s", len(t)) for i, (t, _, _) in enumerate(HARD)] + [(99, None, None, None, None)]
    got = {r.doc_id: r for r in secrets.report(frame(spark, rows)).collect()}
    for i, (_, base, spans) in enumerate(HARD):
        assert got[i].spans == (base if spans is None else spans), HARD[i]
    assert got[99].spans == "" and got[99].n_hex == 0
    clean = {r.doc_id: r for r in secrets.redact(frame(spark, rows)).collect()}
    assert clean[1].text == "[SECRET]' and [SECRET]\"" and clean[1].n_chars == len(clean[1].text)
    assert clean[3].text == "AKIASHORT [SECRET]" and clean[99].text is None and clean[0].text == HARD[0][0]


def test_secrets_of_awkward_rows(spark):
    for clashes in (False, True):
        docs = frame(spark, clashes=clashes)
        assert rows_of(secrets.report(docs), "doc_id") == Counter((r[0],) for r in awkward_rows())
        assert rows_of(secrets.redact(docs), *docs.columns) == rows_of(docs)
    assert secrets.report(frame(spark, [])).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert secrets.trigram_query("[0-9a-f]{24,}") == [] and secrets.trigram_query("ab|cdef") == []
    assert secrets.trigram_query("(abc|xyz)[^q]*(def)?") == [["abc"], ["xyz"]]
    assert secrets.trigram_query("a[bc]d") == [["abd"], ["acd"]]
    assert secrets.trigram_query("(?:foo)+bar") == [["bar", "foo"]]


def test_near_copies_leave_little_behind(spark):
    """Of what the search for near copies writes, sets, sketches of nodes and places go as soon as nothing reads them."""
    rows = [(i, " ".join(f"w{(i // 2) * 50 + k}" for k in range(40)) + (" more" if i % 2 else ""), "en", "a", 1) for i in range(40)]
    folder = pathlib.Path(scratch_path(spark, "x")).parent
    before = set(folder.glob("*"))
    assert near_copies.keep_one(frame(spark, rows)).count() == 20
    left = {p.name.split("-")[0] for p in set(folder.glob("*")) - before}
    assert "kept" in left and not left & {"sets", "nodes", "meetings", "met", "placed"}


def test_kept_rows_are_found_without_sketches(spark):
    """When the rows that stay are known, the sketches of all texts are removed too."""
    folder = pathlib.Path(scratch_path(spark, "x")).parent
    before = set(folder.glob("*"))
    kept = near_copies.keep_one(frame(spark, [(i, f"a b c d e f {i // 2}", "en", "a", 1) for i in range(20)] * 2))
    left = {p.name.split("-")[0] for p in set(folder.glob("*")) - before}
    assert "kept" in left and not left & {"sketches", "pairs"}
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 20, 2))


def test_texts_that_nobody_asks_for_are_not_shuffled(spark):
    """Of 3000 rows the 30 that are asked for stay, with a few others at most, whatever nulls and repeats there are."""
    rows = spark.createDataFrame([(f"={i % 1500}" if i % 7 else "null", f"m{i % 1500}") for i in range(3000)], "k string, m string")
    wanted = rows.filter("k = 'null' AND m < 'm11' OR k IN ('=1', '=2', '=3')").distinct()
    left = near_copies.likely(rows, wanted, ["k", "m"])
    assert left.join(wanted, ["k", "m"], "left_semi").exceptAll(rows.join(wanted, ["k", "m"], "left_semi")).count() == 0
    assert rows.join(wanted, ["k", "m"], "left_semi").count() <= left.count() < rows.join(wanted, ["k", "m"], "left_semi").count() + 30
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()
    assert near_copies.likely(rows, wanted.limit(0), ["k", "m"]).count() == 0
