"""Chat formatting, packing and token counts against the libraries and exact round trips; the pipeline."""

from __future__ import annotations

import json
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import awkward_rows, base_counts, frame, kept_by_jaccard, overlaps, rows_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fieldloom.llm import chat, packing, token_counts
from fieldloom.llm.queries import QUERIES
from oracle import compare, connect

BYTES, WORDS, PIECES = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))

#: Texts at which splitting by chunks or words could go wrong.
HARD = [
    "", " ", "a<|endoftext|> b", "  a\n\n b  \t c ", " x", "x　 y", "é à  \x1c  y", " <|endoftext|>  <|ENDOFTEXT|>",
    "a\u0085 b", "Don't  can 't 'll", "日本 語  x", "x \x1f y", "ab_cd e'f x'", " É! Ü?? a.b", "x\xa0 \xa0y",
    "H̱ İ É ß ẞ Σς", "12 3a a3,b\r\n", "a" * 5000, "word&&& *** ### |",
]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_token_counts_query(spark, sf_dir, documents):
    got = rows_of(QUERIES["op10_token_counts"][0](spark, sf_dir), "doc_id", "n_bytes", "n_tokens", "over_limit")
    ids = library(BYTES, [t for _, t in documents])
    assert got == Counter((i, len(t.encode()), len(x), len(x) > 1024) for (i, t), x in zip(documents, ids))


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_hard_texts_are_counted_as_the_library_does(spark, path):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(HARD)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark, rows), path).collect()}
    assert [got[i] for i in range(len(HARD))] == [len(x) for x in library(path, HARD)]


def test_token_counts_of_awkward_rows(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for path, count in ((BYTES, lambda t: len(library(BYTES, [t])[0])), (PIECES, lambda t: len(model.encode(t)))):
        for clashes in (False, True):
            got = token_counts.token_counts(frame(spark, clashes=clashes), path)
            want = Counter((r[0], len((r[1] or "").encode()), count(r[1] or "")) for r in awkward_rows())
            assert rows_of(got, "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts.token_counts(frame(spark, []), BYTES).count() == 0


def check_packing(rows, docs, capacity=2048):
    """Every id in one piece, sequences without gaps or overflow, and little padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    ids = library(WORDS, [t or "" for _, t in docs])
    want = Counter()
    for (i, _), x in zip(docs, ids):
        x = [*x, 1]
        for start in range(0, len(x), capacity):
            piece = np.array(x[start : start + capacity], "<u4")
            want[i, start, len(piece), zlib.crc32(piece.tobytes()), len(x)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and {r.padded_to for r in pieces} == {at if at & (at - 1) == 0 else capacity}
    return sum(r.length for r in rows) / sum(p[0].padded_to for p in by_sequence.values())


def test_packing_query(spark, sf_dir, documents):
    assert check_packing(QUERIES["op9_packing"][0](spark, sf_dir).collect(), documents) > 0.98


def test_packing_of_awkward_rows_and_hard_texts(spark):
    for clashes in (False, True):
        rows = awkward_rows() + [(100 + i, t, "en", "a", 0) for i, t in enumerate(HARD)]
        got = packing.pack_documents(frame(spark, rows, clashes), WORDS).collect()
        check_packing(got, [r[:2] for r in rows])
    assert packing.pack_documents(frame(spark, []), WORDS).count() == 0


def test_best_fit_is_that_of_a_search_of_all_windows():
    rng = np.random.default_rng(4)
    for capacity in (1, 7, 64, 100):
        lengths = sorted(rng.integers(1, capacity + 1, 300).tolist(), reverse=True)
        windows, offsets = packing.best_fit_decreasing(lengths, capacity)
        room = []
        for n, w, o in zip(lengths, windows, offsets):
            fitting = [r for r in room if r >= n]
            if w == len(room):
                assert not fitting
                room.append(capacity)
            assert room[w] >= n and room[w] == (min(fitting) if fitting else capacity) and o == capacity - room[w]
            room[w] -= n


def test_chat_query_against_sql(spark, sf_dir):
    assert compare(spark, sf_dir, *QUERIES["op8_chat_format"], connect(sf_dir)) == []


RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, [("user", "hi"), ("assistant", "")]),
    ({"id": 3, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"system": "s", "instruction": "do", "input": "this", "output": "done"}, [("system", "s"), ("user", "do\n\nthis"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"context": "k", "question": "q", "answer": "a"}, [("user", "k\n\nq"), ("assistant", "a")]),
    ({"turn": 1, "role": None, "text": "t"}, [("", "t")]),
    ({"messages": []}, []),
    ({"unknown": {"deep": [1]}}, [(None, None)]),
    ("no object", [(None, None)]),
]


def test_layouts_by_fingerprint(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(RECORDS)] + [(50, None), (51, "{broken")]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string"), ["conv_id"]).collect()
    for i, (_, want) in enumerate(RECORDS):
        got = sorted((r for r in turns if r.conv_id == i), key=lambda r: r.place)
        assert [(r.role, r.text) for r in got] == want
    assert [(r.role, r.fingerprint) for r in turns if r.conv_id in (50, 51)] == [(None, None)] * 2


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    marks = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
    texts = [m + "\\" + n for m in marks for n in marks] + ["\\", "\\\\<s>", "<\\s>", "<<s>", "[[INST]", "<|im_<s>end|>", "\n\\n", "$1 \\2"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).collect()
    for r in got:
        assert chat.unescape(r.e) == r.t and not any(m in r.e for m in marks)


def test_chat_of_awkward_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a <s>"), (1, 1, "assistant", "a <s>"), (None, 0, "user", "x"), (2, None, "tool", "")]
    turns = spark.createDataFrame([(c, t, 0, r, x or "") for c, t, r, x in rows], "conv_id long, turn long, place long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns, ["turn", "place"], "conv_id"), ["turn", "place"], "conv_id").collect()}
    assert {c: (r.n_turns, r.loss_chars) for c, r in got.items()} == {1: (3, 10), None: (1, 0), 2: (1, 0)}
    assert chat.read_back(chat.format_turns(turns.filter("false"), ["turn"], "conv_id"), ["turn"], "conv_id").count() == 0


def test_line_breaks_in_roles_come_back(spark):
    rows = [(1, 0, 0, "us\ner", "hi\n"), (1, 1, 0, "a\\l", "x\\l\n"), (1, 2, 0, "<s>\n\n", ""), (1, 3, 0, "assistant", "yes\\")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, place long, role string, text string")
    segments = chat.format_turns(turns, ["turn", "place"], "conv_id")
    assert all(r.segment.count("\n") == 2 + r.segment.partition("\n")[2].count("\n") - 1 for r in segments.collect())
    got = chat.read_back(segments, ["turn", "place"], "conv_id").first()
    import hashlib

    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in rows).encode()).hexdigest()


def test_canonical_turns_beside_columns_of_their_names(spark):
    records = spark.createDataFrame([(1, "p", "r", "t", '{"prompt": "a", "completion": "b"}')], "fingerprint long, place string, role string, Text string, record string")
    got = chat.canonical_turns(records, ["fingerprint", "place", "role", "Text"])
    assert got.columns == ["fingerprint", "place", "role", "Text", "_fingerprint", "_place", "_role", "_text"]
    assert [(r.fingerprint, r._role, r._text) for r in got.collect()] == [(1, "user", "a"), (1, "assistant", "b")]
    assert chat.canonical_turns(records, ["record"]).columns == ["record", "fingerprint", "place", "role", "text"]


def test_pipeline_stage_by_stage(spark, sf_dir):
    """Each stage against plain Python on what its predecessor kept."""
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, given = docs.columns, docs.collect()
    stages = dict(corpus_pipeline.STAGES)

    kept = spark.createDataFrame(stages["quality_rules"](spark, docs, small).collect(), docs.schema)
    after = kept.collect()
    assert kept.columns == columns and {r.doc_id for r in after} <= {r.doc_id for r in given}
    failed = {r.doc_id for r in given for n in [base_counts(r.text)] if n[0] < 50 or 100 * n[4] > 50 * n[0]}
    assert not failed & {r.doc_id for r in after} and len(after) > 0.9 * (len(given) - len(failed)) - 20

    single = spark.createDataFrame(stages["simhash_near_dedup"](spark, kept, small).collect(), docs.schema)
    assert Counter(r.doc_id for r in single.collect()) == kept_by_jaccard([(r.doc_id, r.text) for r in after])

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = spark.createDataFrame(stages["benchmark_decontamination"](spark, single, small).collect(), docs.schema)
    leaks = {i for i, _ in overlaps([(r.doc_id, r.text) for r in single.collect()], items)}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in single.collect() if r.doc_id not in leaks)

    masked = spark.createDataFrame(stages["secret_scan"](spark, clean, small).collect(), docs.schema)
    assert masked.columns == columns and masked.count() == clean.count()
    was = {r.doc_id: r.text for r in clean.collect()}
    changed = [r for r in masked.collect() if r.text != was[r.doc_id]]
    assert all("[SECRET]" in r.text and r.n_chars == len(r.text) for r in changed)

    packed = stages["packing"](spark, masked, small).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in masked.collect()])


@pytest.mark.parametrize("clashes", [False, True])
def test_pipeline_of_awkward_rows(spark, sf_dir, clashes):
    docs = frame(spark, clashes=clashes)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, schema = docs.columns, docs.schema
        rows = stage(spark, docs, sf_dir).collect()
        docs = spark.createDataFrame(rows, schema)
        assert docs.columns == columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
