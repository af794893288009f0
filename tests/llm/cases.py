"""Small tables with every awkward row, and plain-Python versions of what the operators do."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Column names that operators use inside; tables that bring them must come through unharmed.
CLASHES = {"row_key": "1L", "text_read": "'x'", "bits": "2L", "word": "'w'", "score": "0.5D", "kept": "false", "id_text": "'i'", "id_bits": "5L", "secret_spans": "'s'", "shard": "3L", "Component_ID": "9L"}


def awkward_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids."""
    prose = " ".join(f"word{i % 97} of{i % 89} the" for i in range(60))
    return [
        (1, prose, "en", "a", 10),
        (2, prose, "en", "a", 10),
        (2, prose, "en", "a", 10),
        (3, None, "de", None, None),
        (4, "", None, "b", 0),
        (None, prose + " end", "fr", "b", 3),
        (None, None, None, None, None),
        (None, None, None, None, None),
        (5, " \t\n ", "en", "b", 4),
        (5, "another text with the same id", "en", "b", 4),
        (6, "x " * 30_000, "en", "c", 60_000),
        (7, "naïve Ünïcode 日本語 \U0001f600 text here", "fr", "c", 5),
        (8, "a", "en", None, 1),
    ]


def frame(spark, rows=None, clashes=False):
    made = spark.createDataFrame(awkward_rows() if rows is None else rows, DOCS)
    for name, value in CLASHES.items() if clashes else ():
        made = made.selectExpr("*", f"{value} AS {name}")
    return made


def rows_of(df, *columns):
    """All rows as a bag."""
    return Counter(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def lowered(text):
    return [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in words(text)]


def held_out(doc_id, modulus):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == 0


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, counted one thing at a time."""
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, same = [], 0
    for line in text.split("\n"):
        if words(line):
            same += line in lines
            lines.append(line)
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), same, len(covered)


def fingerprint(text, size=3):
    w = lowered(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    """Smallest node that each node reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def unigram(docs, modulus=10):
    """(held_out, n_tokens, n_known, N, base score) of each (id, text)."""
    end = b"\n"
    counts = Counter()
    for i, t in docs:
        if not held_out(i, modulus):
            counts.update([*lowered(t), end])
    n, v = sum(counts.values()), len(counts)
    made = []
    for i, t in docs:
        tokens = [*lowered(t), end]
        score = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)
        made.append((held_out(i, modulus), len(tokens), sum(counts[x] > 0 for x in tokens), n, round(score, 6)))
    return made


def overlaps(docs, items, size=13, agree=0.8):
    """(doc_id, item_id) of documents and benchmark items that agree in a window on some alignment."""

    def split(t):
        return [x for x in re.split(r"[^\w]+|_+", (t or "").lower()) if x]

    found = set()
    for i, text in docs:
        w = split(text)
        for j, item in items:
            b = split(item)
            if len(b) < 6:
                continue
            window = min(size, len(b))
            for shift in range(window - len(b), len(w) - window + 1):
                same = [b[k] == w[k + shift] for k in range(max(0, -shift), min(len(b), len(w) - shift))]
                if any(sum(same[s : s + window]) >= math.ceil(window * agree) for s in range(len(same) - window + 1)):
                    found.add((i, j))
                    break
    return found


def similar(a, b):
    if min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
        return False
    return len(a & b) >= 0.8 * len(a | b)


def kept_by_jaccard(rows):
    """Ids that stay by comparing the five-word shingles of every text with every other."""
    sets = []
    for _, text in rows:
        w = lowered(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else []))
    distinct = list(set(sets))
    number = {s: k for k, s in enumerate(distinct)}
    root = classes(range(len(distinct)), lambda a, b: similar(distinct[a], distinct[b]))
    best = {}
    for (i, _), s in zip(rows, sets):
        k = root[number[s]]
        best[k] = min(best.get(k, (True, 0)), (i is None, i or 0))
    return Counter(None if none else i for none, i in best.values())
