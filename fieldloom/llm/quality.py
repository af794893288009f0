"""Quality rules, and an isolation forest over their statistics.

The rules count words, symbols, repeated lines and repeated words of a whole text. Their ratios place
a document in a small space, in which an isolation forest finds the odd ones: trees split a sample at
random, and what is odd is alone after few splits. The forest is fitted on a bounded sample; the
threshold on its scores comes from all labelled rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.text import fresh, map_texts, row_key, words_of
from fieldloom.session import materialize

#: Trees, rows in the sample of a tree, bins of the score, and the share of good labelled rows that the threshold may reject.
TREES, TREE_ROWS, BINS, GOOD_REJECTED = 100, 256, 1000, 0.005
SEED = 7

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forest sees, in steps: a whole character, a twentieth, a tenth. Short good texts differ by less than a
#: step; a repeated opening line or a number in a good text is rare too, and says nothing.
RATIOS = ["word_length", "symbol_share", "capital_share"]
SCHEMA = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in RATIOS])

_SYMBOLS, _CAPITALS, _CONTINUED = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window found twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(window))))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    count = reach = 0
    for i, w in enumerate(windows):
        if w in twice:
            count += i + window - max(i, reach)
            reach = i + window
    return count


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier one."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _count(text: bytes, characters: bytes) -> int:
    return len(text) - len(text.translate(None, characters))


def statistics(text: bytes | None) -> list[float]:
    """``COUNTS`` and ``RATIOS`` of a text; all are 0 without words."""
    text = text or b""
    words = words_of(text)
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) - _count(joined, _CONTINUED)
    symbols = _count(joined, _SYMBOLS)
    shares = max(chars, 1)
    ratios = [(2 * chars + n) // max(2 * n, 1), 20 * symbols // shares / 20, 10 * _count(joined, _CAPITALS) // shares / 10]
    return [n, chars, symbols, repeated_lines(text), repeated_words(words), *ratios]


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def path_correction(n: float) -> float:
    """Mean path length of a search that fails among ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), split, children, and at leaves the path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    roots: list[int]
    rows: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score of each row, 0 to 1: near 1 if few splits isolate it."""
        total = np.zeros(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                at = node[inner]
                below = x[inner, f[inner]] < self.split[at]
                node[inner] = np.where(below, self.left[at], self.right[at])
            total += self.length[node]
        return 2.0 ** (-total / len(self.roots) / max(path_correction(self.rows), 1e-9)) if self.roots else total


def grow(sample: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """An isolation forest on ``sample``; without rows it has no trees and scores all 0."""
    rng = np.random.default_rng(seed)
    feature, split, left, right, length, roots = [], [], [], [], [], []
    rows = min(rows, len(sample))
    limit = math.ceil(math.log2(max(rows, 2)))

    def tree(part: np.ndarray, depth: int) -> int:
        node = len(feature)
        for column, value in ((feature, -1), (split, 0.0), (left, 0), (right, 0), (length, depth + path_correction(len(part)))):
            column.append(value)
        low, high = part.min(0), part.max(0)
        open_features = np.flatnonzero(high > low)
        if depth < limit and len(part) > 1 and len(open_features):
            f = int(rng.choice(open_features))
            at = rng.uniform(low[f], high[f])
            below = part[:, f] < at
            if below.any() and not below.all():
                feature[node], split[node] = f, at
                left[node], right[node] = tree(part[below], depth + 1), tree(part[~below], depth + 1)
        return node

    for _ in range(trees if rows else 0):
        roots.append(tree(sample[rng.choice(len(sample), rows, replace=False)], 0))
    return Forest(np.array(feature, int), np.array(split), np.array(left, int), np.array(right, int), np.array(length), roots, rows)


@dataclass
class QualityModel:
    forest: Forest
    threshold: float

    def scores(self, ratios: np.ndarray) -> np.ndarray:
        return np.floor(self.forest.scores(ratios) * BINS) / BINS

    def kept(self, counts: np.ndarray, ratios: np.ndarray) -> np.ndarray:
        return ~base_failed(counts[:, 0], counts[:, 4]) & (self.scores(ratios) <= self.threshold)


def threshold_of(bins: dict[float, tuple[int, int]], good_rejected: float = GOOD_REJECTED) -> float:
    """Lowest score bound that rejects at most this share of good rows; bins: (good, bad) rows by score.

    Among the bounds that reject the same bad rows the highest is taken, so that nothing is rejected
    for nothing. Without labelled rows, or without bad ones, nothing is rejected.
    """
    allowed = good_rejected * sum(good for good, _ in bins.values())
    bound, best = 1.0, 1.0
    for score in sorted(bins, reverse=True):
        good, bad = bins[score]
        allowed -= good
        if allowed < 0:
            break
        bound = score - 1 / (2 * BINS)
        best = bound if bad else best
    return best


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Forest from about ``TREES * TREE_ROWS`` rows, those of the smallest hashes; threshold from all labelled rows.

    A document is labelled good if its labels' mean is over a half, bad if under; ids that are null and
    labels that are null have no part. Only documents that pass the base rules count, as the forest judges
    no others.
    """
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, row_key(doc_id, text))
    numbers = materialize(map_texts(keyed, text, [doc_id, key], _statistics, SCHEMA), "statistics")
    judged = numbers.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    share = TREES * TREE_ROWS / max(judged.count(), 1)
    sample = judged.filter(F.shiftrightunsigned(key, 11) < F.lit(share * 2.0**53)).select(key, *RATIOS).distinct()
    forest = grow(np.array([r[1:] for r in sorted(sample.collect())], float).reshape(-1, len(RATIOS)))

    marks = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.avg(label).alias("mark"))
    marked = judged.join(marks.filter("mark <> 0.5"), doc_id).select(F.when(F.col("mark") > 0.5, 1).otherwise(0).alias("good"), *RATIOS)
    model = QualityModel(forest, 1.0)

    def binned(batches):
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy() for i in range(len(RATIOS))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["good", "score"])

    by_bin = marked.mapInArrow(binned, "good int, score double").groupBy("score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    model.threshold = threshold_of({r.score: (r.good, r.bad) for r in by_bin.collect()})
    return model


def _statistics(texts: list[bytes | None]) -> list[pa.Array]:
    rows = list(zip(*map(statistics, texts)))
    return [pa.array(x, pa.int64()) for x in rows[: len(COUNTS)]] + [pa.array(x, pa.float64()) for x in rows[len(COUNTS) :]]


def judge(docs: DataFrame, model: QualityModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row, the counts, ``base_failed``, ``anomaly`` and ``kept``; one pass, no shuffle.

    Null and empty texts have no words and fail the base rules. Rows that repeat are judged each.
    """

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        numbers = np.array(list(map(statistics, texts)), float)
        counts, ratios = numbers[:, : len(COUNTS)], numbers[:, len(COUNTS) :]
        made = [pa.array(c.astype(np.int64)) for c in counts.T]
        return made + [pa.array(base_failed(counts[:, 0], counts[:, 4])), pa.array(model.scores(ratios)), pa.array(model.kept(counts, ratios))]

    return map_texts(docs, text, keep, work, ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules and the forest keep."""
    model = fit(docs, labels, doc_id, text)
    names = [fresh(docs, f"judged_{c}") for c in (*COUNTS, "base_failed", "anomaly", "kept")]
    judged = judge(docs, model, docs.columns, text).toDF(*docs.columns, *names)
    return judged.filter(F.col(names[-1])).select(*docs.columns)
