"""Scores of texts by a probabilistic suffix tree over bytes, beside a unigram score of words.

The tree models the words of a text, A-Z in lower case, joined by blanks and closed by an end symbol,
byte by byte. Its states are contexts of up to ``DEPTH`` bytes. A context is considered if it makes up
``MIN_SHARE`` of all training positions, which bounds the contexts of a length by 1 / ``MIN_SHARE``
whatever the data, and retained if its next-symbol distribution diverges from that of the context one
byte shorter. Counts, divergences and retention are Spark aggregations over all training documents.
Distributions are smoothed towards the shorter context's. For scoring, the retained contexts become an
automaton whose state is the longest one that ends at a position; texts are cut into lanes that
begin a few bytes early, since the state depends on no more, and all lanes move on together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.text import byte_slices, held_out, map_texts, reachable, row_key, text_bytes, words_of
from fieldloom.session import materialize

#: Bytes of the longest context, least share of positions of a context, least divergence (nats) from the shorter
#: one, and the weight of the shorter context's distribution, in observations.
DEPTH, MIN_SHARE, MIN_DIVERGENCE, PRIOR = 6, 4e-6, 0.02, 10.0
#: Words with at least this share of all tokens are broadcast: at most a million, however much text there is.
KNOWN_SHARE = 1e-6
#: Bytes of a lane, and distinct words or contexts that a task counts before it hands them on.
LANE, HELD = 256, 1_000_000

END = b"\n"  # never part of a word


def symbols(words: list[bytes]) -> bytes:
    """What the tree models of a text."""
    return b" ".join(words) + END


def _training(docs: DataFrame, doc_id: str, text: str, modulus: int) -> DataFrame:
    return docs.filter(~held_out(doc_id, modulus)).select(F.col(text).cast("string").alias("text"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes | None]]:
    for batch in batches:
        texts = text_bytes(batch, "text")
        for a, b in byte_slices(texts):
            yield texts[a:b]


def word_counts(train: DataFrame) -> DataFrame:
    """``word, c``: how often each word stands in the training texts, and ``END`` once for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for texts in _texts(batches):
            for t in texts:
                counts.update(words_of(t, lower=True))
            counts[END] += len(texts)
            if len(counts) > HELD:
                yield out()
                counts.clear()
        yield out()

    return reachable(train).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def grams(texts: list[bytes | None], depth: int) -> np.ndarray:
    """For each symbol of the texts, it and the ``depth`` bytes before it as one number; before a text there are ends."""
    pad = END * depth
    parts = [pad + symbols(words_of(t, lower=True)) for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    code = np.zeros(len(raw) - depth, np.uint64)
    for k in range(depth + 1):
        code |= raw[k : len(raw) - depth + k].astype(np.uint64) << np.uint64(8 * (depth - k))
    inside = np.ones(len(raw), bool)
    begins = np.cumsum([0, *(len(p) for p in parts[:-1])])
    inside[(begins[:, None] + np.arange(depth)).ravel()] = False
    return code[inside[depth:]]


def gram_counts(train: DataFrame, depth: int) -> DataFrame:
    """``code, n``: how often each symbol stands after each ``depth`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for texts in _texts(batches):
            new, n = np.unique(grams(texts, depth), return_counts=True)
            both = np.concatenate([codes, new])
            codes, where = np.unique(both, return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(codes)).astype(np.int64)
            if len(codes) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["code", "n"])
                codes, counts = codes[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["code", "n"])

    return reachable(train).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def retained(counted: DataFrame, depth: int, min_share: float, min_divergence: float) -> DataFrame:
    """``length, context, symbol, n`` of the contexts of the tree, the empty one included.

    ``counted`` is a written table, see ``gram_counts``. A retained context brings its suffixes along.
    """
    levels = counted.select(F.explode(F.array(*(F.lit(k) for k in range(depth + 1)))).alias("length"), "code", "n")
    context = F.expr("shiftrightunsigned(code, 8) & (shiftleft(1L, 8 * length) - 1)")
    following = levels.groupBy("length", context.alias("context"), F.expr("code & 255").alias("symbol")).agg(F.sum("n").alias("n"))
    following = materialize(following, "following")
    positions = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    least = max(2.0, min_share * positions)
    totals = following.groupBy("length", "context").agg(F.sum("n").alias("total")).filter((F.col("length") == 0) | (F.col("total") >= least))
    frequent = materialize(following.join(totals, ["length", "context"]), "frequent")

    shorter = frequent.select((F.col("length") + 1).alias("length"), F.col("context").alias("shorter"), "symbol", (F.col("n") / F.col("total")).alias("q"))
    longer = frequent.filter("length > 0").withColumn("shorter", F.expr("context & (shiftleft(1L, 8 * (length - 1)) - 1)"))
    share = F.col("n") / F.col("total")
    diverging = longer.join(shorter, ["length", "shorter", "symbol"]).groupBy("length", "context").agg(F.sum(share * F.log(share / F.col("q"))).alias("d"))
    kept = diverging.filter(F.col("d") >= min_divergence).select("context", F.explode(F.sequence(F.lit(1), F.col("length"))).alias("length"))
    kept = kept.select("length", F.expr("context & (shiftleft(1L, 8 * length) - 1)").alias("context")).distinct()
    states = frequent.join(kept, ["length", "context"], "left_semi").unionByName(frequent.filter("length = 0"))
    return states.select("length", "context", "symbol", "n")


@dataclass
class Tree:
    """An automaton: ``step[state * width + symbol]`` is the next state and ``log10p`` there the symbol's log10 probability.

    ``code`` maps a byte to its symbol; bytes never seen share one; the last symbol is no byte and changes nothing.
    """

    code: np.ndarray
    step: np.ndarray
    log10p: np.ndarray
    width: int
    states: int
    depth: int

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text (as ``symbols`` gives them)."""
        depth, nothing = self.depth, self.width - 1
        lanes, owner = [], []
        for i, text in enumerate(texts):
            padded = END * depth + text
            for start in range(0, len(text), LANE):
                lanes.append(padded[start : start + depth + LANE])
                owner.append(i)
        total = np.zeros(len(texts))
        for a in range(0, len(lanes), 8192):
            part = lanes[a : a + 8192]
            length = np.array([len(x) for x in part])
            grid = np.full((len(part), depth + LANE), nothing, np.int32)
            grid[np.arange(depth + LANE) < length[:, None]] = self.code[np.frombuffer(b"".join(part), np.uint8)]
            grid = np.ascontiguousarray(grid.T)
            state, score = np.zeros(len(part), np.int32), np.zeros(len(part))
            for t, symbol in enumerate(grid[: length.max()]):
                at = state * np.int32(self.width) + symbol
                if t >= depth:
                    score += self.log10p[at]
                state = self.step[at]
            np.add.at(total, owner[a : a + 8192], score)
        return total


def grow(length: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, depth: int, prior: float) -> Tree:
    """The automaton of the retained contexts: distributions from short to long, states from their spellings."""
    seen = np.unique(symbol)
    alphabet = len(seen) + 1  # the last one: any byte never seen
    code = np.full(256, len(seen), np.int32)
    code[seen] = np.arange(len(seen))
    width = alphabet + 1

    # contexts from short to long, the empty one among them; one number for a context's length and bytes
    marks, row = np.unique(np.append(length << 48 | context, 0), return_inverse=True)
    names = [(m & (1 << 48) - 1).to_bytes(depth, "big")[depth - (m >> 48) :] for m in marks.tolist()]
    spelled = {name: i for i, name in enumerate(names)}
    log10p = np.zeros((len(names), alphabet), np.float32)
    log10p[row[:-1], code[symbol]] = n
    total = np.bincount(row[:-1], weights=n, minlength=len(names))
    # in place: counts become probabilities, shorter contexts first, and then their logarithms
    for i, name in enumerate(names):
        below = log10p[spelled[name[1:]]] if name else np.float32(1 / 256)
        log10p[i] = (log10p[i] + np.float32(prior) * below) / np.float32(total[i] + prior)
    np.log10(log10p, out=log10p)

    # states: every beginning of a retained context; its distribution is that of its longest retained ending
    names = sorted({c[:k] for c in spelled for k in range(len(c) + 1)}, key=lambda x: (len(x), x))
    place = {name: i for i, name in enumerate(names)}
    step = np.zeros((len(names), width), np.int32)
    scores = np.zeros((len(names), width), np.float32)
    children: dict[bytes, list[bytes]] = {}
    for name in names[1:]:
        children.setdefault(name[:-1], []).append(name)
    for i, name in enumerate(names):
        ending = next(name[k:] for k in range(len(name) + 1) if name[k:] in spelled)
        scores[i, :alphabet] = log10p[spelled[ending]]
        if name:
            fallback = next(place[name[k:]] for k in range(1, len(name) + 1) if name[k:] in place)
            step[i] = step[fallback]
        for child in children.get(name, ()):
            step[i, code[child[-1]]] = place[child]
        step[i, width - 1] = i
    return Tree(code, step.ravel(), scores.ravel(), width, len(names), depth)


def fit_tree(train: DataFrame, depth: int = DEPTH, min_share: float = MIN_SHARE, min_divergence: float = MIN_DIVERGENCE, prior: float = PRIOR) -> Tree:
    """The tree of the training texts (column ``text``). The driver gets the retained contexts alone."""
    counted = materialize(gram_counts(train, depth), "grams")
    states = retained(counted, depth, min_share, min_divergence).toArrow()
    return grow(*(states[c].to_numpy().astype(np.int64) for c in ("length", "context", "symbol", "n")), depth, prior)


def score(docs: DataFrame, modulus: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Words and the tree are learnt from the documents that are not held out. ``base_score`` sums over the
    words and the end log10((c + 0.1) / (N + 0.1 (V + 1))); ``score`` is the tree's. Null texts are empty.
    Rows that repeat are scored each; a null id is never held out. Without training documents c, N and
    V are 0 and the tree knows nothing. Counts of rare words come by a join, those of common words are
    looked up; the share that parts them bounds what is broadcast.
    """
    spark = docs.sparkSession
    train = _training(docs, doc_id, text, modulus)
    counts = materialize(word_counts(train), "words")
    size = counts.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    known = counts.filter(F.col("c") >= max(1.0, KNOWN_SHARE * size.n)).toArrow()
    model = spark.sparkContext.broadcast((dict(zip(known["word"].to_pylist(), known["c"].to_pylist())), fit_tree(train)))
    whole = math.log10(size.n + 0.1 * (size.v + 1))

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        common, tree = model.value
        rows, kinds, words, times, tokens, found, base = [], [], [], [], [], [], []
        spelled = []
        for i, t in enumerate(texts):
            split = words_of(t, lower=True)
            spelled.append(symbols(split))
            here = Counter(split)
            here[END] += 1
            n, total = 0, 0.0
            for w, k in here.items():
                c = common.get(w)
                if c is None:
                    rows.append(i)
                    kinds.append(0)
                    words.append(w)
                    times.append(k)
                else:
                    n += k
                    total += k * math.log10(c + 0.1)
            rows.append(i)
            kinds.append(1)
            words.append(END + i.to_bytes(4, "big"))  # no word, and spread over the tasks of the join
            times.append(0)
            tokens.append(len(split) + 1)
            found.append(n)
            base.append(total)
        of = np.array(rows)
        one = np.array(kinds) == 1
        scores = tree.scores(spelled)

        def of_rows(values, kind) -> pa.Array:
            return pa.array(np.asarray(values)[of], kind, mask=~one)

        return [
            pa.array(of), pa.array(words, pa.binary()), pa.array(times, pa.int64()), pa.array(kinds, pa.int64()),
            of_rows(tokens, pa.int64()), of_rows(found, pa.int64()), of_rows(base, pa.float64()), of_rows(scores, pa.float64()),
        ]

    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("row_key"))
    made = map_texts(keyed, "text", ["doc_id", "row_key"], work, "word binary, times long, whole long, n_tokens long, known long, base double, score double")
    joined = made.join(counts, "word", "left").select(
        "doc_id", "row_key", "whole", "n_tokens", "known", "base", "score",
        F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0).alias("also_known"),
        (F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("rare"),
    )
    # rows that are equal in id and text meet here: what they have alike is counted once and given to each
    by_row = joined.groupBy("doc_id", "row_key").agg(
        F.sum("whole").alias("rows"), F.max("n_tokens").alias("n_tokens"), F.max("known").alias("known"), F.max("base").alias("base"), F.max("score").alias("score"),
        F.sum("also_known").alias("also_known"), F.sum("rare").alias("rare"),
    )
    result = by_row.select(
        "doc_id",
        held_out("doc_id", modulus).alias("held_out"),
        "n_tokens",
        (F.col("known") + (F.col("also_known") / F.col("rows")).cast("long")).alias("n_known"),
        F.lit(size.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare") / F.col("rows") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        "score",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"),
    )
    return result.drop("copy")
