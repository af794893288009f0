"""Phrase collocations: frequent phrases by the partition method of Savasere, Omiecinski and Navathe, scored exactly.

The input's partitions are dealt over ``SHARDS`` shards. A phrase found ``support`` times in all is found
``support / SHARDS`` times in some shard, however the rows are dealt. So each shard is mined completely at that
lowered support, order by order: phrases of n words whose beginnings and ends of n - 1 words are candidates.
The union of what is frequent in some shard are the candidates; their counts in all shards are added, and what
stays under the support goes. A frequent phrase's parts are frequent, so every shard has counted all of its occurrences.

While mining, a phrase is the numbers of its words, 64 bits each. No two words share one: that is checked, and other
numbers are taken if some do. So counts are exact, and a join with the words spells the frequent phrases. Candidates
are a bitmap of ``BITMAP_BITS`` bits, whose size does not depend on the corpus; phrases that share a bit cost work and
change no result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce
from itertools import islice
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.text import LOWER, UPPER, byte_slices, quoted, reachable
from fieldloom.session import discard, materialize, settle

#: Least count of a phrase, its most words, phrases listed for a language, and the share (in percent) of a phrase's
#: occurrences that lie within a longer phrase and make it needless.
SUPPORT, MAX_WORDS, LISTED, WITHIN = 10, 3, 2000, 50
#: Shards: fewer than ``SUPPORT``, or each would hold every phrase that occurs. Mining a shard is itself spread over
#: the cluster, so few shards, whose support is high, leave the fewest candidates to count.
SHARDS = 2
#: log2 of a candidate bitmap's bits: 16 MB.
BITMAP_BITS = 27
#: Bytes of text that are worked on at once, and numbers or words held before a task hands them on.
PART, HELD = 1 << 22, 1_250_000
#: Words whose letters are worked on at once, and rows that are handed on at once.
STRETCH, HANDED = 1 << 15, 1 << 16
#: Groups in which a language's phrases are ranked before they meet.
RANK_GROUPS = 64

#: What parts texts into pieces, and what parts words.
ENDS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
_MAP = bytes.maketrans((UPPER + ENDS + BLANKS).encode(), (LOWER + "\n" * len(ENDS) + " " * len(BLANKS)).encode())
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def parts_of(text: bytes, max_words: int, size: int = PART) -> Iterator[tuple[bytes, int]]:
    """A text, mapped, in parts of about ``size`` bytes, and how many words at a part's begin are the part's before.

    A piece longer than a part goes on in the next one, which begins with its last ``max_words - 1`` words again.
    """
    mapped, start, carried = text.translate(_MAP), 0, []
    while start < len(mapped):
        end = start + size
        goes_on = False
        if end < len(mapped):
            cut = mapped.rfind(b"\n", start, end)
            if cut < 0:
                cut = mapped.rfind(b" ", start, end)
                cut = cut if cut >= 0 else min(x for x in (mapped.find(b" ", end), mapped.find(b"\n", end), len(mapped)) if x >= 0)
                goes_on = mapped[cut : cut + 1] == b" "
            end = cut + 1
        part = b" ".join([*carried, mapped[start:end]])
        yield part, len(carried)
        carried = part.rsplit(b"\n", 1)[-1].split()[1 - max_words :] if goes_on and max_words > 1 else []
        start = end


@cache
def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(12 + seed).integers(0, 1 << 64, (2, 256), np.uint64)


def _longer(shorter: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    made = (shorter ^ (shorter >> np.uint64(31))) * _MIX[1] + numbers
    return made ^ (made >> np.uint64(29))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of mapped texts of one language: where they begin and end, their pieces, and whether it is their first time."""

    def __init__(self, raw: bytes, lang: str, carried: int = 0, seed: int = 0):
        self.raw, self.lang, self.seed = raw, lang, seed
        self.bytes = np.frombuffer(raw, np.uint8)
        inside = np.concatenate([[False], (self.bytes != 32) & (self.bytes != 10), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.begin, self.end = edges[::2], edges[1::2]
        self.piece = np.cumsum(self.bytes == 10, dtype=np.int32)[self.begin]
        self.fresh = np.arange(len(self.begin)) >= carried

    def __len__(self) -> int:
        return len(self.begin)

    def numbers(self, lanes: int = 2) -> np.ndarray:
        """One or two numbers of 64 bits for each word in its language: sums of a random number for each byte, times
        one for its place in the word."""
        made = np.empty((len(self), lanes), np.uint64)
        mark = np.frombuffer(xxhash.xxh3_128_digest(self.lang.encode(), self.seed), "<u8")
        for a in range(0, len(self), STRETCH):
            begin = self.begin[a : a + STRETCH]
            length = self.end[a : a + STRETCH] - begin
            firsts = np.concatenate([[0], np.cumsum(length)[:-1]])
            place = np.arange(int(length.sum())) - np.repeat(firsts, length)
            letters = self.bytes[place + np.repeat(begin, length)]
            place = place.astype(np.uint64)
            for k in range(lanes):
                times = _mixed(place + np.uint64(1 + k)) | np.uint64(1)
                sums = np.add.reduceat(_letters(self.seed)[k][letters] * times, firsts)
                made[a : a + STRETCH, k] = _mixed(sums ^ mark[k])
        return made

    def longer(self, shorter: np.ndarray, numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of what ``n`` words from each place on say, from those of one word fewer, and which of them lie in a piece."""
        m = max(len(self) - n + 1, 0)
        return _longer(shorter[:m], numbers[n - 1 :]), self.piece[:m] == self.piece[n - 1 :]

    def phrase(self, place: int, n: int) -> bytes:
        return b" ".join(self.raw[self.begin[place] : self.end[place + n - 1]].split())


class Bitmap:
    """A set of 64-bit numbers that may say yes wrongly, never no."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.shift = np.uint64(65 - (64 * len(words)).bit_length())

    def has(self, numbers: np.ndarray) -> np.ndarray:
        bits = (numbers >> self.shift).astype(np.int64)
        return (self.words[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) != 0


def bitmap(numbers: DataFrame) -> Broadcast:
    """The broadcast bitmap of a table of numbers (column ``number``): its words of 64 bits are united by Spark."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(number, {64 - BITMAP_BITS}) & 63 AS int))")
    found = numbers.groupBy(F.shiftrightunsigned("number", 64 - BITMAP_BITS + 6).alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    whole = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    whole[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return numbers.sparkSession.sparkContext.broadcast(Bitmap(whole))


def _worked(batches: Iterator[pa.RecordBatch], max_words: int) -> Iterator[tuple[bytes, str, int]]:
    """The mapped texts of all rows (lang, text) with their language, some texts or a part of one at a time (see ``parts_of``)."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        for a, b in byte_slices(texts, PART):
            if b - a == 1:
                yield from ((part, langs[a], carried) for part, carried in parts_of(texts[a], max_words))
                continue
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(langs[a:b], texts[a:b]):
                by_lang.setdefault(lang, []).append(text)
            yield from ((b"\n".join(own).translate(_MAP), lang, 0) for lang, own in by_lang.items())


def _handed(found: dict[bytes, int]) -> Iterator[tuple[list[bytes], list[int]]]:
    """The phrases counted so far and their counts, ``HANDED`` at a time."""
    rows = iter(found.items())
    while part := list(islice(rows, HANDED)):
        yield [p for p, _ in part], [n for _, n in part]


def word_counts(texts: DataFrame, seed: int = 0) -> DataFrame:
    """``lang, phrase, number, n`` of every word of ``texts`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                for words, times in _handed(found):
                    numbers = Words(b" ".join(words), lang, seed=seed).numbers(1)[:, 0]
                    arrays = [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(numbers.view(np.int64)), pa.array(times, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "number", "n"])
            counts.clear()

        for raw, lang, _ in _worked(batches, 1):
            counts.setdefault(lang, Counter()).update(raw.split())
            if sum(map(len, counts.values())) > HELD // 2:
                yield from out()
        yield from out()

    made = reachable(texts).mapInArrow(run, "lang string, phrase string, number long, n long")
    return made.groupBy("lang", "phrase", "number").agg(F.sum("n").alias("n"))


def phrase_numbers(of_words: list[np.ndarray]) -> np.ndarray:
    """Numbers of phrases from those of their words, one array for each place; as ``Words.longer`` has them."""
    now = of_words[0]
    for numbers in of_words[1:]:
        now = _longer(now, numbers)
    return now


def tallied(numbers: np.ndarray, of_words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct phrases, as the numbers of their words, and how often they occur; ``numbers`` has the phrases' own."""
    order = np.argsort(numbers)
    same = numbers[order[1:]] == numbers[order[:-1]]
    alike = np.logical_and.reduce([w[order[1:]] == w[order[:-1]] for w in of_words])
    if (same != alike).any():
        # two phrases of one number: their words tell them apart
        order = np.lexsort(of_words)
        alike = np.logical_and.reduce([w[order[1:]] == w[order[:-1]] for w in of_words])
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), ~alike]))
    return [w[order[first]] for w in of_words], np.diff(first, append=len(order))


def mined(texts: DataFrame, n: int, known: list[Broadcast], local_support: int, shards: int, seed: int = 0) -> DataFrame:
    """``w1`` to ``wn`` and ``n`` of the phrases of ``n`` words that some shard holds ``local_support`` times: the numbers of
    their words, and their count in all shards, exact where all of a phrase's parts are candidates. ``texts`` has lang, text, shard.

    ``known`` has the bitmaps of the candidates of fewer words, single words first. A partition is in one shard.
    """
    places = [f"w{i + 1}" for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = 0, 0
        held: list[list[np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            numbers, *of_words = (np.concatenate(x) for x in zip(*held))
            held.clear()
            of_words, counts = tallied(numbers, of_words)
            arrays = [pa.array(np.full(len(counts), shard, np.int32)), *(pa.array(w.view(np.int64)) for w in of_words), pa.array(counts, pa.int64())]
            whole = pa.RecordBatch.from_arrays(arrays, names=["shard", *places, "n"])
            yield from (whole.slice(a, HANDED) for a in range(0, len(counts), HANDED))

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            for batch in batches:
                if batch.num_rows:
                    shard = batch.column(2)[0].as_py()
                yield batch

        for raw, lang, carried in _worked(seen(), n):
            words = Words(raw, lang, carried, seed)
            numbers = words.numbers(1)[:, 0]
            at, now = _places(words, numbers, known, n)
            held.append([now[at], *(numbers[at + i] for i in range(n))])
            size += len(at)
            if size > 2 * HELD:
                yield from out()
                size = 0
        yield from out()

    found = reachable(texts).mapInArrow(run, f"shard int, {', '.join(f'{w} long' for w in places)}, n long")
    # each shard's count beside the others', so that the rows are shuffled once
    found = found.groupBy(*places).agg(*(F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)).alias(f"s{s}") for s in range(shards)))
    counts = [F.col(f"s{s}") for s in range(shards)]
    return found.filter(F.array_max(F.array(*counts)) >= local_support).select(*places, reduce(add, counts).alias("n"))


def _places(words: Words, numbers: np.ndarray, known: list[Broadcast], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of ``n`` words begin both of whose parts of n - 1 words are candidates, and the phrases' numbers by place."""
    now, good = numbers, known[0].value.has(numbers)
    for order in range(2, n + 1):
        now, in_piece = words.longer(now, numbers, order)
        good = in_piece & good[: len(now)] & good[1 : len(now) + 1]
        if order < n:
            good = good & known[order - 1].value.has(now)
    return np.flatnonzero(good & words.fresh[n - 1 :]), now


def numbered(candidates: DataFrame, n: int) -> DataFrame:
    """``number`` of each of the ``candidates`` (w1 to wn)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = phrase_numbers([c.to_numpy().view(np.uint64) for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(numbers.view(np.int64))], names=["number"])

    return reachable(candidates.select(*(f"w{i + 1}" for i in range(n)))).mapInArrow(run, "number long")


def spelled(candidates: DataFrame, n: int, words: DataFrame) -> DataFrame:
    """``lang, phrase, words, n`` of the ``candidates`` (w1 to wn, n), from the frequent ``words`` (lang, phrase, number)."""
    for i in range(1, n + 1):
        word = words.select(F.col("number").alias(f"w{i}"), F.col("phrase").alias(f"p{i}"), *([F.col("lang")] if i == 1 else []))
        candidates = candidates.join(word, f"w{i}")
    return candidates.select("lang", F.concat_ws(" ", *(f"p{i + 1}" for i in range(n))).alias("phrase"), F.lit(n).alias("words"), "n")


def numbered_words(texts: DataFrame) -> tuple[DataFrame, int]:
    """The written ``word_counts`` and the seed of their numbers: the first with which no two words share one."""
    seed = 0
    while True:
        words = materialize(word_counts(texts, seed), "words")
        if words.groupBy("number").agg(F.count("*").alias("k")).filter("k > 1").isEmpty():
            return words, seed
        discard(words)
        seed += 1


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, max_words: int = MAX_WORDS, shards: int = SHARDS, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two written tables: words (``lang, phrase, n``), and phrases of 2 to ``max_words`` words with n >= ``support``
    (``lang, phrase, words, n``)."""
    texts = docs.select(F.coalesce(F.col(quoted(lang)).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    sharded = texts.withColumn("shard", F.spark_partition_id() % shards)
    words, seed = numbered_words(texts)
    frequent = words.filter(F.col("n") >= support)
    known, local, phrases = [bitmap(frequent.select("number"))], -(-support // shards), None
    for n in range(2, max_words + 1):
        settle(docs.sparkSession)
        candidates = materialize(mined(sharded, n, known, local, shards, seed), "candidates")
        settle(docs.sparkSession)
        if n < max_words:
            known.append(bitmap(numbered(candidates, n)))
        found = materialize(spelled(candidates.filter(F.col("n") >= support), n, frequent), "phrases")
        discard(candidates)
        phrases = found if phrases is None else phrases.unionByName(found)
    for b in known:
        b.unpersist()
    settle(docs.sparkSession)
    return words.drop("number"), phrases


def collocations(
    docs: DataFrame, support: int = SUPPORT, max_words: int = MAX_WORDS, within: int = WITHIN, listed: int = LISTED, shards: int = SHARDS, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """Each language's first ``listed`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is the phrase's count, ``n`` the language's words. Cutting it in two whose counts are ``l`` and ``r``
    gives floor(1000000 a a / (l r)); the cut of the least score counts, the first of several. Phrases that lie
    within a longer one with ``within`` percent of their count or more are left out. Ranks follow score, a
    (both descending) and phrase (by UTF-8 bytes). A null language is ``und``; null and empty texts have no
    words; rows that repeat count each; an empty table gives no rows. Texts of any length are read in parts.
    """
    words, phrases = frequent_phrases(docs, support, max_words, shards, lang, text)
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    # every part of a frequent phrase is as frequent
    parts = words.filter(F.col("n") >= support).unionByName(phrases.select("lang", "phrase", "n"))
    split = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    def joined(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "words", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right")
    )
    left, right = (parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(c)) for side, c in (("left", "l"), ("right", "r")))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    exact = "(cast(1000000 AS decimal(38,0)) * cast(a AS decimal(38,0)) * cast(a AS decimal(38,0))) div (cast(l AS decimal(38,0)) * cast(r AS decimal(38,0)))"
    scored = scored.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = [F.struct(joined(F.lit(s), F.lit(m)).alias("phrase"), F.lit(n).alias("of")) for n in range(3, max_words + 1) for m in range(2, n) for s in range(1, n - m + 2)]
    kept = scored
    if inner:
        inside = split.filter("words > 2").select("lang", "a", F.explode(F.array(*inner)).alias("x"), "words").filter("x.of = words")
        inside = inside.groupBy("lang", F.col("x.phrase").alias("phrase")).agg(F.max("a").alias("longer"))
        kept = scored.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < within * F.col("a"), F.lit(True)))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS)).alias("part"))
    first = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= listed)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= listed)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def collocations_sql(support: int = SUPPORT, within: int = WITHIN, listed: int = LISTED) -> str:
    """The SQL that gives ``collocations`` of ``documents`` for phrases of 2 and 3 words."""
    return f"""
WITH p AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
q AS (SELECT d, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS j FROM p),
s AS (SELECT d, lang, j, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM q),
w AS (SELECT d, lang, j, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM s),
e AS (SELECT lang, word AS w1, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY d, j ORDER BY i)),
c1 AS (SELECT lang, w1, count(*) AS f FROM e GROUP BY lang, w1),
c2 AS (SELECT lang, w1, w2, count(*) AS f FROM e WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= {support}),
c3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM e WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= {support}),
n AS (SELECT lang, sum(f) AS n FROM c1 GROUP BY lang),
i AS (SELECT lang, w1, w2, max(f) AS longer FROM (SELECT lang, w1, w2, f FROM c3 UNION ALL SELECT lang, w2, w3, f FROM c3) GROUP BY lang, w1, w2),
k AS (SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r FROM c2 t
    JOIN c1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN c1 y ON y.lang = t.lang AND y.w1 = t.w2
    LEFT JOIN i ON i.lang = t.lang AND i.w1 = t.w1 AND i.w2 = t.w2 WHERE i.longer IS NULL OR 100 * i.longer < {within} * t.f
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f FROM c3 t
    JOIN c1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN c2 y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f FROM c3 t
    JOIN c2 x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN c1 y ON y.lang = t.lang AND y.w1 = t.w3),
v AS (SELECT *, CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS score FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM v),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE cut = 1)
SELECT z.lang, rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z JOIN n ON n.lang = z.lang WHERE rank <= {listed}"""
