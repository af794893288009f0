"""Removal of passages that stand in an earlier document, by hashing paragraphs of lines.

The units are lines, parted further where a sentence ends, as passages are often put into a line of
another text. A unit is normalised to its lower-cased words. As short units recur by chance, what is
hashed are paragraphs: from each unit on as many as make ``min_words`` words together, and back from each
unit likewise, so that the end of a passage is found as its beginning is. A text of fewer words is one
paragraph. Digests are grouped over all documents and the earliest ranked occurrence stays; the units of all others go, runs
of them together. Offsets are those of the original text, in code points.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.text import fresh, map_texts, row_key
from fieldloom.session import materialize

#: Words of a paragraph.
MIN_WORDS = 20

_UNIT = re.compile(r"[^\n.!?]+[.!?]*")
_WORD = re.compile(r"\w+")


def units_of(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the units that have words."""
    found = []
    for m in _UNIT.finditer(text):
        raw = m.group()
        words = _WORD.findall(raw.lower())
        if words:
            lead = len(raw) - len(raw.lstrip())
            found.append((m.start() + lead, m.start() + len(raw.rstrip()), words))
    return found


def paragraphs_of(text: str, min_words: int) -> list[tuple[int, int, int, int, int, int, bytes]]:
    """(first unit, last unit, start, end, words before, words up to the end, digest) of the paragraphs that begin or end at each unit.

    They come in the order of their places, each once. A text of fewer than ``min_words`` words is one paragraph.
    """
    units = units_of(text)
    if not units:
        return []
    before = [0]
    for _, _, words in units:
        before.append(before[-1] + len(words))
    spans, last, first = set(), 0, 0
    for begin in range(len(units)):
        last = max(last, begin)
        while last < len(units) and before[last + 1] - before[begin] < min_words:
            last += 1
        if last == len(units):
            break
        spans.add((begin, last))
    for end in range(len(units)):
        while first < end and before[end + 1] - before[first + 1] >= min_words:
            first += 1
        if before[end + 1] - before[first] >= min_words:
            spans.add((first, end))
    found = []
    for first, last in sorted(spans) or [(0, len(units) - 1)]:
        digest = xxhash.xxh3_128_digest(" ".join(w for u in units[first : last + 1] for w in u[2]).encode())
        found.append((first, last, units[first][0], units[last][1], before[first], before[last + 1], digest))
    return found


FIELDS = "number long, last long, start long, end long, words_before long, words_after long, high long, low long, again boolean"


def _paragraphs(min_words: int):
    def work(texts: list[bytes | None]) -> list[pa.Array]:
        rows, columns, again = [], [[] for _ in range(8)], []
        for row, text in enumerate(texts):
            seen = set()
            for *numbers, digest in paragraphs_of((text or b"").decode(), min_words):
                rows.append(row)
                numbers += [int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)]
                for column, x in zip(columns, numbers):
                    column.append(x)
                again.append(digest in seen)
                seen.add(digest)
        return [*(pa.array(x, pa.int64()) for x in (rows, *columns)), pa.array(again, pa.bool_())]

    return work


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages to remove: ``doc_id``, ``start``, ``end``, ``n_words``, ``n_units``, ``kept_doc_id``, ``row_key``.

    A paragraph is kept in the document of the smallest id, at its first place there; documents without an
    id come last, in the order of a hash of their text. ``kept_doc_id`` is the smallest id that keeps a
    paragraph of the passage. Rows that are equal in id and text are one document and give their passages
    once; rows with the same id are not earlier than one another. Null and empty texts have no units.
    """
    key, ident = fresh(docs, "row_key"), fresh(docs, "ident")
    keyed = docs.select(F.col(doc_id).alias(ident), F.col(text).alias("text"), row_key(doc_id, text).alias(key))
    paragraphs = map_texts(keyed, "text", [ident, key], _paragraphs(min_words), FIELDS)

    first = paragraphs.groupBy("high", "low").agg(
        F.min(ident).alias("first_id"), F.min(F.when(F.col(ident).isNull(), F.col(key))).alias("first_key"), F.count("*").alias("n")
    )
    # written, so that the join below shuffles both sides and a line of very many documents can be split
    first = materialize(first.filter("n > 1").drop("n"), "repeated")
    earliest = F.when(F.col("first_id").isNull(), F.col(key) == F.col("first_key")).otherwise(F.coalesce(F.col(ident) == F.col("first_id"), F.lit(False)))
    later = paragraphs.join(first, ["high", "low"]).filter(F.col("again") | ~earliest)
    later = later.select(ident, key, "number", "last", "start", "end", "words_before", "words_after", "first_id").dropDuplicates([key, "number", "last"])

    # paragraphs that overlap or follow each other are one passage
    in_order = Window.partitionBy(key).orderBy("number")
    reached = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("number") <= reached + 1, 0).otherwise(1)
    runs = later.withColumn("opens", opens).withColumn("run", F.sum("opens").over(in_order)).groupBy(key, ident, "run")
    found = runs.agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("words_after") - F.min("words_before")).alias("n_words"),
        (F.max("last") - F.min("number") + 1).alias("n_units"), F.min("first_id").alias("kept_doc_id"),
    )
    return found.select(F.col(ident).alias("doc_id"), "start", "end", "n_words", "n_units", "kept_doc_id", F.col(key).alias("row_key"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated passages in ``text``; other columns and other texts stay as they are."""
    key, cuts = fresh(docs, "row_key"), fresh(docs, "cuts")
    passages = repeated_passages(docs, min_words, doc_id, text)
    by_row = passages.groupBy(F.col("row_key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts))

    def step(done, cut):
        kept = F.substring(text, (done["at"] + 1).cast("int"), (cut["start"] - done["at"]).cast("int"))
        return F.struct(cut["end"].alias("at"), F.concat(done["made"], kept).alias("made"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("made"))
    left = F.aggregate(cuts, start, step, lambda done: F.concat(done["made"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))))
    joined = docs.withColumn(key, row_key(doc_id, text)).join(by_row, key, "left")
    return joined.withColumn(text, F.when(F.col(cuts).isNull(), F.col(text)).otherwise(left)).select(*docs.columns)
