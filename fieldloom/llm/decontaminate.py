"""Benchmark passages in documents, by spaced seeds.

A seed is a mask over words: those under a 1 are hashed together, those under a 0 are ignored. With
masks that leave out different places, a copy with one word in five replaced still has seeds in
common with the benchmark (tested by trying every set of replacements). Hashes of all documents meet those of the benchmark; each hit gives an
alignment (document, item, shift), and along it the words are compared: an overlap counts if some
window of ``overlap`` words agrees in ``agree`` of them. Everything is DataFrame expressions.

The benchmark is the small side. Its hashes are broadcast only in blocks whose rows are counted
first; a larger benchmark takes more blocks, each against all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.text import fresh, row_key
from fieldloom.session import materialize

#: Masks. Each leaves out another remainder of positions modulo 5. With up to two words in ten replaced, items of
#: ``OVERLAP`` words or more always have a seed under one of them.
MASKS = ("111101", "1101101", "1011011")
#: The mask of shorter items: of 6 to 12 words with so many replaced, three in a row always stay.
SHORT_MASK, LEAST_WORDS = "111", 6
#: Words of a window, and the share of them that must agree.
OVERLAP, AGREE = 13, 0.8
#: Rows of benchmark hashes in a block (about 40 bytes each).
BLOCK_ROWS = 500_000


def words(text: str) -> str:
    """SQL for the runs of letters and digits of a column, in lower case."""
    return f"array_remove(split(lower(coalesce(`{text}`, '')), r'[^\\p{{L}}\\p{{N}}]+'), '')"


def seeds(text: str, masks: tuple[str, ...] = MASKS) -> Column:
    """``n`` words of a text column, and ``hashes`` under each mask at each place: the first mask's, then the second's, and so on.

    The words are bound to a name once, as they would otherwise be split anew for every hash.
    """
    parts = []
    for number, mask in enumerate(masks):
        under = ", ".join(f"get(w, i + {k})" for k, bit in enumerate(mask) if bit == "1")
        hashed = f"transform(sequence(0, size(w) - {len(mask)}), i -> xxhash64({number}, {under}))"
        parts.append(f"CASE WHEN size(w) >= {len(mask)} THEN {hashed} ELSE cast(array() AS array<bigint>) END")
    return F.expr(f"transform(array({words(text)}), w -> named_struct('n', size(w), 'hashes', concat({', '.join(parts)})))[0]")


def _begin(masks: tuple[str, ...], number: int) -> Column:
    """Position in ``seeds`` of the first seed under a mask."""
    return sum((F.greatest(F.col("n") - len(m) + 1, F.lit(0)) for m in masks[:number]), F.lit(0))


def _place(masks: tuple[str, ...]) -> Column:
    """Word position of a seed, from its position in ``seeds`` and the number of words ``n``."""
    place = F.col("pos")
    for number in range(1, len(masks)):
        at = _begin(masks, number)
        place = F.when(F.col("pos") >= at, F.col("pos") - at).otherwise(place)
    return place


def _seeded(table: DataFrame, keep: str, text: str, masks: tuple[str, ...]) -> DataFrame:
    """``keep`` column, ``n`` (words), ``pos`` and ``hash`` of each seed of a text."""
    made = table.select(keep, seeds(text, masks).alias("made"))
    return made.select(keep, "made.n", F.posexplode("made.hashes").alias("pos", "hash"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    overlap: int = OVERLAP,
    agree: float = AGREE,
    doc_id: str = "doc_id",
    text: str = "text",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs of a document and a benchmark item that overlap, each with its best alignment:

    ``doc_id, item_id, doc_word`` and ``item_word`` (where the aligned words begin), ``n_words`` (aligned),
    ``n_equal``, ``best_window`` (most equal words in a window), ``row_key``. An item shorter than a window
    is the window. Items of fewer than ``LEAST_WORDS`` words are too short to tell and found nowhere; null
    texts have no words. A mask for short items is used if there are any. Items with the same text are searched once and reported each. Rows of ``docs`` that
    are equal in id and text give their pairs once.
    """
    key = fresh(docs, "row_key")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias(key))
    read = benchmark.select("item_id", F.col("text").alias("item_text"))
    items = read.groupBy("item_text").agg(F.collect_set("item_id").alias("item_ids"), F.max(F.col("item_id").isNull()).alias("unnamed"))
    items = materialize(items.select(F.xxhash64("item_text").alias("item"), "item_text", F.expr(words("item_text")).alias("w"), "item_ids", "unnamed"), "items")

    short = items.filter(F.size("w").between(LEAST_WORDS, overlap - 1))
    if not short.isEmpty():
        masks = (*masks, SHORT_MASK)
    place = _place(masks)
    of_items = _seeded(items.filter(F.size("w") >= LEAST_WORDS), "item", "item_text", masks)
    if masks[-1] == SHORT_MASK:
        of_items = of_items.filter((F.col("n") < overlap) | (F.col("pos") < _begin(masks, len(masks) - 1)))
    sought = materialize(of_items.select("item", "hash", place.alias("item_word")).distinct(), "sought")
    blocks = max(1, -(-sought.count() // block_rows))

    hashed = _seeded(keyed, key, "text", masks)
    found = None
    for block in range(blocks):
        part = sought if blocks == 1 else sought.filter(F.pmod(F.col("item"), F.lit(blocks)) == block)
        hits = hashed.join(F.broadcast(part), "hash")
        aligned = hits.select(key, "item", (place - F.col("item_word")).alias("shift")).groupBy(key, "item", "shift").agg(F.count("*").alias("hits"))
        found = aligned if found is None else found.unionByName(aligned)
    found = materialize(found, "aligned")

    # written, so that the words of a document are split once and not for every alignment
    candidates = keyed.join(found.select(key).distinct(), key, "left_semi").dropDuplicates([key])
    candidates = candidates.select(key, "doc_id", F.expr(words("text")).alias("doc_w"))
    candidates = materialize(candidates, "candidates")
    compared = found.join(candidates, key).join(items, "item").select(
        key, "doc_id", "item_ids", "unnamed", "shift", F.expr("greatest(0, -shift)").alias("from"), F.expr("least(size(w), size(doc_w) - shift)").alias("to"), F.size("w").alias("item_n"),
        F.expr("transform(slice(w, greatest(0, -shift) + 1, least(size(w), size(doc_w) - shift) - greatest(0, -shift)), (x, i) -> cast(x = get(doc_w, i + greatest(0, shift)) AS int))").alias("same"),
    )
    window = F.least(F.lit(overlap), F.col("item_n"))
    sums = F.expr(f"transform(sequence(0, size(same) - least({overlap}, item_n)), i -> aggregate(slice(same, i + 1, least({overlap}, item_n)), 0, (a, x) -> a + x))")
    judged = compared.withColumn("best_window", F.when(F.size("same") >= window, F.array_max(sums)).otherwise(0))
    judged = judged.filter(F.col("best_window") >= F.ceil(window * F.lit(agree))).withColumn("n_equal", F.expr("aggregate(same, 0, (a, x) -> a + x)"))
    ids = F.when(F.col("unnamed"), F.concat("item_ids", F.array(F.lit(None).cast(benchmark.schema["item_id"].dataType)))).otherwise(F.col("item_ids"))
    named = judged.select(
        "doc_id", F.explode(ids).alias("item_id"), (F.col("from") + F.col("shift")).alias("doc_word"), F.col("from").alias("item_word"), (F.col("to") - F.col("from")).alias("n_words"), "n_equal", "best_window", F.col(key).alias("row_key")
    )
    best = F.max_by(F.struct("doc_word", "item_word", "n_words", "n_equal", "best_window"), F.struct("best_window", "n_equal", -F.col("doc_word")))
    return named.groupBy("row_key", "doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*", "row_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that overlap with a benchmark item."""
    key = fresh(docs, "row_key")
    found = contaminated(docs, benchmark, doc_id=doc_id, text=text).select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key(doc_id, text)).join(found, key, "left_anti").select(*docs.columns)
