"""Near duplicates by SimHash fingerprints, compared in bit-sliced blocks.

Fingerprints within ``RADIUS`` differing bits are linked; a document's class is what its links reach.
Equal fingerprints are one node. Two fingerprints that differ in at most 2 of 64 bits agree in at
least two of four blocks of 16 bits, so nodes meet in six tables of 32-bit keys. Within a bucket of
a table the 64 bit planes are stored vertically, one long integer a plane with a lane for each
fingerprint; for one shift after another all lanes are compared with the lanes so far behind them at
once, in carry-save counters, and a block is abandoned as soon as every lane exceeds the radius.
Lanes that are in one class already are not compared again.

A bucket of more than ``BUCKET`` nodes would take time with the square of its size. Its nodes meet
instead at every value within one bit of them: two fingerprints differ in at most 2 bits exactly if
they have such a value in common. That is 65 rows a node, no comparison, and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.components import components
from fieldloom.llm.text import fresh, map_texts, reachable, words_of
from fieldloom.session import discard, materialize

RADIUS, BLOCKS, BLOCK_BITS = 2, 4, 16
#: Nodes of a bucket that are compared with each other, and lanes compared at once.
BUCKET, LANES = 2048, 8192


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """Bits set in over half the hashes of the shingles, repeats included; 0 without words."""
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(shingle)))]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``bits`` (the fingerprint as a signed number) of every row; null texts have no words."""

    return map_texts(docs, text, [doc_id], _bits, "bits long")


def _bits(texts: list[bytes | None]) -> list[pa.Array]:
    made = np.array([fingerprint(words_of(t, lower=True)) for t in texts], np.uint64)
    return [pa.array(made.view(np.int64))]


def planes(bits: np.ndarray) -> list[int]:
    """64 integers; bit i of the k-th is bit k of ``bits[i]``."""
    lanes = np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(lanes, axis=0, bitorder="little")
    return [int.from_bytes(packed[:, k].tobytes(), "little") for k in range(64)]


def to_lanes(mask: np.ndarray) -> int:
    return int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")


def from_lanes(mask: int, n: int) -> np.ndarray:
    raw = np.frombuffer(mask.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, count=n, bitorder="little"))


def within(vertical: list[int], shift: int, alive: int) -> int:
    """Of the lanes in ``alive``, those that differ in at most 2 bits from the lane ``shift`` above."""
    ones = twos = 0
    for plane in vertical:
        x = (plane ^ (plane >> shift)) & alive
        carry = ones & x
        ones ^= x
        alive &= ~(twos & x)  # a third differing bit
        twos |= carry
        if not alive:
            return 0
    return alive


def root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def bucket_links(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the radius, for rows sorted by bucket: at most one fewer than rows."""
    n = len(bits)
    vertical, parent, label = planes(bits), list(range(n)), np.arange(n)
    left, right = [], []
    for shift in range(1, n):
        same = keys[:-shift] == keys[shift:]
        if not same.any():
            break
        open_lanes = same & (label[:-shift] != label[shift:])
        if not open_lanes.any():
            continue
        found = from_lanes(within(vertical, shift, to_lanes(open_lanes)), n)
        for i in found.tolist():
            a, b = root(parent, i), root(parent, i + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + shift)
        if len(found):
            label = np.fromiter((root(parent, i) for i in range(n)), np.int64, n)
    return bits[left], bits[right]


def sorted_blocks(batches: Iterator[pa.RecordBatch], lanes: int = LANES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of about ``lanes`` rows that hold whole buckets, from rows sorted by (band, key)."""
    held: list[pa.RecordBatch] = []

    def cut(final: bool):
        nonlocal held
        table = pa.Table.from_batches(held)
        key = (table["band"].to_numpy().astype(np.uint64) << np.uint64(32)) | table["key"].to_numpy().astype(np.uint64)
        bits = table["bits"].to_numpy().view(np.uint64)
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        if not final:
            ends = ends[:-1]
        start = 0
        for a, b in zip(ends, [*ends[1:], None]):
            if b is None or b - start > lanes:
                yield key[start:a], bits[start:a]
                start = a
        held = table.slice(start).to_batches() if not final else []

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > 4 * lanes:
            yield from cut(False)
    if sum(b.num_rows for b in held):
        yield from cut(True)


def link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, bits in sorted_blocks(batches):
        a, b = bucket_links(keys, bits)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def near_links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect exactly the ``bits`` of ``nodes`` (distinct) within two bits of each other."""
    spark = nodes.sparkSession
    mask = (1 << BLOCK_BITS) - 1
    part = [F.shiftrightunsigned("bits", BLOCK_BITS * i).bitwiseAND(F.lit(mask)) for i in range(BLOCKS)]
    tables = [(i, j) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]
    keys = F.array(*(F.shiftleft(part[i], BLOCK_BITS).bitwiseOR(part[j]) for i, j in tables))
    banded = nodes.select("bits", F.posexplode(keys).alias("band", "key"))
    sizes = banded.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = materialize(sizes, "buckets")
    met = materialize(banded.join(sizes, ["band", "key"]).select("band", "key", "bits", "n"), "met")
    discard(sizes)

    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = met.filter(F.col("n") <= bucket).select("band", "key", "bits")
    small = reachable(small).repartition(n_tasks, "band", "key").sortWithinPartitions("band", "key", "bits")
    compared = small.mapInArrow(link_blocks, "a long, b long")

    crowded = met.filter(F.col("n") > bucket).select("bits").distinct()
    flipped = [F.lit(0)] + [F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)]
    near = crowded.select("bits", F.explode(F.transform(F.array(*flipped), lambda f: F.col("bits").bitwiseXOR(f))).alias("middle"))
    first = near.groupBy("middle").agg(F.min("bits").alias("first"), F.count("*").alias("n")).filter("n > 1")
    through = near.join(first, "middle").filter("bits <> first").select(F.col("bits").alias("a"), F.col("first").alias("b"))
    return compared.unionByName(through).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 hex digits), ``component_id``, ``bits`` and ``root``.

    ``component_id`` is the smallest id that links reach from the row, its own included; an id that is
    null is it only where all are. ``root`` names the class also where ids repeat or are null. Texts
    that are null or without words have fingerprint 0 and are linked like others. Rows that repeat are
    in one class. An empty table gives no rows.
    """
    found = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = materialize(found.groupBy("bits").agg(F.min(doc_id).alias("first")), "nodes")
    links = near_links(nodes.select("bits"), bucket)
    reached = components(links)
    discard(links)  # the table of meetings, which nothing reads any more
    rooted = nodes.join(reached, nodes.bits == reached.node, "left").select("bits", "first", F.coalesce("root", "bits").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialize(rooted.join(smallest, "root").select("bits", "root", "component_id"), "classes")
    discard(nodes)
    discard(reached)
    hexed = F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint")
    return found.join(classes, "bits").select(doc_id, hexed, "component_id", "bits", "root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id; a null id counts as the largest.

    Of several rows with that id and fingerprint, one stays.
    """
    rank = F.struct(F.col(doc_id).isNull(), F.col(doc_id).alias("id"), F.col("bits").alias("bits"))
    best = near_duplicates(docs, doc_id, text, bucket).groupBy("root").agg(F.min(rank).alias("best"))
    key, bits, read = fresh(docs, "id_text"), fresh(docs, "id_bits"), fresh(docs, "text_of")
    id_text = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    wanted = materialize(
        best.select(F.coalesce(F.col("best.id").cast("string"), F.lit("null")).alias(key), F.col("best.bits").alias(bits)), "kept"
    )
    marked = map_texts(docs.withColumn(read, F.col(text)), read, docs.columns, _bits, f"`{bits}` long").withColumn(key, id_text)
    return marked.join(wanted, [key, bits], "left_semi").dropDuplicates([key, bits]).select(*docs.columns)
