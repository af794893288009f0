"""Near copies by SimHash fingerprints of word shingles, compared bit-sliced, each link verified by Jaccard similarity.

Documents with equal shingle sets are one node. Fingerprints have ``BITS`` bits, as 64 cannot tell a
similarity of 0.8 from 0.6: of 2048 bits sets of similarity s differ in about 2048 acos(2 s / (1 + s)) / pi,
give or take 16, which is 310 at 0.8 and 459 at 0.62. Nodes meet in the buckets of ``BANDS`` keys of ``ROWS``
minima each; two nodes of similarity s share no key with probability (1 - s^ROWS)^BANDS, 5e-8 at 0.8.

In the first rounds the nodes of a bucket are compared with one of them, so that a large group of near copies
becomes one class in about as many comparisons as it has nodes. Then a bucket's nodes of different classes are
compared with each other: the bits are stored in vertical planes, one long integer a plane with a lane for each
node, and for one shift after another all lanes are compared with the lanes so far behind them, in carry-save
counters, until every lane is beyond the radius. No rows are made of pairs that are. A bucket of more than
``BUCKET`` nodes is compared in blocks, each pair of blocks in a place of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.components import components
from fieldloom.llm.phrases import bitmap
from fieldloom.llm.simhash import from_lanes, to_lanes
from fieldloom.llm.text import fresh, map_texts, quoted, reachable, words_of
from fieldloom.session import discard, materialize, settle

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
#: Bits of a fingerprint, standard deviations that the radius allows, and the size under which sets differ in more bits.
BITS, DEVIATIONS, SMALL = 2048, 4, 64
#: Rounds in which the nodes of a bucket are compared with one of them only, by so many bits.
STARS, HEAD_BITS = 2, 512
#: Nodes of a bucket that are compared in one place, and lanes compared at once.
BUCKET, LANES = 2048, 8192

_RANDOM = np.random.default_rng(5)
_FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_MIX = _RANDOM.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_SPREAD = _RANDOM.integers(0, 1 << 64, (2, BITS // 64), np.uint64) | np.uint64(1)


def shingles_of(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words has none."""
    words = words_of(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    return np.unique(np.array([digest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(shingle)))], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 512):
        np.minimum(least, (hashes[i : i + 512, None] * _FACTORS).min(0), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64)


def fingerprint_of(hashes: np.ndarray) -> np.ndarray:
    """``BITS`` bits as 64-bit numbers: those set in over half the hashes, each spread to that length."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1024):
        x = hashes[i : i + 1024, None] * _SPREAD[0]
        x = (x ^ (x >> np.uint64(29))) * _SPREAD[1]
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def radius_of(similarity: float, small: bool, bits: int = BITS) -> int:
    """Differing ``bits`` that two sets of that similarity hardly ever exceed; small sets often have ties."""
    share = max(math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi, 0.1875 if small and similarity < 1 else 0)
    return min(bits, int(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share))))


def _node(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _sketches(shingle: int):
    def work(texts: list[bytes | None]) -> list[pa.Array]:
        sets = [shingles_of(t, shingle) for t in texts]
        keys = [band_keys(s).view(np.int64) if len(s) else None for s in sets]
        return [pa.array([_node(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]

    return work


def _sets(shingle: int):
    def work(texts: list[bytes | None]) -> list[pa.Array]:
        sets = [shingles_of(t, shingle) for t in texts]
        bits, keys = [fingerprint_of(s).view(np.int64) for s in sets], [band_keys(s).view(np.int64) for s in sets]
        return [pa.array([_node(s) for s in sets], pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary())]

    return work


def planes(bits: np.ndarray) -> list[int]:
    """``BITS`` integers; bit i of the k-th is bit k of the fingerprint ``bits[i]`` (a row of 64-bit numbers)."""
    lanes = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little")
    packed = np.packbits(lanes, axis=0, bitorder="little")
    return [int.from_bytes(packed[:, k].tobytes(), "little") for k in range(packed.shape[1])]


def _add(a: int, b: int, c: int) -> tuple[int, int]:
    """Sum and carry of three bits in every lane."""
    u = a ^ b
    return u ^ c, a & b | u & c


def within(vertical: list[int], shift: int, alive: int, radius: int) -> int:
    """Of the lanes in ``alive``, those that differ in at most ``radius`` bits from the lane ``shift`` above.

    Counters begin so that one more than the radius overflows their highest bit.
    """
    width = max(4, (radius + 1).bit_length())
    begin = (1 << width) - radius - 1
    c = [alive if begin >> j & 1 else 0 for j in range(width)]
    for i in range(0, len(vertical), 8):
        x = [(p ^ (p >> shift)) & alive for p in vertical[i : i + 8]]
        x += [0] * (8 - len(x))
        ones, a = _add(c[0], x[0], x[1])
        ones, b = _add(ones, x[2], x[3])
        twos, d = _add(c[1], a, b)
        ones, a = _add(ones, x[4], x[5])
        ones, b = _add(ones, x[6], x[7])
        twos, e = _add(twos, a, b)
        fours, carry = _add(c[2], d, e)
        c[:3] = ones, twos, fours
        for j in range(3, width):
            if not carry:
                break
            c[j], carry = c[j] ^ carry, c[j] & carry
        if carry:
            alive &= ~carry
            if not alive:
                return 0
    return alive


def bucket_pairs(keys: np.ndarray, roots: np.ndarray, sizes: np.ndarray, bits: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of a bucket and of different classes that lie within the radius; rows are sorted by bucket and size."""
    n = len(keys)
    vertical = None
    wide, narrow = radius_of(similarity, True), radius_of(similarity, False)
    for shift in range(1, n):
        same = keys[:-shift] == keys[shift:]
        if not same.any():
            break
        open_lanes = same & (roots[:-shift] != roots[shift:]) & (sizes[:-shift] >= similarity * sizes[shift:])
        if not open_lanes.any():
            continue
        vertical = planes(bits) if vertical is None else vertical
        radius = wide if sizes[:-shift][open_lanes].min() < SMALL else narrow
        a = from_lanes(within(vertical, shift, to_lanes(open_lanes), radius), n)
        if radius == wide:
            apart = np.bitwise_count(bits[a] ^ bits[a + shift]).sum(1)
            a = a[apart <= np.where(sizes[a] < SMALL, wide, narrow)]
        if len(a):
            yield a, a + shift


def _blocks(batches: Iterator[pa.RecordBatch], lanes: int) -> Iterator[pa.Table]:
    """Tables of about ``lanes`` rows that hold whole buckets, from rows sorted by bucket."""
    held: list[pa.RecordBatch] = []

    def cut(final: bool) -> Iterator[pa.Table]:
        nonlocal held
        table = pa.Table.from_batches(held).combine_chunks()
        key = table["bucket"].to_numpy()
        ends = [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), *([len(key)] if final else [])]
        start = 0
        for a, b in zip(ends, [*ends[1:], None]):
            if b is None or b - start > lanes:
                yield table.slice(start, a - start)
                start = a
        held = [] if final else table.slice(start).to_batches()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > 2 * lanes:
            yield from cut(False)
    if sum(b.num_rows for b in held):
        yield from cut(True)


def met_pairs(met: DataFrame, similarity: float, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a < b) of the nodes in ``met`` (key, node, size, root, bits, keys) that share a key, are in different classes
    and lie within the radius. Of the ``keys`` that two nodes share only the first gives their pair. Crowded keys are
    compared in blocks, each pair of blocks as a bucket of its own."""
    n_tasks = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded = met.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket)
    crowded = crowded.select("key", F.ceil(2 * F.col("n") / bucket).cast("int").alias("groups"))
    own = F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")
    other = F.explode(F.when(F.col("groups").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("groups") - 1)))
    dealt = met.join(crowded, "key", "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
    place = F.when(F.col("groups").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.select(place.alias("bucket"), "key", "node", "root", "size", "bits", "keys").repartition(n_tasks, "bucket").sortWithinPartitions("bucket", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, LANES):
            node, root = table["node"].to_numpy(zero_copy_only=False), table["root"].to_numpy(zero_copy_only=False)
            bits, keys = (np.stack([np.asarray(x) for x in table[c].to_numpy(zero_copy_only=False)]).view(np.uint64) for c in ("bits", "keys"))
            own = table["key"].to_numpy().view(np.uint64)
            for a, b in bucket_pairs(table["bucket"].to_numpy(), root, table["size"].to_numpy(), bits, similarity):
                first = keys[a, (keys[a] == keys[b]).argmax(1)] == own[a]
                a, b = a[first], b[first]
                yield pa.RecordBatch.from_arrays([pa.array(node[a], pa.binary()), pa.array(node[b], pa.binary())], names=["x", "y"])

    pairs = reachable(dealt).mapInArrow(run, "x binary, y binary")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()


def likely(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``columns`` (strings) are not in ``wanted``, found without a shuffle.

    A bitmap of bounded size tells them apart. It loses no row that is wanted; a join drops the others that stay.
    """
    known = bitmap(wanted.select(F.xxhash64(*columns).alias("number")))

    @F.pandas_udf("boolean")
    def has(number: pd.Series) -> pd.Series:
        return pd.Series(known.value.has(number.to_numpy().view(np.uint64)))

    return reachable(rows).filter(has(F.xxhash64(*columns)))


def _apart(a: str, b: str) -> Column:
    """Differing bits of two fingerprints."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the ``pairs`` (a, b), those whose ``sets`` (node, hashes) are at least so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    of_a, of_b = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}")) for c in "ab")
    both = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "of_a", "of_b")
    return reachable(both).mapInArrow(run, "a binary, b binary")


def similar_links(met: DataFrame, sets: DataFrame, similarity: float, bucket: int = BUCKET) -> DataFrame:
    """``node, root`` of what verified links connect, of the nodes that share a key in ``met`` (key, node, size).

    ``sets`` has a row (node, bits, keys, hashes) for each node of ``met``. Nodes are 128 bits; an empty table gives
    no rows; a null key is shared by nobody; rows that repeat count once.
    """
    links = None
    head = sets.select("node", F.slice("bits", 1, HEAD_BITS // 64).alias("head"))
    met = materialize(met.filter("key IS NOT NULL").distinct().join(head, "node"), "met")
    placed = met.withColumn("root", F.col("node"))
    for turn in range(STARS + 1):
        if turn < STARS:
            first = placed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "root", "size", "head")).alias("o"))
            other = first.select("key", *(F.col(f"o.{c}").alias(f"other_{c}") for c in ("node", "root", "size", "head")))
            small = F.least("size", "other_size") < SMALL
            radius = F.when(small, radius_of(similarity, True, HEAD_BITS)).otherwise(radius_of(similarity, False, HEAD_BITS))
            apart = placed.join(other, "key").filter("root <> other_root").filter(F.least("size", "other_size") >= similarity * F.greatest("size", "other_size"))
            pairs = apart.filter(_apart("head", "other_head") <= radius).select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()
        else:
            # only keys whose nodes are in several classes have anything left to compare
            split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
            left = placed.join(split, "key", "left_semi").drop("head")
            pairs = met_pairs(left.join(sets.select("node", "bits", "keys"), "node"), similarity, bucket)
        pairs = materialize(pairs, "pairs")
        settle(met.sparkSession)
        found = materialize(verified(pairs, sets, similarity), "similar")
        discard(pairs)
        settle(met.sparkSession)
        links = found if links is None else links.unionByName(found)
        if turn:
            discard(placed)
        reached = components(links)
        if turn < STARS:
            placed = materialize(met.join(reached, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
        settle(met.sparkSession)
    discard(met)
    return reached


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id; a null id counts as the largest.

    A class is what links reach between documents whose sets of ``shingle`` words have at least that Jaccard
    similarity. Texts that are null or without words are one class. Of several rows with that id and text,
    one stays. Texts are read whole, the very long ones too: a document's set takes 8 bytes a word. An empty
    table gives no rows.
    """
    mark, key = fresh(docs, "text_hash"), fresh(docs, "id_text")
    body, ident = F.col(quoted(text)).cast("string"), F.col(quoted(doc_id))
    named = F.coalesce(F.concat(F.lit("="), ident.cast("string")), F.lit("null"))
    marked = docs.withColumn(mark, F.md5(F.coalesce(body, F.lit("")))).withColumn(key, named)
    found = materialize(map_texts(marked, text, [doc_id, mark, key], _sketches(shingle), "node binary, size long, keys array<long>"), "sketches")
    found = found.toDF("id", "mark", "named", "node", "size", "keys")

    # a node's sketch and the row that speaks for it, found from what each task has of the node
    rank = F.struct(F.col("id").isNull().alias("unnamed"), "id", "named", "mark")
    nodes = materialize(found.groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), F.min(rank).alias("best")), "nodes")
    banded = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    met = materialize(banded.join(materialize(shared, "shared"), "key"), "meetings")
    needed = nodes.join(met.select("node").distinct(), "node", "left_semi").select(F.col("best.named").alias(key), F.col("best.mark").alias(mark))
    needed = materialize(needed, "needed")
    discard(nodes)
    settle(docs.sparkSession)
    # only texts that are likely needed are shuffled; the rows of one id and text are of one node
    asked = likely(marked.select(F.col(quoted(text)), key, mark), needed, [key, mark])
    spoken = asked.join(needed, [key, mark], "left_semi").dropDuplicates([key, mark])
    sets = materialize(map_texts(spoken, text, [], _sets(shingle), "node binary, bits array<long>, keys array<long>, hashes binary"), "sets")
    settle(docs.sparkSession)
    reached = similar_links(met.select("key", "node", "size"), sets, similarity, bucket)
    discard(met)
    discard(sets)

    best = found.join(reached, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(rank).alias("best"))
    wanted = materialize(best.select(F.col("best.named").alias(key), F.col("best.mark").alias(mark)), "kept")
    discard(found)
    settle(docs.sparkSession)
    return marked.join(wanted, [key, mark], "left_semi").dropDuplicates([key, mark]).select(*(F.col(quoted(c)) for c in docs.columns))
