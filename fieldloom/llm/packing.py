"""Packing of documents into windows of tokens: best-fit decreasing.

A document is its token ids and one end id. What is longer than a window is cut into full windows
and a rest. Rests are packed in shards of a few thousand, dealt by their place in the written table
of pieces and so of even size whatever the data: within a shard the longest goes first, into the
open window with the least room that still takes it. A segment tree over the remaining capacity
finds that window. A shard leaves a few windows with room; nothing else is padded.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.text import byte_slices, map_texts, reachable
from fieldloom.llm.tokens import MARKS, Kept, encoded, encoded_joined, plain_specials, rules, tokens_with
from fieldloom.session import materialize

#: Rests packed together. More leave less room in windows, and take more memory in a task.
SHARD_PIECES = 4096

#: Words are looked up for about so much text at a time: it stays in a processor's cache.
LOOKUP_BYTES = 1 << 17

_PLAIN = re.compile(f"([a-zß-öø-ÿ]+)({MARKS})")


class WordIds:
    """Ids of texts by their words, for tokenizers that drop white space and lower the case of letters.

    Such a tokenizer treats each run of other characters by itself, so the ids of a text are those of
    its words. Letters A-Z are lowered before words are looked up, where that can't change how marks
    compose with letters, nor make a special string of another one.
    """

    def __init__(self, path: str):
        self.path, self.words, self.letters = path, Kept(500_000), Kept()
        steps = [n.get("type") for n in (rules(path).get("normalizer") or {}).get("normalizers", [])]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and plain_specials(path)
        self.ends = tokens_with(path, "", "</w>")

    def split(self, text: bytes) -> list[bytes]:
        if text.isascii():
            return (text if b"<|" in text else text.lower()).split()
        lower = text.lower()
        composed = unicodedata.is_normalized("NFC", text.decode()) and unicodedata.is_normalized("NFC", lower.decode())
        return (lower if composed and b"<|" not in text else text).split()

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            plain = [(t or b"").decode() for t in texts]
            whole = encoded(self.path, list(set(plain)))
            return [whole[t] for t in plain]
        made = []
        for a, b in byte_slices(texts, LOOKUP_BYTES):
            made += map(b"".join, self.words.values([self.split(t or b"") for t in texts[a:b]], self.new_words))
        return made

    def new_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words, plain ones from their letters and their punctuation."""
        parts, odd = {}, []
        for w in words:
            m = _PLAIN.fullmatch(w.decode())
            if m:
                parts[w] = m.groups()
            else:
                odd.append(w.decode())
        first = list({a for a, _ in parts.values()})
        letters = dict(zip(first, self.letters.values([first], self.new_letters)[0]))
        rest = encoded(self.path, odd + list({m for _, m in parts.values() if m}))
        rest[""] = b""
        return {t.encode(): rest[t] for t in odd} | {w: letters[a] + rest[m] for w, (a, m) in parts.items()}

    def new_letters(self, runs: list[str]) -> dict[str, bytes]:
        return encoded_joined(self.path, runs, " ", self.ends, True)


_ids: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Full windows and the rest of every document: ``doc_id, start, length, ids_crc32, doc_tokens``."""

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        if tokenizer_path not in _ids:
            _ids[tokenizer_path] = WordIds(tokenizer_path)
        rows, starts, lengths, crcs, totals = [], [], [], [], []
        for row, ids in enumerate(_ids[tokenizer_path].ids(texts)):
            ids += end_id.to_bytes(4, "little")
            total = len(ids) // 4
            for start in range(0, total, capacity):
                piece = ids[4 * start : 4 * (start + capacity)]
                rows.append(row)
                starts.append(start)
                lengths.append(len(piece) // 4)
                crcs.append(zlib.crc32(piece))
                totals.append(total)
        return [pa.array(x, pa.int64()) for x in (rows, starts, lengths, crcs, totals)]

    return map_texts(docs, text, [doc_id], work, "start long, length long, ids_crc32 long, doc_tokens long")


class OpenWindows:
    """Windows by remaining capacity, under a segment tree that tells which capacities occur."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.full = [False] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.size
        while node and not self.full[node]:
            self.full[node] = True
            node //= 2

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out a window with the least room for ``length``: (room, window)."""
        full, node = self.full, length + self.size
        while not full[node]:
            while node & 1:  # a right child: what lies to the right is under another parent
                node //= 2
                if node <= 1:
                    return None
            node += 1
        while node < self.size:
            node *= 2
            if not full[node]:
                node += 1
        room = node - self.size
        window = self.windows[room].pop()
        if not self.windows[room]:
            while node and full[node] and (node >= self.size or not (full[2 * node] or full[2 * node + 1])):
                full[node] = False
                node //= 2
        return room, window


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each length; the lengths come in descending order, 1 to ``capacity``."""
    tree, windows, offsets, opened = OpenWindows(capacity), [], [], 0
    for length in lengths:
        found = tree.tightest(length)
        room, window = found or (capacity, opened)
        opened += found is None
        windows.append(window)
        offsets.append(capacity - room)
        if room > length:
            tree.add(room - length, window)
    return windows, offsets


def pack_pieces(pieces: DataFrame, capacity: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (a written table, see ``token_pieces``) with ``sequence_id``, ``offset`` and ``padded_to``.

    ``sequence_id`` is the shard times 2^32 plus a number within it. Pieces follow each other in a
    sequence without a gap. ``padded_to`` is the capacity, or the sequence's own length if that is a
    power of two. Rows that repeat are placed each; equal lengths keep the order of id, start and crc.
    """
    shards = max(1, -(-pieces.count() // shard_pieces))
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("shard")
    names = pieces.columns

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), (names[0], "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = table["length"].to_pylist()
        windows, offsets = best_fit_decreasing(lengths, capacity)
        used = [0] * (max(windows) + 1)
        for w, n in zip(windows, lengths):
            used[w] += n
        base = table["shard"][0].as_py() << 32
        made = ([base + w for w in windows], offsets, [used[w] if used[w] & (used[w] - 1) == 0 else capacity for w in windows])
        return pa.table([*(table[c] for c in names), *(pa.array(x, pa.int64()) for x in made)], names=[*names, "sequence_id", "offset", "padded_to"])

    schema = pieces.select(*names, *(F.lit(0).cast("long").alias(c) for c in ("sequence_id", "offset", "padded_to"))).schema
    return reachable(pieces).select(*names, shard).groupBy("shard").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` tokens.

    Null and empty texts are documents of the end id alone; an empty table gives no rows; a null id
    stays null; other columns are not read.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id, doc_id, text)
    return pack_pieces(materialize(pieces, "pieces"), capacity)
