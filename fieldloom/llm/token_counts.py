"""Token counts of whole texts: batches through the tokenizer's library, lengths only.

A text is split at safe boundaries into chunks, each a run of ASCII white space and the run of other
characters after it. A byte-level pre-tokenizer never joins a character that is not white space to
white space after it, and looks ahead only over white space, so the tokens of a text are those of its
chunks, one after the other. Texts for which this doesn't hold go to the library whole. Chunks recur
all the time: each worker keeps the lengths of those it has met, in bounded memory, and only new ones
go to the library, in batches balanced by bytes. A new chunk of one blank, letters and punctuation
is split once more, where the pre-tokenizer splits it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.text import byte_slices, map_texts
from fieldloom.llm.tokens import LETTERS, MARKS, Kept, encoded, encoded_joined, plain_specials, rules, tokens_with

#: Chunks are looked up for about so much text at a time: it stays in a processor's cache.
LOOKUP_BYTES = 1 << 17

_CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_PLAIN = re.compile(f"( {LETTERS})({MARKS})")
#: White space beyond ASCII; a chunk that ends with it would part one run of white space.
_OTHER_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Counter:
    """Counts tokens of texts."""

    def __init__(self, path: str):
        self.path, self.chunks, self.words = path, Kept(), Kept()
        pre = rules(path).get("pre_tokenizer") or {}
        self.chunked = (
            pre.get("type") == "ByteLevel"
            and pre["use_regex"]
            and not pre["add_prefix_space"]
            and rules(path).get("normalizer") is None
            and plain_specials(path)
        )

    def safe(self, text: str) -> bool:
        return self.chunked and (text.isascii() or not _OTHER_SPACE.search(text))

    def counts(self, texts: list[bytes | None]) -> list[int]:
        return [n for a, b in byte_slices(texts, LOOKUP_BYTES) for n in self._counts(texts[a:b])]

    def _counts(self, texts: list[bytes | None]) -> list[int]:
        plain = [(t or b"").decode() for t in texts]
        safe = [self.safe(t) for t in plain]
        chunked = iter(self.chunks.values([_CHUNK.findall(t) for t, ok in zip(plain, safe) if ok], self.new_chunks))
        whole = encoded(self.path, list({t for t, ok in zip(plain, safe) if not ok}))
        return [sum(next(chunked)) if ok else len(whole[t]) // 4 for t, ok in zip(plain, safe)]

    def new_chunks(self, chunks: list[str]) -> dict[str, int]:
        """Tokens of new chunks, plain ones from their word and their punctuation."""
        parts, odd = {}, []
        for c in chunks:
            m = _PLAIN.fullmatch(c)
            if m:
                parts[c] = m.groups()
            else:
                odd.append(c)
        first = list({w for w, _ in parts.values()})
        words = dict(zip(first, self.words.values([first], self.new_words)[0]))
        rest = {c: len(ids) // 4 for c, ids in encoded(self.path, odd + list({m for _, m in parts.values() if m})).items()}
        rest[""] = 0
        return {c: rest[c] for c in odd} | {c: words[w] + rest[m] for c, (w, m) in parts.items()}

    def new_words(self, words: list[str]) -> dict[str, int]:
        made = encoded_joined(self.path, words, "", tokens_with(self.path, "Ġ", ""), False)
        return {w: len(ids) // 4 for w, ids in made.items()}


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Tokens are those of the library without begin, end or added special tokens; special strings in a
    text are treated as the library does by default. Null and empty texts have 0 bytes and 0 tokens;
    rows that repeat are counted each; a null id stays null; other columns are not read.
    """

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        if tokenizer_path not in _counters:
            _counters[tokenizer_path] = Counter(tokenizer_path)
        counts = _counters[tokenizer_path].counts(texts)
        return [pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(counts, pa.int64())]

    found = map_texts(docs, text, [doc_id], work, "n_bytes long, n_tokens long")
    return found.select(doc_id, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
