"""Tokens of many short strings from a tokenizer's library, with as few calls as it takes."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Bytes of text in one call of the library, and strings joined into one text.
CALL_BYTES, JOINED = 1 << 18, 400

#: Letters that no pre-tokenizer here parts, and ASCII punctuation without the apostrophe.
LETTERS, MARKS = "[a-zA-Z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff]+", "[!-&(-/:-@\\[-^`{-~]*"


@lru_cache(maxsize=None)
def tokenizer(path: str):
    """The tokenizer of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file, once per worker."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(maxsize=None)
def rules(path: str) -> dict:
    """The parts of a ``.json`` tokenizer that say how it splits text."""
    return {} if path.endswith(".model") else json.loads(tokenizer(path).to_str())


def plain_specials(path: str) -> bool:
    """Whether special strings contain no white space and take none with them."""
    return not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or re.search(r"\s", t["content"]) for t in rules(path)["added_tokens"])


@lru_cache(maxsize=None)
def tokens_with(path: str, start: str, end: str) -> np.ndarray:
    """For each id, whether its token starts and ends with these strings."""
    vocabulary = tokenizer(path).get_vocab()
    found = np.zeros(max(vocabulary.values()) + 1, bool)
    found[[i for token, i in vocabulary.items() if token.startswith(start) and token.endswith(end)]] = True
    return found


def balanced(texts: list[str], limit: int = CALL_BYTES):
    """Lists of texts of about ``limit`` bytes each, shortest first: no call holds one long text among many short ones."""
    part: list[str] = []
    size = 0
    for text in sorted(texts, key=len):
        n = len(text) if text.isascii() else len(text.encode())
        if part and size + n > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += n
    if part:
        yield part


def encoded(path: str, texts: list[str]) -> dict[str, bytes]:
    """Ids of each text as the library alone gives them, as little-endian unsigned 32-bit numbers."""
    tok, found = tokenizer(path), {}
    for part in balanced(texts):
        if path.endswith(".model"):
            made = tok.encode(part, num_threads=1)
        else:
            made = [e.ids for e in tok.encode_batch_fast(part, add_special_tokens=False)]
        found.update((t, np.array(ids, "<u4").tobytes()) for t, ids in zip(part, made))
    return found


def encoded_joined(path: str, pieces: list[str], glue: str, marked: np.ndarray, at_end: bool) -> dict[str, bytes]:
    """``encoded`` of pieces that a joined text keeps apart, found by the tokens that start or end a piece."""
    found: dict[str, bytes] = {}
    groups = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
    made = encoded(path, list({glue.join(g) for g in groups}))
    for group in groups:
        ids = made[glue.join(group)]
        at = 4 * np.flatnonzero(marked[np.frombuffer(ids, "<u4")])
        if len(at) != len(group):
            found.update(encoded(path, group))
        else:
            cuts = [0, *(at + 4).tolist()] if at_end else [*at.tolist(), len(ids)]
            found.update(zip(group, (ids[a:b] for a, b in zip(cuts, cuts[1:]))))
    return found


class Kept:
    """Values of recurring keys in two generations: what a whole generation did not ask for goes."""

    def __init__(self, size: int = 300_000, longest: int = 48):
        self.size, self.longest = size, longest
        self.young: dict = {}
        self.old: dict = {}

    def values(self, rows: list[list], find) -> list[list]:
        """The values of the keys in each row; ``find`` gives those of a list of keys not kept."""
        young = self.young.get
        found = [list(map(young, row)) for row in rows]
        missing = set()
        for row, values in zip(rows, found):
            at = -1
            for _ in range(values.count(None)):
                at = values.index(None, at + 1)
                missing.add(row[at])
        new, old = {}, self.old.get
        for key in missing:
            value = old(key)
            if value is not None:
                new[key] = value
        unknown = [key for key in missing if key not in new]
        new.update(find(unknown) if unknown else {})
        for row, values in zip(rows, found):
            at = -1
            for _ in range(values.count(None)):
                at = values.index(None, at + 1)
                values[at] = new[row[at]]
        self.young.update((k, v) for k, v in new.items() if len(k) <= self.longest)
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        return found
