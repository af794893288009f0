"""Language of texts by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read the bytes of a window forwards and backwards; from both states each
position gets a distribution over the languages, and a document's is the mean over its positions.
The network is trained in numpy by backpropagation through time on a bounded sample: at most
``SAMPLE_DOCS`` documents of each language and ``SAMPLE_WINDOWS`` windows of each document. Whole texts
are predicted, all windows of a slice side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.text import held_out, map_texts, row_key

#: Units of a layer, bytes of a window, documents of a language and windows of a document in the sample.
UNITS, WINDOW, SAMPLE_DOCS, SAMPLE_WINDOWS = 8, 64, 300, 4
#: Languages that are told apart at most, passes over the sample, windows in a step, step size, seed.
LANGUAGES, EPOCHS, BATCH, RATE, SEED = 256, 5, 128, 0.02, 11
#: Windows that go through the network side by side.
LANES = 4096

NO_BYTE = 256  # fills windows up


def windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """The bytes of a text in rows of ``size``; the last row is filled up with ``NO_BYTE``."""
    rows = -(-len(text) // size)
    grid = np.full(rows * size, NO_BYTE, np.int16)
    grid[: len(text)] = np.frombuffer(text, np.uint8)
    return grid.reshape(rows, size)


@dataclass
class Network:
    """For each direction: ``x`` (inputs by byte), ``u`` (recurrence) of the update, reset and new gates, one below
    the other; ``out`` and ``bias`` give the languages from both states. Gate values are halved sigmoids: the
    update and reset gates are (1 + tanh) / 2 of what comes in."""

    x: list[np.ndarray]  # (3 units, 257)
    u: list[np.ndarray]  # (3 units, units)
    out: np.ndarray  # (languages, 2 units)
    bias: np.ndarray  # (languages, 1)

    def parts(self) -> list[np.ndarray]:
        return [*self.x, *self.u, self.out, self.bias]


def start(languages: int, units: int = UNITS, seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)

    def drawn(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    x = [drawn(3 * units, 257, scale=0.3) for _ in range(2)]
    u = [drawn(3 * units, units, scale=0.3) for _ in range(2)]
    return Network(x, u, drawn(languages, 2 * units, scale=0.3), np.zeros((languages, 1), np.float32))


def read(net: Network, direction: int, codes: np.ndarray, keep: bool = False):
    """States after each position, (positions, units, lanes); ``codes`` is (positions, lanes).

    Where a window is filled up the state stays as it is. ``keep`` adds what backpropagation needs.
    """
    steps, lanes = codes.shape
    units = net.u[0].shape[1]
    x, u = net.x[direction], net.u[direction]
    states = np.empty((steps, units, lanes), np.float32)
    h = np.zeros((units, lanes), np.float32)
    trace = []
    order = range(steps) if direction == 0 else range(steps - 1, -1, -1)
    for t in order:
        gates = np.take(x, codes[t], axis=1)
        fed = u @ h
        zr = np.tanh(gates[: 2 * units] + fed[: 2 * units])
        fed_new = fed[2 * units :]
        new = np.tanh(gates[2 * units :] + 0.5 * (1 + zr[units:]) * fed_new)
        moved = 0.5 * ((new + h) + zr[:units] * (h - new))
        gone = codes[t] == NO_BYTE
        if gone.any():
            moved = np.where(gone, h, moved)
        if keep:
            trace.append((h, zr, new, fed_new, gone))
        h = states[t] = moved
    return (states, trace) if keep else states


def position_probabilities(net: Network, codes: np.ndarray) -> np.ndarray:
    """(positions, languages, lanes): what each position says."""
    both = np.concatenate([read(net, 0, codes), read(net, 1, codes)], axis=1)
    scores = np.matmul(net.out, both) + net.bias
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def gradients(net: Network, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions that have a byte, and its gradient for ``net.parts()``."""
    steps, lanes = codes.shape
    units = net.u[0].shape[1]
    traces = [read(net, d, codes, keep=True) for d in (0, 1)]
    both = np.concatenate([s for s, _ in traces], axis=1)
    scores = np.matmul(net.out, both) + net.bias
    scores -= scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(axis=1, keepdims=True)
    there = (codes != NO_BYTE).astype(np.float32)
    count = max(float(there.sum()), 1.0)
    loss = -float((np.log(p[:, labels, np.arange(lanes)] + 1e-9) * there).sum()) / count
    error = p
    error[:, labels, np.arange(lanes)] -= 1
    error *= there[:, None, :] / count
    d_out = np.einsum("tcn,thn->ch", error, both, optimize=True)
    d_bias = error.sum((0, 2))[:, None]
    d_both = np.matmul(net.out.T, error)

    made = []
    for direction in (0, 1):
        u = net.u[direction]
        dx, du = np.zeros_like(net.x[direction]), np.zeros_like(u)
        dh = np.zeros((units, lanes), np.float32)
        trace = traces[direction][1]
        order = range(steps) if direction == 0 else range(steps - 1, -1, -1)
        for t, (h, zr, new, fed_new, gone) in zip(reversed(list(order)), reversed(trace)):
            dh = dh + d_both[t, direction * units : (direction + 1) * units]
            live = np.where(gone, 0, dh).astype(np.float32)
            z, r = zr[:units], zr[units:]
            d_new = live * 0.5 * (1 - z)
            d_in_new = d_new * (1 - new * new)
            d_fed_new = d_in_new * 0.5 * (1 + r)
            d_in_r = d_in_new * 0.5 * fed_new * (1 - r * r)
            d_in_z = live * 0.5 * (h - new) * (1 - z * z)
            d_in = np.concatenate([d_in_z, d_in_r, d_in_new])
            d_fed = np.concatenate([d_in_z, d_in_r, d_fed_new])
            np.add.at(dx.T, codes[t], d_in.T)
            du += d_fed @ h.T
            dh = live * 0.5 * (1 + z) + u.T @ d_fed + np.where(gone, dh, 0)
        made.append((dx, du))
    return loss, [made[0][0], made[1][0], made[0][1], made[1][1], d_out, d_bias]


def train(rows: np.ndarray, labels: np.ndarray, languages: int, units: int = UNITS, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network for windows (``rows``) and their languages; every language weighs alike. Steps are Adam's."""
    net = start(languages, units, seed)
    rng = np.random.default_rng(seed)
    counts = np.bincount(labels, minlength=languages)
    share = 1 / np.maximum(counts[labels], 1)
    first = [np.zeros_like(p) for p in net.parts()]
    second = [np.zeros_like(p) for p in net.parts()]
    total = epochs * -(-len(rows) // BATCH)
    for step in range(1, total + 1):
        chosen = rng.choice(len(rows), min(BATCH, len(rows)), p=share / share.sum())
        _, slopes = gradients(net, np.ascontiguousarray(rows[chosen].T), labels[chosen])
        rate = RATE * (1 - step / (total + 1))
        for p, g, m, v in zip(net.parts(), slopes, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean distribution over the positions of each text (texts, languages); zero for empty ones."""
    found = np.zeros((len(texts), len(net.bias)))
    for a in range(0, len(texts), LANES):
        _pool(net, texts[a : a + LANES], found[a : a + LANES])
    return found / np.maximum([[len(t)] for t in texts], 1)


def _pool(net: Network, texts: list[bytes], found: np.ndarray) -> None:
    """Adds each text's position probabilities to its row of ``found``, ``LANES`` windows at a time."""
    held, owners, size = [], [], 0

    def flush() -> None:
        rows, owner = np.concatenate(held), np.concatenate(owners)
        p = position_probabilities(net, np.ascontiguousarray(rows.T))
        p *= (rows.T != NO_BYTE)[:, None, :]
        np.add.at(found, owner, p.sum(axis=0).T)

    for i, text in enumerate(texts):
        grid = windows(text)
        for b in range(0, len(grid), LANES):
            part = grid[b : b + LANES]
            if size + len(part) > LANES:
                flush()
                held, owners, size = [], [], 0
            held.append(part)
            owners.append(np.full(len(part), i))
            size += len(part)
    if size:
        flush()


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, modulus: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of training documents, their languages, and the languages' names.

    Documents are chosen by a hash of id and text below a bound that leaves about ``SAMPLE_DOCS`` of a
    language; a document's windows by hashes of its text. Rows that repeat are chosen together, and once.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id, modulus))
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang).cast("string")).count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    names = sorted(counts)
    if not names:
        return np.zeros((0, WINDOW), np.int16), np.zeros(0, int), []
    bounds = F.create_map(*(F.lit(x) for name in names for x in (name, SAMPLE_DOCS / counts[name])))
    keyed = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), row_key(doc_id, text).alias("row_key"))
    chosen = keyed.filter(F.shiftrightunsigned("row_key", 11) / F.lit(2.0**53) < F.element_at(bounds, F.col("lang")))

    def cut(texts: list[bytes | None]) -> list[pa.Array]:
        rows, parts = [], []
        for i, t in enumerate(texts):
            spots = range(0, len(t), WINDOW)
            for at in sorted(spots, key=lambda s: xxhash.xxh64_intdigest(t[s : s + WINDOW], s))[:SAMPLE_WINDOWS]:
                rows.append(i)
                parts.append(t[at : at + WINDOW])
        return [pa.array(rows, pa.int64()), pa.array(parts, pa.binary())]

    # distinct before it is gathered: a chosen document may have any number of copies
    parts = map_texts(chosen, "text", ["lang", "row_key"], cut, "part binary").distinct()
    got = sorted((r.lang, r.row_key, bytes(r.part)) for r in parts.collect())
    rows = np.concatenate([windows(part) for _, _, part in got]) if got else np.zeros((0, WINDOW), np.int16)
    return rows, np.array([names.index(name) for name, _, _ in got], int), names


def predict(docs: DataFrame, modulus: int = 5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score`` (pooled probability of the prediction).

    The network learns from the labelled documents that are not held out, and sees bytes alone. A text that
    is null or has no letter is ``und`` with score 0, and so is every text if nothing is labelled. Of equal
    probabilities the first language in order wins. Rows that repeat are predicted each.
    """
    rows, labels, names = sample(docs, doc_id, text, lang, modulus)
    net = train(rows, labels, len(names)) if names else None
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        if net is None:
            return [pa.array(["und"] * len(texts)), pa.array([0.0] * len(texts))]
        p = pooled(net, [t or b"" for t in texts])
        return [pa.array([names[k] for k in p.argmax(1)]), pa.array(p.max(1))]

    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), letters.alias("letters"))
    made = map_texts(keyed, "text", ["doc_id", "letters"], work, "lang_read string, sure double")
    return made.select(
        "doc_id",
        held_out("doc_id", modulus).alias("held_out"),
        F.when(F.col("letters"), F.col("lang_read")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.least("sure", F.lit(1.0))).otherwise(0.0).alias("score"),
    )
