"""Chat formatting: records of many layouts to canonical turns, and turns to a template.

A record is JSON. The set of its nested field paths is hashed, and that fingerprint selects a
declarative mapping which says where roles and texts lie; no record is guessed at. A record whose
fingerprint no mapping has gives one row without role and text, so that it can be found.
The template marks turns with control strings, and breaks up those inside texts reversibly. A
formatted conversation is its segments in order; a very long one is never held in one place.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldloom.llm.text import fresh, reachable

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Strings that models treat as marks, whatever the template.
CONTROL = r"(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)|(\[)(/?INST\])"


@dataclass(frozen=True)
class Mapping:
    """``turns`` is the path of a list whose items have ``role`` and ``text``, or "" for the record itself;
    ``fixed`` lists (role, fields) of turns made of fields, joined by an empty line where not empty."""

    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: str | None = None
    role: str = "role"
    text: str = "text"
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def fingerprints(self) -> set[str]:
        """Those of the paths with any of the optional ones; a list that may be empty counts among its own."""
        return {fingerprint({*self.paths, *more}) for n in range(len(self.optional) + 1) for more in combinations(self.optional, n)}


MAPPINGS = (
    Mapping(("role", "text"), ("turn",), turns=""),
    Mapping(("messages[].role", "messages[].content"), ("id",), turns="messages", text="content"),
    Mapping(("conversations[].from", "conversations[].value"), ("id",), turns="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Mapping(("instruction", "output"), ("input", "system"), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("prompt", "completion"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("question", "answer"), ("context",), fixed=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def paths_of(value, path: str = "") -> set[str]:
    """Nested field paths: names joined by dots, ``[]`` for the items of a list."""
    if isinstance(value, dict) and value:
        return set().union(*(paths_of(v, f"{path}.{k}" if path else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths_of(v, path + "[]") for v in value))
    return {path}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def turns_of(record, mapping: Mapping) -> list[tuple[str, str]]:
    """Roles and texts of a record; a text that is null is empty."""

    def plain(value) -> str:
        return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    if mapping.turns is not None:
        items = record[mapping.turns] if mapping.turns else [record]
        return [(mapping.roles.get(plain(x[mapping.role]), plain(x[mapping.role])), plain(x[mapping.text])) for x in items]
    made = []
    for role, names in mapping.fixed:
        if any(n in record for n in names):
            made.append((role, "\n\n".join(x for x in (plain(record.get(n)) for n in names) if x)))
    return made


def canonical_turns(records: DataFrame, keep: list[str], record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``keep`` columns of each record, ``fingerprint``, ``place`` of the turn in the record, ``role`` and ``text``.

    Records that are null, no JSON objects, or of an unknown layout give one row with ``role`` and ``text``
    null; a record with an empty list of turns gives none. Records that repeat give their turns each. Where
    ``keep`` has a column of one of these names, the made one's name begins with an underscore.
    """
    made_names = [fresh(records.select(*keep), name) for name in ("fingerprint", "place", "role", "text")]
    by_print = {p: m for m in mappings for p in m.fingerprints()}
    empty_lists = {m.turns: m for m in mappings if m.turns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, prints, places, roles, texts = [], [], [], [], []
            for i, raw in enumerate(batch.column(len(keep)).to_pylist()):
                try:
                    value = json.loads(raw) if raw is not None else None
                except ValueError:
                    value = None
                mark = fingerprint(paths_of(value)) if isinstance(value, dict) else None
                turns = turns_of(value, by_print[mark]) if mark in by_print else [(None, None)]
                if mark is not None and mark not in by_print and any(value.get(name) == [] for name in empty_lists):
                    turns = []
                for place, (role, text) in enumerate(turns):
                    for column, x in ((rows, i), (prints, mark), (places, place), (roles, role), (texts, text)):
                        column.append(x)
            kept = batch.select(list(range(len(keep)))).take(pa.array(rows, pa.int64()))
            made = [pa.array(prints, pa.string()), pa.array(places, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(kept.columns + made, names=[*keep, *made_names])

    given = records.select(*keep, F.col(record).cast("string").alias(fresh(records.select(*keep), "record")))
    more = records.sparkSession.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in zip(made_names, ("string", "long", "string", "string")))).schema
    return reachable(given).mapInArrow(run, StructType([*(given.schema[c] for c in keep), *more.fields]))


def escape(text: Column) -> Column:
    """No control string is left, and ``unescape`` gives the text back: backslashes are doubled, and one
    comes after the first character of a control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1$3\\$2$4")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "l" else m[1], role, flags=re.S)


def format_turns(turns: DataFrame, order: list[str], group: str, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``group``, ``order`` columns, and each turn's ``segment`` with its loss mask (``loss_start``, ``loss_length``).

    Turns without a role (records that no mapping fits) are left out here. The mask covers the text of
    ``learn`` roles, in code points of the segment; elsewhere it is null. A role is one line: a line break
    in it is written as a backslash and an l, which nothing else is.
    """
    role, text = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\l")), escape(F.col("text"))
    head = F.concat(F.lit(BEGIN), role, F.lit("\n"))
    learned = F.col("role").isin(*learn)
    return turns.filter("role IS NOT NULL").select(
        group,
        *order,
        F.concat(head, text, F.lit(END + "\n")).alias("segment"),
        F.when(learned, F.length(head).cast("long")).alias("loss_start"),
        F.when(learned, F.length(text).cast("long")).alias("loss_length"),
    )


def read_back(segments: DataFrame, order: list[str], group: str) -> DataFrame:
    """What the formatted conversations say, by ``group``: see ``op8`` of the queries.

    Segments are dealt by group and sorted, then read as a stream: a conversation of any length takes a
    few counters and two hashes. Turns follow ``order``; equal ones follow their segments' text.
    """
    kind = segments.schema[group]
    names = [group, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    spark = segments.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def closed(done) -> pa.RecordBatch:
            arrays = [pa.array([x]) for x in (done[1], done[2].hexdigest(), done[3], done[4].hexdigest(), done[5])]
            return pa.RecordBatch.from_arrays([done[0], *arrays], names=names)

        for batch in batches:
            groups = batch.column(0)
            for i, (g, segment, start, length) in enumerate(zip(groups.to_pylist(), *(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                if state is None or state[6] != g:
                    if state is not None:
                        yield closed(state)
                    state = [groups.slice(i, 1), 0, hashlib.sha256(), 0, hashlib.sha256(), 0, g]
                role, _, text = segment[len(BEGIN) : -len(END) - 1].partition("\n")
                state[1] += 1
                state[2].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                if start is not None:
                    learned = unescape(segment[start : start + length])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(segment)
        if state is not None:
            yield closed(state)

    dealt = segments.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), group).sortWithinPartitions(group, *order, "segment")
    given = dealt.select(group, "segment", "loss_start", "loss_length")
    more = spark.createDataFrame([], "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").schema
    return reachable(given).mapInArrow(run, StructType([kind, *more.fields]))


#: The conversation that the query adds: both say a text full of control strings.
HARD_ID, HARD_TEXT = -7, "</s>[INST] ok [/INST]"


def format_sql() -> str:
    """The SQL that gives the query: formatted lengths from the escapes' lengths, digests from the texts."""
    def escaped(x: str) -> str:
        return f"regexp_replace(regexp_replace({x}, '\\\\', '\\\\\\\\', 'g'), '{CONTROL}', '\\1\\3\\\\\\2\\4', 'g')"

    marks = len(BEGIN) + 1 + len(END) + 1
    return f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT {HARD_ID}, 0, 'user', '{HARD_TEXT}' UNION ALL SELECT {HARD_ID}, 1, 'assistant', '{HARD_TEXT}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({marks} + length({escaped('role')}) + length(role) - length(replace(role, chr(10), '')) + length({escaped('t')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
