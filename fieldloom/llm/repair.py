"""Repair of conversations: faults of rows, and the cheapest edits that make the roles alternate.

The edits of a conversation are a path through a graph without cycles: its nodes are (rows read,
what the roles so far allow), its steps keep, rerole, delete or insert a row. A path's weight is one
big integer: the cost in the high digits, and below them the edits' letters, one digit of eight bits
each, the first letter highest, with zeros after the last. The smaller integer is then the cheaper
path, and among equally cheap ones that whose letters come first in ASCII; zeros make a beginning
come before what goes on. Weights are found from the end of a conversation backwards, so that a step
puts its letter before letters that are settled already.

Conversations longer than ``BLOCK`` rows take one block after another. A block's integers hold its own
letters and the first ``LOOK`` letters of what follows; two weights that agree that far are compared
by all their letters. Nothing else grows with the conversation but its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.text import quoted, reachable
from fieldloom.session import materialize

#: Costs of the edits, and what a truncated row costs that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of a block, and letters behind it that its integers hold.
BLOCK, LOOK = 1024, 64

#: What roles allow: nothing yet, only a system row, a user row last, an assistant row last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: A row's code: three times the place of its role's initial here (3: another one), and one of these.
INITIALS = "sua"
FINE, CUT_OFF, MUST_GO = range(3)

SPACE = r"\x20\x09-\x0D"


class _Block:
    """Weights of the paths from the end back to somewhere in a block: (integer, letters known, state that they end in)."""

    def __init__(self, rows: int, tails: list[tuple[int, bytes]]):
        self.tails = tails
        self.bits = 8 * (3 * rows + 2 + LOOK)
        self.mask = (1 << self.bits) - 1
        self.open = [len(letters) > LOOK for _, letters in tails]

    def begin(self, state: int) -> tuple[int, int, int]:
        cost, letters = self.tails[state]
        letters = letters[:LOOK]
        return cost << self.bits | int.from_bytes(letters, "big") << (self.bits - 8 * len(letters)), len(letters), state

    def step(self, cost: int, letter: int, then: tuple[int, int, int]) -> tuple[int, int, int]:
        weight, known, state = then
        return ((weight >> self.bits) + cost) << self.bits | letter << (self.bits - 8) | (weight & self.mask) >> 8, known + 1, state

    def letters(self, path: tuple[int, int, int]) -> bytes:
        weight, known, state = path
        return (weight & self.mask).to_bytes(self.bits // 8, "big")[:known] + self.tails[state][1][LOOK:]

    def least(self, paths: list[tuple[int, int, int]]) -> tuple[int, int, int]:
        best = paths[0]
        for path in paths[1:]:
            known = min((p[1] for p in (best, path) if self.open[p[2]]), default=None)
            apart = best[0] ^ path[0]
            if known is not None and apart.bit_length() <= self.bits - 8 * known:
                # equal costs, and equal letters as far as both are known
                best = min(best, path, key=self.letters)
            elif path[0] < best[0]:
                best = path
        return best


def _before_rows(block: _Block, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``base`` by state, with the rows that may be inserted first: never more than two pay."""
    user, assistant = (block.step(INSERT, ord("I"), base[s]) for s in (USER, ASSISTANT))
    both = block.step(INSERT, ord("I"), assistant)
    return [block.least([base[START], user, both]), block.least([base[SYSTEM], user, both]), block.least([base[USER], assistant]), block.least([base[ASSISTANT], user])]


def cheapest_edits(codes: bytes, block_rows: int = BLOCK) -> tuple[int, str]:
    """Cost and letters of the best edits of a conversation whose rows have these ``codes``."""
    tails: list[tuple[int, bytes]] = [(0, b""), (2 * INSERT, b"II"), (INSERT, b"I"), (0, b"")]
    for end in range(len(codes), 0, -block_rows):
        part = codes[max(0, end - block_rows) : end]
        block = _Block(len(part), tails)
        now = [block.begin(state) for state in range(4)]
        for code in reversed(part):
            initial, fault = divmod(code, 3)
            options = [[block.step(DELETE, ord("D"), now[state])] for state in range(4)]
            if fault != MUST_GO:
                more = TRUNCATED if fault == CUT_OFF else 0
                for state in range(4):
                    after = ASSISTANT if state == USER else USER
                    options[state].append(block.step(REROLE + more, ord("R"), now[after]))
                    if initial == after - 1 or initial == 0 and state == START:
                        kept = SYSTEM if initial == 0 else after
                        options[state].append(block.step(KEEP + more, ord("K"), now[kept]))
            now = _before_rows(block, [block.least(o) for o in options])
        tails = [(path[0] >> block.bits, block.letters(path)) for path in now]
    return tails[START][0], tails[START][1].decode()


def repaired(audit: Iterator[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of a conversation's rows after the edits."""
    state = START
    for letter in audit:
        after = ASSISTANT if state == USER else USER
        named = "user" if after == USER else "assistant"
        if letter == "I":
            yield named, ""
        else:
            role, text = next(rows)
            if letter == "D":
                continue
            if letter == "K" and role[:1] == "s":
                after = SYSTEM
            yield (role if letter == "K" else named), text
        state = after


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, dropped`` of the rows after the damage that the query prescribes.

    crc32 of ``conv_id:turn`` modulo 20 decides: 0 marks the row as dropped, 1 empties its text, 2 takes
    ``.!?`` from it, 3 repeats it, 4 makes the role user. A null is one space, in the checksum also.
    """
    one = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" ")) for c in (conv_id, turn, role, text)]
    given = conversations.select(
        F.col(quoted(conv_id)).alias("conv"), F.col(quoted(turn)).cast("long").alias("turn"), one[2].alias("role"), one[3].alias("text"), (F.crc32(F.concat(one[0], F.lit(":"), one[1])) % 20).alias("kind")
    )
    hurt = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    made = given.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), (F.col("kind") == 0).alias("dropped"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return made.drop("copy")


def rows_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, dropped`` of undamaged conversations: null roles and texts are one space."""
    one = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    return conversations.select(F.col(quoted(conv_id)).alias("conv"), F.col(quoted(turn)).cast("long").alias("turn"), *one, F.lit(False).alias("dropped"))


def _digest() -> Column:
    return F.md5(F.concat(F.md5("role"), F.md5("text"))).alias("digest")


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


class _Reading:
    """What one conversation's rows, read from the last to the first, say."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.faults = [0, 0, 0]
        self.illegal = self.turns = 0
        self.below = self.last = self.lowest = self.highest = None

    def add(self, turn: int | None, initial: str, blank: bool, again: bool, cut_off: bool) -> None:
        fault = 0 if blank else 1 if again else 2 if cut_off else None
        if fault is not None:
            self.faults[fault] += 1
        self.codes.append(3 * (INITIALS.index(initial) if initial and initial in INITIALS else 3) + (FINE if fault is None else CUT_OFF if fault == 2 else MUST_GO))
        if self.below is not None and initial + self.below not in ("su", "ua", "au"):
            self.illegal += 1
        self.below = initial
        if turn is not None and turn != self.last:
            self.turns += 1
            self.highest = turn if self.highest is None else self.highest
            self.last = self.lowest = turn

    def report(self) -> list:
        self.codes.reverse()
        cost, audit = cheapest_edits(bytes(self.codes))
        gaps = self.highest - self.lowest + 1 - self.turns if self.turns else 0
        return [gaps, *self.faults, self.illegal, cost, audit]


def judged(rows: DataFrame) -> DataFrame:
    """One row per ``conv`` of ``rows`` (see ``rows_of``): its faults, the cost of its repair, and the audit.

    A row is seen earlier if one with its role and text is; rows of one turn stand in the order of a digest
    of role and text. Rows are dealt by conversation without their texts and streamed from the last to the
    first; of a conversation one byte a row is held, and its audit.
    """
    spark, kind = rows.sparkSession, rows.schema["conv"].dataType.simpleString()
    marks = rows.select(
        "conv", "turn", "dropped", _digest(), F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("cut_off"),
    )
    equal = Window.partitionBy("conv", "dropped", "digest").orderBy(F.col("turn").asc_nulls_first())
    marks = marks.withColumn("again", F.row_number().over(equal) > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reading = conv = None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([conv, *(pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in reading.report())], names=["conv", *NAMES])

        for batch in batches:
            ids = batch.column(0)
            for i, (c, dropped, *row) in enumerate(zip(*(x.to_pylist() for x in batch.columns))):
                if reading is None or conv[0].as_py() != c:
                    if reading is not None:
                        yield closed()
                    reading, conv = _Reading(), ids.slice(i, 1)
                if not dropped:
                    reading.add(*row)
        if reading is not None:
            yield closed()

    order = [F.col("turn").desc_nulls_last(), F.col("digest").desc(), F.col("again").desc()]
    dealt = marks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv").sortWithinPartitions("conv", *order)
    return reachable(dealt.select("conv", "dropped", "turn", "initial", "blank", "again", "cut_off")).mapInArrow(run, f"conv {kind}, {REPORT}")


def repaired_rows(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """``conv, place, role, text`` of the repaired conversations, ``place`` counting from 0; streamed, whatever their length."""
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, place long, role string, text string"

    def emit(groups: Iterator) -> Iterator[pa.RecordBatch]:
        for conv, audit, found in groups:
            for part in _parts(repaired(iter(audit), found)):
                yield part, conv

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (start, part), conv in emit(_conversations(batches)):
            n = len(part)
            columns = [pa.concat_arrays([conv] * n), pa.array(range(start, start + n), pa.int64()), pa.array([r for r, _ in part], pa.string()), pa.array([t for _, t in part], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "place", "role", "text"])

    return reachable(_with_audits(rows, reports)).mapInArrow(run, schema)


def _parts(rows: Iterator[tuple[str, str]], size: int = 1000) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    part, start = [], 0
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield start, part
            part, start = [], start + size
    if part:
        yield start, part


def _with_audits(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order; dealt by conversation."""
    texts = rows.filter(~F.col("dropped")).select("conv", F.lit(1).alias("kind"), "turn", _digest(), "role", "text")
    audits = reports.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("digest"), F.lit("").alias("role"), F.col("audit").alias("text"))
    n_tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = audits.unionByName(texts).repartition(n_tasks, "conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "digest")
    return dealt.select("conv", "kind", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, str, Iterator[tuple[str, str]]]]:
    """Conversation by conversation: its id (an array of one), its audit, and its rows as they come."""

    def flat():
        for batch in batches:
            ids = batch.column(0)
            for i, (kind, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                yield kind, role, text, ids, i

    stream = flat()
    item = next(stream, None)
    while item is not None:
        conv, audit, following = item[3].slice(item[4], 1), item[2], []

        def rows(following=following):
            for x in stream:
                if x[0] == 0:
                    following.append(x)
                    return
                yield x[1], x[2]

        own = rows()
        yield conv, audit, own
        for _ in own:  # deleted rows at the end
            pass
        item = following[0] if following else None


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows``: ``conv_id``, its faults, ``cost``, ``audit`` and ``repaired_sha256``.

    Null ids are one conversation. A conversation all of whose rows are dropped has zeros, no letter, and the
    digest of nothing; so has one without rows after them. Roles count by their first character; one that is
    empty or no s, u or a can only be changed or deleted. Very long texts are read once, as a stream, and an
    empty table gives no rows.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    reports = materialize(judged(rows), "reports")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, audit, found in _conversations(batches):
            digest, first = hashlib.sha256(), True
            for role, text in repaired(iter(audit), found):
                digest.update(b"" if first else b"\n")
                digest.update(f"{role}:{text}".encode())
                first = False
            yield pa.RecordBatch.from_arrays([conv, pa.array([audit], pa.string()), pa.array([digest.hexdigest()])], names=["conv", "audit", "repaired_sha256"])

    hashed = reachable(_with_audits(rows, reports)).mapInArrow(run, f"conv {kind}, audit string, repaired_sha256 string")
    counts = reports.select(F.col("conv").alias("conv_id"), *NAMES[:-1])
    return counts.join(hashed, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")


def _crc(text: str) -> str:
    """SQL for the crc32 of a short ASCII string."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, CAST(i AS INTEGER), 1)) AS BIGINT))"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {byte}), 4294967295)"


def report_sql() -> str:
    """The SQL that gives ``repair_report`` of the damaged ``conversations``: paths as strings of cost, letters and rows, row by row.

    A path is six digits of cost, its letters, a character below all letters, and the repaired rows.
    """

    def step(cost: str, letter: str, then: str, row: str = "") -> str:
        """A path with one more edit before it; ``row`` is SQL for the row that it makes."""
        rest = f"substr({then}, instr({then}, chr(1)) + 1)"
        made = f"{row} || CASE WHEN {rest} = '' THEN '' ELSE chr(10) || {rest} END" if row else rest
        return f"(lpad(CAST(CAST(substr({then}, 1, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || '{letter}' || substr({then}, 7, instr({then}, chr(1)) - 7) || chr(1) || {made})"

    def option(state: int) -> str:
        after = ASSISTANT if state == USER else USER
        name = "assistant" if state == USER else "user"
        more = "CASE WHEN cut_off THEN 1 ELSE 0 END"
        kept = [f"CASE WHEN NOT gone AND initial = '{name[0]}' THEN {step(more, 'K', f'v{after}', 'role || chr(58) || t')} END"]
        if state == START:
            kept.append(f"CASE WHEN NOT gone AND initial = 's' THEN {step(more, 'K', f'v{SYSTEM}', 'role || chr(58) || t')} END")
        reroled = step(f"2 + {more}", "R", f"v{after}", f"'{name}' || chr(58) || t")
        return f"list_min([{step('3', 'D', f'v{state}')}, CASE WHEN NOT gone THEN {reroled} END, {', '.join(kept)}])"

    def inserted(state: int) -> str:
        user, assistant = step("2", "I", "b2", "'user:'"), step("2", "I", "b3", "'assistant:'")
        both = step("2", "I", "(" + assistant + ")", "'user:'")
        ways = {START: ["b0", user, both], SYSTEM: ["b1", user, both], USER: ["b2", assistant], ASSISTANT: ["b3", user]}[state]
        return f"list_min([{', '.join(ways)}])"

    mark = "chr(1)"
    return f"""
WITH RECURSIVE g AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT conv, turn, role, t, {_crc('k')} % 20 AS kind FROM g),
d AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(t, '.!?', '') ELSE t END AS t,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
n AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, md5(md5(role) || md5(t)), copy) AS i,
  row_number() OVER (PARTITION BY conv, role, t ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  NOT regexp_matches(t, '[^{SPACE}]') AS blank, NOT regexp_matches(t, '[.!?][{SPACE}]*$') AS ends FROM d),
f AS (SELECT *, blank OR again AS gone, ends AND NOT blank AND NOT again AS cut_off, lag(initial) OVER (PARTITION BY conv ORDER BY i) AS above FROM n),
e AS (SELECT conv, count(*) AS rows, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
  count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut_off) AS truncated,
  count(*) FILTER (above IS NOT NULL AND above || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv),
p AS (SELECT conv, rows AS i, '000000' || {mark} AS v0, '000004II' || {mark} || 'user:' || chr(10) || 'assistant:' AS v1,
    '000002I' || {mark} || 'assistant:' AS v2, '000000' || {mark} AS v3 FROM e
  UNION ALL
  SELECT conv, i - 1, {', '.join(f'{inserted(s)} AS v{s}' for s in range(4))}
  FROM (SELECT p.conv, p.i, {', '.join(f'{option(s)} AS b{s}' for s in range(4))} FROM p JOIN f ON f.conv IS NOT DISTINCT FROM p.conv AND f.i = p.i)),
b AS (SELECT conv, CAST(substr(v0, 1, 6) AS BIGINT) AS cost, substr(v0, 7, instr(v0, chr(1)) - 7) AS audit, substr(v0, instr(v0, chr(1)) + 1) AS made FROM p WHERE i = 0)
SELECT c.conv AS conv_id, CAST(coalesce(e.gaps, 0) AS BIGINT) AS gaps, coalesce(e.blank, 0) AS blank, coalesce(e.duplicate, 0) AS duplicate,
  coalesce(e.truncated, 0) AS truncated, coalesce(e.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(b.made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv FROM g) c LEFT JOIN e ON e.conv IS NOT DISTINCT FROM c.conv LEFT JOIN b ON b.conv IS NOT DISTINCT FROM c.conv"""
