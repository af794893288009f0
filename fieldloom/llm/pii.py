"""Personal data in texts, and the terms that give it away, by the information that they carry.

Addresses, numbers and cards that patterns find are the protected entities. Words near their mentions may
reveal them: by the corpus, a term discloses an entity if the mutual information of the two is nearly all the
information that there is about the entity,

    log(N n(t, e) / (n(t) n(e)))  >=  ALPHA log(N / n(e)),

with N documents, n(t) of them with the term, and n(e) and n(t, e) contexts of the entity and of the term with it.
Contexts that read alike count once, so that copies of a passage are no evidence. A term that discloses is
generalised to the class of the words that begin like it, or removed if that class discloses as well; only where it
stands near the entity, so texts that name no entity stay as they are.

Everything is DataFrame expressions. Mentions with their contexts are found in one pass; documents with a term
are counted after a partial count in each task, and only for words that begin like one near an entity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.text import fresh, quoted
from fieldloom.session import materialize

#: Code points of a context on either side of a mention; contexts that must hold a term with an entity; the share of the
#: information about an entity that no term may carry; letters that the words of a class begin with.
REACH, SUPPORT, ALPHA, CLASS = 80, 3, 0.9, 3
#: Matches whose places are added up at once.
PART = 256
#: What parts words, and what is taken off their ends.
SPACE, MARKS = r"[\x20\x09-\x0D]", "\"'([.,;:!?)]"
SPACE_SQL, MARKS_SQL = SPACE.replace("\\", "\\\\"), MARKS.replace("'", "\\'")
#: What a word must look like to be a term. Such words are never part of a number or an address.
TERM = r"^\p{L}+(['’-]\p{L}+)*$"


@dataclass(frozen=True)
class Kind:
    """``pattern``'s leftmost matches that do not overlap and are ``valid``; ``gate`` is quickly false for most texts.

    ``value`` gives what the mentions of one entity have in common.
    """

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    value: Callable[[Column], Column]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Whether the digits, every second from the right doubled, add up to a multiple of ten."""
    digits = F.split(F.reverse(_digits(match)), "")
    doubled = F.transform(
        digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int"))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _between(match: Column, low: int, high: int) -> Column:
    return F.length(_digits(match)).between(low, high)


_PART_255 = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

#: The patterns take no longer than the text is long: a run of characters is entered at its begin only, or where the
#: match before ended, and never given back. They match what the plain patterns of ``PLAIN`` match.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: F.contains(t, F.lit("@")),
        lambda m: F.lit(True),
        lambda m: F.lower(m),
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        lambda t: F.contains(t, F.lit(".")),
        lambda m: m.rlike(rf"^{_PART_255}(?:\.{_PART_255}){{3}}\z"),
        lambda m: F.regexp_replace(m, r"(?<![0-9])0+(?=[0-9])", ""),
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
        lambda m: F.when(_between(m, 14, 19), _luhn(m)).otherwise(F.lit(False)),
        _digits,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: F.contains(t, F.lit("+")),
        lambda m: _between(m, 10, 15),
        _digits,
    ),
)
#: The patterns as they are prescribed.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = ("generalise", "remove")
NAMES = (*(k.name for k in KINDS), *ADDED)
MENTIONS = "array<struct<start:int,place:int,end:int,value:string,before:string,after:string>>"


def mentions(text: Column, kind: Kind, place: int) -> Column:
    """The valid matches of a kind in a text that is not null: start, place, end, value, and the text before and after.

    Matches and what lies between them alternate; their lengths add up to the places, for ``PART`` of them at a time.
    A context reaches to the next match of the kind at most, and has one code point more than ``REACH`` if it is cut.
    """
    gaps, found = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    first = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(REACH + 1)).alias("before"), m.alias("match")))
    steps = F.zip_with(first, F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(1))), lambda x, g: F.struct(
        x["gap"].alias("gap"), F.coalesce(F.length(x["match"]), F.lit(0)).alias("length"), x["match"].alias("match"), x["before"].alias("before"), F.left(g, F.lit(REACH + 1)).alias("after")
    ))

    def walked(part: Column, begin: Column) -> Column:
        def step(done: Column, x: Column) -> Column:
            start = done["at"] + x["gap"]
            end = start + x["length"]
            span = F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), kind.value(x["match"]).alias("value"), x["before"].alias("before"), x["after"].alias("after"))
            more = F.when(x["match"].isNotNull() & kind.valid(x["match"]), F.concat(done["found"], F.array(span))).otherwise(done["found"])
            return F.struct(end.alias("at"), more.alias("found"))

        return F.aggregate(part, F.struct(begin.alias("at"), F.array().cast(MENTIONS).alias("found")), step, lambda done: done["found"])

    def added(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, n: a + n)

    def whole(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["gap"] + x["length"]))
        return F.transform(F.array(lengths), lambda ns: F.flatten(F.transform(parts, lambda p, i: walked(p, added(F.slice(ns, F.lit(1), i))))))[0]

    def parted(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / PART).cast("int")), lambda c: F.slice(xs, c * PART + 1, F.lit(PART)))

    made = F.transform(F.array(steps), lambda xs: F.transform(F.array(parted(xs)), whole)[0])[0]
    return F.when(kind.gate(text), made).otherwise(F.array().cast(MENTIONS))


def found_mentions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table of all rows: ``doc_id``, ``mentions`` by start and place, and ``row_key`` (null without mentions)."""
    whole = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    ident = F.col(quoted(doc_id))
    found = docs.select(ident.alias("doc_id"), whole.alias("whole")).select("doc_id", "whole", F.array_sort(F.concat(*(mentions(F.col("whole"), k, i) for i, k in enumerate(KINDS)))).alias("mentions"))
    key = F.when(F.size("mentions") > 0, _row_key(F.col("doc_id"), F.col("whole")))
    return materialize(found.select("doc_id", "mentions", key.alias("row_key")), "mentions")


def _row_key(doc_id: Column, whole: Column) -> Column:
    """128 bits for a row's id and text."""
    return F.md5(F.concat(F.md5(F.coalesce(doc_id.cast("string"), F.lit("\x00"))), F.md5(whole)))


def _terms(chunk: str, at: str, cut: str) -> str:
    """SQL for the terms of a context: lower-cased words with their places; ``cut`` names the end whose word may be cut off."""
    pieces = f"split({chunk}, '{SPACE_SQL}')"
    dropped = f"length({chunk}) > {REACH}"
    inside = "i > 0" if cut == "first" else f"i < size({pieces}) - 1"
    walked = (
        f"aggregate({pieces}, named_struct('at', {at}, 'found', cast(array() AS array<struct<at:int,piece:string>>)), "
        "(d, p) -> named_struct('at', d.at + length(p) + 1, 'found', concat(d.found, array(named_struct('at', d.at, 'piece', p)))), d -> d.found)"
    )
    kept = f"filter({walked}, (x, i) -> NOT ({dropped}) OR {inside})"
    word = f"trim(BOTH '{MARKS_SQL}' FROM x.piece)"
    start = f"x.at + length(x.piece) - length(trim(LEADING '{MARKS_SQL}' FROM x.piece))"
    return f"transform({kept}, x -> named_struct('term', lower({word}), 'start', {start}, 'end', {start} + length({word})))"


def near_terms(found: DataFrame) -> DataFrame:
    """``row_key, place, value, before, after, term, start, end`` of the terms in the contexts of the mentions."""
    each = found.filter("row_key IS NOT NULL").select("row_key", F.explode("mentions").alias("m")).select("row_key", "m.*")
    begin = f"start - least(length(before), {REACH + 1})"
    both = F.expr(f"concat({_terms('before', begin, 'first')}, {_terms('after', 'end', 'last')})")
    terms = each.select("row_key", "place", "value", "before", "after", F.explode(both).alias("t")).select("row_key", "place", "value", "before", "after", "t.*")
    return terms.filter(F.col("term").rlike(TERM))


def _class(term: str = "term") -> Column:
    """The class of a term: its first letters; a term that is no longer has none."""
    return F.when(F.length(term) > CLASS, F.substring(term, 1, CLASS))


def disclosing(docs: DataFrame, found: DataFrame, text: str = "text", support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """``place, value, term, action`` of the terms that disclose an entity; action is the place of its name in ``NAMES``."""
    near = near_terms(found)
    contexts = found.filter("row_key IS NOT NULL").select(F.explode("mentions").alias("m")).select("m.place", "m.value", "m.before", "m.after").distinct()
    n_entity = contexts.groupBy("place", "value").agg(F.count("*").alias("n_e"))
    pairs = near.select("place", "value", "before", "after", "term").distinct().groupBy("place", "value", "term").agg(F.count("*").alias("n_te"))
    # what is near an entity often enough to be judged, as a term or as a class
    pairs = pairs.join(n_entity.filter(F.col("n_e") >= support), ["place", "value"]).withColumn("class", F.coalesce(_class(), F.col("term")))
    pairs = materialize(pairs, "pairs")
    wanted = pairs.filter(F.col("n_te") >= support).select("class").distinct()

    words = F.split(F.lower(F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))), SPACE)
    words = F.array_distinct(F.transform(words, lambda w: F.btrim(w, F.lit(MARKS))))
    counted = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    counted = counted.filter(F.col("term").rlike(TERM)).withColumn("class", F.coalesce(_class(), F.col("term")))
    counted = materialize(counted.join(wanted, "class", "left_semi"), "counted")
    n = docs.count()

    def too_much(both: str, alone: str) -> Column:
        return (F.col("n_e") < n) & (F.col(both) >= support) & (F.col(both) >= F.col(alone) * F.pow(F.col("n_e") / F.lit(float(max(n, 1))), F.lit(1 - alpha)))

    n_class = counted.filter(F.length("term") > CLASS).groupBy("class").agg(F.sum("n_t").alias("n_c"))
    n_class_pairs = pairs.filter(F.length("term") > CLASS).groupBy("place", "value", "class").agg(F.sum("n_te").alias("n_ce"))
    judged = pairs.filter(F.col("n_te") >= support).join(counted.select("term", "n_t"), "term").filter(too_much("n_te", "n_t"))
    judged = judged.join(n_class, "class", "left").join(n_class_pairs, ["place", "value", "class"], "left")
    general = (F.length("term") > CLASS) & ~too_much("n_ce", "n_c")
    return judged.select("place", "value", "term", F.when(general, len(KINDS)).otherwise(len(KINDS) + 1).alias("action"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``row_key`` (null where nothing was found) and ``spans``.

    Spans are structs of start, place (in ``NAMES``) and end, by start and then place; offsets are code points.
    Null and empty texts have none. Rows that repeat have theirs each and are evidence once.
    """
    found = found_mentions(docs, doc_id, text)
    told = materialize(disclosing(docs, found, text, support, alpha), "told")
    added = near_terms(found).join(told, ["place", "value", "term"]).groupBy("row_key", "start", "end").agg(F.max("action").alias("place"))
    added = added.groupBy("row_key").agg(F.collect_list(F.struct("start", "place", "end")).alias("added"))
    base = F.transform("mentions", lambda m: F.struct(m["start"].alias("start"), m["place"].alias("place"), m["end"].alias("end")))
    # rows without mentions have no key to meet
    some = found.filter("row_key IS NOT NULL").join(added, "row_key", "left")
    some = some.select("doc_id", "row_key", F.array_sort(F.concat(base, F.coalesce("added", F.array().cast("array<struct<start:int,place:int,end:int>>")))).alias("spans"))
    return some.unionByName(found.filter("row_key IS NULL").select("doc_id", "row_key", base.alias("spans")))


def described(spans: Column) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """One row per row of ``docs``: its id, the mentions of each kind, ``base_sha256`` and ``spans``, see ``scan``."""
    found = scan(docs, doc_id, text, support, alpha)
    counts = [F.size(F.filter("spans", lambda s: s["place"] == F.lit(i))).cast("long").alias(f"n_{k.name}") for i, k in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s["place"] < len(KINDS))
    return found.select(F.col("doc_id").alias(doc_id), *counts, F.sha2(described(base), 256).alias("base_sha256"), described(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with mentions replaced by ``[EMAIL]`` and so on, disclosing terms by the letters of their class and ``*``, or by ``[...]``.

    Spans that overlap are replaced by the first one's mark. Only texts with spans meet them by a join; the others
    stay as they are, and so do all other columns.
    """
    key, spans = fresh(docs, "row_key"), fresh(docs, "spans")
    column = F.col(quoted(text))
    found = scan(docs, doc_id, text, support, alpha).filter("row_key IS NOT NULL").select(F.col("row_key").alias(key), F.col("spans").alias(spans)).dropDuplicates([key])
    keyed = docs.withColumn(key, _row_key(F.col(quoted(doc_id)), F.coalesce(column.cast("string"), F.lit(""))))
    marks = F.array(*(F.lit(f"[{k.name.upper()}]") for k in KINDS))

    def step(done: Column, s: Column) -> Column:
        between = F.substring(column, done["at"] + 1, s["start"] - done["at"])
        short = F.concat(F.substring(column, s["start"] + 1, F.lit(CLASS)), F.lit("*"))
        mark = F.when(s["place"] < len(KINDS), F.get(marks, s["place"])).when(s["place"] == len(KINDS), short).otherwise(F.lit("[...]"))
        more = F.when(s["start"] >= done["at"], F.concat(done["made"], between, mark)).otherwise(done["made"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), more.alias("made"))

    made = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("made")), step, lambda done: F.concat(done["made"], F.substring(column, done["at"] + 1, F.length(column))))
    joined = keyed.join(found, key, "left")
    return joined.withColumn(text, F.when(F.col(spans).isNull(), column).otherwise(made)).select(*(F.col(quoted(c)) for c in docs.columns))


def report_sql(support: int = SUPPORT, alpha: float = ALPHA) -> str:
    """The SQL that gives ``report`` of ``documents``."""
    marks = MARKS.replace("'", "''")
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    octets = "list_transform(string_split(m, '.'), lambda x: ltrim(x, '0'))"
    doubled = f"list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({digits}), CAST(i AS INTEGER), 1) AS INTEGER) ELSE 2 * CAST(substr(reverse({digits}), CAST(i AS INTEGER), 1) AS INTEGER) % 10 + CAST(substr(reverse({digits}), CAST(i AS INTEGER), 1) AS INTEGER) // 5 END)"
    valid = {
        "email": "true",
        "ip": f"list_bool_and(list_transform({octets}, lambda x: length(x) < 3 OR (length(x) = 3 AND x <= '255')))",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND list_sum({doubled}) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
    }
    value = {"email": "lower(m)", "ip": f"array_to_string(list_transform({octets}, lambda x: CASE WHEN x = '' THEN '0' ELSE x END), '.')", "card": digits, "phone": digits}
    kinds = " UNION ALL ".join(
        f"SELECT d, id, {i} AS place, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS found FROM d" for i, p in enumerate(PLAIN.values())
    )

    def by_place(parts: dict[str, str]) -> str:
        return "CASE place " + " ".join(f"WHEN {i} THEN {parts[k]}" for i, k in enumerate(PLAIN)) + " END"

    def terms(chunk: str, at: str, last: bool) -> str:
        pieces = f"string_split_regex({chunk}, '{SPACE}')"
        lost = f"CASE WHEN length({chunk}) > {REACH} THEN {f'len({pieces})' if last else '1'} ELSE 0 END"
        return f"SELECT d, place, value, before, after, unnest({pieces}) AS piece, generate_subscripts({pieces}, 1) AS j, {at} AS pos, {pieces} AS pieces, {lost} AS lost FROM e"

    word = f"trim(piece, '{marks}')"
    lead = f"length(piece) - length(ltrim(piece, '{marks}'))"
    begin = "pos + CAST(coalesce(list_sum(list_transform(list_slice(pieces, 1, j - 1), lambda p: length(p) + 1)), 0) AS BIGINT)"
    base = ", ".join(f"'{k}'" for k in PLAIN)
    counts = ", ".join(f"count(*) FILTER (place = {i}) AS n_{k}" for i, k in enumerate(PLAIN))
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place){}, '')"
    enough = f"n_e < n AND {{both}} >= {support} AND {{both}} >= {{alone}} * pow(n_e / CAST(n AS DOUBLE), {1 - alpha!r})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id AS id, coalesce(text, '') AS t FROM documents),
m AS ({kinds}),
x AS (SELECT d, place, gaps, found, unnest(found) AS m, generate_subscripts(found, 1) AS i FROM m WHERE len(found) > 0),
v AS (SELECT d, place, gaps[i] AS g, gaps[i + 1] AS h, m, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS s FROM x
  WHERE {by_place(valid)}),
e AS (SELECT d, place, {by_place(value)} AS value, s, s + length(m) AS e, right(g, {REACH + 1}) AS before, left(h, {REACH + 1}) AS after FROM v),
w AS ({terms('before', 's - length(before)', False)} UNION ALL {terms('after', 'e', True)}),
t AS (SELECT d, place, value, before, after, lower({word}) AS term, {begin} + {lead} AS s, {begin} + {lead} + length({word}) AS e FROM w
  WHERE j <> lost AND regexp_matches(lower({word}), '{TERM.replace("'", "''")}')),
ne AS (SELECT place, value, count(*) AS n_e FROM (SELECT DISTINCT place, value, before, after FROM e) GROUP BY place, value),
p AS (SELECT p.*, ne.n_e, CASE WHEN length(term) > {CLASS} THEN left(term, {CLASS}) END AS class FROM
  (SELECT place, value, term, count(*) AS n_te FROM (SELECT DISTINCT place, value, before, after, term FROM t) GROUP BY place, value, term) p
  JOIN ne ON ne.place = p.place AND ne.value = p.value WHERE n_e >= {support}),
a AS (SELECT d, unnest(list_distinct(list_transform(string_split_regex(lower(t), '{SPACE}'), lambda piece: {word}))) AS term FROM d),
c AS (SELECT term, count(*) AS n_t FROM a WHERE regexp_matches(term, '{TERM.replace("'", "''")}') GROUP BY term),
cc AS (SELECT left(term, {CLASS}) AS class, sum(n_t) AS n_c FROM c WHERE length(term) > {CLASS} GROUP BY 1),
cp AS (SELECT place, value, class, sum(n_te) AS n_ce FROM p WHERE class IS NOT NULL GROUP BY place, value, class),
n AS (SELECT count(*) AS n FROM d),
o AS (SELECT p.place, p.value, p.term, CASE WHEN p.class IS NOT NULL AND NOT ({enough.format(both='n_ce', alone='n_c')}) THEN {len(PLAIN)} ELSE {len(PLAIN) + 1} END AS action
  FROM p JOIN c ON c.term = p.term CROSS JOIN n LEFT JOIN cc ON cc.class = p.class LEFT JOIN cp ON cp.place = p.place AND cp.value = p.value AND cp.class = p.class
  WHERE {enough.format(both='n_te', alone='n_t')}),
f AS (SELECT d, place, s, e FROM e UNION ALL
  SELECT d, max(action), s, e FROM t JOIN o ON o.place = t.place AND o.value = t.value AND o.term = t.term GROUP BY d, s, e),
z AS (SELECT d, place, s, e, list_extract([{base}, 'generalise', 'remove'], place + 1) AS kind FROM f)
SELECT d.id AS doc_id, {counts}, sha256({listed.format(f' FILTER (place < {len(PLAIN)})')}) AS base_sha256, {listed.format('')} AS spans
FROM d LEFT JOIN z ON z.d = d.d GROUP BY d.d, d.id"""
