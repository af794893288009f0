"""Rules that are tables: ordered expressions and wildcard rules of any number, matched by joins.

Expressions meet the *distinct* codes through an index of literals. Every match of most expressions
contains some string literally; of its pieces the rarest among the codes is the expression's entry in
the index, a code meets the entries that it contains, and what meets is verified with the expression
itself. Expressions without such a string are tried on every code, in blocks of ``BLOCK``.

Wildcard rules are a prefix tree: a rule is a path of key values, some of them ``any``. All distinct
rows of keys descend together, one key a join, into the children that exist, so a row meets the rules
whose keys fit and no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.rules import ANY
from fieldloom.session import materialize

#: Lengths of indexed pieces: the longer one where a literal is long enough.
SHORT, LONG = 3, 6
#: Expressions without a literal that are tried on a code at a time.
BLOCK = 256
#: Rows of keys that meet wildcard rules in one task, and nodes of a prefix tree that are few enough to be sent to all tasks.
ROWS, FEW = 100_000, 20_000

_BREAK = "\x00"
# syntax that the reading below does not understand: flags and look-around, quoting and coded characters, nested classes
_UNREAD = r"\(\?(?!:)|\\[a-zA-Z0-9&&[^dDwWsSbBAzZtnrf]]|\[[^\]]*\["


def literals(pattern: Column) -> Column:
    """Strings of ``SHORT`` characters or more that every match of an expression contains; null if none is certain.

    Escapes, classes and groups are taken out, then what quantifiers make optional; what is left between is
    literal. An alternative outside groups, or syntax that is not understood, gives null.
    """
    p = F.regexp_replace(pattern, r"\\[\s\S]", _BREAK)
    p = F.regexp_replace(p, r"\[\^?\]?[^\]]*\]", _BREAK)
    for _ in range(4):
        p = F.regexp_replace(p, r"\([^()]*\)", _BREAK)
    plain = ~pattern.rlike(_UNREAD) & ~p.rlike("[|()]")
    for optional in (r"[\s\S]\{[^}]*\}[?+]?", r"[\s\S][*?][?+]?", r"\+"):
        p = F.regexp_replace(p, optional, _BREAK)
    runs = F.filter(F.split(p, r"[.^$\x00\[\]{}]"), lambda run: F.length(run) >= SHORT)
    return F.when(plain & (F.size(runs) > 0), runs)


def _pieces(text: Column, length: int) -> Column:
    """All substrings of that length."""
    at = F.when(F.length(text) >= length, F.sequence(F.lit(1), F.length(text) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(text, i, F.lit(length)))


def pattern_matches(codes: DataFrame, patterns: DataFrame) -> DataFrame:
    """``code, pattern`` of every code and expression that occurs in it; both tables have one column, without repeats.

    No row is collected and nothing is broadcast by force; the number of expressions without a literal is counted.
    Expressions are written with their literals, which are read once. A code has dozens of pieces, which estimates from
    the codes do not see, so the pieces are sorted and never broadcast, however few codes there seem to be.
    """
    known = materialize(patterns.filter("pattern IS NOT NULL").select("pattern", literals(F.col("pattern")).alias("runs")), "patterns")
    code = F.col("code")
    of_code = codes.filter("code IS NOT NULL").select("code", F.explode(F.array_distinct(F.concat(_pieces(code, SHORT), _pieces(code, LONG)))).alias("piece"))
    frequency = of_code.groupBy("piece").agg(F.count("*").alias("n"))
    of_run = F.transform("runs", lambda run: F.when(F.length(run) >= LONG, _pieces(run, LONG)).otherwise(_pieces(run, SHORT)))
    of_rule = known.filter("runs IS NOT NULL").select("pattern", F.explode(F.array_distinct(F.flatten(of_run))).alias("piece"))
    # a piece that no code contains decides that the expression occurs nowhere
    rarest = of_rule.join(frequency, "piece", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("rarest"))
    entries = rarest.filter("rarest.n > 0").select("pattern", F.col("rarest.piece").alias("piece"))
    met = of_code.join(entries.hint("merge"), "piece").select("code", "pattern")
    found = met.filter(F.rlike("code", F.col("pattern")))

    unread = known.filter("runs IS NULL").select("pattern")
    n = unread.count()
    if not n:
        return found
    blocks = -(-n // BLOCK)
    block = F.pmod(F.xxhash64("pattern"), F.lit(blocks)).cast("int")
    listed = unread.groupBy(block.alias("block")).agg(F.collect_list("pattern").alias("tried"))
    each = codes.filter("code IS NOT NULL").select("code", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    tried = each.join(listed, "block").select("code", F.explode(F.filter("tried", lambda p: F.rlike(code, p))).alias("pattern"))
    return found.unionByName(tried)


def match_table(df: DataFrame, col: str, rules: DataFrame, mode: str = "first", out: str = "value") -> DataFrame:
    """``df`` with the value of the first (or last) rule of a table ``seq, pattern, value`` that occurs in ``col``.

    Rules of the same ``seq`` follow their pattern and value. No rule, or a null code, gives null. Patterns that are
    null match nothing.
    """
    if mode not in ("first", "last"):
        raise ValueError("mode must be 'first' or 'last'")
    codes = df.select(F.col(col).alias("code")).distinct()
    matches = pattern_matches(codes, rules.select("pattern").distinct())
    pick = F.min if mode == "first" else F.max
    each = rules.groupBy("pattern").agg(pick(F.struct("seq", "pattern", "value")).alias("rule"))
    best = matches.join(each, "pattern").groupBy(F.col("code").alias("_code")).agg(pick("rule").alias("_rule"))
    joined = df.join(best, df[col] == best["_code"], "left")
    return joined.withColumn(out, F.col("_rule.value")).drop("_code", "_rule")


def _step(key: Column) -> Column:
    """What a key value adds to a path; values of any text stay apart."""
    return F.concat(F.lit("="), F.length(key).cast("string"), F.lit(":"), key, F.lit(";"))


def _hot(state: DataFrame, on: Sequence[str]) -> DataFrame:
    """The values of ``on`` that more than ``ROWS`` rows have, with the ``_parts`` to deal those into; one for ``ROWS`` rows at most."""
    return materialize(state.groupBy(*on).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("_parts")).filter("_parts > 1"), "hot")


def _dealt(state: DataFrame, hot: DataFrame, on: Sequence[str], n_tasks: int) -> DataFrame:
    """Rows with the part (``_salt``) of their value they are dealt into, spread over so many tasks."""
    salt = F.pmod(F.xxhash64("_row"), F.coalesce("_parts", F.lit(1))).cast("int")
    return state.join(F.broadcast(hot), list(on), "left").withColumn("_salt", salt).drop("_parts").repartition(n_tasks, *on, "_salt")


def _copied(right: DataFrame, hot: DataFrame, on: Sequence[str], n_tasks: int) -> DataFrame:
    """The other side's rows once for each part, spread over the same tasks."""
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return right.join(F.broadcast(hot), list(on), "left").withColumn("_salt", parts).drop("_parts").repartition(n_tasks, *on, "_salt").hint("merge")


def specific_table(
    df: DataFrame, rules: DataFrame, keys: Sequence[str], attrs: Sequence[str], code: str | None = None, pattern: str = "pattern", position: str = "rule_id"
) -> DataFrame:
    """``df`` with ``position`` and ``attrs`` of the most specific rule of a table whose keys and pattern fit.

    ``rules`` has the columns ``keys`` (``any`` or null fits everything), ``pattern`` if ``code`` is given (``any`` or
    null fits too), ``position`` and ``attrs``. A rule is as specific as it has conditions; ties go to the higher
    position. A null key in ``df`` fits ``any`` only. Rows that no rule fits have nulls. Rows and nodes are counted: what
    fits a row is sorted, so there are as many tasks as keep a task's share at ``ROWS`` rows of keys, and nodes that more
    rows than that have come to are dealt over several.
    """
    named = {k: F.col(k).cast("string") for k in keys}
    whole = [F.coalesce(_step(named[k]), F.lit("-;")) for k in keys]
    if code is not None:
        whole.append(F.coalesce(_step(F.col(code).cast("string")), F.lit("-;")))
    marked = df.withColumn("_row", F.concat(*whole))
    shown = [F.coalesce(_step(named[k]), F.lit("-;")).alias(f"_k{i}") for i, k in enumerate(keys)]
    rows = marked.select("_row", *shown, (F.col(code).cast("string") if code else F.lit(None).cast("string")).alias("code")).distinct()

    def condition(name: str) -> Column:
        return F.nullif(F.col(name).cast("string"), F.lit(ANY))

    steps = [F.coalesce(_step(condition(k)), F.lit("*;")) for k in keys]
    wanted = condition(pattern) if code is not None else F.lit(None).cast("string")
    score = sum((F.when(condition(k).isNotNull(), 1).otherwise(0) for k in keys), F.when(wanted.isNotNull(), 1).otherwise(0))
    rank = F.struct(score.alias("score"), F.col(position).alias("position"), F.struct(*attrs).alias("attrs"))
    paths = [F.concat(F.lit(""), *steps[: i + 1]).alias(f"_p{i}") for i in range(len(keys))]
    # of rules with equal conditions only the last can win
    best = rules.select(*paths, wanted.alias("pattern"), rank.alias("rank")).groupBy(*(f"_p{i}" for i in range(len(keys))), "pattern").agg(F.max("rank").alias("rank"))

    n_tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    node = [f"_p{i}" for i in range(len(keys))]
    # a rule's last node and expression; none is told from all others by the mark before them
    wants = F.coalesce(F.concat(F.lit("="), "pattern"), F.lit("")).alias("want")
    leaf = best.select(F.col(node[-1]).alias("node") if keys else F.lit("").alias("node"), wants, "rank")
    n_nodes = best.agg(*(F.approx_count_distinct(p) for p in node), F.count("*")).first()
    state, hot = rows.repartition(n_tasks, "_row").withColumn("node", F.lit("")), None
    for i in range(len(keys)):
        children = F.array(F.concat("node", F.lit("*;")), F.concat("node", f"_k{i}"))
        state = state.drop("_salt").withColumn("node", F.explode(children))
        nodes, hot = best.select(F.col(node[i]).alias("node")).distinct(), None
        if n_nodes[i] <= FEW:
            state = state.join(F.broadcast(nodes), "node", "left_semi")
        else:
            # a node of conditions that most rows meet would have them all in one task
            hot = _hot(state, ["node"])
            state = _dealt(state, hot, ["node"], n_tasks).join(_copied(nodes, hot, ["node"], n_tasks), ["node", "_salt"], "left_semi")
    if code is None:
        state = state.withColumn("want", F.lit(""))
    else:
        codes = rows.select("code").distinct()
        matches = pattern_matches(codes, best.select("pattern").filter("pattern IS NOT NULL").distinct())
        # every code fits the rules without an expression
        fits = codes.select("code", F.lit(None).cast("string").alias("pattern")).unionByName(matches)
        state = state.join(fits.select(F.col("code").alias("_code"), wants), F.col("code").eqNullSafe(F.col("_code")))
    if n_nodes[len(keys)] <= FEW:
        fitting = state.join(F.broadcast(leaf), ["node", "want"])
    elif hot is not None:
        fitting = state.join(_copied(leaf, hot, ["node"], n_tasks), ["node", "_salt", "want"])
    else:
        hot = _hot(state, ["node", "want"])
        fitting = _dealt(state, hot, ["node", "want"], n_tasks).join(_copied(leaf, hot, ["node", "want"], n_tasks), ["node", "want", "_salt"])
    if hot is not None:
        fitting = fitting.select("_row", "rank").repartition(n_tasks, "_row")
    chosen = fitting.groupBy("_row").agg(F.max("rank").alias("_rank"))
    joined = marked.join(chosen, "_row", "left")
    return joined.select(*df.columns, F.col("_rank.position").alias(position), *(F.col(f"_rank.attrs.{a}").alias(a) for a in attrs))
