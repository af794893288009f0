"""Settings files (``name = value`` with comments and continued lists) as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A comment starts at the first '!' outside quotes.
BEFORE_COMMENT = r"""(?s)^((?:[^'"!]++|'[^']*+(?:'|\z)|"[^"]*+(?:"|\z))*+).*\z"""
# A name, which may have parts, each with an index or a range in brackets.
NAME = r"[A-Za-z_][A-Za-z0-9_%]*+(?:\([0-9:, ]*+\)[A-Za-z0-9_%]*+)*+"
START = rf"^{NAME}[ \t]*+="
NOT_A_START = rf"\n(?!{NAME}[ \t]*+=)"


def statements(text: Column) -> Column:
    """Whole file text -> array of one-line assignments, in order.

    Lines are cut at comments and trimmed, empty ones and those that begin or
    end a group (``&name``, ``/``) dropped, and every line
    that does not start an assignment is joined to the one before it. All of it
    happens inside one row, so files are never split or regrouped.
    """
    lines = F.transform(
        F.split(text, r"\r?\n"), lambda line: F.btrim(F.regexp_replace(line, BEFORE_COMMENT, "$1"), F.lit(" \t"))
    )
    joined = F.regexp_replace(F.array_join(F.filter(lines, lambda s: ~s.rlike("^(&.*|/|)$")), "\n"), NOT_A_START, " ")
    return F.filter(F.split(joined, "\n"), lambda s: s.rlike(START))


def settings_rows(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per assignment: the other columns of ``files``, seq, key, value."""
    rest = [c for c in files.columns if c != text]
    rows = files.select(*rest, F.posexplode(statements(F.col(text))).alias("seq", "_s"))
    cut = F.instr("_s", F.lit("="))
    return rows.select(
        *rest,
        "seq",
        F.btrim(F.substring(F.col("_s"), F.lit(1), cut - 1), F.lit(" \t")).alias("key"),
        F.btrim(F.substring(F.col("_s"), cut + 1, F.length("_s")), F.lit(" \t")).alias("value"),
    )


def settings_scan(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Assignments of many settings files: scope (file path), seq, key, value."""
    files = spark.read.text(path if isinstance(path, str) else list(path), wholetext=True)
    return settings_rows(files.select(F.input_file_name().alias("scope"), F.col("value").alias("text")))
