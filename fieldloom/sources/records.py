"""Nested records (XML or arrays) and ragged delimited tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_records(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """XML records under ``row_tag``; records inside XML comments are not read."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def parse_xml(rows: DataFrame, col: str, schema: str, options: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """XML records in a text column -> (rows with the columns of ``schema``, rejected rows with a reason).

    Comments are taken out first, so what they hold is not read. A record that is null or blank is ``empty``, one that
    cannot be parsed is ``not well-formed``, and one whose values do not fit the types is ``not of the schema``.
    """
    rest = [c for c in rows.columns if c != col]
    settings = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", **(options or {})}
    text = F.regexp_replace(F.col(col), r"(?s)<!--.*?-->", "")
    # parsed twice: as text alone, and into the types; what only the second refuses has values of other types
    loose = _as_text(T._parse_datatype_string(schema))
    loose.add("_corrupt", T.StringType())
    parsed = rows.withColumn("_text", text).withColumn("_loose", F.from_xml("_text", loose.json(), settings))
    parsed = parsed.withColumn("_row", F.from_xml("_text", f"{schema}, _corrupt string", settings))
    reason = (
        F.when(F.coalesce(F.trim("_text"), F.lit("")) == "", "empty").when(F.col("_loose._corrupt").isNotNull(), "not well-formed").when(F.col("_row._corrupt").isNotNull(), "not of the schema")
    )
    parsed = parsed.withColumn("reject", reason)
    names = [n for n in parsed.schema["_row"].dataType.names if n != "_corrupt"]
    good = parsed.filter(F.col("reject").isNull()).select(*rest, *[F.col(f"_row.{n}").alias(n) for n in names])
    return good, parsed.filter(F.col("reject").isNotNull()).select(*rest, col, "reject")


def _as_text(kind: T.DataType) -> T.DataType:
    """The same shape with every value a string."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_text(kind.elementType))
    return T.StringType()


def flatten_records(df: DataFrame, arrays: Sequence[str], outer: bool = True, position: bool = False) -> DataFrame:
    """One row per record and child; struct children become columns.

    ``outer`` keeps records without children. ``position`` adds ``<array>_pos``.
    """
    for name in arrays:
        child = df.schema[name].dataType.elementType
        rest = [F.col(c) for c in df.columns if c != name]
        if position:
            explode = F.posexplode_outer if outer else F.posexplode
            df = df.select(*rest, explode(name).alias(f"{name}_pos", name))
        else:
            explode = F.explode_outer if outer else F.explode
            df = df.select(*rest, explode(name).alias(name))
        if isinstance(child, T.StructType):
            taken = {c for c in df.columns if c != name}
            fields = []
            for f in child.fieldNames():
                label = f.lstrip("_")
                fields.append(F.col(f"{name}.`{f}`").alias(label if label not in taken else f"{name}_{label}"))
            df = df.select(*[c for c in df.columns if c != name], *fields)
    return df


def options_map(entries: Column, key: str = "_name", value: str = "_VALUE") -> Column:
    """Array of (name, text) entries -> map with trimmed texts."""
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e[key], F.trim(e[value]))))


def name_list(text: Column) -> Column:
    """Comma list that may contain line breaks and blanks -> array of names."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")


def parse_ragged(
    lines: DataFrame, col: str, schema: str, domains: Mapping[str, Sequence[str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Delimited text lines -> (typed good rows, rejected rows with a reason).

    Too short, too long or untyped rows are ``malformed``; rows of the right
    shape whose columns are shifted show as a value outside its domain.
    """
    rest = [c for c in lines.columns if c != col]
    options = {
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "_corrupt",
        "ignoreLeadingWhiteSpace": "true",
        "ignoreTrailingWhiteSpace": "true",
    }
    parsed = lines.withColumn("_row", F.from_csv(F.col(col), f"{schema}, _corrupt string", options))
    reason = F.when(F.col("_row._corrupt").isNotNull(), F.lit("malformed"))
    for name, allowed in (domains or {}).items():
        inside = F.coalesce(F.col(f"_row.{name}").isin(list(allowed)), F.lit(False))
        reason = reason.when(~inside, F.lit(f"{name} outside its domain"))
    parsed = parsed.withColumn("reject", reason)
    names = [n for n in parsed.schema["_row"].dataType.names if n != "_corrupt"]
    good = parsed.filter(F.col("reject").isNull()).select(*rest, *[F.col(f"_row.{n}").alias(n) for n in names])
    bad = parsed.filter(F.col("reject").isNotNull()).select(*rest, F.col(col), "reject")
    return good, bad


def read_ragged(
    spark: SparkSession, path: str, schema: str, domains: Mapping[str, Sequence[str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return parse_ragged(lines, "value", schema, domains)
