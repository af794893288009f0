"""History samples: partitioned long-form Parquet in, tapes out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.ordered import number_steps
from fieldloom.session import materialize

# Canonical columns of a history table.
HISTORY_SCHEMA = "member int, field string, ts timestamp_ntz, step bigint, cell bigint, lev int, value double"


def history_scan(
    spark: SparkSession,
    path: str | Sequence[str],
    fields: Sequence[str] | None = None,
    members: Sequence[int] | None = None,
    columns: Mapping[str, str] | None = None,
    schema: str | None = None,
) -> DataFrame:
    """Samples of all members as one table.

    ``columns`` maps canonical names to SQL expressions over the stored ones;
    plain renames keep filters and column pruning at the scan. Without a stored
    ``member`` it is read from the ``.NNNN.`` in the file name. ``fields`` and
    ``members`` prune ``field=``/``member=`` directories, or reach the Parquet
    reader where they are ordinary columns. With a ``schema`` (``HISTORY_SCHEMA``
    for canonical tables) no file's footer is read to find it out.
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = (spark.read if schema is None else spark.read.schema(schema)).parquet(*paths)
    kept = {c: F.col(c) for c in df.columns} if columns is None else {name: F.expr(sql) for name, sql in columns.items()}
    if "member" not in kept:
        # of the file's metadata, not of its rows: a filter on it leaves whole files out
        kept["member"] = F.regexp_extract(F.col("_metadata.file_name"), r"\.(\d{4,})\.[^/]*$", 1).try_cast("int")
    df = df.select(*[made.alias(name) for name, made in kept.items()])
    if fields is not None:
        df = df.filter(F.col("field").isin(list(fields)))
    if members is not None:
        df = df.filter(F.col("member").isin(list(members)))
    return df


def file_numbers(tape: DataFrame, samples_per_file: int) -> DataFrame:
    """(field, win, file_id): consecutive windows of a field, ``samples_per_file`` to a file."""
    if samples_per_file < 1:
        raise ValueError("samples_per_file must be positive")
    windows = tape.select("field", "win").distinct()
    ranked = number_steps(windows, ["field"], ["win"], "_rank")
    return ranked.select("field", "win", F.floor((F.col("_rank") - 1) / samples_per_file).cast("bigint").alias("file_id"))


def history_write(tape: DataFrame, path: str, samples_per_file: int = 1, dtype: str = "double") -> None:
    """Write a tape partitioned by field and file number, values as double or float.

    The tape is settled in the shared folder first, because numbering the files
    and writing them both need it and it is far smaller than its samples. The
    rebalance hint lets Spark split a (field, file) that is too big for one
    writer and merge small ones.
    """
    if dtype not in ("double", "float"):
        raise ValueError("dtype must be 'double' or 'float'")
    tape = materialize(tape, "tape")
    # As a struct the pair compares null-safely: a null window is written too.
    pair = F.struct("field", "win").alias("_pair")
    numbers = file_numbers(tape, samples_per_file).select(pair, "file_id")
    numbered = tape.select("*", pair).join(numbers, "_pair").drop("_pair")
    (
        numbered.withColumn("value", F.col("value").cast(dtype))
        .hint("rebalance", "field", "file_id")
        .write.partitionBy("field", "file_id")
        .parquet(path)
    )
