"""Small helpers that the text operators share: words, row keys, splits and Arrow streaming."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word is a run of bytes other than these; ``bytes.split()`` without argument splits at exactly them.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Arrow batches are worked on in slices of about this many bytes of text.
SLICE_BYTES = 4 << 20


def words_of(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Words of a UTF-8 text; ``lower`` maps A-Z only (``bytes.lower`` knows no other letters)."""
    if not text:
        return []
    return text.lower().split() if lower else text.split()


def held_out(doc_id: str, modulus: int) -> Column:
    """Whether crc32 of the id's text leaves remainder 0; ids that are null are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == 0, F.lit(False))


def row_key(doc_id: str, text: str) -> Column:
    """One number for a row's id and text. Equal rows share it, which is what the users of it expect."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00")), F.coalesce(F.col(text), F.lit("\x00")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the table has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def byte_slices(texts: list[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` bytes together; one longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or b"")
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def reachable(df: DataFrame) -> DataFrame:
    """Lets Python workers on this machine import the package from where it lies; clusters install it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", root)
    return df


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def map_texts(df: DataFrame, text: str, keep: list[str], work: Callable, out: str) -> DataFrame:
    """``keep`` columns of every row followed by what ``work`` gives for its text.

    ``work`` takes a list of UTF-8 texts (None for null) of one slice and returns one Arrow array
    for each column of ``out`` (DDL), with one element per text. Where it gives a row several results
    or none, it puts the rows' positions in the slice first, as one more array. Nothing but the kept
    columns and the text goes to Python, and no more than a slice of results is held.
    """
    # names inside are numbers, as those of the table and of ``out`` may clash
    kept = df.select(*(F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)), F.col(quoted(text)).cast("string").alias("text"))
    made_fields = df.sparkSession.createDataFrame([], out).schema.fields
    schema = StructType([*kept.schema.fields[:-1], *(StructField(f"m{i}", f.dataType) for i, f in enumerate(made_fields))])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch, "text")
            for a, b in byte_slices(texts):
                made = list(work(texts[a:b]))
                part = batch.slice(a, b - a).select(list(range(width)))
                if len(made) > len(made_fields):
                    part = part.take(made.pop(0))
                yield pa.RecordBatch.from_arrays(part.columns + made, names=schema.names)

    return reachable(kept).mapInArrow(run, schema).toDF(*keep, *(f.name for f in made_fields))


def quoted(column: str) -> str:
    """A column's name as an expression takes it."""
    return "`" + column.replace("`", "``") + "`"
