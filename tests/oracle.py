"""Runs a registered query and its SQL on the same tables and compares all rows."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, Decimal):
        return float(value)
    return value


def _bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


SPARK_KIND = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float",
    "string": "text", "boolean": "bool", "timestamp_ntz": "time", "timestamp": "timetz", "date": "date",
}
DUCK_KIND = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "FLOAT": "float", "DOUBLE": "float",
    "VARCHAR": "text", "BOOLEAN": "bool", "TIMESTAMP": "time", "DATE": "date", "HUGEINT": "huge",
}


def compare(spark, sf_dir: str, run, sql: str, con=None) -> list[str]:
    """Differences as text; empty when schema and rows agree."""
    con = con or connect(sf_dir)
    df = run(spark, sf_dir)
    result = con.execute(sql)
    duck_names = [d[0] for d in result.description]
    duck_types = {d[0]: DUCK_KIND.get(str(d[1]), str(d[1])) for d in result.description}
    duck_rows = result.fetchall()
    found = []
    if sorted(df.columns) != sorted(duck_names):
        return [f"columns {sorted(df.columns)} != {sorted(duck_names)}"]
    for field in df.schema.fields:
        kind = SPARK_KIND.get(field.dataType.simpleString(), field.dataType.simpleString())
        if kind != duck_types[field.name]:
            found.append(f"type of {field.name}: {field.dataType.simpleString()} != {duck_types[field.name]}")
    rows = df.collect()
    ours, theirs = _bag(df.columns, rows), _bag(duck_names, duck_rows)
    if len(rows) != len(duck_rows):
        found.append(f"rows {len(rows)} != {len(duck_rows)}")
    if not rows:
        found.append("no rows")
    for label, more in (("only spark", ours - theirs), ("only sql", theirs - ours)):
        if more:
            found.append(f"{label} {sum(more.values())}: {list(more)[:2]}")
    return found
