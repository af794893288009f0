"""Layered settings and include graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.exact import order_key
from fieldloom.session import discard, materialize

def merge_settings(df: DataFrame, by: Sequence[str] = ("scope",)) -> DataFrame:
    """Last assignment wins: greatest (layer, seq) per (by, key).

    ``max_by`` combines on the map side, so a setting written a billion times
    still reaches the reducer as one row per input partition.
    """
    at = order_key(F.col("layer").cast("bigint"), F.col("seq").cast("bigint"))
    return df.groupBy(*by, "key").agg(
        F.max_by("value", at).alias("value"), F.count(F.lit(1)).alias("n_assignments")
    )


def append_settings(df: DataFrame, by: Sequence[str] = ("scope",)) -> DataFrame:
    """One value per setting: those appended (``op`` = append) after the last plain assignment, joined in order.

    The plain assignment itself, when there is one, comes first. What lies before
    it is dropped ahead of the grouping, so a group holds no more than the value
    it makes.
    """
    at = order_key(F.col("layer").cast("bigint"), F.col("seq").cast("bigint"))
    keys = [*by, "key"]
    resets = df.filter(F.col("op") == "set").groupBy(*keys).agg(F.max(at).alias("_reset"))
    live = df.withColumn("_at", at).join(resets, keys, "left").filter("_reset IS NULL OR _at >= _reset")
    values = F.array_sort(F.collect_list(F.struct("_at", "value")))["value"]
    return live.groupBy(*keys).agg(F.count("value").alias("n_values"), F.array_join(values, " ").alias("value"))


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Transitive includes: (root, node, depth) with the least depth, to the fixed point.

    Distances double each round: everything at distance exactly 2^k is joined
    with everything reachable within 2^k, so a chain of depth d takes log2(d)
    rounds and each pair is generated once along its shortest path. Each round
    is written to the shared folder, and the one before it removed. A row with
    node = root marks a cycle. Raises when ``max_depth`` is given and something
    lies deeper.
    """
    reach = edges.select(F.col("src").alias("root"), F.col("dst").alias("node")).distinct()
    reach = materialize(reach.withColumn("depth", F.lit(1)), "closure")
    span = 1
    while True:
        far = reach.filter(F.col("depth") == span).select("root", F.col("node").alias("mid"))
        near = reach.select(F.col("root").alias("mid"), "node", "depth")
        longer = far.join(near, "mid").select("root", "node", (F.col("depth") + span).alias("depth"))
        found = reach.unionByName(longer).groupBy("root", "node").agg(F.min("depth").alias("depth"))
        before, reach = reach, materialize(found, "closure")
        discard(before)
        if max_depth is not None and not reach.filter(F.col("depth") > max_depth).isEmpty():
            raise ValueError(f"includes go deeper than {max_depth}")
        span *= 2
        if reach.filter(F.col("depth") == span).isEmpty():
            return reach


def layered_settings(reach: DataFrame, rows: DataFrame) -> DataFrame:
    """Settings of every file with those of the files it includes: scope, layer, seq, key, value, op.

    ``reach`` comes from :func:`closure`; ``rows`` holds (scope, seq, key, value,
    op). What lies deeper is applied earlier, a file's own settings (layer 0)
    last. A file that includes itself by a cycle has its own ones once.
    """
    files = rows.select(F.col("scope").alias("root"), F.col("scope").alias("node"), F.lit(0).alias("depth")).distinct()
    owners = files.unionByName(reach.filter("root <> node").select("root", "node", "depth"))
    joined = owners.join(rows.withColumnRenamed("scope", "node"), "node")
    return joined.select(F.col("root").alias("scope"), (-F.col("depth")).alias("layer"), "seq", "key", "value", "op")


def include_report(edges: DataFrame, existing: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """Closure with findings per row: ``is_cycle``, ``is_leaf`` (includes nothing) and ``missing``.

    ``existing`` (column ``node``) lists what can be included; a node neither
    there nor a source of an include is missing. Without it nothing is.
    """
    sources = edges.select(F.col("src").alias("node")).distinct().withColumn("_source", F.lit(True))
    rows = closure(edges, max_depth).join(sources, "node", "left")
    if existing is not None:
        rows = rows.join(existing.select("node").distinct().withColumn("_there", F.lit(True)), "node", "left")
    absent = F.lit(False) if existing is None else F.col("_there").isNull() & F.col("_source").isNull()
    return rows.select(
        "root", "node", "depth", (F.col("root") == F.col("node")).alias("is_cycle"), F.col("_source").isNull().alias("is_leaf"), absent.alias("missing")
    )
