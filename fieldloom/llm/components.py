"""Connected components of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import discard, materialize


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Hangs neighbours on the smallest node around each node: the larger ones, or the node's smaller ones and itself.

    Either keeps the components as they are (Kiveris et al., Connected Components in MapReduce and
    Beyond, 2014). The smallest is a partial aggregate, and the join with it has one row per node on
    one side, so that a node with very many neighbours can be split.
    """
    around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = around.join(least, "a")
    if larger:
        hung = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        hung = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return hung.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``links`` (a, b): the smallest node that links reach.

    Rounds end when one changes nothing: then every node hangs on its root. Each round is written to
    the shared folder, and the one before it removed. Nodes are anything that has an order; links with a null and links
    of a node to itself are ignored; repeated links count once.
    """
    order = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(order, "links")
    before = None
    while True:
        changed = materialize(_star(_star(now, larger=True), larger=False), "links")
        state = changed.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = changed
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
        before = state
