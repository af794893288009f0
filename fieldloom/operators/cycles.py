"""Cycles of includes, condensed: what includes what, in rows that grow with the files and not with the pairs of a cycle.

Strongly connected components are found in three steps. Rounds of shortening take out files that nothing includes or
that include nothing, and files with one include each way, whose neighbours are then tied directly; of such a run of
files a random third goes each round, so a cycle of n files takes log(n) rounds. What is left is coloured forwards by the
greatest file that reaches each, and within a colour backwards from that file. Files that were taken out join the
component of their neighbours where both are in one. Every round is written, and the one before it removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.settings import closure
from fieldloom.session import discard, materialize

#: Share of the edges that a round of shortening must take away to be worth another.
WORTH = 0.05


def _shortened(live: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The edges after one round, and the files taken out between two others: ``node, p, s``."""
    inner = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    inner = materialize(inner.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "inner")
    after = inner.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min("dst").alias("s")).filter("_n = 1").drop("_n")
    before = inner.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min("src").alias("p")).filter("_n = 1").drop("_n")
    chain = materialize(before.join(after, "node").withColumn("_order", F.xxhash64("node", F.lit(turn))), "chain")
    near = [chain.select(F.col("node").alias(side), F.col("_order").alias(f"_{side}")) for side in ("p", "s")]
    first = chain.join(near[0], "p", "left").join(near[1], "s", "left").filter("(_p IS NULL OR _order < _p) AND (_s IS NULL OR _order < _s)")
    taken = materialize(first.select("node", "p", "s"), "taken")
    gone = taken.select("node")
    rest = inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    tied = taken.filter("p <> s").select(F.col("p").alias("src"), F.col("s").alias("dst"))
    made = materialize(rest.select("src", "dst").unionByName(tied).distinct(), "edges")
    discard(inner)
    discard(chain)
    return made, taken


def _spread(values: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """The greatest ``color`` that reaches each node along ``edges`` (src, dst), its own included."""
    while True:
        along = edges.join(values.select(F.col("node").alias("src"), "color"), "src").select(F.col("dst").alias("node"), "color")
        now = materialize(values.unionByName(along).groupBy("node").agg(F.max("color").alias("color")), label)
        same = now.join(values.withColumnRenamed("color", "_was"), "node", "left").filter("_was IS NULL OR color <> _was").isEmpty()
        discard(values)
        values = now
        if same:
            return values


def _colored(live: DataFrame) -> list[DataFrame]:
    """``node, component`` of the components of two nodes or more."""
    found = []
    while not live.isEmpty():
        nodes = live.select(F.col("src").alias("node")).unionByName(live.select(F.col("dst").alias("node"))).distinct()
        colors = _spread(materialize(nodes.select("node", F.col("node").alias("color")), "colors"), live, "colors")
        of_src, of_dst = (colors.select(F.col("node").alias(c), F.col("color").alias(f"_{c}")) for c in ("src", "dst"))
        within = live.join(of_src, "src").join(of_dst, "dst").filter("_src = _dst").select("src", "dst")
        within = materialize(within, "within")
        # what reaches a colour's file backwards; all of it has that colour
        back = within.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        members = _spread(materialize(colors.filter("node = color"), "members"), back, "members")
        found.append(members.select("node", F.col("color").alias("component")))
        done = members.select("node")
        left = within.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti")
        before, live = live, materialize(left.select("src", "dst"), "edges")
        discard(before)
        discard(within)
        discard(colors)
    return found


def strong_components(edges: DataFrame, worth: float = WORTH) -> DataFrame:
    """``node, component, n_members, is_cycle`` of every node of ``edges`` (src, dst); a component is named by its least node.

    Two nodes are in one component if each reaches the other. ``is_cycle`` also holds for a node that includes itself.
    Repeated edges count once, edges with a null not at all; an empty table gives no rows.
    """
    known = materialize(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "known")
    live, taken, n = materialize(known.filter("src <> dst"), "edges"), [], None
    while True:
        n = live.count() if n is None else n
        if not n:
            break
        before, (live, out) = live, _shortened(live, len(taken))
        discard(before)
        taken.append(out)
        was, n = n, live.count()
        if was - n < worth * was:
            break
    parts = _colored(live)
    inside = parts[0] if parts else known.select(F.col("src").alias("node"), F.col("src").alias("component")).filter("false")
    for p in parts[1:]:
        inside = inside.unionByName(p)
    inside = materialize(inside, "inside")
    for out in reversed(taken):
        of_p, of_s = (inside.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("p", "s"))
        met = out.join(of_p, "p", "left").join(of_s, "s", "left")
        joined = met.filter("_p = _s").select("node", F.col("_p").alias("component"))
        # two files that include each other, of which the other was in no component yet
        pairs = met.filter("p = s AND _p IS NULL").select(F.explode(F.array("node", "p")).alias("node"), F.col("p").alias("component")).distinct()
        before, inside = inside, materialize(inside.unionByName(joined).unionByName(pairs), "inside")
        discard(before)
        discard(out)
    names = inside.groupBy("component").agg(F.min("node").alias("_name"), F.count(F.lit(1)).alias("n_members"))
    named = inside.join(names, "component").select("node", F.col("_name").alias("component"), "n_members")
    loops = known.filter("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("_loop"))
    nodes = known.select(F.col("src").alias("node")).unionByName(known.select(F.col("dst").alias("node"))).distinct()
    return nodes.join(named, "node", "left").join(loops, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), F.coalesce("n_members", F.lit(1)).alias("n_members"),
        (F.col("n_members").isNotNull() | F.col("_loop").isNotNull()).alias("is_cycle"),
    )


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components of ``edges`` (see :func:`strong_components`, written), and ``root, node, depth`` of which component
    reaches which, itself left out; a file reaches all files of the components that its own reaches, and of its own if
    that is a cycle."""
    members = materialize(strong_components(edges), "components")
    of_src, of_dst = (members.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("src", "dst"))
    between = edges.join(of_src, "src").join(of_dst, "dst").filter("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    return members, closure(between)
