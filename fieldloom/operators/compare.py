"""Run comparison, expected failures, release bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.codes import version_key, version_parts
from fieldloom.functions.exact import exact_sum

# Relative RMS difference up to which two fields count as equal but for rounding.
ROUNDOFF = 1e-12


def compare_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Key by key: ``only_left``, ``only_right``, ``equal`` or ``different``.

    Both sides are stacked and grouped by key: one shuffle, no sort, and a key
    that occurs many times is combined before the shuffle. Null equals null.
    Where a key repeats, its values are compared as multisets, by their number
    and the sum of their hashes.
    """
    hashed = F.xxhash64("_v").cast("decimal(38,0)")
    left = a.select(*keys, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    right = b.select(*keys, F.lit(1).alias("_side"), F.col(value).alias("_v"))
    is_left, is_right = F.col("_side") == 0, F.col("_side") == 1
    rows = left.unionByName(right).groupBy(*keys).agg(
        F.count_if(is_left).alias("n_left"),
        F.count_if(is_right).alias("n_right"),
        F.max(F.when(is_left, F.col("_v"))).alias("left_value"),
        F.max(F.when(is_right, F.col("_v"))).alias("right_value"),
        F.sum(F.when(is_left, hashed)).alias("_left"),
        F.sum(F.when(is_right, hashed)).alias("_right"),
    )
    once = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    equal = F.when(once, F.col("left_value").eqNullSafe(F.col("right_value"))).otherwise(
        (F.col("n_left") == F.col("n_right")) & (F.col("_left") == F.col("_right"))
    )
    state = (
        F.when(F.col("n_right") == 0, "only_left")
        .when(F.col("n_left") == 0, "only_right")
        .when(equal, "equal")
        .otherwise("different")
    )
    return rows.withColumn("state", state).drop("_left", "_right")


def dataset_diff(
    a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, by: Sequence[str] = ("field",), digits: int | None = None
) -> DataFrame:
    """Per ``by``: counts per state, greatest absolute and RMS difference, RMS of the left side.

    Every column of ``by`` must be one of ``keys``. ``unmeasured`` counts the
    different keys that have no difference: a value is null, or the key repeats.
    """
    rows = compare_rows(a, b, keys, value)
    repeated = (F.col("n_left") > 1) | (F.col("n_right") > 1)
    paired = F.col("state").isin("equal", "different") & ~repeated
    d = F.when(paired, F.col("right_value") - F.col("left_value"))
    matched = F.when(d.isNotNull(), F.col("left_value"))
    return rows.groupBy(*by).agg(
        F.count_if(F.col("state") == "only_left").alias("only_left"),
        F.count_if(F.col("state") == "only_right").alias("only_right"),
        F.count_if(F.col("state") == "equal").alias("equal"),
        F.count_if(F.col("state") == "different").alias("different"),
        F.count_if((F.col("state") == "different") & d.isNull()).alias("unmeasured"),
        F.count_if(repeated).alias("repeated_keys"),
        F.max(F.abs(d)).alias("max_abs"),
        F.sqrt(exact_sum(d * d, digits) / F.nullif(F.count(d), F.lit(0).cast("bigint"))).alias("rms"),
        F.sqrt(F.avg(matched * matched)).alias("rms_left"),
    )


def change_class(diff: DataFrame, eps: float = ROUNDOFF, verdicts: DataFrame | None = None, by: Sequence[str] = ("field",)) -> DataFrame:
    """Nature of an answer change per field.

    ``bit-for-bit``, ``roundoff`` (relative RMS up to ``eps``), else
    ``same climate`` / ``new climate`` by the consistency verdict, or
    ``larger than roundoff`` while no verdict is known. A change without a
    measured difference is never roundoff.
    """
    rows = diff if verdicts is None else diff.join(verdicts.select(*by, "verdict"), list(by), "left")
    verdict = F.col("verdict") if verdicts is not None else F.lit(None).cast("string")
    same = (F.col("different") == 0) & (F.col("only_left") == 0) & (F.col("only_right") == 0)
    aligned = (F.col("only_left") == 0) & (F.col("only_right") == 0)
    label = (
        F.when(same, "bit-for-bit")
        .when(aligned & (F.col("unmeasured") == 0) & (F.col("rms") <= F.col("rms_left") * eps), "roundoff")
        .when(verdict == "PASS", "same climate")
        .when(verdict == "FAIL", "new climate")
        .otherwise("larger than roundoff")
    )
    return rows.withColumn("change", label)


def reconcile(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Results against the list of expected failures.

    Every result keeps its row: ``PASS``, ``expected fail``, ``unexpected fail``
    or ``unexpected pass``. Expected entries that no result refers to are added
    as ``stale``. A test may occur any number of times in ``results``.
    """
    keys = ["test", "phase"]
    listed = expected.groupBy(*keys).agg(F.max("status").alias("expected_status"))
    label = (
        F.when((F.col("status") == "PASS") & F.col("expected_status").isNull(), "PASS")
        .when(F.col("status") == "PASS", "unexpected pass")
        .when(F.col("status") == F.col("expected_status"), "expected fail")
        .otherwise("unexpected fail")
    )
    matched = results.join(listed, keys, "left").withColumn("outcome", label)
    seen = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    stale = listed.join(seen, keys, "left_anti").withColumn("outcome", F.lit("stale"))
    return matched.unionByName(stale, allowMissingColumns=True)


def gate(results: DataFrame, tag: str = "tag", counted: Column | None = None) -> DataFrame:
    """A tag may be made unless a regression test is FAIL2 or a restart test is FAIL (of any kind).

    Results for which ``counted`` does not hold neither count nor block, but their tag keeps its row.
    """
    counted = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    blocked = counted & (
        ((F.col("suite") == "regression") & (F.col("status") == "FAIL2"))
        | ((F.col("suite") == "restart") & F.col("status").startswith("FAIL"))
    )
    return results.groupBy(tag).agg(
        F.count_if(counted).alias("n_results"),
        F.count_if(blocked).alias("n_blocking"),
        F.count_if(counted & (F.col("suite") == "regression") & (F.col("status") == "FAIL1")).alias("n_answer_changes"),
        (~F.coalesce(F.bool_or(blocked), F.lit(False))).alias("allowed"),
    )


def release_delta(tags: DataFrame) -> DataFrame:
    """Components that changed against the previous tag of the sequence.

    ``tags`` holds (tag_seq, component, version); numbers may have gaps. The
    distinct tags, a short list, are put in order once; each row is then compared
    with its component's at the tag before by shifting a copy to the next tag
    and grouping on (component, tag_seq): near-unique keys, so no component's
    whole history meets in one task. ``change`` is added, changed or removed.
    A component of several versions at a tag has them all, in order and joined by
    commas; one whose version is null is there all the same.
    """
    following = tags.select("tag_seq").distinct().select("tag_seq", F.lead("tag_seq").over(Window.orderBy("tag_seq")).alias("_next"))
    nothing = F.lit(None).cast("string")
    now = tags.select("component", "tag_seq", F.col("version").cast("string").alias("version"), nothing.alias("previous"), F.lit(True).alias("_is"))
    before = tags.join(following.filter("_next IS NOT NULL"), "tag_seq").select(
        "component", F.col("_next").alias("tag_seq"), nothing.alias("version"), F.col("version").cast("string").alias("previous"), F.lit(False).alias("_is")
    )

    def versions(name: str) -> Column:
        found = F.collect_set(name)
        return F.when(F.size(found) > 0, F.array_join(F.array_sort(found), ","))

    rows = now.unionByName(before).groupBy("component", "tag_seq").agg(
        versions("version").alias("version"), versions("previous").alias("previous"), F.bool_or("_is").alias("_is"), F.bool_or(~F.col("_is")).alias("_was")
    )
    change = F.when(~F.col("_was"), "added").when(~F.col("_is"), "removed").when(~F.col("version").eqNullSafe(F.col("previous")), "changed")
    return rows.withColumn("change", change).filter(F.col("change").isNotNull()).drop("_is", "_was")


def latest_per_line(tags: DataFrame, tag: str = "tag", by: Sequence[str] = ()) -> DataFrame:
    """Greatest tag by meaning per release line (name, major, minor).

    A tag of unknown shape has a row of its own, with ``reject`` set.
    """
    keyed = tags.withColumn("_v", version_parts(F.col(tag)))
    keyed = keyed.withColumn("_odd", F.when(F.col("_v").isNull(), F.col(tag))).withColumn("_shaped", F.col("_v").isNotNull())
    rows = keyed.groupBy(*by, "_v.line", "_v.major", "_v.minor", "_odd", "_shaped").agg(
        F.max_by(tag, version_key(F.col("_v"))).alias("_latest"), F.count_distinct(tag).alias("n_tags")
    )
    return rows.select(
        *by, "line", "major", "minor", F.coalesce("_latest", "_odd").alias("latest"), "n_tags",
        F.when(~F.col("_shaped"), "unknown shape").alias("reject"),
    )
