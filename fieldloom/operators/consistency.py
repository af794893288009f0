"""Ensemble consistency: global means, statistics, principal components, verdicts.

Thresholds are parameters. Their defaults follow the published ensemble
consistency papers and are not constants of any run configuration.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.exact import exact_sum, from_fixed
from fieldloom.operators.ensemble import MAX_MEMBERS

# Aggregates per pass of the covariance; keeps each plan small.
FIELDS_PER_PASS = 100


def global_mean(
    history: DataFrame,
    area: DataFrame,
    values: Sequence[str] = ("value",),
    by: Sequence[str] = ("member", "field"),
    digits: int | None = None,
) -> DataFrame:
    """Area-weighted mean per ``by``; several value columns share one pass.

    ``area`` holds (cell, w). Spark broadcasts it when it turns out small;
    otherwise adaptive execution splits cells that hold too many samples, which
    the following grouping on other keys allows. A mean is null if one of its
    samples lies in a cell without an area: it would not be the global one.
    """
    joined = history.join(area, "cell", "left")
    weight = F.col("w")

    def mean(v: str) -> Column:
        there = F.col(v).isNotNull()
        whole = F.count_if(there & weight.isNull()) == 0
        return F.when(whole, exact_sum(F.col(v) * weight, digits) / exact_sum(F.when(there, weight), digits)).alias(v)

    return joined.groupBy(*by).agg(*map(mean, values))


def ensemble_stats(gm: DataFrame, value: str = "value", by: Sequence[str] = ("field",)) -> DataFrame:
    """n, mean and sample standard deviation over members; ``constant`` marks zero variance."""
    return gm.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        (F.min(value) == F.max(value)).alias("constant"),
    )


def standardize(gm: DataFrame, stats: DataFrame, value: str = "value", by: Sequence[str] = ("field",)) -> DataFrame:
    """z = (x - mean) / std; fields without variance are left out."""
    usable = stats.filter(~F.col("constant") & (F.col("std") > 0)).select(*by, "mean", "std")
    z = (F.col(value) - F.col("mean")) / F.col("std")
    return gm.join(usable, list(by)).withColumn("z", z).drop("mean", "std")


def field_list(df: DataFrame, field: str = "field", limit: int = MAX_MEMBERS) -> list[str]:
    """Distinct field names; more fields than the largest ensemble cannot be tested."""
    names = [r[0] for r in df.select(field).distinct().limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} fields")
    return sorted(names)


def precheck(history: DataFrame, member: str = "member", field: str = "field") -> DataFrame:
    """One row: members, fields, and whether members outnumber fields."""
    counts = history.agg(
        F.count_distinct(member).alias("n_members"), F.count_distinct(field).alias("n_fields")
    )
    return counts.withColumn("ok", F.col("n_members") > F.col("n_fields"))


def covariance(z: DataFrame, value: str = "z", fields: Sequence[str] | None = None) -> DataFrame:
    """Field x field sample covariance over members.

    The table is members x fields, at most 2000 x 2000, however many samples
    lie behind it. Each value meets its member's wide row inside one task and
    adds to one aggregate per field; only partial moments are shuffled.
    """
    names = list(fields) if fields is not None else field_list(z)
    wide = z.groupBy("member").pivot("field", names).agg(F.first(value))
    wide = wide.select(*[F.col(f"`{n}`").alias(f"f{i}") for i, n in enumerate(names)])
    each = F.array(*[F.struct(F.lit(n).alias("_field"), F.col(f"f{i}").alias("_x")) for i, n in enumerate(names)])
    rows = wide.select("*", F.inline(each))
    out: DataFrame | None = None
    for at in range(0, len(names), FIELDS_PER_PASS):
        some = range(at, min(at + FIELDS_PER_PASS, len(names)))
        moments = rows.groupBy("_field").agg(*[F.covar_samp("_x", f"f{i}").alias(f"c{i}") for i in some])
        cells = F.array(*[F.struct(F.lit(names[i]).alias("f2"), F.col(f"c{i}").alias("cov")) for i in some])
        part = moments.select(F.col("_field").alias("f1"), F.inline(cells))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fields")
    return out


def pca_fit(z: DataFrame, k: int, value: str = "z", fields: Sequence[str] | None = None) -> DataFrame:
    """Loadings (field, pc, loading) of the k leading components, from the members that have every field.

    Spark ML builds the covariance on the executors; only the field x field
    eigenproblem runs on the driver. The largest loading of each component is
    made positive so that signs are reproducible.
    """
    from pyspark.ml.feature import PCA, VectorAssembler

    names = list(fields) if fields is not None else field_list(z)
    wide = z.groupBy("member").pivot("field", names).agg(F.first(value)).dropna()
    inputs = [f"f{i}" for i in range(len(names))]
    wide = wide.select("member", *[F.col(f"`{n}`").alias(c) for n, c in zip(names, inputs)])
    vectors = VectorAssembler(inputCols=inputs, outputCol="v").transform(wide).select("v")
    axes = PCA(k=k, inputCol="v", outputCol="s").fit(vectors).pc.toArray()
    rows = []
    for pc in range(k):
        axis = axes[:, pc]
        sign = 1.0 if axis[abs(axis).argmax()] >= 0 else -1.0
        rows += [(name, pc + 1, float(sign * axis[i])) for i, name in enumerate(names)]
    return z.sparkSession.createDataFrame(rows, "field string, pc int, loading double")


def pca_scores(z: DataFrame, loadings: DataFrame, value: str = "z") -> DataFrame:
    """Score of every member on every component; null where the member lacks a field, as in the fit."""
    wanted = loadings.agg(F.count_distinct("field").alias("n")).select("n").scalar()
    part = F.col(value) * F.col("loading")
    return (
        z.join(loadings, "field")
        .groupBy("member", "pc")
        .agg(F.sum(part).alias("score"), F.count(part).alias("_n"))
        .withColumn("score", F.when(F.col("_n") == wanted, F.col("score")))
        .drop("_n")
    )


def ect_features(
    new: DataFrame, limits: DataFrame, feature: str, value: str, m: float = 2.0, runs: int = 2
) -> DataFrame:
    """Per feature: in how many new runs it lies outside mean +/- m*std, and whether that fails it.

    Features that only the ensemble or only the new runs have keep their row.
    ``judged`` tells whether there are limits and at least ``runs`` values.
    """
    outside = F.abs(F.col(value) - F.col("mean")) > F.col("std") * m
    return (
        new.join(limits.select(feature, "mean", "std"), feature, "full")
        .groupBy(feature)
        .agg(
            F.sum(F.when(outside, 1).otherwise(0)).alias("fail_runs"),
            F.count(value).alias("n_runs"),
            (F.count_if(F.col("std").isNotNull()) > 0).alias("_limits"),
        )
        .withColumn("fails", F.col("fail_runs") >= runs)
        .withColumn("judged", F.col("_limits") & (F.col("n_runs") >= runs))
        .drop("_limits")
    )


def ect_verdict(
    new: DataFrame, limits: DataFrame, feature: str = "pc", value: str = "score", m: float = 2.0, p: int = 3, r: int = 2
) -> DataFrame:
    """One row: FAIL when at least p features fail in at least r of the new runs.

    It is INCOMPLETE, not PASS, while a feature could not be judged or there is none.
    """
    rows = ect_features(new, limits, feature, value, m, r)
    failing = F.coalesce(F.sum(F.col("fails").cast("bigint")), F.lit(0))
    unjudged = F.count_if(~F.col("judged"))
    open_end = (unjudged > 0) | (F.count(F.lit(1)) == 0)
    return rows.agg(
        F.count(F.lit(1)).alias("n_features"),
        failing.alias("n_failing"),
        unjudged.alias("n_unjudged"),
        F.when(failing >= p, "FAIL").when(open_end, "INCOMPLETE").otherwise("PASS").alias("verdict"),
    )


def zpf(
    ensemble: DataFrame,
    new: DataFrame,
    tol: float = 3.0,
    threshold: float = 0.9,
    by: Sequence[str] = ("cell", "win"),
    digits: int | None = None,
) -> DataFrame:
    """Pointwise pass fraction per field: share of points with |z| <= tol.

    Points without spread in the ensemble pass when they equal its mean. Points
    that the ensemble does not have (``unknown``) or that have no value do not pass.
    ``digits`` makes the two moments independent of the summation order.
    """
    keys = ["field", *by]
    # As a struct the keys compare null-safely, so a null window is tested too.
    point = F.struct(*keys).alias("_point")
    v = F.col("value")
    if digits is None:
        stats = ensemble.groupBy(point).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    else:
        q = F.rint(v * F.lit(float(10**digits))).cast("decimal(19,0)")
        n, s1, s2 = F.count(v), F.sum(q), F.sum((q * q).cast("decimal(38,0)"))
        centred = (n * s2 - s1 * s1).cast("double")
        std = F.sqrt(centred / (n * F.nullif(n - 1, F.lit(0).cast("bigint"))).cast("double"))
        stats = ensemble.groupBy(point).agg(
            from_fixed(s1.cast("double") / n, digits).alias("mean"), (std / F.lit(float(10**digits))).alias("std")
        )
    distance = F.abs(v - F.col("mean"))
    within = F.when(F.col("std") > 0, distance <= F.col("std") * tol).otherwise(distance == 0)
    return (
        new.select("field", "value", point)
        .join(stats, "_point", "left")
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("points"), F.count_if(within).alias("passing"), F.count_if(F.col("mean").isNull()).alias("unknown"))
        .withColumn("fraction", F.col("passing") / F.col("points"))
        .withColumn("passes", F.col("fraction") >= threshold)
    )


def compat(runs: DataFrame, summary: DataFrame, keys: Sequence[str] = ("compset", "grid")) -> DataFrame:
    """Runs whose configuration differs from the ensemble's, with the differing attributes.

    ``summary`` is the one metadata row of an ensemble per ``ensemble`` id. A run
    of an ensemble without one mismatches in ``ensemble``.
    """
    want = summary.select("ensemble", F.lit(True).alias("_known"), *[F.col(k).alias(f"want_{k}") for k in keys])
    differs = [F.when(~F.col(k).eqNullSafe(F.col(f"want_{k}")), F.lit(k)) for k in keys]
    return (
        runs.join(want, "ensemble", "left")
        .withColumn("mismatch", F.when(F.col("_known").isNull(), "ensemble").otherwise(F.concat_ws(",", *differs)))
        .filter(F.col("mismatch") != "")
        .drop("_known", *[f"want_{k}" for k in keys])
    )


def stamp(history: DataFrame, runs: DataFrame, key: str = "case") -> DataFrame:
    """Attach run metadata columns to every sample."""
    return history.join(runs, key, "left")


def limits_from(scores: DataFrame, feature: str = "pc", value: str = "score") -> DataFrame:
    return scores.groupBy(feature).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


