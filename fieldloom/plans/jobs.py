"""The jobs a user runs: several operators in order, as one or few Spark plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.codes import member_key, parse_code
from fieldloom.operators import compare, consistency, ensemble, fields, reduce, rules
from fieldloom.session import materialize


@dataclass(frozen=True)
class Segment:
    """A run segment: start date, stop option (nsteps, ndays, nmonths, nyears) and count."""

    start: str
    option: str
    n: int


def tape_job(
    history: DataFrame,
    spec: Mapping[str, str],
    freq: reduce.Frequency,
    segment: Segment | None = None,
    runs: DataFrame | None = None,
    by: Sequence[str] = ("member", "cell"),
    run_key: str = "member",
    calendar: str = "gregorian",
    digits: int | None = None,
) -> DataFrame:
    """Samples -> run segment -> listed fields -> reduction -> stamped tape.

    Metadata is joined to the reduced tape, not to the samples. The result goes
    to ``sources.history.history_write``.
    """
    if segment is not None:
        history = reduce.run_window(history, segment.start, segment.option, segment.n, calendar)
    tape = reduce.history_reduce(history, dict(spec), freq, by, calendar, digits)
    return tape if runs is None else consistency.stamp(tape, runs, run_key)


def replicate_job(base: DataFrame, case: str, col: str, cell: str, size: int, start: int = 0) -> DataFrame:
    """Base table -> perturbed replicas, each row carrying its member's case name."""
    copies = ensemble.fanout(base, size, col, cell, start)
    return copies.withColumn("case", member_key(F.col(case), F.col("member")))


def consistency_job(
    history: DataFrame,
    new_history: DataFrame,
    area: DataFrame,
    status: DataFrame | None = None,
    k: int = 3,
    m: float = 2.0,
    p: int = 3,
    r: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Ensemble and new runs -> (scores of the new runs, one-row verdict); see :func:`consistency_of_means`."""
    if status is not None:
        history = history.join(status.filter("success").select("member").distinct(), "member", "left_semi")
    return consistency_of_means(consistency.global_mean(history, area), consistency.global_mean(new_history, area), k, m, p, r)


def consistency_of_means(
    trusted: DataFrame, new: DataFrame, k: int = 3, m: float = 2.0, p: int = 3, r: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Global means (member, field, value) of an ensemble and of new runs -> (scores of the new runs, one-row verdict).

    The means, at most 2000 members x fields, are written to the shared folder
    and everything after that works on them. Raises when the ensemble does not
    have more members than fields.
    """
    trusted, new = materialize(trusted, "ensemble-means"), materialize(new, "new-means")
    size = consistency.precheck(trusted).first()
    if not size["ok"]:
        raise ValueError(f"{size['n_members']} members cannot judge {size['n_fields']} fields")
    stats = materialize(consistency.ensemble_stats(trusted), "ensemble-stats")
    columns = ["member", "field", "z"]
    z = consistency.standardize(trusted, stats).select(columns)
    loadings = consistency.pca_fit(z, k)
    limits = consistency.limits_from(consistency.pca_scores(z, loadings))
    scores = consistency.pca_scores(consistency.standardize(new, stats).select(columns), loadings)
    return scores, consistency.ect_verdict(scores, limits, m=m, p=p, r=r)


def release_job(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Test results -> reconciled with expected failures -> gate per tag.

    Expected failures do not block a tag; everything unexpected counts. A tag
    with expected failures alone keeps its row.
    """
    rows = compare.reconcile(results, expected).filter(F.col("outcome") != "stale")
    return compare.gate(rows, counted=F.col("outcome") != "expected fail")


def enrich_job(
    records: DataFrame,
    col: str,
    registry: DataFrame,
    positions: Sequence[str],
    value_rules: Sequence[tuple[str, str]],
    layouts: Sequence[rules.WildcardRule],
) -> DataFrame:
    """Records with an alias or code -> long name -> parsed parts -> rule value -> layout attributes."""
    named = rules.resolve(records, col, registry, "lname")
    parsed = named.withColumn("parsed", parse_code(F.col("lname"), positions))
    return rules.specific_match(rules.rule_match(parsed, "lname", value_rules), layouts, code="lname")


def fields_job(
    history: DataFrame, weights: DataFrame, names: Mapping[str, float], by: str = "win", digits: int | None = None
) -> DataFrame:
    """Samples -> regridded fields -> one merged field by constant area fractions."""
    wanted = history.filter(F.col("field").isin(list(names)))
    mapped = fields.remap(wanted, weights, by=["field", by], norm=True, digits=digits)
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    f = F.element_at(F.create_map(*pairs), F.col("field"))
    there = F.sum(F.when(F.col("value").isNotNull(), f))
    return mapped.groupBy("cell", by).agg((F.sum(f * F.col("value")) / F.nullif(there, F.lit(0.0))).alias("value"))
