"""Members, perturbations, replicas, and the consistency test."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import codes
from fieldloom.operators import consistency as C
from fieldloom.operators import ensemble as E
from fieldloom.plans import jobs


def test_perturbation_check_values(spark):
    got = {r.member: r.pertlim for r in E.perturbation_table(spark, 2000).collect()}
    want = {
        0: "0", 1: "0.101d-13", 2: "-0.101d-13", 100: "-0.983d-13", 900: "-0.999d-13", 901: "0.118d-13",
        1000: "-0.1000d-13", 1001: "0.102d-13", 1801: "0.001d-13", 2000: "-0.100d-13",
    }
    assert {i: got[i] for i in want} == want


def test_perturbations_are_distinct_texts_but_not_distinct_numbers(spark):
    table = E.perturbation_table(spark, 2000).filter("member > 0")
    row = table.agg(
        F.count_distinct("pertlim").alias("t"), F.count_distinct("pertlim_num").alias("v"),
        F.count_if(F.col("pertlim_num") != E.pertlim_number(F.col("pertlim"))).alias("unlike"),
    ).first()
    assert (row.t, row.v, row.unlike) == (2000, 1998, 0)
    pairs = {r.member: r.pertlim_num for r in table.filter("member in (999, 1999, 1000, 2000)").collect()}
    assert pairs[999] == pairs[1999] and pairs[1000] == pairs[2000]


def test_member_arguments(spark):
    with pytest.raises(ValueError):
        E.perturbation_table(spark, 2001)
    with pytest.raises(ValueError):
        E.members(spark, "a.0000", 2001)
    with pytest.raises(ValueError):
        E.members(spark, "a.0000", 5, start=5)
    with pytest.raises(ValueError):
        E.members(spark, "a.000", 5)
    assert [r.member for r in E.members(spark, "a.0000", 3, start=-4).collect()] == [0, 1, 2]
    assert E.members(spark, "a.0000", 3, start=2, mode="verify").count() == 3
    first = E.members(spark, "x/a.0000", 2).orderBy("member").collect()
    assert [(r.case, r.pertlim, r.pertlim_num) for r in first] == [("x/a.0000", "0", 0.0), ("x/a.0001", "0.101d-13", 1.01e-14)]


def test_draw_is_reproducible_and_distinct(spark):
    for k, size in E.DRAWS.values():
        pool = spark.range(size).withColumnRenamed("id", "member")
        one, two = (sorted(r.member for r in E.draw(pool, k, 3).collect()) for _ in range(2))
        assert one == two and len(set(one)) == k


def test_fanout_copies_everything(spark):
    base = spark.range(100).select(F.col("id").alias("cell"), (F.col("id") + 1.0).alias("v"))
    out = E.fanout(base, 5, "v", "cell")
    assert out.count() == 500
    assert out.filter("member = 0 and v <> cell + 1.0").isEmpty()
    assert out.filter("abs(v / (cell + 1.0) - 1) > 2e-14").isEmpty()
    assert out.filter("member > 0 and v <> cell + 1.0").count() > 100


def test_replace_drops_every_line_with_the_key(spark):
    lines = spark.createDataFrame([(1, 0, "pertlim = 1"), (1, 1, "! old pertlim"), (1, 2, "mfilt = 1"), (2, 0, "a = 1")], "scope int, seq int, line string")
    got = sorted((r.scope, r.seq, r.line) for r in E.replace_setting(lines, "pertlim", "0.101d-13").collect())
    assert got == [(1, 2, "mfilt = 1"), (1, 3, "pertlim = 0.101d-13"), (2, 0, "a = 1"), (2, 1, "pertlim = 0.101d-13")]


def test_codes_of_runs(spark):
    row = spark.range(1).select(
        codes.classify_testtype(F.lit("nmonths")).alias("a"),
        codes.classify_testtype(F.lit("nyears")).alias("b"),
        codes.classify_testtype(F.lit("nsteps")).alias("c"),
        codes.classify_testtype(F.lit(None).cast("string")).alias("d"),
        codes.default_walltime(F.lit("00:00"), F.lit("pop"), F.lit(True)).alias("w"),
    ).first()
    assert tuple(row) == ("ECT", "POP-ECT", "UF-ECT", "UF-ECT", "00:10")


def _ensemble(spark, seed=1, members=60, fields=5):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=(members, 1))
    data = rng.normal(size=(members, fields)) + common * np.arange(fields)
    rows = [(m, f"f{i}", float(data[m, i])) for m in range(members) for i in range(fields)]
    rows += [(m, "flat", 1.0) for m in range(members)]
    return data, spark.createDataFrame(rows, "member int, field string, value double")


def test_statistics_and_components_against_numpy(spark):
    data, gm = _ensemble(spark)
    stats = C.ensemble_stats(gm)
    assert [r.field for r in stats.filter("constant").collect()] == ["flat"]
    z = C.standardize(gm, stats).select("member", "field", "z").cache()
    assert z.filter("field = 'flat'").isEmpty()
    want = (data - data.mean(0)) / data.std(0, ddof=1)
    cov = {(r.f1, r.f2): r["cov"] for r in C.covariance(z).collect()}
    assert len(cov) == 25
    assert np.allclose([[cov[f"f{i}", f"f{j}"] for j in range(5)] for i in range(5)], np.cov(want.T))

    loadings = C.pca_fit(z, 5)
    axes = np.zeros((5, 5))
    for r in loadings.collect():
        axes[int(r.field[1]), r.pc - 1] = r.loading
    assert np.allclose(axes.T @ axes, np.eye(5), atol=1e-9)
    assert all(axes[np.abs(axes[:, k]).argmax(), k] > 0 for k in range(5))
    scores = C.pca_scores(z, loadings)
    spread = [r.v for r in scores.groupBy("pc").agg(F.var_samp("score").alias("v")).orderBy("pc").collect()]
    assert spread == sorted(spread, reverse=True) and np.isclose(sum(spread), 5.0)
    assert np.allclose(sorted(spread), np.linalg.eigvalsh(np.cov(want.T)))


def test_covariance_in_several_passes(spark, monkeypatch):
    _, gm = _ensemble(spark)
    z = gm.filter("field <> 'flat'").withColumnRenamed("value", "z")
    once = sorted(C.covariance(z).collect())
    monkeypatch.setattr(C, "FIELDS_PER_PASS", 2)
    assert sorted(C.covariance(z).collect()) == once


def test_precheck(spark):
    _, gm = _ensemble(spark, members=7)
    assert C.precheck(gm).first().ok
    assert not C.precheck(gm.filter("member < 6")).first().ok


def test_verdicts(spark):
    _, gm = _ensemble(spark)
    gm = gm.filter("field <> 'flat'")
    limits = C.limits_from(gm, "field", "value")
    fine = gm.filter("member < 3").join(limits, "field").select("member", "field", F.col("mean").alias("value"))
    far = fine.withColumn("value", F.when(F.col("field") < "f3", F.col("value") + 1000).otherwise(F.col("value")))
    one_run = fine.withColumn("value", F.when(F.col("member") == 0, F.col("value") + 1000).otherwise(F.col("value")))
    got = [C.ect_verdict(new, limits, "field", "value").first() for new in (fine, far, one_run)]
    assert [(r.n_features, r.n_failing, r.verdict) for r in got] == [(5, 0, "PASS"), (5, 3, "FAIL"), (5, 0, "PASS")]


def test_pointwise(spark):
    ens = spark.createDataFrame([("t", c, 1, float(m % 3)) for c in range(10) for m in range(9)] + [("k", 0, 1, 2.0)] * 3, "field string, cell int, win int, value double")
    new = spark.createDataFrame([("t", c, 1, 1.0 if c else 99.0) for c in range(10)] + [("k", 0, 1, 2.0)], ens.schema)
    for digits in (None, 2):
        got = {r.field: (r.points, r.passing, r.passes) for r in C.zpf(ens, new, digits=digits).collect()}
        assert got == {"t": (10, 9, True), "k": (1, 1, True)}


def test_weighted_mean_skips_nulls(spark):
    h = spark.createDataFrame([(0, "a", 1, 2.0), (0, "a", 2, None), (0, "a", 3, 5.0)], "member int, field string, cell int, value double")
    area = spark.createDataFrame([(1, 1.0), (2, 10.0), (3, 2.0)], "cell int, w double")
    assert C.global_mean(h, area).first().value == 4.0


def test_config_mismatch(spark):
    runs = spark.createDataFrame([(1, "r1", "B", "g"), (1, "r2", "F", None), (1, "r3", "B", "h")], "ensemble int, run string, compset string, grid string")
    summary = spark.createDataFrame([(1, "B", "g")], "ensemble int, compset string, grid string")
    assert {r.run: r.mismatch for r in C.compat(runs, summary).collect()} == {"r2": "compset,grid", "r3": "grid"}


def test_consistency_job(spark):
    """Members from one distribution pass against each other; a shifted run does not."""
    rng = np.random.default_rng(8)
    mix = rng.normal(size=(4, 4))

    def rows(members, shift=0.0):
        for m in members:
            field = mix @ rng.normal(size=4) + shift
            for i in range(4):
                yield from ((m, f"f{i}", c, float(field[i] + c)) for c in range(3))

    schema = "member int, field string, cell int, value double"
    ensemble = spark.createDataFrame(list(rows(range(80))), schema)
    area = spark.createDataFrame([(c, 1.0 + c) for c in range(3)], "cell int, w double")
    status = spark.createDataFrame([(m, m != 7) for m in range(80)], "member int, success boolean")
    far = spark.createDataFrame(list(rows(range(3), shift=50.0)), schema)
    scores, verdict = jobs.consistency_job(ensemble, far, area, status, k=4, p=1)
    assert scores.count() == 12 and verdict.first().verdict == "FAIL"
    near = ensemble.filter("member in (11, 12, 13)")
    assert jobs.consistency_job(ensemble, near, area, k=4, m=6.0, p=1)[1].first().verdict == "PASS"
    with pytest.raises(ValueError, match="cannot judge"):
        jobs.consistency_job(ensemble.filter("member < 4"), near, area)
