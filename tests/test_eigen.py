"""Principal components by orthogonal iteration against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import eigen


def table(spark, x):
    members, fields = x.shape
    flat = spark.createDataFrame([(m, [float(v) for v in x[m]]) for m in range(members)], "member long, xs array<double>")
    return flat.select("member", F.posexplode("xs").alias("f", "z")).select("member", F.format_string("f%05d", "f").alias("field"), "z")


def plain(x, k):
    size, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, ::-1][:, :k]
    return size[::-1][:k], axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])


def check(found, x, k, digits=6):
    rows = found.collect()
    size, axes = plain(x, k)
    got = np.zeros_like(axes)
    for r in rows:
        got[int(r.field[1:]), r.pc - 1] = r.loading
    assert len(rows) == x.shape[1] * k
    np.testing.assert_allclose(got, axes, atol=10.0**-digits)
    np.testing.assert_allclose([e for _, e in sorted({(r.pc, r.eigenvalue) for r in rows})], size, rtol=10.0**-digits)


def test_all_components_of_a_few_fields(spark):
    x = np.random.default_rng(1).normal(size=(40, 6)) * [5, 4, 3, 2, 1, 0.5]
    found = eigen.components(eigen.centred(table(spark, x)), 6)
    check(found, x, 6)
    row = eigen.checks(eigen.centred(table(spark, x)), found).first()
    assert row.n_fields == row.n_components == 6
    assert row.total == pytest.approx(row.explained) and row.squares == pytest.approx((np.cov(x.T) ** 2).sum())
    assert row.worst_residual < 1e-8 and row.worst_product < 1e-10


def test_leading_components_of_five_thousand_fields(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) * [40, 25, 12, 6] @ rng.normal(size=(4, 5000)) / 70 + 0.01 * rng.normal(size=(60, 5000))
    found = eigen.components(eigen.centred(table(spark, x)), 2, extra=4)
    rows = found.collect()
    _, size, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    by_pc = {p: np.array([r.loading for r in sorted(rows, key=lambda r: r.field) if r.pc == p]) for p in (1, 2)}
    for p in (1, 2):
        assert abs(by_pc[p] @ axes[p - 1]) == pytest.approx(1, abs=1e-7)
        assert {round(r.eigenvalue / (size[p - 1] ** 2 / 59), 8) for r in rows if r.pc == p} == {1.0}
    assert max(r.residual for r in rows) < 1e-8 * size[0] ** 2 / 59


def test_low_rank_and_missing_values(spark):
    """A member that lacks a field has no part; repeated fields leave fewer components than asked for."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(9, 2)), 3, axis=1)
    z = table(spark, x)
    more = spark.createDataFrame([(99, "f00000", 7.0), (98, "f00001", None), (98, "f00000", 1.0)], "member long, field string, z double")
    found = eigen.components(eigen.centred(z.unionByName(more)), 5)
    assert sorted({r.pc for r in found.collect()}) == [1, 2]
    values = sorted({r.eigenvalue for r in found.collect()}, reverse=True)
    np.testing.assert_allclose(values, plain(x, 2)[0], rtol=1e-9)
    with pytest.raises(ValueError, match="complete members"):
        eigen.components(eigen.centred(z.filter("member = 0")), 1)
