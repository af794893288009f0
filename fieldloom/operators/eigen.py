"""Principal components of very many fields by orthogonal iteration, without a covariance matrix or a wide table.

The table stays long, (member, field, x). A block of vectors has one row a field and one column a vector; multiplying it
by the covariance takes two aggregations, over fields to a row a member and over members back to a row a field, each of
which adds up in the tasks before it shuffles one row a member or field. The block is orthonormalised by its Gram matrix
and turned to the Ritz vectors: of all that the driver sees numbers of vectors by vectors alone, a dozen squared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.session import discard, materialize

#: Vectors beyond those that are wanted, the residual (as a share of the greatest eigenvalue) that ends the rounds,
#: and how many there are at most.
EXTRA, TOLERANCE, ROUNDS = 8, 1e-9, 200


def centred(z: DataFrame, value: str = "z") -> DataFrame:
    """``member, field, x`` of the members that have every field, each field less its mean over them."""
    known = z.filter(F.col(value).isNotNull()).groupBy("member", "field").agg(F.first(value).alias("_v"))
    n_fields = z.select("field").distinct().agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    whole = known.groupBy("member").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n_fields).select("member")
    used = known.join(whole, "member")
    means = used.groupBy("field").agg(F.avg("_v").alias("_mean"))
    return used.join(means, "field").select("member", "field", (F.col("_v") - F.col("_mean")).alias("x"))


def _products(df: DataFrame, names: list[str]) -> np.ndarray:
    """Sums of the products of every two columns."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs)).first()
    made = np.zeros((len(names), len(names)))
    for (i, j), x in zip(pairs, row):
        made[i, j] = made[j, i] = x or 0.0
    return made


def _turned(names: list[str], by: np.ndarray, out: str) -> list[Column]:
    """The columns times a small matrix."""
    return [sum((F.col(n) * float(by[i, j]) for i, n in enumerate(names)), F.lit(0.0)).alias(f"{out}{j}") for j in range(by.shape[1])]


def _whitening(gram: np.ndarray) -> np.ndarray:
    """What makes vectors of this Gram matrix orthonormal; directions that they do not span are left out."""
    size, axes = np.linalg.eigh(gram)
    kept = size > size.max(initial=0) * 1e-13
    return axes[:, kept] / np.sqrt(size[kept])


def components(x: DataFrame, k: int, extra: int = EXTRA, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``field, pc, loading, eigenvalue, residual`` of the ``k`` leading components of ``x`` (see :func:`centred`).

    Components are unit vectors, the largest loading positive, by falling eigenvalue of the sample covariance; there are
    fewer than ``k`` if the table has a lower rank. ``residual`` is the length of C v - eigenvalue v, which bounds the
    eigenvalue's error; rounds end when it is below ``tolerance`` times the greatest eigenvalue for all, or at the last.
    """
    x = materialize(x, "centred")
    n = x.select("member").distinct().count()
    if n < 2:
        raise ValueError("components need two complete members")
    names = [f"v{j}" for j in range(k + extra)]
    start = [(F.xxhash64("field", F.lit(j)) / float(2**63)).alias(v) for j, v in enumerate(names)]
    block = materialize(x.select("field").distinct().select("field", *start), "block")
    block = _orthonormal(block, names)
    for turn in range(rounds):
        names = [c for c in block.columns if c != "field"]
        across = x.join(block, "field").groupBy("member").agg(*(F.sum(F.col("x") * F.col(v)).alias(v) for v in names))
        across = materialize(across, "across")
        size, turn_by = np.linalg.eigh(_products(across, names) / (n - 1))
        turn_by, size = turn_by[:, ::-1], size[::-1]
        image = x.join(across, "member").groupBy("field").agg(*(F.sum(F.col("x") * F.col(v) / (n - 1)).alias(f"y{i}") for i, v in enumerate(names)))
        both = block.join(image, "field").select("field", *_turned(names, turn_by, "r"), *_turned([f"y{i}" for i in range(len(names))], turn_by, "c"))
        both = materialize(both, "ritz")
        wanted = range(min(k, len(names)))
        apart = both.agg(*(F.sqrt(F.sum((F.col(f"c{j}") - float(size[j]) * F.col(f"r{j}")) ** 2)).alias(f"d{j}") for j in wanted)).first()
        discard(across)
        discard(block)
        # the small ones are the rank's end: nothing is left of them
        real = [j for j in wanted if size[j] > size[0] * 1e-12]
        if turn == rounds - 1 or all(apart[j] <= tolerance * size[0] for j in real):
            made = F.array(*(F.struct(F.lit(j + 1).alias("pc"), F.col(f"r{j}").alias("loading"), F.lit(float(size[j])).alias("eigenvalue"), F.lit(float(apart[j])).alias("residual")) for j in real))
            long = both.select("field", F.inline(made))
            signs = long.groupBy("pc").agg(F.signum(F.max_by("loading", F.abs("loading"))).alias("_sign"))
            return long.join(signs, "pc").select("field", "pc", (F.col("loading") * F.col("_sign")).alias("loading"), "eigenvalue", "residual")
        block = _orthonormal(both.select("field", *(F.col(f"c{j}").alias(f"v{j}") for j in range(len(names)))), names)
        discard(both)
    raise ValueError("rounds must be positive")


def _orthonormal(block: DataFrame, names: list[str]) -> DataFrame:
    """Orthonormal vectors that span what the columns span, written; made twice, as the first turn is not exact."""
    for _ in range(2):
        whiten = _whitening(_products(block, names))
        block = block.select("field", *_turned(names, whiten, "v"))
        names = [f"v{j}" for j in range(whiten.shape[1])]
    return materialize(block, "block")


def checks(x: DataFrame, found: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row that says how good ``found`` components of ``x`` are, in numbers that do not depend on their signs.

    ``n_fields``, ``n_components``, ``total`` (sum of all variances), ``explained`` (sum of the eigenvalues), ``squares``
    (sum of their squares), ``worst_residual`` and ``worst_product`` (of two components, or of one less 1).
    """
    total = x.groupBy("field").agg(F.var_samp("x").alias("_var")).agg(F.sum("_var").alias("total"), F.count(F.lit(1)).alias("n_fields"))
    values = found.select("pc", "eigenvalue", "residual").distinct().agg(
        F.count(F.lit(1)).alias("n_components"), F.sum("eigenvalue").alias("explained"), F.sum(F.col("eigenvalue") ** 2).alias("squares"), F.max("residual").alias("worst_residual")
    )
    other = found.select("field", F.col("pc").alias("_pc"), F.col("loading").alias("_loading"))
    products = found.join(other, "field").filter("_pc >= pc").groupBy("pc", "_pc").agg(F.sum(F.col("loading") * F.col("_loading")).alias("_p"))
    worst = products.agg(F.max(F.abs(F.col("_p") - F.when(F.col("pc") == F.col("_pc"), 1.0).otherwise(0.0))).alias("worst_product"))
    scalars = {c: df.select(c).scalar() for df in (total, values, worst) for c in df.columns}
    return x.sparkSession.range(1).select(*(v.alias(c) for c, v in scalars.items()))
