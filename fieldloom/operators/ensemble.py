"""Ensemble generation: members, perturbations, replicas, replaced settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.codes import member_key
from fieldloom.functions.exact import hash32

# Largest ensemble, and per band of member numbers
# (last member, first block of 100, base, growth per block, growth per pair).
MAX_MEMBERS = 2000
BANDS = [
    (900, 0, 101, 2, 18),
    (1000, 0, 100, 2, 18),
    (1800, 10, 102, 2, 18),
    (1900, 18, 1, 0, 2),
    (2000, 19, 2, 0, 2),
]
EXPONENT = 13

# Odd step near 2**32 divided by the golden ratio: spreads members evenly around the circle.
TURN = 2654435769

# Fixed values: (how many runs are drawn, from how many members) per kind of test.
DRAWS = {"pop": (1, 40), "cam": (3, 150), "uf": (3, 350)}


def _digits(member: Column) -> Column:
    """Unsigned digits of a member's perturbation; members come in +/- pairs."""
    i = member.cast("int")
    block = F.floor((i - 1) / 100).cast("int")
    pair = F.floor(((i - 1) % 100) / 2).cast("int")
    digits = F.lit(None).cast("int")
    for last, first_block, base, per_block, per_pair in reversed(BANDS):
        band = base + per_block * (block - first_block) + per_pair * pair
        digits = F.when(i <= last, band).otherwise(digits)
    return F.when(i > 0, digits)


def pertlim_text(member: Column) -> Column:
    """Perturbation of a member as written in settings; ``0`` for member 0, null above 2000.

    Digits are padded to three but never cut, so ``0.1000d-13`` (member 999)
    and ``0.100d-13`` (member 1999) stay distinct texts of the same number.
    """
    text = _digits(member).cast("string")
    padded = F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)
    sign = F.when(member % 2 == 0, "-").otherwise("")
    return F.when(member == 0, "0").otherwise(F.concat(sign, F.lit("0."), padded, F.lit(f"d-{EXPONENT}")))


def pertlim_number(text: Column) -> Column:
    """Number written as text with a ``d`` exponent."""
    return F.replace(text, F.lit("d"), F.lit("e")).cast("double")


def pertlim_value(member: Column) -> Column:
    """The same perturbation as a double, without going through text.

    One division of two exactly representable numbers, hence the very double
    that reading the text gives.
    """
    digits = _digits(member)
    places = F.when(digits >= 1000, F.lit(10.0 ** (EXPONENT + 4))).otherwise(F.lit(10.0 ** (EXPONENT + 3)))
    size = digits / places
    return F.when(member == 0, F.lit(0.0)).when(member % 2 == 0, -size).otherwise(size)


def with_perturbation(df: DataFrame, member: str = "member") -> DataFrame:
    return df.withColumn("pertlim", pertlim_text(F.col(member))).withColumn("pertlim_num", pertlim_value(F.col(member)))


def perturbation_table(spark: SparkSession, n: int) -> DataFrame:
    if not 0 <= n <= MAX_MEMBERS:
        raise ValueError(f"perturbations exist for members 0..{MAX_MEMBERS}")
    return with_perturbation(spark.range(n + 1).select(F.col("id").cast("int").alias("member")))


def members(spark: SparkSession, case: str, size: int, start: int = 0, mode: str = "ensemble") -> DataFrame:
    """Member rows ``start..size-1`` with case name and perturbation.

    Member 0 is unperturbed. A negative start counts as 0; ``verify`` ignores it.
    """
    if mode not in ("ensemble", "verify"):
        raise ValueError(f"unknown mode {mode!r}")
    if size > MAX_MEMBERS:
        raise ValueError(f"an ensemble has at most {MAX_MEMBERS} members")
    if not case.endswith(".0000"):
        raise ValueError("the base case name must end in .0000")
    start = 0 if mode == "verify" else max(start, 0)
    if start >= size:
        raise ValueError("start must be smaller than the ensemble size")
    rows = spark.range(start, size).select(F.col("id").cast("int").alias("member"))
    return with_perturbation(rows.withColumn("case", member_key(F.lit(case), F.col("member"))))


def draw(df: DataFrame, k: int, seed: int, id_col: str = "member") -> DataFrame:
    """k distinct rows in a reproducible random order (a top-k, not a sort)."""
    ticket = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    return df.orderBy(ticket, F.col(id_col)).limit(k)


def fanout(base: DataFrame, size: int, col: str, cell: str, start: int = 0) -> DataFrame:
    """One perturbed copy of ``base`` per member ``start..size-1``.

    A copy is made by exploding a literal list of members and perturbations, so
    it needs neither a join nor a shuffle, nor any arithmetic on member numbers
    per row; the copies stay with the partition of their source row.
    The perturbation is relative: a cell's hash, turned by the member number
    around [-1, 1), so that the digest is taken once per source row.
    """
    if not 0 <= start < size <= MAX_MEMBERS:
        raise ValueError("need 0 <= start < size <= 2000")
    hashed = base.withColumn("_hash", hash32(F.col(cell).cast("string")))
    spark = base.sparkSession
    wanted = with_perturbation(spark.range(start, size).select(F.col("id").cast("int").alias("member"))).collect()
    listed = F.array(
        *(F.struct(F.lit(m.member).alias("member"), F.lit(m.pertlim).alias("pertlim"), F.lit(m.pertlim_num).alias("pertlim_num")) for m in wanted)
    )
    copies = hashed.select("*", F.inline(listed))
    turned = F.pmod(F.col("_hash") + F.col("member").cast("bigint") * TURN, F.lit(2**32))
    u = turned / F.lit(float(2**32)) * 2.0 - 1.0
    perturbed = F.when(F.col("member") == 0, F.col(col)).otherwise(F.col(col) * (F.col("pertlim_num") * u + 1.0))
    return copies.withColumn(col, perturbed).drop("_hash")


def replace_setting(lines: DataFrame, key: str, value: Column | str, col: str = "line", scope: str = "scope") -> DataFrame:
    """Drop every line containing ``key`` (anywhere in it), then append one new assignment per scope."""
    text = value if isinstance(value, Column) else F.lit(value)
    kept = lines.filter(~F.col(col).contains(key)).select(scope, "seq", col)
    added = (
        lines.groupBy(scope)
        .agg((F.max("seq") + 1).alias("seq"))
        .select(scope, "seq", F.concat(F.lit(f"{key} = "), text).alias(col))
    )
    return kept.unionByName(added)


def complete(members_df: DataFrame, status: DataFrame, key: str = "member") -> tuple[DataFrame, DataFrame]:
    """(members whose run succeeded, missing members)."""
    ok = status.filter(F.col("success")).select(key).distinct()
    return members_df.join(ok, key, "left_semi"), members_df.join(ok, key, "left_anti").select(key)
