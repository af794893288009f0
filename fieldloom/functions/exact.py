"""Order-independent sums, packed ordering keys and reproducible hashes.

A double sum depends on the order in which tasks finish. Reductions that must
agree bit for bit between runs (or between one long run and two merged
segments) therefore add integers: each value is scaled by ``10**digits`` and
rounded to a whole number first, so digits beyond that are lost. The whole
number is added in two halves, each a BIGINT, which stay in the hash-aggregate
fast path and have room for 10^11 rows of values up to 10^17 after scaling.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Weight of the upper half of a whole number.
HALF = 2**24


def fixed_sum(value: Column, digits: int) -> Column:
    """Aggregate: the sum of the scaled and rounded values, a DECIMAL(38,0)."""
    whole = F.rint(value * F.lit(float(10**digits)))
    upper = F.floor(whole / F.lit(float(HALF)))
    lower = (whole - upper.cast("double") * F.lit(float(HALF))).cast("bigint")
    return (F.sum(upper.cast("bigint")).cast("decimal(28,0)") * F.lit(HALF).cast("decimal(9,0)") + F.sum(lower).cast("decimal(28,0)")).cast("decimal(38,0)")


def from_fixed(total: Column, digits: int) -> Column:
    return total.cast("double") / F.lit(float(10**digits))


def exact_sum(value: Column, digits: int | None) -> Column:
    """Sum as double; order-independent when ``digits`` is given."""
    if digits is None:
        return F.sum(value)
    return from_fixed(fixed_sum(value, digits), digits)


def exact_avg(value: Column, digits: int | None) -> Column:
    if digits is None:
        return F.avg(value)
    return exact_sum(value, digits) / F.count(value)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 on the clock of a TIMESTAMP_NTZ.

    A difference of two such timestamps never consults the session time zone;
    a cast to TIMESTAMP would put 02:30 after 03:00 on the night clocks change.
    """
    since = ts.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("bigint")


def clock(seconds: Column) -> Column:
    """TIMESTAMP_NTZ that lies whole seconds after 1970."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def order_key(major: Column, minor: Column) -> Column:
    """Two BIGINTs as one DECIMAL(38,0) that sorts like the pair.

    ``max_by`` over a struct falls back to a sort aggregate; over a decimal it
    stays a hash aggregate with map-side combine.
    """
    wide = F.lit(str(2**64)).cast("decimal(20,0)")
    return major.cast("decimal(18,0)") * wide + minor.cast("decimal(20,0)")


def time_order(ts: Column, step: Column) -> Column:
    return order_key(micros(ts), step.cast("bigint"))


def hash32(text: Column) -> Column:
    """Reproducible number in [0, 2**32): the first 32 bits of an md5, as BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
