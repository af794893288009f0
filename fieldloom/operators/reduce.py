"""History reductions: tape specs, output windows, one-pass reduction, mergeable states."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import calendar as cal
from fieldloom.functions.exact import clock, exact_avg, fixed_sum, from_fixed, micros, time_order

# Reduction flags (average, instant, maximum, minimum).
FLAGS = "AIXM"


# ---------------------------------------------------------------- tape specs


def tape_spec(df: DataFrame, col: str, default: str = "A") -> DataFrame:
    """Quoted ``'FIELD:FLAG'`` lists -> one row per item.

    A doubled quote inside an item is an escaped quote, so a missing comma
    yields one malformed item. ``reject`` is null for usable items.
    """
    items = F.regexp_extract_all(F.col(col), F.lit(r"'((?:[^']|'')*+)'"), F.lit(1))
    rest = [c for c in df.columns if c != col]
    rows = df.select(*rest, F.posexplode(items).alias("pos", "_item"))
    item = F.trim(F.replace(F.col("_item"), F.lit("''"), F.lit("'")))
    good = item.rlike(f"^[A-Za-z0-9_]+(:[{FLAGS}])?$")
    flag = F.coalesce(F.nullif(F.split_part(item, F.lit(":"), F.lit(2)), F.lit("")), F.lit(default))
    return rows.select(
        *rest,
        "pos",
        item.alias("item"),
        F.when(good, F.split_part(item, F.lit(":"), F.lit(1))).alias("field"),
        F.when(good, flag).alias("flag"),
        F.when(~good, F.lit("malformed")).alias("reject"),
    )


def _check_spec(spec: dict[str, str]) -> dict[str, str]:
    for field, flag in spec.items():
        if flag not in FLAGS or len(flag) != 1:
            raise ValueError(f"unknown reduction flag {flag!r} for field {field!r}")
    return spec


def select_fields(history: DataFrame, spec: dict[str, str] | Sequence[str] | DataFrame) -> DataFrame:
    """Keep only listed fields.

    A spec given in Python becomes an IN filter, which prunes ``field=``
    partitions and reaches the Parquet scan; a spec table becomes a semi join.
    """
    if isinstance(spec, DataFrame):
        return history.join(spec.select("field").distinct(), "field", "left_semi")
    return history.filter(F.col("field").isin(list(spec)))


def expand_streams(df: DataFrame, code: str, freqs: Sequence[str], ns: Sequence[int], off: str = "x") -> DataFrame:
    """Per-field stream code -> one row per active output stream.

    Character i of the code belongs to stream i. A character that is ``off`` or
    differs from the stream's own frequency leaves the field out of that stream.
    """
    if len(freqs) != len(ns):
        raise ValueError("freqs and ns must have the same length")
    rest = [c for c in df.columns if c != code]
    streams = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(n).alias("n")) for f, n in zip(freqs, ns)])
    rows = df.select(*rest, F.posexplode(F.split(F.col(code), "")).alias("_pos", "_char"))
    rows = rows.withColumn("_stream", F.try_element_at(streams, F.col("_pos") + 1))
    return rows.filter((F.col("_char") != off) & (F.col("_char") == F.col("_stream.f"))).select(
        *rest,
        F.col("_pos").alias("stream"),
        F.col("_stream.f").alias("freq"),
        F.col("_stream.n").alias("freq_n"),
    )


# ------------------------------------------------------------------- windows


@dataclass(frozen=True)
class Hours:
    """Windows of n hours."""

    n: int


@dataclass(frozen=True)
class Steps:
    """Windows of n model steps; step numbers start at 1."""

    n: int


@dataclass(frozen=True)
class Cal:
    """Windows of n calendar units: h, d, m or y."""

    unit: str
    n: int = 1


Frequency = Hours | Steps | Cal

# Stream frequency letters and their calendar unit.
UNITS = {"h": "hour", "d": "day", "m": "month", "y": "year"}


def frequency(number: int) -> Frequency:
    """Signed output frequency: negative counts hours, positive counts steps."""
    if number == 0:
        raise ValueError("frequency 0 has no fixed meaning")
    return Hours(-number) if number < 0 else Steps(number)


def window_key(freq: Frequency, calendar: str = "gregorian", ts: str = "ts", step: str = "step") -> Column:
    """Start of the output window a sample falls into.

    Hours and Cal give a TIMESTAMP_NTZ, Steps a BIGINT window number. In the
    365-day calendar the key is null for samples dated 29 February; they stay
    together in the null window instead of vanishing.
    """
    cal.check_calendar(calendar)
    time = F.col(ts)
    if freq.n < 1:
        raise ValueError("window length must be positive")
    if isinstance(freq, Steps):
        return F.floor((F.col(step) - 1) / freq.n).cast("bigint")
    if isinstance(freq, Cal):
        if freq.unit not in UNITS:
            raise ValueError(f"unknown calendar unit {freq.unit!r}")
        if freq.unit == "h" or freq.unit == "d" and freq.n > 1:
            freq = Hours(freq.n * (24 if freq.unit == "d" else 1))
        else:
            return _calendar_start(freq, calendar, time)
    if calendar == "noleap":
        hours = cal.noleap_hour(time)
        return cal.noleap_timestamp(F.floor(hours / freq.n) * freq.n)
    # a rounded number of seconds, as the window function drops rows without a time
    length = freq.n * 3600
    return clock(F.floor(micros(time) / (length * 1_000_000)) * length)


def _calendar_start(freq: Cal, calendar: str, time: Column) -> Column:
    if freq.unit == "d":
        start = time.cast("date").cast("timestamp_ntz")
    elif freq.n == 1:
        start = F.trunc(time.cast("date"), UNITS[freq.unit]).cast("timestamp_ntz")
    elif freq.unit == "y":
        start = F.make_date((F.floor(F.year(time) / freq.n) * freq.n).cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    else:
        months = F.floor((F.year(time) * 12 + F.month(time) - 1) / freq.n) * freq.n
        start = F.make_date(F.floor(months / 12).cast("int"), (months % 12 + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")
    if calendar == "noleap":
        leap_day = (F.month(time) == 2) & (F.dayofmonth(time) == 29)
        return F.when(~leap_day, start)
    return start


# Fixed values of the stop option below: nsteps, ndays, nmonths, nyears.


def _first_steps(history: DataFrame, begin: Column, n: int, ts: str, step: str, by: Sequence[str]) -> DataFrame:
    """The samples of n steps, counted for each of ``by`` from its first step at or after ``begin``."""
    rest = history.filter((F.col(ts) >= begin) & F.col(step).isNotNull())
    key = F.struct(F.lit(0).alias("_0"), *by)
    first = rest.groupBy(F.hash(F.to_json(key)).alias("_key"), *(F.col(c).alias(f"_by_{c}") for c in by)).agg(F.min(step).alias("_first"))
    met = [F.hash(F.to_json(key)) == F.col("_key"), *(F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by)]
    condition = fold(lambda a, b: a & b, met)
    return rest.join(first, condition).filter(F.col(step) < F.col("_first") + n).select(*history.columns)


def run_window(
    history: DataFrame, start: str, option: str, n: int, calendar: str = "gregorian", ts: str = "ts", step: str = "step", by: Sequence[str] | None = None
) -> DataFrame:
    """Samples of one run segment: ``[start, start + n units)``, or the first n steps from start on.

    Steps are counted from the first one at or after the start, for each member (or each of ``by``). Other bounds
    are constants after folding, so the filter reaches the scan.
    """
    begin = F.to_timestamp_ntz(F.lit(start))
    if option == "nsteps":
        return _first_steps(history, begin, n, ts, step, [c for c in ("member",) if c in history.columns] if by is None else by)
    if calendar == "noleap" and re.match(r"\d+-02-29", start):
        raise ValueError("29 February has no place in the 365-day calendar")
    first = begin.cast("date")
    if option == "ndays":
        last = cal.add_days(first, F.lit(n), calendar)
    elif option in ("nmonths", "nyears"):
        last = cal.add_months(first, n if option == "nmonths" else 12 * n, calendar)
    else:
        raise ValueError(f"unknown stop option {option!r}")
    clock = begin - first.cast("timestamp_ntz")
    return history.filter((F.col(ts) >= begin) & (F.col(ts) < last.cast("timestamp_ntz") + clock))


# ----------------------------------------------------------------- reduction


def state_columns(digits: int | None, ts: str = "ts", step: str = "step", value: str = "value") -> list[Column]:
    """Aggregates that hold everything any flag needs; unused ones are pruned."""
    v = F.col(value)
    at = time_order(F.col(ts), F.col(step))
    return [
        F.count(v).alias("n"),
        (F.sum(v) if digits is None else fixed_sum(v, digits)).alias("total"),
        F.max(v).alias("hi"),
        F.min(v).alias("lo"),
        F.max_by(v, at).alias("last"),
        F.max(at).alias("last_at"),
    ]


def partial_reduce(
    history: DataFrame,
    freq: Frequency,
    by: Sequence[str] = ("member", "cell"),
    calendar: str = "gregorian",
    digits: int | None = None,
) -> DataFrame:
    """Mergeable reduction state per (field, by, window)."""
    keyed = history.withColumn("win", window_key(freq, calendar))
    return keyed.groupBy("field", *by, "win").agg(*state_columns(digits))


def merge_partials(*states: DataFrame, by: Sequence[str] = ("member", "cell")) -> DataFrame:
    """States of several run segments -> states of the whole run."""
    return (
        fold(DataFrame.unionByName, states)
        .groupBy("field", *by, "win")
        .agg(
            F.sum("n").alias("n"),
            F.sum("total").cast(states[0].schema["total"].dataType).alias("total"),
            F.max("hi").alias("hi"),
            F.min("lo").alias("lo"),
            F.max_by("last", "last_at").alias("last"),
            F.max("last_at").alias("last_at"),
        )
    )


def _flagged(flag: Column, digits: int | None, flags: set[str]) -> Column:
    total = F.col("total") if digits is None else from_fixed(F.col("total"), digits)
    mean = total / F.nullif(F.col("n"), F.lit(0).cast("bigint"))
    by_flag = {"A": mean, "I": F.col("last"), "X": F.col("hi"), "M": F.col("lo")}
    out = F.lit(None).cast("double")
    for name in sorted(flags):
        out = F.when(flag == name, by_flag[name]).otherwise(out)
    return out


def finalize(
    state: DataFrame, spec: dict[str, str] | DataFrame, by: Sequence[str] = ("member", "cell"), digits: int | None = None
) -> DataFrame:
    """State -> tape rows: each field reduced by its own flag, once for each flag a spec table lists it under."""
    if isinstance(spec, DataFrame):
        flags = set(FLAGS)
        rows = state if "flag" in state.columns else state.join(spec.select("field", "flag").distinct(), "field")
        flag = F.col("flag")
    else:
        flags = set(_check_spec(spec).values())
        rows = state
        pairs = [F.lit(x) for pair in spec.items() for x in pair]
        flag = F.try_element_at(F.create_map(*pairs), F.col("field")) if pairs else F.lit(None).cast("string")
    return rows.select("field", *by, "win", flag.alias("flag"), _flagged(flag, digits, flags).alias("value"), "n")


def history_reduce(
    history: DataFrame,
    spec: dict[str, str] | DataFrame,
    freq: Frequency,
    by: Sequence[str] = ("member", "cell"),
    calendar: str = "gregorian",
    digits: int | None = None,
) -> DataFrame:
    """Reduce every listed field over its output windows by its own flag, in one pass.

    One aggregation with map-side combine; the flag is a property of the field,
    so it is attached after the aggregation and never travels with the samples.
    ``digits`` makes means independent of the summation order.
    """
    kept = select_fields(history, spec)
    return finalize(partial_reduce(kept, freq, by, calendar, digits), spec, by, digits)


#: Different output frequencies of one job.
MAX_FREQUENCIES = 64


def reduce_streams(
    history: DataFrame,
    spec: DataFrame,
    streams: DataFrame,
    by: Sequence[str] = ("member", "cell"),
    calendar: str = "gregorian",
    digits: int | None = None,
) -> DataFrame:
    """All tapes of several output streams from one pass over the samples.

    ``spec`` holds (field, flag), see :func:`tape_spec`; ``streams`` holds
    (field, stream, freq, freq_n), see :func:`expand_streams`. A field may have
    several flags and be in several streams; a field in only one of the two is
    on no tape. A sample is copied once for each frequency its field needs, and
    states are shared by the streams and flags of the same frequency.
    """
    pairs = sorted(tuple(r) for r in streams.select("freq", "freq_n").distinct().limit(MAX_FREQUENCIES + 1).collect())
    if len(pairs) > MAX_FREQUENCIES:
        raise ValueError(f"more than {MAX_FREQUENCIES} frequencies")
    if not pairs:
        raise ValueError("no streams")
    wanted = streams.join(spec.filter("field IS NOT NULL").select("field", "flag").distinct(), "field")
    needed = wanted.groupBy("field").agg(F.collect_set(F.struct("freq", "freq_n")).alias("_needed"))
    windows = F.array(
        *(F.struct(F.lit(u).alias("freq"), F.lit(n).alias("freq_n"), window_key(Cal(u, n), calendar).alias("win")) for u, n in pairs)
    )
    open_windows = F.filter(windows, lambda w: F.array_contains("_needed", F.struct(w["freq"].alias("freq"), w["freq_n"].alias("freq_n"))))
    kept = history.join(needed, "field").withColumn("_windows", open_windows).select("*", F.inline("_windows"))
    state = kept.groupBy("field", *by, "freq", "freq_n", "win").agg(*state_columns(digits))
    tapes = state.join(wanted.distinct(), ["field", "freq", "freq_n"])
    return tapes.select(
        "stream", "field", *by, "freq", "freq_n", "win", "flag", _flagged(F.col("flag"), digits, set(FLAGS)).alias("value"), "n"
    )


def climatology(
    history: DataFrame, by: Sequence[str] = ("cell",), digits: int | None = None, calendar: str = "gregorian"
) -> DataFrame:
    """Mean annual cycle: the mean over years of monthly means."""
    monthly = (
        history.withColumn("win", window_key(Cal("m"), calendar))
        .groupBy("field", *by, "win")
        .agg(exact_avg(F.col("value"), digits).alias("monthly"))
    )
    return monthly.groupBy("field", *by, F.month("win").alias("month")).agg(
        F.avg("monthly").alias("value"), F.count("monthly").alias("years")
    )
