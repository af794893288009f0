"""Calendar scalars: a 365-day calendar beside Spark's Gregorian one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days before the first of each month in a 365-day year.
DAYS_BEFORE_MONTH = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]

CALENDARS = ("gregorian", "noleap")


def check_calendar(calendar: str) -> None:
    if calendar not in CALENDARS:
        raise ValueError(f"calendar must be one of {CALENDARS}, not {calendar!r}")


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def noleap_daynum(date: Column) -> Column:
    """Day number in the 365-day calendar; null on 29 February, which it lacks."""
    year, month, doy = F.year(date), F.month(date), F.dayofyear(date)
    shift = F.when(is_leap(year) & (month > 2), 1).otherwise(0)
    number = (year * 365 + doy - shift).cast("bigint")
    return F.when((month == 2) & (F.dayofmonth(date) == 29), F.lit(None).cast("bigint")).otherwise(number)


def noleap_hour(ts: Column) -> Column:
    """Hours since the start of year 0 in the 365-day calendar; year y starts at 8760*y."""
    return (noleap_daynum(ts) - 1) * 24 + F.hour(ts)


def noleap_date(daynum: Column) -> Column:
    """Inverse of :func:`noleap_daynum`."""
    year = F.floor((daynum - 1) / 365).cast("int")
    doy = (F.pmod(daynum - 1, F.lit(365)) + 1).cast("int")
    month, before = F.lit(1), F.lit(0)
    for number, days in enumerate(DAYS_BEFORE_MONTH[1:], start=2):
        month = F.when(doy > days, F.lit(number)).otherwise(month)
        before = F.when(doy > days, F.lit(days)).otherwise(before)
    return F.make_date(year, month, doy - before)


def noleap_timestamp(hours: Column) -> Column:
    """TIMESTAMP_NTZ for an hour number of :func:`noleap_hour`."""
    day = noleap_date(F.floor(hours / 24) + 1)
    clock = F.make_interval(hours=F.pmod(hours, F.lit(24)).cast("int"))
    return day.cast("timestamp_ntz") + clock


def noleap_add_days(date: Column, days: Column) -> Column:
    return noleap_date(noleap_daynum(date) + days)


def daynum(date: Column, calendar: str) -> Column:
    """Day number in the chosen calendar (Gregorian: days since 1970-01-01)."""
    check_calendar(calendar)
    if calendar == "noleap":
        return noleap_daynum(date)
    return F.unix_date(date.cast("date")).cast("bigint")


def add_days(date: Column, days: Column, calendar: str) -> Column:
    check_calendar(calendar)
    if calendar == "noleap":
        return noleap_add_days(date, days)
    return F.date_add(date.cast("date"), days.cast("int"))


def add_months(date: Column, months: int, calendar: str) -> Column:
    """Same day-of-month later on, clamped to the month's end in the calendar."""
    check_calendar(calendar)
    moved = F.add_months(date.cast("date"), months)
    if calendar == "noleap":
        leap_day = (F.month(moved) == 2) & (F.dayofmonth(moved) == 29)
        return F.when(leap_day, F.date_sub(moved, 1)).otherwise(moved)
    return moved
