"""Dates and times that the built-in functions lack: ages, justified intervals, bins, ISO fields, time zones."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a time zone, or of a date."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def stride_micros(stride: str) -> int:
    """'15 minutes' as microseconds. Months and years have no fixed length and are refused, as is a stride that isn't positive."""
    total = 0
    for n, unit in re.findall(r"(-?\d+)\s*([a-z]+)", stride.lower()):
        unit = unit.rstrip("s") if unit != "s" else "second"
        if unit not in _UNITS:
            raise ValueError(f"date_bin: a stride in {unit}s has no fixed length")
        total += int(n) * _UNITS[unit]
    if total <= 0:
        raise ValueError("date_bin: the stride must be greater than zero")
    return total


def date_bin(stride: str, ts: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """The beginning of the bin that ts is in."""
    width, start = F.lit(stride_micros(stride)), micros(F.lit(origin).cast("timestamp_ntz"))
    gone = micros(ts) - start
    return from_micros(start + gone - F.pmod(gone, width))


def _months(later: Column, earlier: Column) -> Column:
    """Whole months from one time to a later one: the last doesn't count if its day and time aren't reached."""
    n = (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    within = lambda t: F.dayofmonth(t).cast("long") * 86_400_000_000 + F.pmod(micros(t), F.lit(86_400_000_000))
    return n - (within(later) < within(earlier)).cast("int")


def age(later: Column, earlier: Column) -> Column:
    """years, months, days and microseconds between two times, counted by the calendar; negative if later is the earlier one.

    Days that are left count in the length of the month that the earlier time is in.
    """
    later, earlier = later.cast("timestamp_ntz"), earlier.cast("timestamp_ntz")
    behind = micros(later) < micros(earlier)
    a, b = F.when(behind, earlier).otherwise(later), F.when(behind, later).otherwise(earlier)
    n = _months(a, b)
    day = lambda t: F.dayofmonth(t).cast("long")
    time = lambda t: F.pmod(micros(t), F.lit(86_400_000_000))
    borrow = (time(a) < time(b)).cast("long")
    days = day(a) - day(b) - borrow
    days = F.when(days < 0, days + F.dayofmonth(F.last_day(b.cast("date")))).otherwise(days)
    us = time(a) - time(b) + borrow * 86_400_000_000
    sign = F.when(behind, -1).otherwise(1)
    return F.struct((sign * F.floor(n / 12)).cast("int").alias("years"), (sign * (n % 12)).cast("int").alias("months"), (sign * days).cast("int").alias("days"), (sign * us).cast("long").alias("micros"))


def _carry(big: Column, small: Column, size: int) -> tuple[Column, Column]:
    """small reduced to less than size, with the sign of what comes out, and what it carries to big."""
    whole = (small / size).cast("long")
    small, big = small - whole * size, big + whole
    up, down = (big > 0) & (small < 0), (big < 0) & (small > 0)
    return F.when(up, big - 1).when(down, big + 1).otherwise(big), F.when(up, small + size).when(down, small - size).otherwise(small)


def justify_hours(days: Column, us: Column) -> Column:
    """24 hours as a day."""
    d, u = _carry(days.cast("long"), us.cast("long"), 86_400_000_000)
    return F.struct(d.alias("days"), u.alias("micros"))


def justify_days(months: Column, days: Column) -> Column:
    """30 days as a month."""
    m, d = _carry(months.cast("long"), days.cast("long"), 30)
    return F.struct(m.alias("months"), d.alias("days"))


def is_finite(x: Column) -> Column:
    """Not one of the two infinite times, which the last and first day of the calendar stand for."""
    return (x.cast("date") < F.lit("9999-12-31").cast("date")) & (x.cast("date") > F.lit("0001-01-01").cast("date"))


def iso_dow(x: Column) -> Column:
    """1 (Monday) to 7."""
    return F.weekday(x.cast("date")) + 1


def iso_year(x: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), x.cast("date")).cast("int")


def millennium(x: Column) -> Column:
    return F.floor((F.year(x) + 999) / 1000).cast("int")


def julian(x: Column) -> Column:
    """The Julian day number of a date."""
    return F.datediff(x.cast("date"), F.lit("1970-01-01").cast("date")) + 2_440_588


def make_time(hour: Column, minute: Column, second: Column) -> Column:
    """Microseconds since midnight; null if a part is out of range."""
    us = (hour * 3_600_000_000 + minute * 60_000_000).cast("long") + F.round(second * 1_000_000).cast("long")
    return F.when(hour.between(0, 24) & minute.between(0, 59) & (second >= 0) & (second <= 60) & (us <= 86_400_000_000), us)
