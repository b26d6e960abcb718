"""Dates, cut-offs and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = ("daily", "weekly", "monthly", "all")


def cutoff(time_range: str, today: Column) -> Column:
    """First date of the range: today, its ISO Monday, its month's first; null for 'all'."""
    if time_range not in RANGES:
        raise ValueError(f"unknown time range {time_range!r}")
    unit = {"weekly": "week", "monthly": "month"}.get(time_range)
    if time_range == "all":
        return F.lit(None).cast("date")
    return F.date_trunc(unit, today).cast("date") if unit else today.cast("date")


def within(date: Column, time_range: str, today: Column) -> Column:
    return F.coalesce(date >= cutoff(time_range, today), F.lit(time_range == "all"))


def local_midnight_ms(date: Column) -> Column:
    """Earliest instant of a date in the session's time zone."""
    return F.unix_millis(date.cast("timestamp"))


def ms_to_date(ms: Column) -> Column:
    """Date in the session's time zone; null if no date can hold it."""
    sane = (ms > -62135596800000) & (ms < 253402300800000)
    return F.when(sane, F.to_date(F.timestamp_millis(ms)))


def iso_ms(text: Column) -> Column:
    """Milliseconds of an RFC 3339 instant; 0 if it is malformed or has no offset."""
    offset = text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    return F.coalesce(F.when(offset, F.unix_millis(F.try_to_timestamp(text))), F.lit(0)).cast("long")
