"""Date and time functions; sessions are in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def add_days(day: Column | str, days: Column | int) -> Column:
    """A date or date string, some days later; null for strings that are no date."""
    return F.date_add(_col(day).try_cast("date"), days)


def extract_unix_timestamp(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp with or without a zone, rounded down."""
    return F.unix_seconds(_col(ts).cast("timestamp"))


def floor_to(ts: Column | str, seconds: int) -> Column:
    """The timestamp, rounded down to a multiple of so many seconds (60, 300, 600, 3600, ...)."""
    if seconds <= 0:
        raise ValueError("seconds must be positive")
    whole = F.unix_seconds(_col(ts).cast("timestamp"))
    return F.timestamp_seconds(whole - F.pmod(whole, F.lit(seconds)))


def days_since_epoch(ts: Column | str) -> Column:
    return F.datediff(_col(ts).cast("date"), F.lit("1970-01-01").cast("date"))


def second_of_day(ts: Column | str) -> Column:
    c = _col(ts)
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def day_of_week(ts: Column | str) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(_col(ts))
