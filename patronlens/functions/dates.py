"""Date arithmetic on zone-less timestamps; nothing here depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def midnight(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz")


def whole_days_between(start: Column, end: Column) -> Column:
    """Elapsed 24-hour days, not calendar days: 18:00 to the next midnight is 0."""
    return F.date_part(F.lit("DAY"), end - start).cast("int")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as a decimal with microseconds, whatever the session's time zone."""
    passed = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    days, hours, minutes, seconds = (F.date_part(F.lit(part), passed) for part in ("DAY", "HOUR", "MINUTE", "SECOND"))
    return (days.cast("long") * 86_400 + hours * 3_600 + minutes * 60 + seconds).cast("decimal(20,6)")


def month_label(ts: Column) -> Column:
    return F.date_format(ts.cast("date"), "yyyy-MM")


def week_start(ts: Column) -> Column:
    """Monday of the week, as a date."""
    day = ts.cast("date")
    return F.date_sub(day, F.weekday(day))
