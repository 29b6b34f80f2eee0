"""Date and time functions. Timestamps have no zone and mean UTC; "now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def day(ts: Column) -> Column:
    return ts.cast("date")


def elapsed_seconds(start_ms: Column, end_ms: Column) -> Column:
    """Whole seconds, halves up, never negative."""
    return F.greatest(F.lit(0).cast("long"), F.floor((end_ms - start_ms + 500) / 1000).cast("long"))


def split_by_day(start_s: Column, seconds: Column) -> Column:
    """A span of seconds cut at UTC midnights: array of (day, seconds), none empty."""
    end = start_s + seconds
    first, last = F.floor(start_s / 86400), F.floor((end - 1) / 86400)
    slices = F.transform(F.sequence(first, last), lambda d: F.struct(F.date_from_unix_date(d.cast("int")).alias("day"), (F.least(end, (d + 1) * 86400) - F.greatest(start_s, d * 86400)).cast("long").alias("seconds")))
    return F.when(seconds > 0, slices).otherwise(F.array().cast("array<struct<day:date,seconds:bigint>>"))


def last_days(today: str, n: int = 7) -> Column:
    """The n days that end with `today`, oldest first."""
    end = F.to_date(F.lit(today))
    return F.sequence(F.date_sub(end, n - 1), end)
