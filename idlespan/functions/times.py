"""Timestamps without zone, and lengths of charge periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARGE_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def parse_timestamp(column: Column, dtype: str, pattern: str | None = None) -> Column:
    """To ``timestamp_ntz``; text that does not parse becomes null."""
    if dtype == "string":
        parsed = (F.try_to_timestamp(column, F.lit(pattern)) if pattern
                  else F.try_to_timestamp(column))
        return parsed.cast("timestamp_ntz")
    return column.cast("timestamp_ntz")


def period_hours(start: Column, end: Column) -> Column:
    """Whole hours of a period, truncated, never below one."""
    hours = F.timestamp_diff("SECOND", start, end) / F.lit(3600.0)
    return F.greatest(hours, F.lit(1.0)).cast("bigint")


def plus_hours(start: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours, start)


def whole_days(start: Column, end: Column) -> Column:
    """Days between two times, rounded down (also for negative spans)."""
    return F.floor(F.timestamp_diff("SECOND", start, end) / F.lit(86400.0)).cast("bigint")
