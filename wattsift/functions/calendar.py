"""Clock and calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_of_day(hour: Column) -> Column:
    return (
        F.when(hour.between(6, 11), "morning")
        .when(hour.between(12, 17), "afternoon")
        .when(hour.between(18, 21), "evening")
        .otherwise("night")
    )


def is_peak_hour(hour: Column) -> Column:
    return hour.between(7, 9) | hour.between(18, 21)


def is_night_hour(hour: Column) -> Column:
    return (hour >= 22) | (hour < 6)


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return day_of_week(ts) >= 5


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def iso_time(ts: Column) -> Column:
    """ISO text; the fraction appears, with six digits, only where there is one."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
