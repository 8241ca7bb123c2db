"""Calendar expressions. Every function takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def sunday_week(day: Column) -> Column:
    """First day of the week that starts on Sunday."""
    return F.date_sub(F.next_day(day, "SU"), 7)


def year_start(day: Column) -> Column:
    return F.trunc(day, "year")


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def falls_on(day: Column, weekday: str) -> Column:
    """Weekday test on the day number, which needs no formatting per row."""
    return F.dayofweek(day) == WEEKDAYS.index(weekday) + 1


def month_first_date(text: Column) -> Column:
    """Dates written month first, such as 9-05-2020."""
    return F.to_date(text, "M-dd-yyyy")
