"""Dates a report runs over: the fact's calendar, cut-offs, windows and horizons.

"Today" is always a parameter. The latest date of the fact is a one-row subquery over the
calendar unless the caller already knows it, so the conditions reach the scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Day = Column | dt.date

# Days the panel needs to fill up, and the far edge of the trailing window.
SETTLING_DAYS = 3
WINDOW_FIRST_DAY = 33
# Fixed value: 52 weeks, so that weekdays line up.
YEAR_SHIFT = 364


def as_column(day: Day) -> Column:
    return day if isinstance(day, Column) else F.lit(day)


def calendar_of(items: DataFrame) -> DataFrame:
    """Distinct order dates of the whole fact: a one-column pass, a few thousand rows."""
    return items.select("orderdate").filter(F.col("orderdate").isNotNull()).distinct()


def latest_day(calendar: DataFrame) -> Column:
    """Largest order date, as a subquery that yields one value."""
    return calendar.agg(F.max("orderdate")).scalar()


def settled_by(latest: Day, days: int = SETTLING_DAYS, day: str = "orderdate") -> Column:
    """Dates old enough to be complete."""
    return F.col(day) <= F.date_sub(as_column(latest), days)


def in_trailing_window(
    latest: Day,
    first: int = WINDOW_FIRST_DAY,
    last: int = SETTLING_DAYS,
    shift: int = 0,
    day: str = "orderdate",
) -> Column:
    """Dates from latest-first to latest-last inclusive, moved back by `shift` days."""
    latest = as_column(latest)
    return F.col(day).between(F.date_sub(latest, first + shift), F.date_sub(latest, last + shift))


def same_year_as(today: dt.date, day: str = "orderdate") -> Column:
    """Dates in the calendar year of `today`, as a range the scan can use."""
    return F.col(day).between(F.lit(dt.date(today.year, 1, 1)), F.lit(dt.date(today.year, 12, 31)))


def in_quarters(daily: DataFrame, quarters: DataFrame) -> DataFrame:
    """Daily rows with the quarter they fall in (`quarterstart`, `quarterend`).

    The quarters are unrolled to dates, which turns the range test into an equality join.
    """
    days = quarters.withColumn("orderdate", F.explode(F.sequence("quarterstart", "quarterend")))
    return daily.join(days, "orderdate")
