"""Membership over time: member days as intervals of consecutive days.

Mailboxes stay members for long, so their days shrink to few intervals. Intervals are kept instead of days, and a join
with items unrolls them to months: a row per mailbox and month instead of one per mailbox and day is moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def member_intervals(members: DataFrame) -> DataFrame:
    """(mailboxid, zip, copies, first_day, last_day) from member days (one per mailbox and date).

    Consecutive days of one mailbox with the same zip and number of copies are an interval.
    """
    stays = ["mailboxid", "zip", "copies"]
    order = Window.partitionBy(*stays).orderBy("orderdate")
    island = F.date_sub("orderdate", F.row_number().over(order))
    return (
        members.filter(F.col("orderdate").isNotNull())
        .withColumn("island", island)
        .groupBy(*stays, "island")
        .agg(F.min("orderdate").alias("first_day"), F.max("orderdate").alias("last_day"))
        .drop("island")
    )


def interval_months(intervals: DataFrame) -> DataFrame:
    """A row per interval and month that it touches."""
    months = F.sequence(F.trunc("first_day", "month"), F.trunc("last_day", "month"), F.expr("interval 1 month"))
    return intervals.withColumn("member_month", F.explode(months))


def keep_in_intervals(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows on days inside an interval of their mailbox, with `copies` and `zip`: what `scope.keep_members` gives.

    The join is by mailbox and month, so adaptive execution can split a mailbox with much of the fact.
    """
    dated = rows.withColumn("member_month", F.trunc("orderdate", "month"))
    joined = dated.join(interval_months(intervals), ["mailboxid", "member_month"])
    inside = F.col("orderdate").between(F.col("first_day"), F.col("last_day"))
    return joined.filter(inside).drop("member_month", "first_day", "last_day")
