"""Restricting the fact to a clean panel.

Sizes decide the shape. Merchant lists and geography are read without hints: Spark
broadcasts them while they are under its threshold and otherwise shuffles, where adaptive
execution splits a merchant that holds much of the fact. Mailbox tables always count as
large: they are reduced to one row per (mailbox, date) first, so a mailbox with very many
rows has at most one row per calendar date on that side of the join, and the fact is
never shuffled by mailbox alone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import year_start
from ..session import settle


def drop_merchants(items: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Rows of the listed merchants, and of unknown ones, go."""
    return items.filter(~F.col("merchant").isin(*excluded))


def in_quality_merchants(items: DataFrame, quality_merchants: DataFrame) -> DataFrame:
    return items.join(quality_merchants, "merchant", "left_semi")


def in_sectors(items: DataFrame, merchant_sector: DataFrame, sectors: Sequence[str]) -> DataFrame:
    """Rows whose merchant is in at least one of the sectors."""
    return items.join(merchant_sector.filter(F.col("sector").isin(*sectors)), "merchant", "left_semi")


def eligible_merchants(
    merchant_sector: DataFrame, sectors: Sequence[str], quality_merchants: DataFrame | None = None
) -> DataFrame:
    """Distinct merchants that pass every merchant test."""
    merchants = merchant_sector.filter(F.col("sector").isin(*sectors)).select("merchant")
    if quality_merchants is not None:
        merchants = merchants.join(quality_merchants, "merchant", "left_semi")
    return merchants.distinct()


def in_merchants(items: DataFrame, merchants: DataFrame) -> DataFrame:
    """Rows of the listed merchants, by one join against one settled list.

    Spark chooses the join by the size of the list. As the list is read back as it stands,
    nothing but this join depends on a shuffle by merchant, and adaptive execution can split
    a merchant with very many rows. (Two lists joined in a row, or a list still to be
    built, would tie the shuffle down.)
    """
    return items.join(settle(merchants), "merchant", "left_semi")


def merchants_with_quality(merchant_sector: DataFrame, sectors: Sequence[str], quality_merchants: DataFrame) -> DataFrame:
    """Distinct merchants of the sectors, and whether each also passes the quality test (`is_quality`)."""
    merchants = merchant_sector.filter(F.col("sector").isin(*sectors)).select("merchant").distinct()
    tested = quality_merchants.select("merchant").distinct().withColumn("is_quality", F.lit(True))
    return merchants.join(tested, "merchant", "left").withColumn("is_quality", F.coalesce("is_quality", F.lit(False)))


def in_distribution_types(items: DataFrame, merchant_sector: DataFrame, types: Sequence[str]) -> DataFrame:
    return items.join(merchant_sector.filter(F.col("distribtype").isin(*types)), "merchant", "left_semi")


def single_address_mailboxes(mailbox_zip: DataFrame) -> DataFrame:
    """Mailboxes with exactly one address row, and that row's zip.

    One grouping instead of a count joined back: in a group of one, any value is the value.
    """
    return (
        mailbox_zip.filter(F.col("mailboxid").isNotNull())
        .groupBy("mailboxid")
        .agg(F.count(F.lit(1)).alias("addresses"), F.first("shiptozip").alias("shiptozip"))
        .filter("addresses = 1")
        .drop("addresses")
    )


def with_mailbox_zip(rows: DataFrame, mailbox_zip: DataFrame) -> DataFrame:
    return rows.join(mailbox_zip, "mailboxid")


def cohort_in_fact_years(cohort: DataFrame, calendar: DataFrame, since: dt.date) -> DataFrame:
    """Cohort rows dated in a year in which the fact has orders on or after `since`."""
    years = (
        calendar.filter(F.col("orderdate") >= F.lit(since))
        .select(year_start(F.col("orderdate")).alias("year"))
        .distinct()
    )
    # One row per calendar year.
    return cohort.join(F.broadcast(years), year_start(F.col("udate")) == F.col("year"), "left_semi")


def cohort_days(cohort: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """One row per (mailbox, date) with the number of cohort rows it stands for, and columns fixed by the mailbox.

    Joining a fact to several cohort rows multiplies its sums by that number; the number
    is carried as `copies` instead of the rows.
    """
    return cohort.groupBy("mailboxid", "udate", *more).agg(F.count(F.lit(1)).cast("int").alias("copies"))


def active_members(cohort: DataFrame, mailbox_zip: DataFrame, zip_of: Column | None = None) -> DataFrame:
    """Cohort days of the single-address mailboxes, with copies and zip.

    Zips come first: where the cohort is moved by mailbox for them, its days are counted without another
    move. A mailbox has few cohort rows, so this key is never hot; rows of the fact are not moved by it.
    """
    zip_of = F.col("shiptozip") if zip_of is None else zip_of
    placed = cohort.join(single_address_mailboxes(mailbox_zip), "mailboxid").withColumn("zip", zip_of)
    return cohort_days(placed, ["zip"]).withColumnRenamed("udate", "orderdate")


def members_of_all_reports(cohort: DataFrame, mailbox_zip: DataFrame, zip_of: Column) -> DataFrame:
    """Cohort days of the single-address mailboxes as `active_members`, with the rows of cohort 'all' among the copies."""
    placed = cohort.join(single_address_mailboxes(mailbox_zip), "mailboxid").withColumn("zip", zip_of)
    return (
        placed.groupBy("mailboxid", F.col("udate").alias("orderdate"), "zip")
        .agg(
            F.count(F.lit(1)).cast("int").alias("copies"),
            F.count(F.when(F.col("cohort") == "all", 1)).cast("int").alias("copies_all"),
        )
    )


def fact_years(calendar: DataFrame, since: dt.date) -> list[dt.date]:
    """First days of the years in which the fact has orders on or after `since`: as many values as years."""
    days = calendar.filter(F.col("orderdate") >= F.lit(since))
    return [row.year for row in days.select(year_start(F.col("orderdate")).alias("year")).distinct().orderBy("year").collect()]


def keep_members(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of active members on the days they are active, with `copies` and `zip` added."""
    return rows.join(members, ["mailboxid", "orderdate"])
