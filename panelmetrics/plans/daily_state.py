"""Brand-days kept as a table of their own, rewritten only for days that changed.

A brand-day depends on the items, members and merchants of its day alone, so weekly reports can be built from kept
days. The state has one partition per date with the raw sums (the panel size is attached when a report
is built, as it may change by itself). A refresh reads the items of the days it is given and rewrites just
their partitions; a day that lost its last row is rewritten, too. Fingerprints, load and refreshes each read the
items: where these are not stored but come from joins, keep them for the time (`session.kept`).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup, timeframe
from ..session import settle
from ..sources import PanelTables
from .reports import HORIZON_DAYS, WeeklySeries, brand_sums, calendar_for, cohort_calendar, growth_of_days


def refresh_days(
    tables: PanelTables,
    series: Sequence[WeeklySeries],
    sectors: Sequence[str],
    since: dt.date,
    folder: str,
    days: Sequence[dt.date] | None = None,
    calendar: DataFrame | None = None,
) -> None:
    """Compute the brand-days of `days` (of all dates where it is None) and put them in place of what is kept for them.

    Give the same series, sectors and `since` to every refresh of a folder.
    """
    calendar = cohort_calendar(tables, series, since, calendar)
    spark = tables.items.sparkSession
    if days is None:
        brand_sums(tables, series, sectors, since, calendar, _every_day).write.mode("overwrite").partitionBy(
            "orderdate"
        ).parquet(folder)
        return
    if not days:
        return

    def given(day: str) -> Column:
        return F.col(day).isin(*days)

    sums = brand_sums(tables, series, sectors, since, calendar, given)
    # A row without a brand for every day: its partition is rewritten even if no brand has rows any more.
    marks = spark.createDataFrame([(day,) for day in days], "orderdate date")
    rows = sums.unionByName(marks, allowMissingColumns=True)
    writer = rows.repartition("orderdate").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("orderdate").parquet(folder)


def _every_day(day: str) -> Column:
    return F.col(day).isNotNull()


def kept_days(spark: SparkSession, folder: str) -> DataFrame:
    """Kept brand-days: brand, orderdate, ordercount, item_count, pq."""
    days = spark.read.parquet(folder).withColumn("orderdate", F.col("orderdate").cast("date"))
    return days.filter(F.col("brand").isNotNull())


def growth_of_state(
    folder: str,
    tables: PanelTables,
    series: Sequence[WeeklySeries],
    since: dt.date,
    today: dt.date,
    latest: dt.date,
    calendar: DataFrame | None = None,
    horizon_days: int | None = HORIZON_DAYS,
) -> DataFrame:
    """`weekly_growth` from kept days: of the tables, it reads the panel sizes (and the calendar, for daily series)."""
    calendar = calendar_for(tables, series, since, calendar)
    days = kept_days(tables.panel.sparkSession, folder).filter(timeframe.settled_by(latest))
    daily = settle(rollup.per_panel_days(days, tables.panel))
    return growth_of_days(daily, series, since, today, calendar, horizon_days, latest)


def day_prints(rows: DataFrame, day: str) -> DataFrame:
    """(day, n, print): number of rows of each date and a fingerprint of them that does not depend on their order."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in rows.columns])
    return rows.groupBy(F.col(day).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("print")
    )


def changed_days(before: DataFrame, after: DataFrame) -> list[dt.date]:
    """Dates whose fingerprints differ or stand on one side only: as many values as dates that changed."""
    left, right = (prints.select("day", F.struct("n", "print").alias(side)) for prints, side in ((before, "a"), (after, "b")))
    both = left.join(right, "day", "full").filter(~F.col("a").eqNullSafe(F.col("b")) & F.col("day").isNotNull())
    return [row.day for row in both.select("day").orderBy("day").collect()]
