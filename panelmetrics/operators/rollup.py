"""Item rows to orders, orders to days, and normalisation by panel size.

Item rows are combined by order before any shuffle on mailbox, so a mailbox, date or
merchant that holds much of the fact arrives already reduced. The panel size is a
function of the date and is attached after the roll-up, to a frame of a row per date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import NORMALISED_FLOOR, or_else, per_panel, ratio
from .geo import with_region
from .scope import keep_members

ORDER_KEYS = ("mailboxid", "orderdate", "orderid")


def revenue() -> Column:
    return F.sum(F.col("itemprice") * F.col("itemquantity"))


def order_rollup(items: DataFrame, keys: Sequence[str] = ("brand", *ORDER_KEYS)) -> DataFrame:
    """Quantity and revenue per order."""
    return items.groupBy(*keys).agg(F.sum("itemquantity").alias("item_count"), revenue().alias("pq"))


def order_total_estimate(stated: Column, listed: Column) -> Column:
    """Mean stated order total where it is at least the sum of item prices, else that sum.

    A missing side makes the test unknown, which falls to the sum.
    """
    return F.when(stated >= listed, stated).otherwise(listed)


def geo_order_rollup(items: DataFrame, members: DataFrame, regions: DataFrame) -> DataFrame:
    """Orders of active members with zip, region and state, and the stated order totals.

    Sums count an item once per cohort row and geography row behind it.
    """
    orders = items.groupBy(*ORDER_KEYS).agg(
        F.max("ordertotal").alias("ordertotal"),
        ratio(F.sum("ordertotal"), F.count("ordertotal")).alias("stated"),
        F.sum("itemprice").alias("listed"),
        F.sum("itemquantity").alias("item_count"),
        revenue().alias("pq"),
    )
    placed = with_region(keep_members(orders, members), regions)
    times = F.col("copies") * F.col("geo_copies")
    return placed.select(
        *ORDER_KEYS,
        "zip",
        "msa",
        "state_abbrev",
        "ordertotal",
        (F.col("item_count") * times).alias("item_count"),
        (F.col("pq") * times).alias("pq"),
        order_total_estimate(F.col("stated"), (F.col("listed") * times).cast("double")).alias(
            "ordertotal_estimate"
        ),
    )


def zip_totals(items: DataFrame, members: DataFrame, panel: DataFrame, by: Sequence[str] = ("brand",)) -> DataFrame:
    """Revenue and largest panel size per zip of active members.

    Rows are combined to mailbox-days first, so both sides of the member join hold one
    row per mailbox and date (and group), whatever the skew of the items.
    """
    mailbox_days = items.groupBy(*by, "mailboxid", "orderdate").agg(revenue().alias("pq"))
    zip_days = (
        keep_members(mailbox_days, members)
        .groupBy(*by, "orderdate", "zip")
        .agg(F.sum(F.col("pq") * F.col("copies")).alias("pq"))
    )
    return zip_days_total(zip_days, panel, by)


def zip_days_total(zip_days: DataFrame, panel: DataFrame, by: Sequence[str] = ("brand",)) -> DataFrame:
    """Revenue and largest panel size per zip from revenue per zip and date."""
    return (
        with_panel(zip_days, panel)
        .groupBy(*by, "zip")
        .agg(F.sum("pq").alias("pq"), F.max("panel").alias("panel"))
    )


def region_totals(by_zip: DataFrame, regions: DataFrame) -> DataFrame:
    """Zip totals with their region, counted once per geography row."""
    return with_region(by_zip, regions).withColumn("pq", F.col("pq") * F.col("geo_copies"))


def panel_by_date(panel: DataFrame) -> DataFrame:
    """Largest panel size a date, so that joining it does not multiply rows."""
    return panel.groupBy("date").agg(F.max("panel").alias("panel"))


def with_panel(rows: DataFrame, panel: DataFrame) -> DataFrame:
    """Rows on dates with a known panel size, with that size.

    The panel side has one row per calendar date, which bounds what is broadcast.
    """
    sizes = panel_by_date(panel).withColumnRenamed("date", "orderdate")
    return rows.join(F.broadcast(sizes), "orderdate")


def daily_sums(orders: DataFrame, by: Sequence[str] = ("brand",)) -> DataFrame:
    """Distinct orders, items and revenue per date.

    Orders carry `copies`, the cohort rows behind each; sums count them, distinct orders do not.
    """
    return orders.groupBy(*by, "orderdate").agg(
        F.countDistinct("orderid").alias("ordercount"),
        F.sum(F.col("item_count") * F.col("copies")).alias("item_count"),
        F.sum(F.col("pq") * F.col("copies")).alias("pq"),
    )


def per_panel_days(daily: DataFrame, panel: DataFrame, by: Sequence[str] = ("brand",)) -> DataFrame:
    """Daily sums, raw and per thousand panel members."""
    return with_panel(daily, panel).select(
        *by,
        "orderdate",
        "panel",
        *[F.col(c).cast("double").alias(c) for c in ("ordercount", "item_count", "pq")],
        per_panel(F.col("ordercount"), F.col("panel"), 1000).alias("pnl_ordercount"),
        per_panel(F.col("item_count"), F.col("panel"), 1000).alias("pnl_itemcount"),
        per_panel(F.col("pq"), F.col("panel"), 1000).alias("pnlpq"),
    )


def daily_rollup(orders: DataFrame, panel: DataFrame, by: Sequence[str] = ("brand",)) -> DataFrame:
    """Distinct orders, items and revenue per date, raw and per thousand panel members."""
    return per_panel_days(daily_sums(orders, by), panel, by)


def window_rate(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Revenue per ten thousand panel members over a window, per group.

    Each group is divided by the largest panel it saw itself, so groups do not add up to
    the rate of their union. Grouping by a constant column gives no row on empty input.
    """
    return totals.groupBy(*by).agg(
        or_else(per_panel(F.sum("pq"), F.max("panel"), 10000), NORMALISED_FLOOR).alias("rate")
    )
