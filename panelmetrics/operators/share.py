"""Weekly market share from item descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import any_like, ordered_sum, ratio, sunday_week
from .rules import BrandRule

ITEM_KEYS = ("odate", "brand", "merchant", "itemdescription")


def weekly_item_orders(branded: DataFrame, keys: Sequence[str] = ITEM_KEYS) -> DataFrame:
    """Distinct orders per week, brand, merchant and item text."""
    return (
        branded.withColumn("odate", sunday_week(F.col("orderdate")))
        .groupBy(*keys)
        .agg(F.countDistinct("orderid").alias("order_count"))
    )


def drop_unconfirmed_singletons(item_orders: DataFrame, rules: Sequence[BrandRule]) -> DataFrame:
    """Items ordered once in a week stay only if they match their brand's stricter patterns."""
    strict = [rule for rule in rules if rule.singleton_any_of]
    for rule in strict:
        confirmed = any_like(F.col("itemdescription"), rule.singleton_any_of)
        item_orders = item_orders.filter(
            (F.col("brand") != rule.brand) | (F.col("order_count") > 1) | ((F.col("order_count") == 1) & confirmed)
        )
    return item_orders


def weekly_brand_orders(item_orders: DataFrame) -> DataFrame:
    """Item counts added up: an order with two item texts of a brand counts twice."""
    return item_orders.groupBy("odate", "brand").agg(F.sum("order_count").alias("order_count"))


def share_within(frame: DataFrame, value: str, by: Sequence[str], name: str = "perc") -> DataFrame:
    """Each row's part of its group's total."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return frame.withColumn(name, ratio(F.col(value), total))


def share_of_total(frame: DataFrame, value: str, name: str = "perc") -> DataFrame:
    """Each row's part of the grand total, which is one row and therefore safe to broadcast.

    The frame is read twice and its values are gathered for the total: give it settled, and with
    a row per region or the like.
    """
    total = frame.agg(ordered_sum(F.col(value)).alias("grand_total"))
    return (
        frame.crossJoin(F.broadcast(total))
        .withColumn(name, ratio(F.col(value), F.col("grand_total")))
        .drop("grand_total")
    )


def brand_columns(shares: DataFrame, brands: Sequence[str], value: str = "perc") -> DataFrame:
    """One row per week and one column per brand; a brand without sales that week is null."""
    return shares.groupBy("odate").pivot("brand", list(brands)).agg(F.first(value))
