"""Subscription events: adds, cancels and their ratio by state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordered_sum, per_panel, ratio
from .rollup import with_panel


def daily_event_rates(events: DataFrame, panel: DataFrame, by: Sequence[str] = ("event_kind",)) -> DataFrame:
    """Distinct orders per ten thousand panel members for each date, region and state."""
    counts = events.groupBy(*by, "orderdate", "msa", "state_abbrev").agg(
        F.round(F.countDistinct("orderid"), 4).alias("orders")
    )
    return with_panel(counts, panel).withColumn("ordercount", per_panel(F.col("orders"), F.col("panel"), 10000))


def state_volume(rates: DataFrame, by: Sequence[str] = ("event_kind",)) -> DataFrame:
    """Daily rates added up per state. There is at most one rate per date and region."""
    return rates.groupBy(*by, "state_abbrev").agg(ordered_sum(F.col("ordercount")).alias("volume"))


def cancel_add_ratio(adds: DataFrame, cancels: DataFrame) -> DataFrame:
    """Cancels per hundred adds, for the states that have both."""
    left = adds.select("state_abbrev", F.col("volume").alias("adds"))
    right = cancels.select("state_abbrev", F.col("volume").alias("cancels"))
    return (
        left.join(right, "state_abbrev", "left")
        .withColumn("cncl_share", ratio(F.col("cancels"), F.col("adds")) * 100)
        .filter("cncl_share > 0")
    )
