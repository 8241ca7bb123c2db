"""Trailing sums over daily frames.

The three operators differ in which rows a seven-row frame sees, and reports depend on
the difference: anchor rows only, every observed day, or every day of a calendar. All run
per brand on a frame of one row per brand and date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import falls_on

ANCHOR = "Saturday"
TRAILING_ROWS = 7
RAW_MEASURES = ("pq", "ordercount", "item_count")
PANEL_MEASURES = ("pnlpq", "pnl_ordercount", "pnl_itemcount")
SMOOTHED = {
    "pq": "pq_dma7",
    "pnlpq": "pnlpq_dma7",
    "ordercount": "vol_dma7",
    "pnl_ordercount": "pnlvol_dma7",
    "item_count": "items_dma7",
    "pnl_itemcount": "pnlitems_dma7",
}


def trailing_sums(
    daily: DataFrame, by: Sequence[str] = ("brand",), measures: Sequence[str] = tuple(SMOOTHED)
) -> DataFrame:
    """Sum of each measure over the row and the six before it: rows, not days."""
    frame = Window.partitionBy(*by).orderBy("orderdate").rowsBetween(1 - TRAILING_ROWS, 0)
    return daily.select(*by, "orderdate", *[F.sum(m).over(frame).alias(SMOOTHED[m]) for m in measures])


def anchor_days(frame: DataFrame, anchor: str = ANCHOR) -> DataFrame:
    return frame.filter(falls_on(F.col("orderdate"), anchor))


def trailing_anchor_rows(daily: DataFrame, **options) -> DataFrame:
    """Anchor days first, then the sums: seven anchors, about seven weeks."""
    return trailing_sums(anchor_days(daily), **options)


def trailing_observed_days(daily: DataFrame, **options) -> DataFrame:
    """Sums over the days that have sales, then anchor days."""
    return anchor_days(trailing_sums(daily, **options))


def trailing_calendar_days(daily: DataFrame, spine: DataFrame, **options) -> DataFrame:
    """Sums over every date of the spine; a date without sales adds nothing but counts as a row.

    `spine` holds one row per brand and date.
    """
    return trailing_sums(spine.join(daily, ["brand", "orderdate"], "left"), **options)
