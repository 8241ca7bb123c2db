"""Year over year by a 52-week shift, and the weekly metrics built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import growth, ratio
from .timeframe import YEAR_SHIFT

PRIOR = "prior_"


def with_prior_year(current: DataFrame, prior: DataFrame, shift: int = YEAR_SHIFT) -> DataFrame:
    """Rows of `current` that have a row of `prior` exactly `shift` days earlier.

    The key of the prior side is moved, which leaves an equality join.
    """
    keys = ["brand", "orderdate"]
    moved = prior.select(
        "brand",
        F.date_add("orderdate", shift).alias("orderdate"),
        *[F.col(c).alias(PRIOR + c) for c in prior.columns if c not in keys],
    )
    return current.join(moved, keys)


def weekly_metrics(paired: DataFrame, legacy_price_yoy: bool = False) -> DataFrame:
    """Sales, transactions, basket size and price with their growth, labelled by week start.

    `legacy_price_yoy` divides this year's price per item by last year's items per order,
    as one published series did.
    """
    c = F.col
    items_per_order = ratio(c("pnlitems_dma7"), c("pnlvol_dma7"))
    price_per_item = ratio(c("pnlpq_dma7"), c("pnlitems_dma7"))
    prior_items_per_order = ratio(c(PRIOR + "pnlitems_dma7"), c(PRIOR + "pnlvol_dma7"))
    prior_price_per_item = ratio(c(PRIOR + "pnlpq_dma7"), c(PRIOR + "pnlitems_dma7"))
    return paired.select(
        "brand",
        F.date_sub("orderdate", 6).alias("weekstart"),
        "pnlpq_dma7",
        growth(c("pnlpq_dma7"), c(PRIOR + "pnlpq_dma7")).alias("yy_sales"),
        "pnlvol_dma7",
        growth(c("pnlvol_dma7"), c(PRIOR + "pnlvol_dma7")).alias("yy_txns"),
        items_per_order.alias("avgitems"),
        growth(items_per_order, prior_items_per_order).alias("yy_avgitems"),
        price_per_item.alias("avgprice"),
        growth(price_per_item, prior_items_per_order if legacy_price_yoy else prior_price_per_item).alias(
            "yy_avgprice"
        ),
    )
