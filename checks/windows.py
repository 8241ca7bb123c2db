"""Trailing windows, shares, orders and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmetrics.operators import share, smooth, timeframe
from panelmetrics.operators.rules import BrandRule, Clause, stack_brands, tag_brands, tag_brands_by_text
from panelmetrics.plans import WeeklySeries
from panelmetrics.plans.reports import brand_days
from panelmetrics.session import settle

from .base import (
    ALL,
    BLUE_SQL,
    DAILY_ALL,
    OLD_SQL,
    RED_SQL,
    RULES,
    SECTORS,
    SINCE,
    WIDGETS_SQL,
    Inputs,
    check,
    with_views,
)

SMOOTHED_SQL = """sum(pq) OVER w AS pq_dma7, sum(pnlpq) OVER w AS pnlpq_dma7, sum(ordercount) OVER w AS vol_dma7,
  sum(pnl_ordercount) OVER w AS pnlvol_dma7, sum(item_count) OVER w AS items_dma7,
  sum(pnl_itemcount) OVER w AS pnlitems_dma7"""
WINDOW_SQL = "WINDOW w AS (ORDER BY orderdate ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
SPINE_SQL = """spine AS (SELECT DISTINCT orderdate FROM fact_items
  WHERE orderdate >= DATE '1998-01-01' AND orderdate <= (SELECT day FROM latest) - 3)"""


def brand_daily(t: Inputs) -> DataFrame:
    """Daily metrics of the all-items brand over every date of the fact."""
    calendar = timeframe.calendar_of(t.sales.items)
    return brand_days(t.sales, [WeeklySeries(ALL, daily=True)], SECTORS, SINCE, calendar, dt.date(9999, 1, 1))


def calendar_spine(t: Inputs, since: dt.date) -> DataFrame:
    calendar = settle(timeframe.calendar_of(t.sales.items))
    settled = timeframe.settled_by(timeframe.latest_day(calendar))
    return calendar.filter((F.col("orderdate") >= F.lit(since)) & settled).withColumn("brand", F.lit("All"))


@check("w1_trailing_rows", with_views(f"SELECT brand, orderdate, {SMOOTHED_SQL} FROM daily {WINDOW_SQL}", DAILY_ALL))
def trailing_rows(t: Inputs) -> DataFrame:
    return smooth.trailing_sums(brand_daily(t))


@check(
    "w2_anchor_rows_trailing",
    with_views(
        f"SELECT brand, orderdate, {SMOOTHED_SQL} FROM (SELECT * FROM daily WHERE isodow(orderdate) = 6) {WINDOW_SQL}",
        DAILY_ALL,
    ),
)
def anchor_rows_trailing(t: Inputs) -> DataFrame:
    return smooth.trailing_anchor_rows(brand_daily(t))


@check(
    "w3_trailing_then_anchor",
    with_views(
        f"""SELECT * FROM (SELECT brand, orderdate, {SMOOTHED_SQL} FROM daily {WINDOW_SQL})
  WHERE isodow(orderdate) = 6""",
        DAILY_ALL,
    ),
)
def trailing_then_anchor(t: Inputs) -> DataFrame:
    return smooth.trailing_observed_days(brand_daily(t))


@check(
    "w4_trailing_over_spine",
    with_views(
        f"""SELECT 'All' AS brand, orderdate, {SMOOTHED_SQL}
  FROM (SELECT s.orderdate, d.* EXCLUDE (orderdate) FROM spine s LEFT JOIN daily d ON s.orderdate = d.orderdate)
  {WINDOW_SQL}""",
        DAILY_ALL,
        SPINE_SQL,
    ),
)
def trailing_over_spine(t: Inputs) -> DataFrame:
    return smooth.trailing_calendar_days(brand_daily(t), calendar_spine(t, SINCE))


@check(
    "w5_share_of_partition",
    """SELECT CAST(o_orderdate AS DATE) AS odate, o_orderpriority, count(*) AS orders,
  CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY CAST(o_orderdate AS DATE)) AS DOUBLE) AS perc
  FROM orders GROUP BY 1, 2""",
)
def share_of_partition(t: Inputs) -> DataFrame:
    counts = (
        t.raw("orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("odate"), "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    return share.share_within(counts, "orders", ["odate"])


@check(
    "w6_share_of_total",
    with_views("""SELECT merchant, CAST(sum(itemprice) AS DOUBLE) AS sales, CAST(sum(itemprice) AS DOUBLE)
  / CAST((SELECT sum(itemprice) FROM fact_items) AS DOUBLE) AS perc FROM fact_items GROUP BY merchant"""),
)
def share_of_total(t: Inputs) -> DataFrame:
    sales = t.sales.items.groupBy("merchant").agg(F.sum("itemprice").cast("double").alias("sales"))
    return share.share_of_total(sales, "sales")


@check(
    "o1_newest_first",
    "SELECT CAST(o_orderdate AS DATE) AS orderdate, count(*) AS orders FROM orders GROUP BY 1 ORDER BY 1 DESC",
)
def newest_first(t: Inputs) -> DataFrame:
    days = t.raw("orders").groupBy(F.col("o_orderdate").cast("date").alias("orderdate"))
    return days.agg(F.count(F.lit(1)).alias("orders")).orderBy(F.desc("orderdate"))


@check(
    "o2_largest_first",
    "SELECT o_custkey, max(o_totalprice) AS top_total FROM orders GROUP BY 1 ORDER BY 2 DESC",
)
def largest_first(t: Inputs) -> DataFrame:
    return t.raw("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top_total")).orderBy(F.desc("top_total"))


STACKED_SQL = with_views(
    "\nUNION ALL ".join(
        f"SELECT '{brand}' AS brand, orderid, merchant, itemdescription FROM fact_items WHERE {condition}"
        for brand, condition in (("Red", RED_SQL), ("Blue", BLUE_SQL), ("Old", OLD_SQL), ("Widgets", WIDGETS_SQL))
    )
)


@check("u1_stacked_branches", STACKED_SQL)
def stacked_branches(t: Inputs) -> DataFrame:
    return stack_brands(t.sales.items, RULES).select("brand", "orderid", "merchant", "itemdescription")


@check("u2_one_pass_tags", STACKED_SQL)
def one_pass_tags(t: Inputs) -> DataFrame:
    return tag_brands(t.sales.items, RULES).select("brand", "orderid", "merchant", "itemdescription")


@check("u2_tags_by_text", STACKED_SQL)
def tags_by_text(t: Inputs) -> DataFrame:
    return tag_brands_by_text(t.sales.items, RULES).select("brand", "orderid", "merchant", "itemdescription")


@check(
    "u2_rules_of_one_name",
    with_views("""SELECT 'X' AS brand, orderid, itemdescription FROM fact_items WHERE itemdescription ILIKE 'RED %'
  UNION ALL SELECT 'X', orderid, itemdescription FROM fact_items WHERE itemdescription ILIKE '%WIDGET'"""),
)
def rules_of_one_name(t: Inputs) -> DataFrame:
    rules = [BrandRule("X", (Clause(("RED %",)),)), BrandRule("X", (Clause(("%WIDGET",)),))]
    return tag_brands(t.sales.items, rules).select("brand", "orderid", "itemdescription")


@check(
    "u3_stacked_series",
    with_views(
        f"""SELECT brand, orderdate, {SMOOTHED_SQL} FROM (SELECT * FROM daily WHERE isodow(orderdate) = 6) {WINDOW_SQL}
  UNION ALL SELECT 'All, daily', orderdate, pq_dma7, pnlpq_dma7, vol_dma7, pnlvol_dma7, items_dma7, pnlitems_dma7
  FROM (SELECT orderdate, {SMOOTHED_SQL} FROM daily {WINDOW_SQL}) WHERE isodow(orderdate) = 6""",
        DAILY_ALL,
    ),
)
def stacked_series(t: Inputs) -> DataFrame:
    daily = settle(brand_daily(t))
    every_day = smooth.trailing_observed_days(daily).withColumn("brand", F.lit("All, daily"))
    return smooth.trailing_anchor_rows(daily).unionByName(every_day)
