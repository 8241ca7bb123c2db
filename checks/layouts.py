"""Kept state and layouts: buckets, intervals, daily state, order sets, rejected rows."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmetrics.functions import per_panel, sunday_week
from panelmetrics.operators import rollup, scope, timeframe
from panelmetrics.operators.colocate import colocated
from panelmetrics.operators.membership import keep_in_intervals, member_intervals
from panelmetrics.operators.order_sets import counted_sets, merged_sets, order_sets
from panelmetrics.operators.rules import tag_brands
from panelmetrics.plans import WeeklySeries, daily_state
from panelmetrics.session import kept, shared_folder
from panelmetrics.sources import checked_codes, checked_dates

from .aggregates import EVENT_RATES, EVENT_ROWS, event_orders
from .base import ALL, BLUE_SQL, DAILY_ALL, EXCLUDED, OLD_SQL, RED_SQL, RULES, SECTORS, SINCE, WIDGETS_SQL, Inputs, check, with_views
from .metrics import SCOPE_SQL

NEW_DAYS = dt.date(2001, 1, 1)
SCOPE_COLUMNS = ("mailboxid", "orderid", "orderdate", "merchant", "itemdescription")


def new_folder(t: Inputs) -> str:
    return f"{shared_folder(t.spark)}/checks-{uuid.uuid4().hex}"


def scope_merchants(t: Inputs) -> DataFrame:
    return scope.eligible_merchants(t.sales.merchant_sector, SECTORS, t.sales.quality_merchants)


def scope_cohort(t: Inputs) -> DataFrame:
    calendar = timeframe.calendar_of(t.sales.items)
    return scope.cohort_in_fact_years(t.sales.cohort.filter("cohort = 'all'"), calendar, SINCE)


@check("m1_colocated_scope", SCOPE_SQL)
def colocated_scope(t: Inputs) -> DataFrame:
    name = f"scope_{uuid.uuid4().hex}"
    tables = colocated(t.sales.items, scope_cohort(t), t.sales.mailbox_zip, name, new_folder(t), buckets=8)
    kept = tables.kept_items(~F.col("merchant").isin(*EXCLUDED), cohort_all=True)
    scoped = scope.in_merchants(kept, scope_merchants(t))
    return rollup.with_panel(scoped, t.sales.panel).select(*SCOPE_COLUMNS)


@check("j6_membership_intervals", SCOPE_SQL)
def membership_intervals(t: Inputs) -> DataFrame:
    intervals = member_intervals(scope.active_members(scope_cohort(t), t.sales.mailbox_zip))
    items = scope.in_merchants(scope.drop_merchants(t.sales.items, EXCLUDED), scope_merchants(t))
    return rollup.with_panel(keep_in_intervals(items, intervals), t.sales.panel).select(*SCOPE_COLUMNS)


@check(
    "a4_daily_state",
    with_views("SELECT brand, orderdate, ordercount, item_count, pq FROM daily", DAILY_ALL),
)
def kept_daily_state(t: Inputs) -> DataFrame:
    """A state loaded up to a date, then refreshed for the days that came."""
    folder, series = new_folder(t), [WeeklySeries(ALL, daily=True)]
    with kept(t.sales.items) as items:
        after = replace(t.sales, items=items)
        before = replace(t.sales, items=items.filter(F.col("orderdate") < F.lit(NEW_DAYS)))
        daily_state.refresh_days(before, series, SECTORS, SINCE, folder)
        came = daily_state.changed_days(
            daily_state.day_prints(before.items, "orderdate"), daily_state.day_prints(after.items, "orderdate")
        )
        daily_state.refresh_days(after, series, SECTORS, SINCE, folder, came)
    days = rollup.per_panel_days(daily_state.kept_days(t.spark, folder), t.sales.panel)
    return days.select("brand", "orderdate", "ordercount", "item_count", "pq")


BRAND_WEEKS_SQL = " UNION ALL ".join(
    f"SELECT '{brand}' AS brand, orderdate, orderid FROM fact_items WHERE {holds}"
    for brand, holds in (("Red", RED_SQL), ("Blue", BLUE_SQL), ("Old", OLD_SQL), ("Widgets", WIDGETS_SQL))
)


@check(
    "a4_order_sets",
    with_views(f"""SELECT brand, orderdate - CAST(isodow(orderdate) % 7 AS INTEGER) AS odate, count(DISTINCT orderid) AS order_count
  FROM ({BRAND_WEEKS_SQL}) GROUP BY 1, 2"""),
)
def brand_order_sets(t: Inputs) -> DataFrame:
    """Weekly orders of a brand, added up from sets of its days."""
    days = order_sets(tag_brands(t.sales.items, RULES), ["brand", "orderdate"])
    weeks = merged_sets(days.withColumn("odate", sunday_week(F.col("orderdate"))), ["brand", "odate"])
    return counted_sets(weeks, ["brand", "odate"])


@check("a7_order_sets", with_views("SELECT * FROM event_rates", EVENT_ROWS, EVENT_RATES))
def event_order_sets(t: Inputs) -> DataFrame:
    keys = ["event_kind", "orderdate", "msa", "state_abbrev"]
    counts = counted_sets(order_sets(event_orders(t), keys), keys, "orders")
    rates = rollup.with_panel(counts, t.events.panel)
    return rates.select(*keys, per_panel(F.col("orders"), F.col("panel"), 10000).alias("ordercount"))


@check(
    "a12_order_sets",
    with_views(f"""SELECT brand, CAST(date_trunc('month', orderdate) AS DATE) AS month, count(DISTINCT orderid) AS order_count
  FROM ({BRAND_WEEKS_SQL}) GROUP BY 1, 2"""),
)
def monthly_order_sets(t: Inputs) -> DataFrame:
    """Monthly orders from days, by way of weeks cut at months: an order counts once however often sets are merged."""
    days = order_sets(tag_brands(t.sales.items, RULES), ["brand", "orderdate"])
    dated = days.withColumns({"month": F.trunc("orderdate", "month"), "odate": sunday_week(F.col("orderdate"))})
    weeks = merged_sets(dated, ["brand", "month", "odate"])
    return counted_sets(merged_sets(weeks, ["brand", "month"]), ["brand", "month"])


CODE_SQL = """codes AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey AS VARCHAR)
  WHEN 1 THEN CAST(c_custkey AS VARCHAR) || '.0' WHEN 2 THEN 'x' || CAST(c_custkey AS VARCHAR) WHEN 3 THEN ' '
  WHEN 4 THEN CAST(-c_custkey AS VARCHAR) END AS code FROM customer)"""


@check(
    "s2_checked_code_list",
    f"""WITH {CODE_SQL} SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN printf('%05d', c_custkey) WHEN 1 THEN printf('%05d', c_custkey)
  ELSE code END AS code, CASE WHEN c_custkey % 6 < 2 THEN NULL WHEN c_custkey % 6 = 2 THEN 'not a number'
  WHEN c_custkey % 6 = 4 THEN 'not a code' ELSE 'missing code' END AS reject_reason FROM codes""",
)
def checked_code_list(t: Inputs) -> DataFrame:
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    code = (
        F.when(key % 6 == 0, text)
        .when(key % 6 == 1, F.concat(text, F.lit(".0")))
        .when(key % 6 == 2, F.concat(F.lit("x"), text))
        .when(key % 6 == 3, F.lit(" "))
        .when(key % 6 == 4, (-key).cast("string"))
    )
    found = checked_codes(t.raw("customer").select("c_custkey", code.alias("code")), "code")
    return found.rows.unionByName(found.rejects, allowMissingColumns=True)


@check(
    "f19_checked_dates",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) END AS day,
  CASE o_orderkey % 4 WHEN 1 THEN 'missing date' WHEN 2 THEN 'not a date' WHEN 3 THEN 'not a date' END AS reject_reason FROM orders""",
)
def checked_text_dates(t: Inputs) -> DataFrame:
    key, day = F.col("o_orderkey"), F.date_format(F.col("o_orderdate").cast("date"), "M-dd-yyyy")
    text = F.when(key % 4 == 0, day).when(key % 4 == 2, F.lit("13-45-2020")).when(key % 4 == 3, F.lit("soon"))
    found = checked_dates(t.raw("orders").select("o_orderkey", text.alias("day")), "day")
    return found.rows.unionByName(found.rejects.withColumn("day", F.lit(None).cast("date")), allowMissingColumns=True)
