"""Joins of the panel scope and of the weekly metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmetrics.functions import first_five
from panelmetrics.operators import rollup, scope, timeframe, yoy
from panelmetrics.session import settle

from .base import DAILY_ALL, MIDYEAR, SECTORS, SINCE, Inputs, check, with_views
from .windows import brand_daily, calendar_spine


@check(
    "j1_panel_by_date",
    with_views("SELECT orderid, itemdescription, panel FROM fact_items JOIN panel_by_date ON orderdate = date"),
)
def panel_by_date(t: Inputs) -> DataFrame:
    return rollup.with_panel(t.sales.items, t.sales.panel).select("orderid", "itemdescription", "panel")


@check(
    "j2_quality_merchants",
    with_views("""SELECT orderid, f.merchant, itemdescription FROM fact_items f
  JOIN (SELECT DISTINCT merchant FROM quality_merchants) q ON f.merchant = q.merchant"""),
)
def quality_merchants(t: Inputs) -> DataFrame:
    return scope.in_quality_merchants(t.sales.items, t.sales.quality_merchants).select(
        "orderid", "merchant", "itemdescription"
    )


@check(
    "j3_sector_restriction",
    with_views("""SELECT orderid, merchant, itemdescription FROM fact_items
  WHERE merchant IN (SELECT merchant FROM sector_merchants)"""),
)
def sector_restriction(t: Inputs) -> DataFrame:
    return scope.in_sectors(t.sales.items, t.sales.merchant_sector, SECTORS).select(
        "orderid", "merchant", "itemdescription"
    )


@check(
    "j4_single_address_mailboxes",
    with_views("""SELECT mailboxid, shiptozip FROM userzips WHERE mailboxid IN
  (SELECT mailboxid FROM userzips GROUP BY mailboxid HAVING count(*) = 1)"""),
)
def single_address(t: Inputs) -> DataFrame:
    return scope.single_address_mailboxes(t.sales.mailbox_zip)


@check(
    "j5_mailbox_zip",
    with_views("""SELECT f.mailboxid, orderid, itemdescription, zip FROM fact_items f
  JOIN single_zip z ON f.mailboxid = z.mailboxid"""),
)
def mailbox_zip(t: Inputs) -> DataFrame:
    zips = scope.single_address_mailboxes(t.sales.mailbox_zip)
    return scope.with_mailbox_zip(t.sales.items, zips).select(
        "mailboxid", "orderid", "itemdescription", first_five(F.col("shiptozip")).alias("zip")
    )


@check(
    "j6_cohort_membership",
    with_views("""SELECT f.mailboxid, orderid, itemdescription, cohort FROM fact_items f
  JOIN cohort_list c ON f.mailboxid = c.mailboxid AND f.orderdate = c.udate"""),
)
def cohort_membership(t: Inputs) -> DataFrame:
    members = t.sales.cohort.withColumnRenamed("udate", "orderdate")
    return scope.keep_members(t.sales.items, members).select(
        "mailboxid", "orderid", "itemdescription", "cohort"
    )


@check(
    "j7_year_membership",
    with_views("""SELECT mailboxid, udate, cohort FROM cohort_list WHERE year(udate) IN
  (SELECT DISTINCT year(orderdate) FROM fact_items WHERE orderdate >= DATE '1998-07-01')"""),
)
def year_membership(t: Inputs) -> DataFrame:
    return scope.cohort_in_fact_years(t.sales.cohort, timeframe.calendar_of(t.sales.items), MIDYEAR)


OFFSET_COLUMNS = ("pnlpq", "pnl_ordercount", "pnl_itemcount")


@check(
    "j9_year_offset_join",
    with_views(
        """SELECT a.brand, a.orderdate, a.pnlpq, a.pnl_ordercount, a.pnl_itemcount, b.pnlpq AS prior_pnlpq,
  b.pnl_ordercount AS prior_pnl_ordercount, b.pnl_itemcount AS prior_pnl_itemcount
  FROM daily a JOIN daily b ON a.orderdate = b.orderdate + 364""",
        DAILY_ALL,
    ),
)
def year_offset_join(t: Inputs) -> DataFrame:
    daily = settle(brand_daily(t).select("brand", "orderdate", *OFFSET_COLUMNS))
    return yoy.with_prior_year(daily, daily)


@check(
    "j12_date_spine",
    with_views(
        """SELECT 'All' AS brand, s.orderdate, ordercount, pq FROM
  (SELECT DISTINCT orderdate FROM fact_items WHERE orderdate >= DATE '1998-01-01') s
  FULL OUTER JOIN daily d ON s.orderdate = d.orderdate WHERE s.orderdate <= (SELECT day FROM latest) - 3""",
        DAILY_ALL,
    ),
)
def date_spine(t: Inputs) -> DataFrame:
    spine = calendar_spine(t, SINCE)
    return spine.join(brand_daily(t), ["brand", "orderdate"], "left").select("brand", "orderdate", "ordercount", "pq")
