"""Composed business metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmetrics.functions import ratio
from panelmetrics.operators import geo, rollup, scope, share, smooth, timeframe, yoy
from panelmetrics.plans import weekly_market_share
from panelmetrics.session import settle

from .aggregates import item_orders_sql, sector_items
from .base import (
    DAILY_ALL,
    EXCLUDED,
    EXCLUDED_SQL,
    MIDYEAR,
    RULES,
    SECTORS,
    SECTORS_SQL,
    SINCE,
    TODAY,
    Inputs,
    check,
    with_views,
)
from .geography import (
    BRAND_CTES,
    CANCEL_ADD_SQL,
    MAP_CTES,
    adds_with_cancels,
    merged_brands,
    merged_periods,
    prior_total,
)
from .windows import SMOOTHED_SQL, WINDOW_SQL, brand_daily


SCOPE_SQL = with_views(f"""SELECT f.mailboxid, f.orderid, f.orderdate, f.merchant, f.itemdescription
  FROM fact_items f
  JOIN (SELECT DISTINCT merchant FROM quality_merchants) q ON f.merchant = q.merchant
  JOIN single_zip z ON f.mailboxid = z.mailboxid
  JOIN clean_cohort c ON f.mailboxid = c.mailboxid AND f.orderdate = c.udate
  JOIN panel_by_date p ON f.orderdate = p.date
  WHERE f.merchant IN (SELECT merchant FROM sector_all WHERE sector IN {SECTORS_SQL})
  AND f.merchant NOT IN {EXCLUDED_SQL}""")


@check("m1_panel_scope", SCOPE_SQL)
def panel_scope(t: Inputs) -> DataFrame:
    merchants = scope.eligible_merchants(t.sales.merchant_sector, SECTORS, t.sales.quality_merchants)
    items = scope.in_merchants(scope.drop_merchants(t.sales.items, EXCLUDED), merchants)
    cohort = scope.cohort_in_fact_years(
        t.sales.cohort.filter("cohort = 'all'"), timeframe.calendar_of(t.sales.items), SINCE
    )
    members = scope.active_members(cohort, t.sales.mailbox_zip)
    return rollup.with_panel(scope.keep_members(items, members), t.sales.panel).select(
        "mailboxid", "orderid", "orderdate", "merchant", "itemdescription"
    )


@check(
    "m2_panel_scope_geographic",
    with_views(f"""SELECT f.mailboxid, f.orderid, f.itemdescription, z.zip, g.msa, g.state_abbrev, count(*) AS copies
  FROM fact_items f JOIN panel_by_date p ON f.orderdate = p.date
  JOIN (SELECT *, row_number() OVER () AS row_no FROM cohort_list WHERE year(udate) = 2001) c
    ON f.mailboxid = c.mailboxid AND f.orderdate = c.udate
  JOIN single_zip z ON f.mailboxid = z.mailboxid LEFT JOIN zip_msa g ON z.zip = g.zip
  WHERE f.merchant IN (SELECT merchant FROM sector_merchants) AND f.merchant NOT IN {EXCLUDED_SQL}
  GROUP BY ALL"""),
)
def panel_scope_geographic(t: Inputs) -> DataFrame:
    items = scope.drop_merchants(sector_items(t), EXCLUDED)
    cohort = t.sales.cohort.filter(timeframe.same_year_as(TODAY, day="udate"))
    members = scope.active_members(cohort, t.sales.mailbox_zip, geo.mailbox_zip_prefix(F.col("shiptozip")))
    rows = rollup.with_panel(scope.keep_members(items, members), t.sales.panel)
    placed = geo.with_region(rows, geo.zip_regions(t.sales.geo))
    return placed.groupBy("mailboxid", "orderid", "itemdescription", "zip", "msa", "state_abbrev").agg(
        F.sum(F.col("copies") * F.col("geo_copies")).alias("copies")
    )


PAIRED_SQL = f"""series AS (SELECT brand, orderdate, {SMOOTHED_SQL}
  FROM (SELECT * FROM daily WHERE isodow(orderdate) = 6 AND orderdate <= (SELECT day FROM latest) - 3) {WINDOW_SQL}),
paired AS (SELECT a.*, b.pnlpq_dma7 AS l_pq, b.pnlvol_dma7 AS l_vol, b.pnlitems_dma7 AS l_items
  FROM series a JOIN series b ON a.orderdate = b.orderdate + 364)"""


def paired_weeks(t: Inputs) -> DataFrame:
    latest = timeframe.latest_day(timeframe.calendar_of(t.sales.items))
    daily = brand_daily(t).filter(timeframe.settled_by(latest))
    series = settle(smooth.trailing_anchor_rows(daily, measures=smooth.PANEL_MEASURES))
    return yoy.with_prior_year(series, series)


def metric_columns(t: Inputs, *names: str, legacy: bool = False) -> DataFrame:
    return yoy.weekly_metrics(paired_weeks(t), legacy).select("brand", "weekstart", *names)


def metric_sql(columns: str) -> str:
    return with_views(f"SELECT brand, orderdate - 6 AS weekstart, {columns} FROM paired", DAILY_ALL, PAIRED_SQL)


@check("m3_sales_growth", metric_sql("pnlpq_dma7, pnlpq_dma7 / nullif(l_pq, 0) - 1 AS yy_sales"))
def sales_growth(t: Inputs) -> DataFrame:
    return metric_columns(t, "pnlpq_dma7", "yy_sales")


@check("m4_transaction_growth", metric_sql("pnlvol_dma7, pnlvol_dma7 / nullif(l_vol, 0) - 1 AS yy_txns"))
def transaction_growth(t: Inputs) -> DataFrame:
    return metric_columns(t, "pnlvol_dma7", "yy_txns")


@check(
    "m5_items_per_order",
    metric_sql("""pnlitems_dma7 / nullif(pnlvol_dma7, 0) AS avgitems,
  (pnlitems_dma7 / nullif(pnlvol_dma7, 0)) / nullif(l_items / nullif(l_vol, 0), 0) - 1 AS yy_avgitems"""),
)
def items_per_order(t: Inputs) -> DataFrame:
    return metric_columns(t, "avgitems", "yy_avgitems")


@check(
    "m6_price_per_item",
    metric_sql("""pnlpq_dma7 / nullif(pnlitems_dma7, 0) AS avgprice,
  (pnlpq_dma7 / nullif(pnlitems_dma7, 0)) / nullif(l_pq / nullif(l_items, 0), 0) - 1 AS yy_avgprice"""),
)
def price_per_item(t: Inputs) -> DataFrame:
    return metric_columns(t, "avgprice", "yy_avgprice")


@check(
    "m7_price_growth_variant",
    metric_sql("(pnlpq_dma7 / nullif(pnlitems_dma7, 0)) / nullif(l_items / nullif(l_vol, 0), 0) - 1 AS yy_avgprice"),
)
def price_growth_variant(t: Inputs) -> DataFrame:
    return metric_columns(t, "yy_avgprice", legacy=True)


@check("m8_week_start", with_views("SELECT DISTINCT orderdate, orderdate - 6 AS weekstart FROM fact_items WHERE isodow(orderdate) = 6"))
def week_start(t: Inputs) -> DataFrame:
    anchors = smooth.anchor_days(timeframe.calendar_of(t.sales.items))
    return anchors.withColumn("weekstart", F.date_sub("orderdate", 6))


WEEK_COUNTS_SQL = f"""week_counts AS (SELECT odate, brand, sum(order_count) AS order_count FROM ({item_orders_sql()})
  WHERE odate <= DATE '2001-08-01' - 3 - 9 GROUP BY 1, 2),
shares AS (SELECT odate, brand, CAST(order_count AS DOUBLE) / CAST(sum(order_count) OVER (PARTITION BY odate) AS DOUBLE)
  AS perc FROM week_counts)"""
MARKET_SHARE_SQL = with_views("SELECT odate, brand, perc FROM shares WHERE odate >= DATE '1998-07-01'", WEEK_COUNTS_SQL)


@check("m9_market_share", MARKET_SHARE_SQL)
def market_share(t: Inputs) -> DataFrame:
    return weekly_market_share(t.sales, RULES, SECTORS, TODAY, MIDYEAR)


CHANGE_SQL = "coalesce(current, 0) - coalesce(prior, 0)"


@check("m10_region_change", with_views(f"SELECT msa, {CHANGE_SQL} AS change FROM merged", *MAP_CTES))
def region_change(t: Inputs) -> DataFrame:
    return geo.region_change(merged_periods(t)).select("msa", "change")


@check(
    "m11_contribution_to_growth",
    with_views(f"SELECT msa, ({CHANGE_SQL}) / nullif(ttl.rate, 0) AS contrib FROM merged, ttl", *MAP_CTES),
)
def contribution_to_growth(t: Inputs) -> DataFrame:
    changes = geo.region_change(merged_periods(t))
    return geo.attach_scalar(changes, prior_total(t)).select("msa", ratio(F.col("change"), F.col("total")).alias("contrib"))


GROWTH_SQL = "round((current / (coalesce(prior, 0) + 0.00001::DOUBLE) - 1) * 100, 2)"


@check("m12_region_growth_percent", with_views(f"SELECT msa, {GROWTH_SQL} AS yygrowth FROM merged", *MAP_CTES))
def region_growth_percent(t: Inputs) -> DataFrame:
    return geo.region_change(merged_periods(t)).select("msa", "yygrowth")


PERC_SQL = """current / (SELECT list_reduce(list_sort(list(current) FILTER (WHERE current IS NOT NULL)), lambda a, b: a + b)
  FROM merged)"""


@check("m13_share_of_current_sales", with_views(f"SELECT msa, {PERC_SQL} AS perc FROM merged", *MAP_CTES))
def share_of_current_sales(t: Inputs) -> DataFrame:
    return share.share_of_total(merged_periods(t), "current").select("msa", "perc")


GAP_SQL = "coalesce(red, 1e-18::DOUBLE) - coalesce(blue, 1e-18::DOUBLE)"


@check("m14_head_to_head_gap", with_views(f"SELECT msa, {GAP_SQL} AS gap FROM brands", *BRAND_CTES))
def head_to_head_gap(t: Inputs) -> DataFrame:
    return geo.region_gap(merged_brands(t), "red", "blue", "gap")


@check("m15_cancel_add_ratio", CANCEL_ADD_SQL)
def cancel_add_ratio(t: Inputs) -> DataFrame:
    return adds_with_cancels(t)


@check(
    "m16_series_pivot",
    with_views(
        """SELECT odate, max(perc) FILTER (WHERE brand = 'Red') AS "Red", max(perc) FILTER (WHERE brand = 'Blue') AS "Blue",
  max(perc) FILTER (WHERE brand = 'Old') AS "Old", max(perc) FILTER (WHERE brand = 'Widgets') AS "Widgets"
  FROM shares WHERE odate >= DATE '1998-07-01' GROUP BY odate""",
        WEEK_COUNTS_SQL,
    ),
)
def series_pivot(t: Inputs) -> DataFrame:
    return share.brand_columns(market_share(t), [rule.brand for rule in RULES])


@check(
    "m17_panel_scope_events",
    with_views("""SELECT DISTINCT f.mailboxid, orderdate, orderid, z.zip, msa, state_abbrev
  FROM fact_events f JOIN event_panel p ON f.orderdate = p.date
  JOIN event_cohort c ON f.mailboxid = c.mailboxid AND f.orderdate = c.udate
  JOIN (SELECT mailboxid, lpad(shiptozip, 5, '0') AS zip FROM userzips WHERE mailboxid IN
    (SELECT mailboxid FROM userzips GROUP BY mailboxid HAVING count(*) = 1)) z ON f.mailboxid = z.mailboxid
  LEFT JOIN (SELECT lpad(zipcode, 5, '0') AS zip, msa, state_abbrev FROM zip_level_info) g ON z.zip = g.zip
  WHERE merchant = 'Streamer'"""),
)
def panel_scope_events(t: Inputs) -> DataFrame:
    orders = t.events.items.filter("merchant = 'Streamer'").select(*rollup.ORDER_KEYS).distinct()
    members = scope.active_members(
        t.events.cohort, t.events.mailbox_zip, geo.mailbox_zip_padded(F.col("shiptozip"))
    )
    kept = rollup.with_panel(scope.keep_members(orders, members), t.events.panel)
    placed = geo.with_region(kept, geo.zip_regions(t.events.geo, geo.mailbox_zip_padded))
    return placed.select("mailboxid", "orderdate", "orderid", "zip", "msa", "state_abbrev")
