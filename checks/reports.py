"""The six reports, the set shown together, and the dormant fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmetrics.functions import ratio
from panelmetrics.operators import geo, rollup, scope, timeframe
from panelmetrics.plans import (
    WeeklySeries,
    cancel_add_by_state,
    contribution_by_county,
    gap_by_county,
    report_set,
    weekly_growth,
)

from .aggregates import sector_items
from .base import (
    ADD_DAYS,
    ADDS,
    ALL,
    ALL_SQL,
    BLUE_ALL,
    BLUE_ALL_SQL,
    CANCEL_DAYS,
    CANCELS,
    MIDYEAR,
    RED_ALL,
    RED_ALL_SQL,
    RULES,
    SECTORS,
    SINCE,
    TODAY,
    Inputs,
    check,
    daily_cte,
    with_views,
)
from .geography import BRAND_CTES, CANCEL_ADD_SQL, MAP_CTES
from .metrics import CHANGE_SQL, GAP_SQL, GROWTH_SQL, MARKET_SHARE_SQL, PERC_SQL, WEEK_COUNTS_SQL, market_share
from .windows import SPINE_SQL

FINISH_SQL = """a.brand, a.orderdate - 6 AS weekstart, a.pq AS pnlpq_dma7, a.pq / nullif(b.pq, 0) - 1 AS yy_sales,
  a.vol AS pnlvol_dma7, a.vol / nullif(b.vol, 0) - 1 AS yy_txns,
  a.items / nullif(a.vol, 0) AS avgitems,
  (a.items / nullif(a.vol, 0)) / nullif(b.items / nullif(b.vol, 0), 0) - 1 AS yy_avgitems,
  a.pq / nullif(a.items, 0) AS avgprice,
  (a.pq / nullif(a.items, 0)) / nullif(b.pq / nullif(b.items, 0), 0) - 1 AS yy_avgprice"""
SUMS_SQL = """orderdate, sum(pnlpq) OVER w AS pq, sum(pnl_ordercount) OVER w AS vol, sum(pnl_itemcount) OVER w AS items"""
FRAME_SQL = "WINDOW w AS (ORDER BY orderdate ROWS 6 PRECEDING)"


def anchor_series(brand: str, condition: str) -> str:
    name = brand.lower()
    return f"""{daily_cte('daily_' + name, brand, condition)},
{name}_line AS (SELECT brand, {SUMS_SQL} FROM (SELECT * FROM daily_{name}
  WHERE orderdate <= (SELECT day FROM latest) - 3 AND isodow(orderdate) = 6) {FRAME_SQL})"""


ALL_SERIES = f"""{daily_cte('daily_all', 'All', ALL_SQL)},
all_line AS (SELECT brand, {SUMS_SQL} FROM (SELECT * FROM daily_all
  WHERE orderdate <= (SELECT day FROM latest) - 3) {FRAME_SQL}),
all_prior AS (SELECT {SUMS_SQL} FROM (SELECT s.orderdate, pnlpq, pnl_ordercount, pnl_itemcount
  FROM spine s LEFT JOIN daily_all d ON s.orderdate = d.orderdate) {FRAME_SQL})"""


def anchored(brand: str) -> str:
    name = brand.lower()
    return f"""SELECT {FINISH_SQL} FROM {name}_line a JOIN {name}_line b ON a.orderdate = b.orderdate + 364
  WHERE a.orderdate >= DATE '2001-08-01' - 10 - 455"""


GROWTH_CTES = (SPINE_SQL, anchor_series("Red", RED_ALL_SQL), anchor_series("Blue", BLUE_ALL_SQL), ALL_SERIES)
GROWTH_BODY = f"""{anchored('Red')} UNION ALL {anchored('Blue')}
  UNION ALL SELECT {FINISH_SQL} FROM all_line a JOIN all_prior b ON a.orderdate - 364 = b.orderdate
  WHERE a.orderdate >= DATE '2001-08-01' - 10 - 455 AND isodow(a.orderdate) = 6"""
SERIES = (WeeklySeries(RED_ALL), WeeklySeries(ALL, daily=True), WeeklySeries(BLUE_ALL))


@check("report_weekly_metrics", with_views(anchored("Red"), anchor_series("Red", RED_ALL_SQL)))
def weekly_metrics(t: Inputs) -> DataFrame:
    return weekly_growth(t.sales, SERIES[:1], SECTORS, SINCE, TODAY)


@check("report_weekly_metrics_three_groups", with_views(GROWTH_BODY, *GROWTH_CTES))
def weekly_metrics_three_groups(t: Inputs) -> DataFrame:
    return weekly_growth(t.sales, SERIES, SECTORS, SINCE, TODAY)


@check("report_market_share", MARKET_SHARE_SQL)
def report_market_share(t: Inputs) -> DataFrame:
    return market_share(t)


CONTRIBUTION_BODY = f"""SELECT lpad(coalesce(z.fips, ''), 5, '0') AS fips, z.msa, contrib, yygrowth, perc
  FROM (SELECT DISTINCT fips, msa FROM zip_level_info) z
  JOIN (SELECT msa, ({CHANGE_SQL}) / nullif(ttl.rate, 0) AS contrib, {GROWTH_SQL} AS yygrowth, {PERC_SQL} AS perc
    FROM merged, ttl) m ON z.msa = m.msa"""


@check("report_growth_contribution", with_views(CONTRIBUTION_BODY, *MAP_CTES))
def growth_contribution(t: Inputs) -> DataFrame:
    return contribution_by_county(t.sales, ALL, SECTORS, TODAY)


GAP_BODY = f"""SELECT lpad(coalesce(z.fips, ''), 5, '0') AS fips, z.msa, gap
  FROM (SELECT DISTINCT fips, msa FROM zip_level_info) z
  JOIN (SELECT msa, {GAP_SQL} AS gap FROM brands) m ON z.msa = m.msa"""


@check("report_head_to_head_gap", with_views(GAP_BODY, *BRAND_CTES))
def head_to_head_gap(t: Inputs) -> DataFrame:
    return gap_by_county(t.sales, RED_ALL, BLUE_ALL, SECTORS, TODAY)


@check("report_cancel_add_ratio", CANCEL_ADD_SQL)
def cancel_add(t: Inputs) -> DataFrame:
    return cancel_add_by_state(t.events, ADDS, CANCELS, "Streamer", ADD_DAYS, CANCEL_DAYS)


def published_set(t: Inputs) -> dict[str, DataFrame]:
    return report_set(
        t.sales, SERIES, RULES, ALL, (RED_ALL, BLUE_ALL), SECTORS, SINCE, MIDYEAR, TODAY
    )


REPORT_SET_SQL = with_views(
    f"""SELECT 'growth' AS report, brand AS grp, CAST(weekstart AS VARCHAR) AS key, yy_sales AS value FROM ({GROWTH_BODY})
  UNION ALL SELECT 'share', brand, CAST(odate AS VARCHAR), perc FROM shares WHERE odate >= DATE '1998-07-01'
  UNION ALL SELECT 'gap_map', msa, fips, gap FROM ({GAP_BODY})
  UNION ALL SELECT 'contribution_map', msa, fips, contrib FROM ({CONTRIBUTION_BODY})""",
    *GROWTH_CTES,
    WEEK_COUNTS_SQL,
    *MAP_CTES,
    *BRAND_CTES[1:],
)

QUARTERS_SQL = """quarters AS (SELECT DISTINCT CAST(date_trunc('quarter', orderdate) AS DATE) AS quarterstart,
  CAST(date_trunc('quarter', orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarterend FROM fact_items)"""


def quarters(t: Inputs) -> DataFrame:
    start = F.trunc("orderdate", "quarter")
    days = timeframe.calendar_of(t.sales.items).select(start.alias("quarterstart")).distinct()
    return days.withColumn("quarterend", F.date_sub(F.add_months("quarterstart", 3), 1))


@check(
    "d1_fiscal_quarter_range",
    with_views(
        """SELECT orderdate, merchant, quarterstart, quarterend, count(*) AS items FROM fact_items
  JOIN quarters ON orderdate BETWEEN quarterstart AND quarterend GROUP BY ALL""",
        QUARTERS_SQL,
    ),
)
def fiscal_quarter_range(t: Inputs) -> DataFrame:
    daily = t.sales.items.groupBy("orderdate", "merchant").agg(F.count(F.lit(1)).alias("items"))
    return timeframe.in_quarters(daily, quarters(t))


@check(
    "d2_zip_result_to_county",
    with_views("""SELECT fips, CAST(sum(ordertotal) AS DOUBLE) AS ordertotal FROM fact_items f
  JOIN single_zip z ON f.mailboxid = z.mailboxid
  JOIN (SELECT lpad(zipcode, 5, '0') AS zip, fips FROM zip_level_info) g ON z.zip = g.zip GROUP BY fips"""),
)
def zip_result_to_county(t: Inputs) -> DataFrame:
    zips = scope.single_address_mailboxes(t.sales.mailbox_zip)
    by_mailbox = t.sales.items.groupBy("mailboxid").agg(F.sum("ordertotal").alias("ordertotal"))
    by_zip = (
        by_mailbox.join(zips, "mailboxid")
        .groupBy(F.substring("shiptozip", 1, 5).alias("zip"))
        .agg(F.sum("ordertotal").alias("ordertotal"))
    )
    counties = t.sales.geo.select(F.lpad("zipcode", 5, "0").alias("zip"), "fips")
    return by_zip.join(counties, "zip").groupBy("fips").agg(F.sum("ordertotal").cast("double").alias("ordertotal"))


@check(
    "d3_quarter_to_date",
    with_views(
        """SELECT quarterstart, CAST(sum(pq) AS DOUBLE) AS pq, count(DISTINCT orderid) AS orders,
  CAST(sum(pq) AS DOUBLE) / CAST(count(DISTINCT orderid) AS DOUBLE) AS average_order
  FROM (SELECT orderdate, orderid, sum(itemprice * itemquantity) AS pq FROM fact_items
    WHERE merchant IN (SELECT merchant FROM sector_merchants) GROUP BY 1, 2)
  JOIN quarters ON orderdate BETWEEN quarterstart AND quarterend GROUP BY 1""",
        QUARTERS_SQL,
    ),
)
def quarter_to_date(t: Inputs) -> DataFrame:
    orders = rollup.order_rollup(sector_items(t), ("orderdate", "orderid"))
    return (
        timeframe.in_quarters(orders, quarters(t))
        .groupBy("quarterstart")
        .agg(F.sum("pq").cast("double").alias("pq"), F.countDistinct("orderid").alias("orders"))
        .withColumn("average_order", ratio(F.col("pq"), F.col("orders")))
    )


@check(
    "d4_state_list",
    with_views("""SELECT mailboxid, state_abbrev FROM single_zip z JOIN zip_msa g ON z.zip = g.zip
  WHERE state_abbrev IN ('AS', 'EU')"""),
)
def state_list(t: Inputs) -> DataFrame:
    zips = scope.single_address_mailboxes(t.sales.mailbox_zip).select(
        "mailboxid", geo.mailbox_zip_prefix(F.col("shiptozip")).alias("zip")
    )
    placed = geo.with_each_region(zips, geo.zip_regions(t.sales.geo))
    return placed.filter(F.col("state_abbrev").isin("AS", "EU")).select("mailboxid", "state_abbrev")


@check(
    "d5_distribution_type",
    with_views("""SELECT orderid, merchant, itemdescription FROM fact_items
  WHERE merchant IN (SELECT merchant FROM sector_all WHERE distribtype IN ('NATION_3', 'NATION_15'))"""),
)
def distribution_type(t: Inputs) -> DataFrame:
    kept = scope.in_distribution_types(t.sales.items, t.sales.merchant_sector, ("NATION_3", "NATION_15"))
    return kept.select("orderid", "merchant", "itemdescription")
