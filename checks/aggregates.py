"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmetrics.functions import NORMALISED_FLOOR, or_else, per_panel
from panelmetrics.operators import churn, geo, rollup, scope, share, timeframe
from panelmetrics.operators.rules import rule_holds, tag_brands, tag_each

from .base import (
    ADD_DAYS,
    ADDS,
    ALL,
    BLUE_SQL,
    CANCEL_DAYS,
    CANCELS,
    CURRENT_WINDOW,
    DAILY_ALL,
    MAP_ROWS,
    OLD_SQL,
    PRIOR_WINDOW,
    RED_SQL,
    RULES,
    SECTORS,
    TOTAL_ROWS,
    WIDGETS_SQL,
    Inputs,
    check,
    region_rate,
    with_views,
)
from .windows import brand_daily

ORDER = ("mailboxid", "orderdate", "orderid")
ORDER_SQL = """SELECT {distinct} mailboxid, orderdate, orderid, CAST(sum(itemquantity) AS DOUBLE) AS item_count,
  CAST(sum(itemprice * itemquantity) AS DOUBLE) AS pq FROM fact_items GROUP BY 1, 2, 3"""


def as_double(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({name: F.col(name).cast("double") for name in names})


@check("a1_order_rollup", with_views(ORDER_SQL.format(distinct="")))
def order_rollup(t: Inputs) -> DataFrame:
    return as_double(rollup.order_rollup(t.sales.items, ORDER), "item_count", "pq")


def map_members(t: Inputs) -> DataFrame:
    return scope.active_members(t.sales.cohort, t.sales.mailbox_zip, geo.mailbox_zip_prefix(F.col("shiptozip")))


def sector_items(t: Inputs) -> DataFrame:
    return scope.in_sectors(t.sales.items, t.sales.merchant_sector, SECTORS)


def map_orders(t: Inputs) -> DataFrame:
    """Orders of the map scope; dates without a panel size leave as in the published join."""
    rows = rollup.geo_order_rollup(sector_items(t), map_members(t), geo.zip_regions(t.sales.geo))
    return rollup.with_panel(rows, t.sales.panel)


@check(
    "a2_order_rollup_with_geography",
    with_views(
        """SELECT mailboxid, orderdate, orderid, zip, msa, state_abbrev, max(panel) AS panel,
  CAST(max(ordertotal) AS DOUBLE) AS ordertotal, CAST(sum(itemquantity) AS DOUBLE) AS item_count,
  CAST(sum(itemprice * itemquantity) AS DOUBLE) AS pq FROM map_rows GROUP BY 1, 2, 3, 4, 5, 6""",
        MAP_ROWS,
    ),
)
def order_rollup_with_geography(t: Inputs) -> DataFrame:
    return as_double(map_orders(t).drop("ordertotal_estimate"), "ordertotal", "item_count", "pq")


@check("a3_distinct_on_grouped", with_views(ORDER_SQL.format(distinct="DISTINCT")))
def distinct_on_grouped(t: Inputs) -> DataFrame:
    return as_double(rollup.order_rollup(t.sales.items, ORDER).distinct(), "item_count", "pq")


@check(
    "a4_daily_rollup",
    with_views("SELECT brand, orderdate, panel, ordercount, item_count, pq FROM daily", DAILY_ALL),
)
def daily_rollup(t: Inputs) -> DataFrame:
    return brand_daily(t).select("brand", "orderdate", "panel", "ordercount", "item_count", "pq")


@check(
    "a5_per_thousand_panel",
    with_views("SELECT brand, orderdate, pnl_ordercount, pnl_itemcount, pnlpq FROM daily", DAILY_ALL),
)
def per_thousand_panel(t: Inputs) -> DataFrame:
    return brand_daily(t).select("brand", "orderdate", "pnl_ordercount", "pnl_itemcount", "pnlpq")


@check(
    "a6_per_ten_thousand_with_floor",
    with_views("""SELECT merchant, orderdate, coalesce(CAST(sum(CASE WHEN itemquantity > 10 THEN itemprice END) AS DOUBLE)
  * 10000.0::DOUBLE / CAST(max(panel) AS DOUBLE), 0.0001::DOUBLE) AS rate
  FROM fact_items JOIN panel_by_date ON orderdate = date GROUP BY 1, 2"""),
)
def per_ten_thousand_with_floor(t: Inputs) -> DataFrame:
    sums = t.sales.items.groupBy("merchant", "orderdate").agg(
        F.sum(F.when(F.col("itemquantity") > 10, F.col("itemprice"))).alias("sales")
    )
    rate = or_else(per_panel(F.col("sales"), F.col("panel"), 10000), NORMALISED_FLOOR)
    return rollup.with_panel(sums, t.sales.panel).select("merchant", "orderdate", rate.alias("rate"))


def event_orders(t: Inputs) -> DataFrame:
    kinds = [
        (rule.brand, rule_holds(rule) & F.col("orderdate").between(F.lit(first), F.lit(last)))
        for rule, (first, last) in ((ADDS, ADD_DAYS), (CANCELS, CANCEL_DAYS))
    ]
    orders = tag_each(t.events.items.filter("merchant = 'Streamer'"), kinds, "event_kind")
    members = scope.active_members(
        t.events.cohort, t.events.mailbox_zip, geo.mailbox_zip_padded(F.col("shiptozip"))
    )
    regions = geo.zip_regions(t.events.geo, geo.mailbox_zip_padded)
    distinct_orders = orders.select("event_kind", *ORDER).distinct()
    return geo.with_region(scope.keep_members(distinct_orders, members), regions)


def event_rows(kind: str, patterns: str, first: str, last: str) -> str:
    return f"""SELECT DISTINCT '{kind}' AS event_kind, f.mailboxid, orderdate, orderid, z.zip, g.msa, g.state_abbrev, panel
  FROM fact_events f JOIN event_panel p ON f.orderdate = p.date
  JOIN event_cohort c ON f.mailboxid = c.mailboxid AND f.orderdate = c.udate
  JOIN single_zip z ON f.mailboxid = z.mailboxid LEFT JOIN zip_msa g ON z.zip = g.zip
  WHERE merchant = 'Streamer' AND ({patterns}) AND orderdate BETWEEN DATE '{first}' AND DATE '{last}'"""


EVENT_ROWS = (
    "event_rows AS ("
    + event_rows("adds", "itemdescription ILIKE 'SIGN%' OR itemdescription ILIKE '%CHASE'", "2024-01-01", "2024-01-30")
    + "\n  UNION ALL "
    + event_rows("cancels", "itemdescription ILIKE 'ERR%'", "2024-01-20", "2024-01-26")
    + ")"
)
EVENT_RATES = """event_rates AS (
  SELECT event_kind, orderdate, msa, state_abbrev,
         CAST(round(count(DISTINCT orderid), 4) AS DOUBLE) * 10000.0::DOUBLE / CAST(max(panel) AS DOUBLE) AS ordercount
  FROM event_rows GROUP BY 1, 2, 3, 4)"""


@check("a7_normalised_order_count", with_views("SELECT * FROM event_rates", EVENT_ROWS, EVENT_RATES))
def normalised_order_count(t: Inputs) -> DataFrame:
    rates = churn.daily_event_rates(event_orders(t), t.events.panel)
    return rates.select("event_kind", "orderdate", "msa", "state_abbrev", "ordercount")


@check(
    "a8_revenue",
    with_views("SELECT merchant, CAST(sum(itemprice * itemquantity) AS DOUBLE) AS revenue FROM fact_items GROUP BY 1"),
)
def revenue(t: Inputs) -> DataFrame:
    return t.sales.items.groupBy("merchant").agg(rollup.revenue().cast("double").alias("revenue"))


@check(
    "a9_order_total_estimate",
    with_views(
        """SELECT mailboxid, orderdate, orderid, zip, msa, state_abbrev,
  CASE WHEN CAST(sum(ordertotal) AS DOUBLE) / count(ordertotal) >= CAST(sum(itemprice) AS DOUBLE)
       THEN CAST(sum(ordertotal) AS DOUBLE) / count(ordertotal)
       ELSE CAST(sum(itemprice) AS DOUBLE) END AS ordertotal_estimate
  FROM map_rows GROUP BY 1, 2, 3, 4, 5, 6""",
        MAP_ROWS,
    ),
)
def order_total_estimate(t: Inputs) -> DataFrame:
    return map_orders(t).select(*ORDER, "zip", "msa", "state_abbrev", "ordertotal_estimate")


@check(
    "a10_singleton_keys",
    with_views("SELECT mailboxid, count(*) AS n FROM userzips GROUP BY 1 HAVING count(*) = 1"),
)
def singleton_keys(t: Inputs) -> DataFrame:
    return scope.single_address_mailboxes(t.sales.mailbox_zip).select("mailboxid", F.lit(1).cast("long").alias("n"))


WEEK_SQL = "CAST(date_trunc('week', orderdate + 1) - INTERVAL 1 DAY AS DATE)"


def item_orders_sql(extra: str = "merchant, itemdescription") -> str:
    """Distinct orders per week and item of the four rules, the first with its singleton test."""
    branches = []
    for brand, condition in (("Red", RED_SQL), ("Blue", BLUE_SQL), ("Old", OLD_SQL), ("Widgets", WIDGETS_SQL)):
        having = ""
        if brand == "Red":
            having = """ HAVING (count(DISTINCT orderid) = 1 AND (itemdescription ILIKE 'RED W%'
              OR itemdescription ILIKE '%GEAR')) OR count(DISTINCT orderid) > 1"""
        branches.append(
            f"""SELECT {WEEK_SQL} AS odate, '{brand}' AS brand, {extra}, count(DISTINCT orderid) AS order_count
            FROM fact_items WHERE merchant IN (SELECT merchant FROM sector_merchants) AND {condition}
            GROUP BY ALL{having}"""
        )
    return " UNION ALL ".join(branches)


@check("a11_singleton_rule", with_views(item_orders_sql()))
def singleton_rule(t: Inputs) -> DataFrame:
    counts = share.weekly_item_orders(tag_brands(t.sales.items, RULES))
    return share.drop_unconfirmed_singletons(scope.in_sectors(counts, t.sales.merchant_sector, SECTORS), RULES)


@check("a11_singleton_rule_by_item", with_views(item_orders_sql("itemdescription")))
def singleton_rule_by_item(t: Inputs) -> DataFrame:
    counts = share.weekly_item_orders(tag_brands(sector_items(t), RULES), ("odate", "brand", "itemdescription"))
    return share.drop_unconfirmed_singletons(counts, RULES)


@check(
    "a12_semi_additive_count",
    with_views(f"""SELECT odate, brand, CAST(sum(order_count) AS BIGINT) AS order_count
  FROM ({item_orders_sql()}) GROUP BY 1, 2"""),
)
def semi_additive_count(t: Inputs) -> DataFrame:
    return share.weekly_brand_orders(singleton_rule(t))


@check("a13_global_max", with_views("SELECT max(orderdate) AS latest FROM fact_items"))
def global_max(t: Inputs) -> DataFrame:
    return timeframe.calendar_of(t.sales.items).agg(F.max("orderdate").alias("latest"))


@check("a14_max_per_key", with_views("SELECT date, panel FROM panel_by_date"))
def max_per_key(t: Inputs) -> DataFrame:
    return rollup.panel_by_date(t.sales.panel)


@check(
    "a15_distinct_projection",
    with_views("SELECT DISTINCT orderdate FROM fact_items"),
)
def distinct_projection(t: Inputs) -> DataFrame:
    return timeframe.calendar_of(t.sales.items)


def window_zip_totals(t: Inputs, shift: int) -> DataFrame:
    latest = timeframe.latest_day(timeframe.calendar_of(t.sales.items))
    items = sector_items(t).filter(timeframe.in_trailing_window(latest, shift=shift))
    return rollup.zip_totals(tag_brands(items, [ALL]), map_members(t), t.sales.panel)


@check(
    "a16_region_window_total",
    with_views(
        "SELECT 'All' AS brand, msa, rate FROM current_rate",
        MAP_ROWS,
        region_rate("current_rate", f"merchant NOT IN ('Supplier#000000001', 'Supplier#000000002') AND {CURRENT_WINDOW}"),
    ),
)
def region_window_total(t: Inputs) -> DataFrame:
    totals = rollup.region_totals(window_zip_totals(t, 0), geo.zip_regions(t.sales.geo))
    return rollup.window_rate(totals, ["brand", "msa"])


@check(
    "a17_global_window_total",
    with_views(
        "SELECT 'All' AS brand, rate AS total FROM prior_rate",
        TOTAL_ROWS,
        region_rate(
            "prior_rate",
            f"merchant NOT IN ('Supplier#000000001', 'Supplier#000000002') AND {PRIOR_WINDOW}",
            "'All'",
            "total_rows",
        ),
    ),
)
def global_window_total(t: Inputs) -> DataFrame:
    return rollup.window_rate(window_zip_totals(t, timeframe.YEAR_SHIFT), ["brand"]).withColumnRenamed("rate", "total")


@check(
    "a18_state_total_of_daily_rates",
    with_views(
        """SELECT event_kind, state_abbrev, list_reduce(list_sort(list(ordercount) FILTER (WHERE ordercount IS NOT NULL)), lambda a, b: a + b) AS volume
  FROM event_rates GROUP BY 1, 2""",
        EVENT_ROWS,
        EVENT_RATES,
    ),
)
def state_total_of_daily_rates(t: Inputs) -> DataFrame:
    return churn.state_volume(churn.daily_event_rates(event_orders(t), t.events.panel))
