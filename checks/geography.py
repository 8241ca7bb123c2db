"""Joins of the maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmetrics.functions import first_five
from panelmetrics.operators import churn, geo, rollup, scope
from panelmetrics.operators.rules import tag_brands, tag_each
from panelmetrics.operators.timeframe import YEAR_SHIFT, calendar_of, in_trailing_window, latest_day
from panelmetrics.session import settle

from .aggregates import EVENT_RATES, EVENT_ROWS, event_orders, map_members, sector_items, window_zip_totals
from .base import (
    ALL_SQL,
    BLUE_ALL,
    BLUE_ALL_SQL,
    CURRENT_WINDOW,
    MAP_ROWS,
    PRIOR_WINDOW,
    RED_ALL,
    RED_ALL_SQL,
    TOTAL_ROWS,
    Inputs,
    check,
    region_rate,
    with_views,
)

CURRENT_SQL = region_rate("cur", f"{ALL_SQL} AND {CURRENT_WINDOW}")
PRIOR_SQL = region_rate("lst", f"{ALL_SQL} AND {PRIOR_WINDOW}")
RED_RATE_SQL = region_rate("red", f"{RED_ALL_SQL} AND {CURRENT_WINDOW}")
BLUE_RATE_SQL = region_rate("blue", f"{BLUE_ALL_SQL} AND {CURRENT_WINDOW}")
MERGED_SQL = """merged AS (SELECT coalesce(cur.msa, lst.msa) AS msa, cur.rate AS current, lst.rate AS prior
  FROM cur FULL OUTER JOIN lst ON cur.msa = lst.msa)"""
TOTAL_SQL = region_rate("ttl", f"{ALL_SQL} AND {PRIOR_WINDOW}", "'xx'", "total_rows")
MAP_CTES = (MAP_ROWS, TOTAL_ROWS, CURRENT_SQL, PRIOR_SQL, MERGED_SQL, TOTAL_SQL)


@check(
    "j8_geography_enrichment",
    with_views("""SELECT u.mailboxid, substring(shiptozip, 1, 5) AS zip, msa, state_abbrev
  FROM userzips u LEFT JOIN zip_msa g ON substring(u.shiptozip, 1, 5) = g.zip"""),
)
def geography_enrichment(t: Inputs) -> DataFrame:
    zips = t.sales.mailbox_zip.select("mailboxid", first_five(F.col("shiptozip")).alias("zip"))
    return geo.with_each_region(zips, geo.zip_regions(t.sales.geo))


def period_rates(t: Inputs) -> DataFrame:
    """Region rates of the trailing window and of the same window a year before, one pass."""
    latest = latest_day(calendar_of(t.sales.items))
    periods = [("current", in_trailing_window(latest)), ("prior", in_trailing_window(latest, shift=YEAR_SHIFT))]
    items = tag_each(scope.drop_merchants(sector_items(t), ("Supplier#000000001", "Supplier#000000002")), periods, "period")
    by_zip = rollup.zip_totals(items, map_members(t), t.sales.panel, by=["period"])
    return rollup.window_rate(rollup.region_totals(by_zip, geo.zip_regions(t.sales.geo)), ["period", "msa"])


def merged_periods(t: Inputs) -> DataFrame:
    rates = settle(period_rates(t))
    current, prior = (
        rates.filter(F.col("period") == period).select("msa", F.col("rate").alias(period))
        for period in ("current", "prior")
    )
    return geo.outer_merge(current, prior)


@check("j10_period_merge", with_views("SELECT * FROM merged", *MAP_CTES))
def period_merge(t: Inputs) -> DataFrame:
    return merged_periods(t)


def merged_brands(t: Inputs) -> DataFrame:
    latest = latest_day(calendar_of(t.sales.items))
    items = tag_brands(sector_items(t).filter(in_trailing_window(latest)), [RED_ALL, BLUE_ALL])
    by_zip = rollup.zip_totals(items, map_members(t), t.sales.panel)
    rates = settle(rollup.window_rate(rollup.region_totals(by_zip, geo.zip_regions(t.sales.geo)), ["brand", "msa"]))
    red, blue = (
        rates.filter(F.col("brand") == brand).select("msa", F.col("rate").alias(brand.lower()))
        for brand in ("Red", "Blue")
    )
    return geo.outer_merge(red, blue)


BRANDS_SQL = """brands AS (SELECT coalesce(red.msa, blue.msa) AS msa, red.rate AS red, blue.rate AS blue
  FROM red FULL OUTER JOIN blue ON red.msa = blue.msa)"""
BRAND_CTES = (MAP_ROWS, RED_RATE_SQL, BLUE_RATE_SQL, BRANDS_SQL)


@check("j11_brand_merge", with_views("SELECT * FROM brands", *BRAND_CTES))
def brand_merge(t: Inputs) -> DataFrame:
    return merged_brands(t)


VOLUME_SQL = """volume AS (SELECT event_kind, state_abbrev,
  list_reduce(list_sort(list(ordercount) FILTER (WHERE ordercount IS NOT NULL)), lambda a, b: a + b) AS volume FROM event_rates GROUP BY 1, 2)"""
CANCEL_ADD_SQL = with_views(
    """SELECT * FROM (SELECT a.state_abbrev, a.volume AS adds, c.volume AS cancels,
    c.volume / nullif(a.volume, 0) * 100 AS cncl_share
  FROM (SELECT * FROM volume WHERE event_kind = 'adds') a
  LEFT JOIN (SELECT * FROM volume WHERE event_kind = 'cancels') c ON a.state_abbrev = c.state_abbrev)
  WHERE cncl_share > 0""",
    EVENT_ROWS,
    EVENT_RATES,
    VOLUME_SQL,
)


@check("j13_adds_with_cancels", CANCEL_ADD_SQL)
def adds_with_cancels(t: Inputs) -> DataFrame:
    volume = settle(churn.state_volume(churn.daily_event_rates(event_orders(t), t.events.panel)))
    return churn.cancel_add_ratio(volume.filter("event_kind = 'adds'"), volume.filter("event_kind = 'cancels'"))


def prior_total(t: Inputs) -> DataFrame:
    rate = rollup.window_rate(window_zip_totals(t, YEAR_SHIFT), ["brand"])
    return rate.select(F.col("rate").alias("total"))


@check("j14_scalar_attach", with_views("SELECT msa, current, rate AS total FROM merged, ttl", *MAP_CTES))
def scalar_attach(t: Inputs) -> DataFrame:
    return geo.attach_scalar(merged_periods(t).select("msa", "current"), prior_total(t))


@check(
    "j15_region_to_counties",
    with_views(
        """SELECT lpad(coalesce(z.fips, ''), 5, '0') AS fips, z.msa, current, prior
  FROM (SELECT DISTINCT fips, msa FROM zip_level_info) z JOIN merged m ON z.msa = m.msa""",
        *MAP_CTES,
    ),
)
def region_to_counties(t: Inputs) -> DataFrame:
    return geo.to_counties(merged_periods(t), t.sales.geo)
