"""Projections, filters and predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmetrics.functions import any_like, falls_on, month_first_date, ratio
from panelmetrics.operators import scope, timeframe
from panelmetrics.operators.rules import Clause, clause_holds, rule_holds, tag_brands
from panelmetrics.plans.reports import HORIZON_DAYS

from .base import (
    ADDS,
    CANCELS,
    EXCLUDED,
    EXCLUDED_SQL,
    LOOSE,
    OLD,
    OLD_SQL,
    RULES,
    SECTORS,
    SECTORS_SQL,
    TODAY,
    WIDGETS,
    Inputs,
    check,
    with_views,
)

ITEM = ("orderid", "orderdate", "merchant", "itemdescription")
ITEM_SQL = "SELECT orderid, orderdate, merchant, itemdescription FROM fact_items WHERE "


@check("p1_constant_tag", with_views("SELECT 'Red' AS brand, orderid, itemdescription FROM fact_items"))
def constant_tag(t: Inputs) -> DataFrame:
    return t.sales.items.select(F.lit("Red").alias("brand"), "orderid", "itemdescription")


@check(
    "p2_derived_projection",
    with_views("""SELECT orderid, CAST(itemprice AS DOUBLE) / CAST(nullif(itemquantity, 0) AS DOUBLE) AS unit_price,
  CAST(ordertotal AS DOUBLE) / CAST(nullif(itemprice, 0) AS DOUBLE) - 1 AS excess FROM fact_items"""),
)
def derived_projection(t: Inputs) -> DataFrame:
    return t.sales.items.select(
        "orderid",
        ratio(F.col("itemprice"), F.col("itemquantity")).alias("unit_price"),
        (ratio(F.col("ordertotal"), F.col("itemprice")) - 1).alias("excess"),
    )


@check("p3_equality_filter", with_views(ITEM_SQL + "merchant = 'Supplier#000000005'"))
def equality_filter(t: Inputs) -> DataFrame:
    return t.sales.items.filter(F.col("merchant") == LOOSE).select(*ITEM)


@check("p4_in_list", with_views(f"SELECT merchant, sector FROM sector_all WHERE sector IN {SECTORS_SQL}"))
def in_list(t: Inputs) -> DataFrame:
    return t.sales.merchant_sector.filter(F.col("sector").isin(*SECTORS)).select("merchant", "sector")


@check("p5_not_in_list", with_views(ITEM_SQL + f"merchant NOT IN {EXCLUDED_SQL}"))
def not_in_list(t: Inputs) -> DataFrame:
    return scope.drop_merchants(t.sales.items, EXCLUDED).select(*ITEM)


@check(
    "p6_case_insensitive_like",
    with_views(ITEM_SQL + "(itemdescription ILIKE 'RED %' OR itemdescription ILIKE 'Blue Widget')"),
)
def case_insensitive_like(t: Inputs) -> DataFrame:
    return t.sales.items.filter(any_like(F.col("itemdescription"), ("RED %", "Blue Widget"))).select(*ITEM)


@check(
    "p7_negated_like",
    with_views(ITEM_SQL + "itemdescription NOT ILIKE 'RED %' AND itemdescription NOT ILIKE '%L%GE%'"),
)
def negated_like(t: Inputs) -> DataFrame:
    text = F.col("itemdescription")
    return t.sales.items.filter(~text.ilike("RED %") & ~text.ilike("%L%GE%")).select(*ITEM)


@check("p8_composite_rule", with_views(ITEM_SQL + OLD_SQL))
def composite_rule(t: Inputs) -> DataFrame:
    return t.sales.items.filter(rule_holds(OLD)).select(*ITEM)


@check(
    "p9_co_occurrence_rule",
    with_views(
        ITEM_SQL + "itemdescription ILIKE 'RED%' AND (itemdescription ILIKE '%WIDG%' OR itemdescription ILIKE '%R%NG')"
    ),
)
def co_occurrence_rule(t: Inputs) -> DataFrame:
    return t.sales.items.filter(clause_holds(Clause(("RED%",), and_any_of=("%WIDG%", "%R%NG")))).select(*ITEM)


@check(
    "p10_event_classifier",
    with_views("""SELECT orderid, orderdate,
  CASE WHEN itemdescription ILIKE 'SIGN%' OR itemdescription ILIKE '%CHASE' THEN 'adds' ELSE 'cancels' END AS event_kind
  FROM fact_events WHERE itemdescription ILIKE 'SIGN%' OR itemdescription ILIKE '%CHASE'
  OR itemdescription ILIKE 'ERR%' OR itemdescription ILIKE 'cancelled'"""),
)
def event_classifier(t: Inputs) -> DataFrame:
    kind = F.when(rule_holds(ADDS), "adds").when(rule_holds(CANCELS), "cancels")
    return t.events.items.select("orderid", "orderdate", kind.alias("event_kind")).filter("event_kind IS NOT NULL")


@check(
    "p11_closed_date_range",
    with_views(ITEM_SQL + "orderdate BETWEEN DATE '1998-01-01' AND DATE '1998-09-05'"),
)
def closed_date_range(t: Inputs) -> DataFrame:
    first, last = (month_first_date(F.lit(text)) for text in ("1-01-1998", "09-05-1998"))
    return t.sales.items.filter(F.col("orderdate").between(first, last)).select(*ITEM)


@check("p12_date_floor", with_views(ITEM_SQL + "orderdate >= DATE '1999-01-01'"))
def date_floor(t: Inputs) -> DataFrame:
    return t.sales.items.filter(F.col("orderdate") >= F.lit(dt.date(1999, 1, 1))).select(*ITEM)


@check(
    "p13_freshness_cut_off",
    with_views(ITEM_SQL + "orderdate <= (SELECT max(orderdate) FROM fact_items) - 3"),
)
def freshness_cut_off(t: Inputs) -> DataFrame:
    latest = timeframe.latest_day(timeframe.calendar_of(t.sales.items))
    return t.sales.items.filter(timeframe.settled_by(latest)).select(*ITEM)


@check(
    "p14_trailing_window",
    with_views(ITEM_SQL + "orderdate BETWEEN (SELECT day FROM latest) - 33 AND (SELECT day FROM latest) - 3"),
)
def trailing_window(t: Inputs) -> DataFrame:
    latest = timeframe.latest_day(timeframe.calendar_of(t.sales.items))
    return t.sales.items.filter(timeframe.in_trailing_window(latest)).select(*ITEM)


@check(
    "p15_shifted_window",
    with_views(ITEM_SQL + "orderdate BETWEEN (SELECT day FROM latest) - 397 AND (SELECT day FROM latest) - 367"),
)
def shifted_window(t: Inputs) -> DataFrame:
    latest = timeframe.latest_day(timeframe.calendar_of(t.sales.items))
    return t.sales.items.filter(timeframe.in_trailing_window(latest, shift=timeframe.YEAR_SHIFT)).select(*ITEM)


@check("p16_reporting_horizon", with_views(ITEM_SQL + "orderdate >= DATE '2001-08-01' - 10 - 455"))
def reporting_horizon(t: Inputs) -> DataFrame:
    return t.sales.items.filter(F.col("orderdate") >= F.date_sub(F.lit(TODAY), HORIZON_DAYS)).select(*ITEM)


@check("p17_weekday_anchor", with_views(ITEM_SQL + "isodow(orderdate) = 6"))
def weekday_anchor(t: Inputs) -> DataFrame:
    return t.sales.items.filter(falls_on(F.col("orderdate"), "Saturday")).select(*ITEM)


@check(
    "p18_filter_on_ratio",
    """SELECT o_orderkey, o_totalprice / 100000 - 1 AS excess FROM orders WHERE o_totalprice / 100000 - 1 > 0""",
)
def filter_on_ratio(t: Inputs) -> DataFrame:
    return t.raw("orders").select("o_orderkey", (F.col("o_totalprice") / 100000 - 1).alias("excess")).filter("excess > 0")


@check(
    "p19_slice_by_key",
    with_views("""SELECT orderid, orderdate, merchant, itemdescription FROM fact_items
  WHERE itemdescription ILIKE '%WIDGET' AND itemdescription NOT ILIKE 'RED %' AND merchant NOT IN ('Supplier#000000001')"""),
)
def slice_by_key(t: Inputs) -> DataFrame:
    return tag_brands(t.sales.items, RULES).filter(F.col("brand") == WIDGETS.brand).select(*ITEM)


@check(
    "p20_column_rename",
    with_views("SELECT mailboxid AS member, orderid AS receipt, itemdescription AS item FROM fact_items"),
)
def column_rename(t: Inputs) -> DataFrame:
    names = {"mailboxid": "member", "orderid": "receipt", "itemdescription": "item"}
    return t.sales.items.select(*names).withColumnsRenamed(names)
