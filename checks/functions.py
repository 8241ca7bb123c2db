"""Scalar functions over whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmetrics.functions import (
    blank_padded,
    first_five,
    growth,
    left_padded,
    month_first_date,
    number_padded,
    or_else,
    ratio,
    sunday_week,
    weekday_name,
    year_start,
)

from .base import TODAY, Inputs, check, with_views



def day() -> Column:
    return F.col("o_orderdate").cast("date")


DAY_SQL = "CAST(o_orderdate AS DATE)"


def order_column(t: Inputs, **columns) -> DataFrame:
    return t.raw("orders").select("o_orderkey", *[c.alias(name) for name, c in columns.items()])


@check("f1_day_arithmetic", f"SELECT o_orderkey, {DAY_SQL} - 364 AS back, {DAY_SQL} + 364 AS ahead FROM orders")
def day_arithmetic(t: Inputs) -> DataFrame:
    return order_column(t, back=F.date_sub(day(), 364), ahead=F.date_add(day(), 364))


@check(
    "f2_sunday_week",
    f"SELECT o_orderkey, CAST(date_trunc('week', {DAY_SQL} - 6) AS DATE) + 6 AS week FROM orders",
)
def sunday_weeks(t: Inputs) -> DataFrame:
    return order_column(t, week=sunday_week(day()))


@check("f3_year_start", f"SELECT o_orderkey, CAST(date_trunc('year', {DAY_SQL}) AS DATE) AS year FROM orders")
def year_starts(t: Inputs) -> DataFrame:
    return order_column(t, year=year_start(day()))


@check("f4_day_of_timestamp", "SELECT event_id, CAST(date_trunc('day', ts) AS DATE) AS day FROM events")
def day_of_timestamp(t: Inputs) -> DataFrame:
    return t.raw("events").select("event_id", F.to_date("ts").alias("day"))


@check("f5_weekday_name", f"SELECT o_orderkey, dayname({DAY_SQL}) AS weekday FROM orders")
def weekday_names(t: Inputs) -> DataFrame:
    return order_column(t, weekday=weekday_name(day()))


@check("f6_interval_arithmetic", "SELECT event_id, CAST(ts - INTERVAL 6 DAY AS DATE) AS day FROM events")
def interval_arithmetic(t: Inputs) -> DataFrame:
    return t.raw("events").select("event_id", (F.col("ts") - F.expr("INTERVAL 6 DAY")).cast("date").alias("day"))


@check(
    "f7_run_date",
    f"SELECT o_orderkey, CAST(DATE '2001-08-01' - {DAY_SQL} AS INTEGER) AS age FROM orders",
)
def run_date(t: Inputs) -> DataFrame:
    return order_column(t, age=F.date_diff(F.lit(TODAY), day()))


@check(
    "f8_casts",
    f"SELECT o_orderkey, {DAY_SQL} AS day, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS total FROM orders",
)
def casts(t: Inputs) -> DataFrame:
    return order_column(t, day=day(), total=F.col("o_totalprice").cast("decimal(12,2)").cast("double"))


@check("f9_first_five", with_views("SELECT mailboxid, substring(shiptozip, 0, 6) AS zip FROM userzips"))
def first_five_characters(t: Inputs) -> DataFrame:
    return t.sales.mailbox_zip.select("mailboxid", first_five(F.col("shiptozip")).alias("zip"))


# Customer keys are shorter and longer than five digits, and a third of them is blanked.
def code() -> Column:
    return F.when(F.col("c_mktsegment") != "BUILDING", (F.col("c_custkey") * 37).cast("string"))


CODE_SQL = "CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_custkey * 37 AS VARCHAR) END"


@check(
    "f10_pad_blank_to_zeros",
    f"SELECT c_custkey, right(concat('00000', coalesce({CODE_SQL}, '')), 5) AS code FROM customer",
)
def pad_blank_to_zeros(t: Inputs) -> DataFrame:
    return t.raw("customer").select("c_custkey", blank_padded(code()).alias("code"))


@check("f11_pad_left", f"SELECT c_custkey, lpad({CODE_SQL}, 5, '0') AS code FROM customer")
def pad_left(t: Inputs) -> DataFrame:
    return t.raw("customer").select("c_custkey", left_padded(code()).alias("code"))


@check("f12_pad_number", "SELECT c_custkey, printf('%05d', c_custkey * 37) AS code FROM customer")
def pad_number(t: Inputs) -> DataFrame:
    return t.raw("customer").select("c_custkey", number_padded(F.col("c_custkey") * 37).alias("code"))


def price() -> Column:
    return F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))


PRICE_SQL = "CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END"


@check(
    "f13_default_for_missing",
    f"""SELECT o_orderkey, coalesce({PRICE_SQL}, 0) AS zero, coalesce({PRICE_SQL}, 0.0001::DOUBLE) AS floor,
  coalesce({PRICE_SQL}, 1e-18::DOUBLE) AS tiny FROM orders""",
)
def default_for_missing(t: Inputs) -> DataFrame:
    return order_column(t, zero=or_else(price(), 0.0), floor=or_else(price(), 0.0001), tiny=or_else(price(), 1e-18))


@check(
    "f14_first_present",
    f"""SELECT o_orderkey, CASE WHEN {PRICE_SQL} IS NULL THEN CAST(o_custkey AS DOUBLE) ELSE {PRICE_SQL} END AS value
  FROM orders""",
)
def first_present(t: Inputs) -> DataFrame:
    return order_column(t, value=F.coalesce(price(), F.col("o_custkey").cast("double")))


@check(
    "f15_round",
    """SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(12,2)), 1) AS DOUBLE) AS r1,
  CAST(round(CAST(o_totalprice AS DECIMAL(12,2)) / 3, 2) AS DOUBLE) AS r2, round(o_custkey, 4) AS r4 FROM orders""",
)
def rounds(t: Inputs) -> DataFrame:
    money = F.col("o_totalprice").cast("decimal(12,2)")
    return order_column(
        t,
        r1=F.round(money, 1).cast("double"),
        r2=F.round(money.cast("double") / 3, 2),
        r4=F.round("o_custkey", 4),
    )


@check(
    "f16_epsilon_denominator",
    f"SELECT o_orderkey, 100.0::DOUBLE / (coalesce({PRICE_SQL}, 0) + 0.00001::DOUBLE) AS value FROM orders",
)
def epsilon_denominator(t: Inputs) -> DataFrame:
    return order_column(t, value=ratio(F.lit(100.0), or_else(price(), 0.0) + F.lit(0.00001)))


@check("f17_concat", "SELECT o_orderkey, o_orderstatus || '/' || o_orderpriority AS label FROM orders")
def concat(t: Inputs) -> DataFrame:
    return order_column(t, label=F.concat("o_orderstatus", F.lit("/"), "o_orderpriority"))


@check(
    "f18_guarded_division",
    """SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) AS value,
  l_quantity / nullif(l_tax, 0) - 1 AS growth FROM lineitem""",
)
def guarded_division(t: Inputs) -> DataFrame:
    return t.raw("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        ratio(F.col("l_extendedprice"), F.col("l_discount")).alias("value"),
        growth(F.col("l_quantity"), F.col("l_tax")).alias("growth"),
    )


@check(
    "f19_text_dates",
    f"""SELECT o_orderkey, {DAY_SQL} >= DATE '1998-07-01' AS recent,
  strptime(strftime({DAY_SQL}, '%m-%d-%Y'), '%m-%d-%Y')::DATE AS day FROM orders""",
)
def text_dates(t: Inputs) -> DataFrame:
    return order_column(
        t,
        recent=day() >= F.to_date(F.lit("1998-07-01")),
        day=month_first_date(F.date_format(day(), "MM-dd-yyyy")),
    )


@check(
    "f20_null_tests",
    f"SELECT o_orderkey, {PRICE_SQL} IS NULL AS missing, {PRICE_SQL} IS NOT NULL AS present FROM orders",
)
def null_tests(t: Inputs) -> DataFrame:
    return order_column(t, missing=price().isNull(), present=price().isNotNull())
