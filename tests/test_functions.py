import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelmetrics.functions import (
    blank_padded,
    ordered_sum,
    falls_on,
    first_five,
    growth,
    left_padded,
    month_first_date,
    number_padded,
    or_else,
    per_panel,
    ratio,
    sunday_week,
    weekday_name,
    year_start,
)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def day(text):
    return F.lit(dt.date.fromisoformat(text))


def test_weeks_start_on_sunday(spark):
    assert one(spark, sunday_week(day("2020-09-05"))) == dt.date(2020, 8, 30)
    assert one(spark, sunday_week(day("2020-09-06"))) == dt.date(2020, 9, 6)
    assert one(spark, sunday_week(day("2020-09-07"))) == dt.date(2020, 9, 6)


def test_every_day_of_a_decade_agrees_with_the_truncation_formula(spark):
    days = spark.range(3653).select(F.date_add(F.lit(dt.date(2015, 1, 1)), F.col("id").cast("int")).alias("d"))
    formula = F.date_add(F.date_trunc("week", F.date_sub("d", 6)).cast("date"), 6)
    assert days.filter(sunday_week(F.col("d")) != formula).count() == 0
    assert days.filter(falls_on(F.col("d"), "Saturday") != (weekday_name(F.col("d")) == "Saturday")).count() == 0


def test_year_start_and_month_first_dates(spark):
    assert one(spark, year_start(day("2020-09-05"))) == dt.date(2020, 1, 1)
    assert one(spark, month_first_date(F.lit("1-01-2016"))) == dt.date(2016, 1, 1)
    assert one(spark, month_first_date(F.lit("09-05-2020"))) == dt.date(2020, 9, 5)


def test_zip_codes(spark):
    null = F.lit(None).cast("string")
    assert one(spark, first_five(F.lit("123456789"))) == "12345"
    assert one(spark, first_five(F.lit("1234"))) == "1234"
    assert one(spark, first_five(null)) is None
    assert [one(spark, blank_padded(c)) for c in (F.lit("42"), F.lit("1234567"), null)] == ["00042", "34567", "00000"]
    assert [one(spark, left_padded(c)) for c in (F.lit("42"), F.lit("1234567"), null)] == ["00042", "12345", None]
    assert one(spark, number_padded(F.lit(1001.0))) == "01001"
    assert one(spark, number_padded(F.lit(123456))) == "123456"


def test_ratios_are_null_on_zero_and_missing(spark):
    assert one(spark, ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, ratio(F.lit(1), F.lit(4))) == 0.25
    assert one(spark, growth(F.lit(3), F.lit(2))) == 0.5
    assert one(spark, per_panel(F.lit(5), F.lit(200), 1000)) == 25.0
    assert one(spark, or_else(per_panel(F.lit(None).cast("double"), F.lit(200), 10000), 0.0001)) == 0.0001


def test_ordered_sum_ignores_row_order(spark):
    values = [0.1, 1e3, 0.2, -1e3, 0.3] * 50
    frames = [spark.createDataFrame([(v,) for v in order], "v double") for order in (values, sorted(values))]
    sums = {frame.repartition(7).agg(ordered_sum(F.col("v")).alias("s")).first().s for frame in frames}
    assert len(sums) == 1 and sums.pop() == pytest.approx(30.0, abs=1e-9)
