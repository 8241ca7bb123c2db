import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelmetrics.operators import share, smooth, yoy
from panelmetrics.operators.rules import BrandRule, Clause, tag_brands

D = dt.date.fromisoformat
SATURDAY = D("2020-01-04")


@pytest.fixture(scope="module")
def daily(spark):
    """A brand's daily frame from {date: value}; every measure holds the value."""

    def make(values, brand="B"):
        rows = [(brand, day, *[float(v)] * 6) for day, v in values.items()]
        names = ("pq", "pnlpq", "ordercount", "pnl_ordercount", "item_count", "pnl_itemcount")
        return spark.createDataFrame(rows, "brand string, orderdate date, " + ", ".join(f"{n} double" for n in names))

    return make


def sums(frame):
    return {row.orderdate: row.pnlpq_dma7 for row in frame.collect()}


def test_frame_counts_rows_not_days(daily):
    frame = daily({D("2020-01-01"): 1, D("2020-01-02"): 1, D("2020-01-20"): 1})
    assert sums(smooth.trailing_sums(frame)) == {D("2020-01-01"): 1, D("2020-01-02"): 2, D("2020-01-20"): 3}


def test_three_smoothings_differ(spark, daily):
    days = {SATURDAY + dt.timedelta(days=n): n for n in range(56)}
    last = SATURDAY + dt.timedelta(days=49)
    frame = daily(days)
    assert sums(smooth.trailing_anchor_rows(frame))[last] == sum(range(7, 50, 7))
    assert sums(smooth.trailing_observed_days(frame))[last] == sum(range(43, 50))
    gone = [44, 45]
    sparse = daily({day: n for day, n in days.items() if n not in gone})
    spine = spark.createDataFrame([("B", day) for day in days], "brand string, orderdate date")
    assert sums(smooth.trailing_observed_days(sparse))[last] == sum(range(41, 50)) - sum(gone)
    over_spine = sums(smooth.trailing_calendar_days(sparse, spine))
    assert over_spine[last] == sum(range(43, 50)) - sum(gone)
    assert len(over_spine) == 56
    assert all(day.isoweekday() == 6 for day in sums(smooth.trailing_observed_days(frame)))


def test_a_spine_date_before_any_sales_sums_to_null(spark, daily):
    spine = spark.createDataFrame([("B", D("2020-01-01")), ("B", D("2020-01-02"))], "brand string, orderdate date")
    assert sums(smooth.trailing_calendar_days(daily({D("2020-01-02"): 5}), spine)) == {
        D("2020-01-01"): None,
        D("2020-01-02"): 5,
    }


def test_brands_are_smoothed_apart(daily):
    frame = daily({SATURDAY: 1}).unionByName(daily({SATURDAY: 10}, "C"))
    assert {(r.brand, r.pnlpq_dma7) for r in smooth.trailing_sums(frame).collect()} == {("B", 1.0), ("C", 10.0)}


def test_prior_year_is_fifty_two_weeks_back(spark):
    schema = "brand string, orderdate date, pnlpq_dma7 double, pnlvol_dma7 double, pnlitems_dma7 double"
    this, last = SATURDAY, SATURDAY - dt.timedelta(days=364)
    frame = spark.createDataFrame(
        [("B", this, 90.0, 10.0, 30.0), ("B", last, 40.0, 8.0, 16.0), ("B", this - dt.timedelta(days=7), 1.0, 1.0, 1.0)],
        schema,
    )
    paired = yoy.with_prior_year(frame, frame)
    row = yoy.weekly_metrics(paired).collect()
    assert len(row) == 1
    row = row[0]
    assert row.weekstart == this - dt.timedelta(days=6)
    assert (row.yy_sales, row.yy_txns) == (1.25, 0.25)
    assert (row.avgitems, row.yy_avgitems) == (3.0, 0.5)
    assert row.avgprice == 3.0
    assert row.yy_avgprice == pytest.approx(3.0 / 2.5 - 1)
    legacy = yoy.weekly_metrics(paired, legacy_price_yoy=True).first()
    assert legacy.yy_avgprice == pytest.approx(3.0 / 2.0 - 1)


STRICT = BrandRule("Red", (Clause(("RED %",)),), singleton_any_of=("RED W%",))
LOOSE = BrandRule("Blue", (Clause(("BLUE %",)),))


def test_singletons_need_their_stricter_patterns(make_tables, item):
    day = "2020-01-07"
    items = make_tables(
        items=[
            item(day, "red widget", order=1),
            item(day, "red ring", order=1),
            item(day, "red gear", order=1),
            item(day, "red gear", order=2),
            item(day, "blue ring", order=3),
        ]
    ).items
    counts = share.weekly_item_orders(tag_brands(items, [STRICT, LOOSE]))
    kept = share.drop_unconfirmed_singletons(counts, [STRICT, LOOSE]).collect()
    assert {(r.itemdescription, r.order_count) for r in kept} == {("red widget", 1), ("red gear", 2), ("blue ring", 1)}


def test_an_order_with_two_item_texts_counts_twice(make_tables, item):
    items = make_tables(items=[item("2020-01-07", "blue ring"), item("2020-01-07", "blue rod")]).items
    weekly = share.weekly_brand_orders(share.weekly_item_orders(tag_brands(items, [LOOSE]))).collect()
    assert [(r.odate, r.order_count) for r in weekly] == [(D("2020-01-05"), 2)]


def test_shares_add_up_to_one(spark):
    frame = spark.range(1000).select(
        (F.col("id") % 7).alias("odate"), F.col("id").alias("brand"), (F.col("id") * 13 % 101 + 1).alias("n")
    )
    weekly = share.share_within(frame, "n", ["odate"]).groupBy("odate").agg(F.sum("perc").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in weekly)
    assert share.share_of_total(frame, "n").agg(F.sum("perc")).first()[0] == pytest.approx(1)


def test_a_brand_missing_a_week_is_null_there(spark):
    one, two = D("2020-01-05"), D("2020-01-12")
    shares = spark.createDataFrame([(one, "A", 0.4), (one, "B", 0.6), (two, "A", 1.0)], "odate date, brand string, perc double")
    wide = {r.odate: (r.A, r.B, r.C) for r in share.brand_columns(shares, ["A", "B", "C"]).collect()}
    assert wide == {one: (0.4, 0.6, None), two: (1.0, None, None)}
