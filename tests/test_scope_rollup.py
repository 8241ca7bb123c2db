import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from panelmetrics.operators import geo, rollup, scope, timeframe
from panelmetrics.operators.rules import BrandRule, Clause, tag_brands

D = dt.date.fromisoformat
ANY = BrandRule("Any", (Clause(("%",)),))


def rows_of(frame, *columns):
    return sorted(tuple(row) for row in frame.select(*columns).collect())


def test_single_address_mailboxes(spark, make_tables):
    zips = make_tables(
        mailbox_zip=[(1, "10001-1"), (2, "20002"), (2, "20002"), (3, None), (None, "30003")]
    ).mailbox_zip
    assert rows_of(scope.single_address_mailboxes(zips).na.fill("none"), "mailboxid", "shiptozip") == [
        (1, "10001-1"),
        (3, "none"),
    ]


def test_merchant_lists_do_not_multiply_rows(make_tables, item):
    t = make_tables(
        items=[item("2020-01-01", merchant="A"), item("2020-01-01", merchant="B"), item("2020-01-01", merchant=None)],
        quality_merchants=[("A",), ("A",), ("B",)],
        merchant_sector=[("A", "Food"), ("A", "Mass"), ("B", "Cars")],
    )
    assert rows_of(scope.in_quality_merchants(t.items, t.quality_merchants), "merchant") == [("A",), ("B",)]
    assert rows_of(scope.in_sectors(t.items, t.merchant_sector, ["Food", "Mass"]), "merchant") == [("A",)]
    both = scope.eligible_merchants(t.merchant_sector, ["Food", "Mass", "Cars"], t.quality_merchants)
    assert rows_of(scope.in_merchants(t.items, both), "merchant") == [("A",), ("B",)]


def test_years_with_orders_since_a_midyear_date(make_tables, item):
    t = make_tables(
        items=[item("2018-03-01"), item("2019-08-01")],
        cohort=[(1, D("2018-05-01"), "all"), (1, D("2019-02-01"), "all"), (1, D("2020-01-01"), "all")],
    )
    kept = scope.cohort_in_fact_years(t.cohort, timeframe.calendar_of(t.items), D("2018-07-01"))
    assert rows_of(kept, "udate") == [(D("2019-02-01"),)]


def test_a_mailbox_in_two_cohorts_doubles_sums_but_not_orders(make_tables, item):
    t = make_tables(
        items=[item("2020-01-01", order=7, price=3), item("2020-01-01", order=8, price=4), item("2020-01-02", order=9)],
        panel=[(D("2020-01-01"), 100), (D("2020-01-01"), 200), (D("2020-01-02"), 50)],
        cohort=[(1, D("2020-01-01"), "all"), (1, D("2020-01-01"), "urgent")],
        mailbox_zip=[(1, "10001")],
    )
    members = scope.active_members(t.cohort, t.mailbox_zip)
    orders = rollup.order_rollup(tag_brands(t.items, [ANY]))
    daily = rollup.daily_rollup(scope.keep_members(orders, members), t.panel).collect()
    assert len(daily) == 1
    assert (daily[0].ordercount, daily[0].item_count, daily[0].pq, daily[0].panel) == (2.0, 4.0, 14.0, 200)
    assert daily[0].pnl_ordercount == 10.0


def test_carrying_copies_equals_joining_every_cohort_row(spark, make_tables, item):
    import random

    random.seed(5)
    days = [D("2020-01-01") + dt.timedelta(days=n) for n in range(5)]
    t = make_tables(
        items=[
            item(random.choice(days), mailbox=random.randrange(6), order=random.randrange(20), price=random.randrange(9))
            for _ in range(200)
        ],
        panel=[(day, 100 + n) for n, day in enumerate(days)],
        cohort=[(random.randrange(6), random.choice(days), random.choice("ab")) for _ in range(40)],
        mailbox_zip=[(n, "1") for n in range(5)],
    )
    orders = rollup.order_rollup(tag_brands(t.items, [ANY]))
    mine = rollup.daily_rollup(scope.keep_members(orders, scope.active_members(t.cohort, t.mailbox_zip)), t.panel)
    joined = (
        t.items.join(t.cohort.withColumnRenamed("udate", "orderdate"), ["mailboxid", "orderdate"])
        .join(t.mailbox_zip, "mailboxid")
        .groupBy("orderdate")
        .agg(
            F.countDistinct("orderid").cast("double").alias("ordercount"),
            F.sum("itemquantity").cast("double").alias("item_count"),
            F.sum(F.col("itemprice") * F.col("itemquantity")).cast("double").alias("pq"),
        )
    )
    columns = ("orderdate", "ordercount", "item_count", "pq")
    assert rows_of(mine, *columns) == rows_of(joined, *columns)


@pytest.mark.parametrize(
    ("totals", "prices", "expected"),
    [((10, 10), (4, 4), 10.0), ((8, 8), (5, 5), 10.0), ((None, None), (2, 3), 5.0), ((5, 5), (None, None), None)],
)
def test_order_total_estimate(make_tables, item, totals, prices, expected):
    t = make_tables(
        items=[item("2020-01-01", price=p, total=total) for p, total in zip(prices, totals)],
        cohort=[(1, D("2020-01-01"), "all")],
        mailbox_zip=[(1, "10001")],
    )
    members = scope.active_members(t.cohort, t.mailbox_zip)
    row = rollup.geo_order_rollup(t.items, members, geo.zip_regions(t.geo)).first()
    assert row.ordertotal_estimate == expected
    assert row.msa is None


def test_geography_rows_multiply_like_a_join(make_tables, item):
    t = make_tables(
        items=[item("2020-01-01", price=5)],
        panel=[(D("2020-01-01"), 100)],
        cohort=[(1, D("2020-01-01"), "all")],
        mailbox_zip=[(1, "00042-9")],
        geo=[("42", "1", "X", "NY"), ("42", "1", "X", "NY"), ("00042", "2", "Y", "NY")],
    )
    members = scope.active_members(t.cohort, t.mailbox_zip, geo.mailbox_zip_prefix(F.col("shiptozip")))
    regions = geo.zip_regions(t.geo)
    orders = rollup.geo_order_rollup(t.items, members, regions)
    assert rows_of(orders, "msa", F.col("pq").cast("double")) == [("X", 10.0), ("Y", 5.0)]
    totals = rollup.region_totals(rollup.zip_totals(tag_brands(t.items, [ANY]), members, t.panel), regions)
    assert rows_of(rollup.window_rate(totals, ["brand", "msa"]), "msa", "rate") == [("X", 1000.0), ("Y", 500.0)]


def test_a_window_without_rows_has_no_total(make_tables):
    t = make_tables()
    members = scope.active_members(t.cohort, t.mailbox_zip)
    totals = rollup.zip_totals(tag_brands(t.items, [ANY]), members, t.panel)
    assert rollup.window_rate(totals, ["brand"]).count() == 0


def test_a_window_without_prices_gets_the_floor(make_tables, item):
    t = make_tables(
        items=[item("2020-01-01", price=None)],
        panel=[(D("2020-01-01"), 100)],
        cohort=[(1, D("2020-01-01"), "all")],
        mailbox_zip=[(1, "1")],
    )
    members = scope.active_members(t.cohort, t.mailbox_zip)
    totals = rollup.zip_totals(tag_brands(t.items, [ANY]), members, t.panel)
    assert rollup.window_rate(totals, ["brand"]).first().rate == 0.0001


def test_trailing_window_bounds(make_tables, item):
    last = D("2020-08-31")
    offsets = (0, 2, 3, 33, 34, 366, 367, 397, 398)
    items = make_tables(items=[item(last - dt.timedelta(days=n), order=n) for n in offsets]).items
    latest = timeframe.latest_day(timeframe.calendar_of(items))
    assert rows_of(items.filter(timeframe.in_trailing_window(latest)), "orderid") == [(3,), (33,)]
    shifted = items.filter(timeframe.in_trailing_window(last, shift=timeframe.YEAR_SHIFT))
    assert rows_of(shifted, "orderid") == [(367,), (397,)]
    assert rows_of(items.filter(timeframe.settled_by(latest)), "orderid") == [(n,) for n in offsets[2:]]
    assert items.filter(timeframe.settled_by(None)).count() == 0


def test_quarters_by_date_range(spark, make_tables, item):
    items = make_tables(items=[item("2020-03-31", order=1), item("2020-04-01", order=2), item("2020-07-01", order=3)]).items
    quarters = spark.createDataFrame(
        [(D("2020-01-01"), D("2020-03-31")), (D("2020-04-01"), D("2020-06-30"))], "quarterstart date, quarterend date"
    )
    assert rows_of(timeframe.in_quarters(items, quarters), "orderid", "quarterstart") == [
        (1, D("2020-01-01")),
        (2, D("2020-04-01")),
    ]


def test_sums_stay_exact_in_decimals(make_tables, item):
    items = make_tables(items=[item("2020-01-01", quantity="0.03", price="0.07") for _ in range(1000)]).items
    row = rollup.order_rollup(items, ("orderid",)).first()
    assert (row.item_count, row.pq) == (Decimal("30.00"), Decimal("2.1000"))
