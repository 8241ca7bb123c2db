"""Reports on small tables: figures by hand, empty input, and the published parameters."""

import dataclasses
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelmetrics.operators.rules import BrandRule, Clause
from panelmetrics.plans import (
    WeeklySeries,
    cancel_add_by_state,
    contribution_by_county,
    gap_by_county,
    published,
    report_set,
    weekly_growth,
    weekly_market_share,
)

SATURDAY = dt.date(2020, 8, 29)
RED = BrandRule("Red", (Clause(("RED %",)),))
BLUE = BrandRule("Blue", (Clause(("BLUE %",)),))


@pytest.fixture(scope="module")
def two_years(make_tables, item):
    """One order a day for two years: sales of 10 a day, then of 20."""
    days = [SATURDAY + dt.timedelta(days=n) for n in range(-728, 4)]
    return make_tables(
        items=[
            item(day, "red widget", order=n, price=10 if n <= 364 else 20, merchant="Shop") for n, day in enumerate(days)
        ],
        panel=[(day, 1000) for day in days],
        quality_merchants=[("Shop",)],
        merchant_sector=[("Shop", "Food")],
        mailbox_zip=[(1, "10001")],
        cohort=[(1, day, "all") for day in days],
        geo=[("10001", "36061", "NYC", "NY"), ("10002", "36047", "NYC", "NY"), ("60601", "17031", "CHI", "IL")],
    )


def growth_rows(tables, **options):
    report = weekly_growth(tables, options.pop("series", [WeeklySeries(RED)]), ["Food"], dt.date(2018, 1, 1), SATURDAY, **options)
    return {(row.brand, row.weekstart): row for row in report.collect()}


def test_weekly_growth_by_anchor_rows(two_years):
    rows = growth_rows(two_years)
    last = rows["Red", SATURDAY - dt.timedelta(days=6)]
    assert (last.pnlpq_dma7, last.yy_sales, last.yy_txns) == (140.0, 1.0, 0.0)
    assert (last.avgitems, last.avgprice, last.yy_avgitems, last.yy_avgprice) == (1.0, 20.0, 0.0, 1.0)


def test_horizon_and_cut_off(two_years):
    weeks = sorted(week for _, week in growth_rows(two_years))
    assert weeks[-1] == SATURDAY - dt.timedelta(days=6)
    assert len(weeks) == 53
    shorter = growth_rows(two_years, horizon_days=14)
    assert len(shorter) == 3


def test_daily_series_runs_next_to_anchor_series(two_years):
    every = BrandRule("Every", (Clause(("%",)),))
    rows = growth_rows(two_years, series=[WeeklySeries(RED), WeeklySeries(every, daily=True)])
    week = SATURDAY - dt.timedelta(days=6)
    assert rows["Every", week].pnlpq_dma7 == rows["Red", week].pnlpq_dma7 == 140.0
    first = min(w for brand, w in rows if brand == "Every")
    assert rows["Every", first].yy_sales is not None


def test_midyear_start_agrees_with_new_year_start(two_years):
    midyear = weekly_growth(two_years, [WeeklySeries(RED)], ["Food"], dt.date(2018, 9, 15), SATURDAY)
    assert {row.weekstart: row.yy_sales for row in midyear.collect()} == {
        week: row.yy_sales for (_, week), row in growth_rows(two_years).items()
    }


def test_market_share_weeks(two_years):
    rows = weekly_market_share(two_years, [RED, BLUE], ["Food"], SATURDAY, dt.date(2020, 7, 1)).collect()
    assert [row.odate for row in rows] == [dt.date(2020, 8, 16) - dt.timedelta(days=7 * n) for n in range(7)]
    assert {row.perc for row in rows} == {1.0}


def test_contribution_by_county(two_years):
    rows = {r.fips: r for r in contribution_by_county(two_years, RED, ["Food"], SATURDAY).collect()}
    assert sorted(rows) == ["36047", "36061"]
    assert (rows["36061"].contrib, rows["36061"].yygrowth, rows["36061"].perc) == (1.0, 100.0, 1.0)


def test_contribution_without_prior_sales_is_null(make_tables, two_years):
    free = two_years.items.withColumn("itemprice", F.lit(0).cast("decimal(12,2)"))
    frame = contribution_by_county(dataclasses.replace(two_years, items=free), RED, ["Food"], SATURDAY)
    assert {r.contrib for r in frame.collect()} <= {None}


def test_gap_by_county(two_years):
    rows = {r.fips: r.gap for r in gap_by_county(two_years, RED, BLUE, ["Food"], SATURDAY).collect()}
    assert rows == {"36047": 31 * 20 * 10.0, "36061": 31 * 20 * 10.0}


def test_windows_keep_to_the_cohorts_calendar_year(two_years):
    """Days of the window before New Year drop out once today's cohort year has turned."""
    newyear = dt.date(2021, 1, 20)
    assert gap_by_county(two_years, RED, BLUE, ["Food"], newyear).count() == 0


def test_empty_tables_give_empty_reports(make_tables):
    tables = make_tables()
    assert weekly_growth(tables, [WeeklySeries(RED), WeeklySeries(BLUE, daily=True)], ["Food"], dt.date(2018, 1, 1), SATURDAY).count() == 0
    assert weekly_market_share(tables, [RED], ["Food"], SATURDAY, dt.date(2018, 7, 1)).count() == 0
    assert contribution_by_county(tables, RED, ["Food"], SATURDAY).count() == 0
    assert gap_by_county(tables, RED, BLUE, ["Food"], SATURDAY).count() == 0
    days = (dt.date(2020, 1, 1), SATURDAY)
    assert cancel_add_by_state(tables, RED, BLUE, "Shop", days, days).count() == 0


TEXTS = (
    "Truly Spiked Seltzer", "Truly Variety Pack", "White Claw Hard Seltzer", "Bud Light Seltzer", "Corona Hard Seltzer",
    "Smirnoff Spiked Seltzer", "High Noon Vodka", "Acme Hard Seltzer", "Bon Viv Spiked",
)


@pytest.fixture(scope="module")
def published_tables(make_tables, item):
    random.seed(11)
    days = [SATURDAY + dt.timedelta(days=n) for n in range(-800, 4)]
    items = [
        item(
            random.choice(days), random.choice(TEXTS), mailbox=random.randrange(20), order=n, price=random.randrange(1, 30),
            merchant=random.choice(["Safeway", "Hannaford", "Walmart"]),
        )
        for n in range(6000)
    ]
    for n in range(300):
        text = random.choice(["welcome to netflix!", "we've cancelled your basic plan"])
        items.append(item(SATURDAY - dt.timedelta(days=n % 6), text, mailbox=n % 20, order=10_000 + n, merchant="Netflix"))
    return make_tables(
        items=items,
        panel=[(day, 100 + day.day) for day in days],
        quality_merchants=[("Safeway",), ("Hannaford",), ("Walmart",)],
        merchant_sector=[(m, "Food") for m in ("Safeway", "Hannaford", "Walmart")],
        mailbox_zip=[(n, f"1000{n % 3}-77") for n in range(20)],
        cohort=[(n, day, "all") for n in range(20) for day in days],
        geo=[("10000", "1001", "A", "NY"), ("10001", "1003", "B", "NJ")],
    )


def test_published_reports(published_tables):
    today = SATURDAY + dt.timedelta(days=3)
    focus = published.focus_brand_growth(published_tables, today)
    assert focus.columns == [
        "brand", "orderdate", "pnlpq_dma7", "yy_sales", "pnlvol_dma7", "yy_txns",
        "avgitems", "yy_avgitems", "avgprice", "yy_avgprice",
    ]
    # Saturdays with sales in both years, of the 53 within the horizon.
    assert 20 < focus.count() <= 53
    ratio = {r.state_abbrev: r for r in published.cancel_add_ratio(published_tables).collect()}
    assert sorted(ratio) == ["NJ", "NY"]
    assert all(r.cncl_share == pytest.approx(100 * r.cancels / r.adds) for r in ratio.values())


def test_legacy_price_growth_touches_the_others_only(published_tables):
    today = SATURDAY + dt.timedelta(days=3)
    plain, legacy = (
        {(r.brand, r.weekstart): r.yy_avgprice for r in published.brand_growth(published_tables, today, flag).collect()}
        for flag in (False, True)
    )
    assert plain.keys() == legacy.keys()
    changed = {brand for brand, week in plain if plain[brand, week] != legacy[brand, week]}
    assert changed == {"Other Seltzers"}


def test_published_dashboard(published_tables):
    reports = published.dashboard(published_tables, SATURDAY + dt.timedelta(days=3))
    assert sorted(reports) == ["contribution_map", "gap_map", "growth", "share"]
    assert {r.brand for r in reports["growth"].collect()} == {"Truly", "White Claw", "Other Seltzers"}
    share = reports["share"].collect()
    assert {r.brand for r in share} == {rule.brand for rule in published.SHARE_RULES}
    totals = {}
    for row in share:
        totals[row.odate] = totals.get(row.odate, 0) + row.perc
    assert all(total == pytest.approx(1) for total in totals.values())
    assert sorted(r.fips for r in reports["gap_map"].collect()) == ["01001", "01003"]
    assert reports["gap_map"].columns == ["fips", "msa", "truly"]
    assert reports["contribution_map"].columns == ["fips", "msa", "contrib", "yygrowth", "perc"]
    assert reports["contribution_map"].count() == 2


def test_dashboard_equals_the_single_reports(published_tables):
    """Cohorts beside 'all', a merchant without quality and mailboxes of two zips part the lines of the shared pass."""
    cohort = published_tables.cohort
    tables = dataclasses.replace(
        published_tables,
        cohort=cohort.filter("mailboxid % 4 <> 1")
        .unionByName(cohort.filter("mailboxid % 3 = 0").withColumn("cohort", F.lit("other")))
        .unionByName(cohort.filter("mailboxid % 5 = 1").withColumn("cohort", F.lit("third"))),
        quality_merchants=published_tables.quality_merchants.filter("merchant <> 'Hannaford'"),
    )
    today = SATURDAY + dt.timedelta(days=3)
    latest = tables.items.agg(F.max("orderdate")).first()[0]
    apart = {
        "growth": published.brand_growth(tables, today, latest=latest),
        "share": published.market_share(tables, today),
        "gap_map": published.rival_gap(tables, today, latest),
        "contribution_map": published.growth_contribution(tables, today, latest),
    }
    apart = {name: sorted(map(repr, frame.collect())) for name, frame in apart.items()}
    for given in ({}, {"latest": latest}):
        found = published.dashboard(tables, today, **given)
        assert {name: sorted(map(repr, frame.collect())) for name, frame in found.items()} == apart


def test_empty_tables_give_an_empty_dashboard(make_tables):
    found = published.dashboard(make_tables(), SATURDAY)
    assert [frame.count() for frame in found.values()] == [0, 0, 0, 0]


def test_a_weekly_report_needs_a_series(two_years):
    with pytest.raises(ValueError, match="at least one series"):
        growth_rows(two_years, series=[])
    with pytest.raises(ValueError, match="at least one series"):
        report_set(two_years, [], [RED], RED, (RED, BLUE), ["Food"], dt.date(2018, 1, 1), SATURDAY, SATURDAY)
