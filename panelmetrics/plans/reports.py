"""The six reports and the report set.

Reports that need one small frame in several branches (brand-days, zip totals) build it
in one pass over the fact, settle it, and do the rest on a few thousand rows. `calendar`
may be a settled calendar shared by several reports, `latest` the last date of the fact where it is known
(`sources.last_order_date` finds it without reading a column); `today` stands for the run date.

The report set makes one such pass for three reports: see `shared_days`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import falls_on, ratio, year_start
from ..operators import geo, rollup, scope, share, smooth, timeframe, yoy
from ..operators.churn import cancel_add_ratio, daily_event_rates, state_volume
from ..operators.rules import BrandRule, distinct_brands, rule_holds, tag_brands, tag_each
from ..session import settle
from ..sources import PanelTables

# How far back weekly series go, and the last weeks market share leaves out.
HORIZON_DAYS = 10 + 455
SHARE_LAG_DAYS = 3 + 9
# Days before today whose calendar year picks the cohort of each period.
CURRENT_COHORT_LAG = 14
PRIOR_COHORT_LAG = 379


@dataclass(frozen=True)
class WeeklySeries:
    """A brand line of the weekly report.

    By default both years sum seven anchor days. `daily` sums seven days instead: observed
    days this year, calendar days last year.
    """

    rule: BrandRule
    daily: bool = False
    legacy_price_yoy: bool = False


def _latest(tables: PanelTables, calendar: DataFrame | None, latest: dt.date | None) -> dt.date | None:
    """Last date of the fact: one value, known before the main pass is planned, so that
    date limits are literals the scan can prune by. Without `latest` or a calendar it
    costs a pass over the date column."""
    if latest is not None:
        return latest
    days = tables.items if calendar is None else calendar
    return days.agg(F.max("orderdate")).first()[0]


def _starts_a_year(day: dt.date) -> bool:
    return (day.month, day.day) == (1, 1)


def brand_days(
    tables: PanelTables,
    series: Sequence[WeeklySeries],
    sectors: Sequence[str],
    since: dt.date,
    calendar: DataFrame | None,
    latest: timeframe.Day,
) -> DataFrame:
    """Daily brand metrics of the clean panel, in one pass over the items.

    The calendar is only read when `since` is not the first day of a year.
    """
    complete = partial(timeframe.settled_by, latest)
    return rollup.per_panel_days(brand_sums(tables, series, sectors, since, calendar, complete), tables.panel)


def brand_sums(
    tables: PanelTables,
    series: Sequence[WeeklySeries],
    sectors: Sequence[str],
    since: dt.date,
    calendar: DataFrame | None,
    days: Callable[..., Column],
) -> DataFrame:
    """Daily orders, items and revenue of each brand, on the dates that `days(day=column)` wants."""

    def wanted(day: str) -> Column:
        # Days no series of this report can use are dropped before the joins.
        complete = days(day=day)
        return complete if any(s.daily for s in series) else complete & falls_on(F.col(day), smooth.ANCHOR)

    merchants = scope.eligible_merchants(tables.merchant_sector, sectors, tables.quality_merchants)
    items = scope.in_merchants(tables.items.filter(wanted("orderdate")), merchants)
    items = tag_brands(items, [s.rule for s in series])
    daily_brands = [s.rule.brand for s in series if s.daily]
    if daily_brands and len(daily_brands) < len(series):
        items = items.filter(F.col("brand").isin(*daily_brands) | falls_on(F.col("orderdate"), smooth.ANCHOR))
    cohort = tables.cohort.filter(F.col("cohort") == "all").filter(wanted("udate"))
    if _starts_a_year(since):
        # Members join on order dates, so "in a year with orders since New Year" is "since New Year".
        cohort = cohort.filter(F.col("udate") >= F.lit(since))
    else:
        cohort = scope.cohort_in_fact_years(cohort, calendar, since)
    members = scope.active_members(cohort, tables.mailbox_zip).drop("zip")
    return rollup.daily_sums(scope.keep_members(rollup.order_rollup(items), members))


def weekly_growth(
    tables: PanelTables,
    series: Sequence[WeeklySeries],
    sectors: Sequence[str],
    since: dt.date,
    today: dt.date,
    calendar: DataFrame | None = None,
    horizon_days: int | None = HORIZON_DAYS,
    latest: dt.date | None = None,
) -> DataFrame:
    """Weekly sales, orders, basket and price of each brand with year-over-year growth."""
    calendar = calendar_for(tables, series, since, calendar)
    latest = _latest(tables, calendar, latest)
    daily = settle(brand_days(tables, series, sectors, since, calendar, latest))
    return growth_of_days(daily, series, since, today, calendar, horizon_days, latest)


def calendar_for(
    tables: PanelTables, series: Sequence[WeeklySeries], since: dt.date, calendar: DataFrame | None
) -> DataFrame | None:
    """The calendar that a weekly report of these series needs: one of its own if none is given, or none."""
    calendar = cohort_calendar(tables, series, since, calendar)
    if calendar is None and any(s.daily for s in series):
        return settle(timeframe.calendar_of(tables.items))
    return calendar


def cohort_calendar(
    tables: PanelTables, series: Sequence[WeeklySeries], since: dt.date, calendar: DataFrame | None
) -> DataFrame | None:
    """The calendar that `brand_sums` of these series needs, which is none where `since` is the first day of a year."""
    if not series:
        raise ValueError("a weekly report needs at least one series")
    distinct_brands([s.rule for s in series])
    if calendar is None and not _starts_a_year(since):
        return settle(timeframe.calendar_of(tables.items))
    return calendar


def growth_of_days(
    daily: DataFrame,
    series: Sequence[WeeklySeries],
    since: dt.date,
    today: dt.date,
    calendar: DataFrame | None,
    horizon_days: int | None,
    latest: timeframe.Day,
) -> DataFrame:
    """The weekly report from settled brand-days."""
    lines = []
    # Brands of one kind share a branch, so the plan does not grow with the number of brands.
    for kind in sorted({(s.daily, s.legacy_price_yoy) for s in series}):
        brands = [s.rule.brand for s in series if (s.daily, s.legacy_price_yoy) == kind]
        own = daily.filter(F.col("brand").isin(*brands))
        if kind[0]:
            days = calendar.filter((F.col("orderdate") >= F.lit(since)) & timeframe.settled_by(latest))
            spine = days.withColumn("brand", F.explode(F.array(*[F.lit(brand) for brand in brands])))
            current = smooth.trailing_observed_days(own, measures=smooth.PANEL_MEASURES)
            prior = smooth.trailing_calendar_days(own, spine, measures=smooth.PANEL_MEASURES)
        else:
            current = prior = smooth.trailing_anchor_rows(own, measures=smooth.PANEL_MEASURES)
        if horizon_days is not None:
            current = current.filter(F.col("orderdate") >= F.date_sub(F.lit(today), horizon_days))
        lines.append(yoy.weekly_metrics(yoy.with_prior_year(current, prior), legacy_price_yoy=kind[1]))
    return reduce(DataFrame.unionByName, lines).orderBy(F.desc("weekstart"), "brand")


def weekly_market_share(
    tables: PanelTables,
    rules: Sequence[BrandRule],
    sectors: Sequence[str],
    today: dt.date,
    first_week: dt.date,
) -> DataFrame:
    """Share of each brand in the week's orders of all brands."""
    last_day = today - dt.timedelta(days=SHARE_LAG_DAYS)
    last_sunday = last_day - dt.timedelta(days=last_day.isoweekday() % 7)
    first_sunday = first_week + dt.timedelta(days=-first_week.isoweekday() % 7)
    items = tables.items.filter(
        F.col("orderdate").between(F.lit(first_sunday), F.lit(last_sunday + dt.timedelta(days=6)))
    )
    distinct_brands(rules)
    # Merchant is a key of the counts, so the sectors are looked up for counts and never for items:
    # a merchant with much of the fact arrives there as few rows.
    counted = share.weekly_item_orders(tag_brands(items, rules))
    counts = share.drop_unconfirmed_singletons(scope.in_sectors(counted, tables.merchant_sector, sectors), rules)
    return (
        share.share_within(share.weekly_brand_orders(counts), "order_count", ["odate"])
        .select("odate", "brand", "perc")
        .orderBy(F.desc("odate"), "brand")
    )


def contribution_by_county(
    tables: PanelTables,
    rule: BrandRule,
    sectors: Sequence[str],
    today: dt.date,
    calendar: DataFrame | None = None,
    latest: dt.date | None = None,
) -> DataFrame:
    """What each region adds to a brand's growth over last year's same window, per county."""
    latest = _latest(tables, calendar, latest)
    items = scope.in_sectors(tables.items.filter(rule_holds(rule)), tables.merchant_sector, sectors)
    in_periods = tag_each(items, list(map_periods(latest, today, "orderdate").items()), "period")
    wanted = map_periods(latest, today, "udate")
    cohort = tables.cohort.filter(wanted["current"] | wanted["prior"])
    members = scope.active_members(cohort, tables.mailbox_zip, geo.mailbox_zip_prefix(F.col("shiptozip")))
    by_zip = settle(rollup.zip_totals(in_periods, members, tables.panel, by=["period"]))
    return contribution_of_zips(by_zip, tables.geo)


def map_periods(latest: timeframe.Day, today: dt.date, day: str) -> dict[str, Column]:
    """Dates of the maps: the trailing window, and the same window a year before."""
    return {
        "current": timeframe.in_trailing_window(latest, day=day)
        & timeframe.same_year_as(today - dt.timedelta(days=CURRENT_COHORT_LAG), day),
        "prior": timeframe.in_trailing_window(latest, shift=timeframe.YEAR_SHIFT, day=day)
        & timeframe.same_year_as(today - dt.timedelta(days=PRIOR_COHORT_LAG), day),
    }


def contribution_of_zips(by_zip: DataFrame, places: DataFrame) -> DataFrame:
    """The contribution map from settled totals per period and zip."""
    regions = rollup.region_totals(by_zip, geo.zip_regions(places))
    rates = settle(rollup.window_rate(regions, ["period", "msa"]))

    def side(period: str) -> DataFrame:
        return rates.filter(F.col("period") == period).select("msa", F.col("rate").alias(period))

    changes = geo.region_change(geo.outer_merge(side("current"), side("prior")))
    total = rollup.window_rate(by_zip.filter("period = 'prior'"), ["period"]).select(F.col("rate").alias("total"))
    by_region = geo.attach_scalar(share.share_of_total(changes, "current"), total).select(
        "msa", ratio(F.col("change"), F.col("total")).alias("contrib"), "yygrowth", "perc"
    )
    return geo.to_counties(by_region, places).select("fips", "msa", "contrib", "yygrowth", "perc")


def gap_by_county(
    tables: PanelTables,
    left: BrandRule,
    right: BrandRule,
    sectors: Sequence[str],
    today: dt.date,
    name: str = "gap",
    calendar: DataFrame | None = None,
    latest: dt.date | None = None,
) -> DataFrame:
    """Difference of two brands' panel-normalised sales over the trailing window, per county."""
    distinct_brands([left, right])
    latest = _latest(tables, calendar, latest)
    items = scope.in_sectors(
        tables.items.filter(map_periods(latest, today, "orderdate")["current"]), tables.merchant_sector, sectors
    )
    cohort = tables.cohort.filter(map_periods(latest, today, "udate")["current"])
    members = scope.active_members(cohort, tables.mailbox_zip, geo.mailbox_zip_prefix(F.col("shiptozip")))
    by_zip = rollup.zip_totals(tag_brands(items, [left, right]), members, tables.panel)
    return gap_of_zips(by_zip, left, right, tables.geo, name)


def gap_of_zips(by_zip: DataFrame, left: BrandRule, right: BrandRule, places: DataFrame, name: str) -> DataFrame:
    """The gap map from totals per brand and zip."""
    rates = settle(rollup.window_rate(rollup.region_totals(by_zip, geo.zip_regions(places)), ["brand", "msa"]))

    def side(rule: BrandRule, column: str) -> DataFrame:
        return rates.filter(F.col("brand") == rule.brand).select("msa", F.col("rate").alias(column))

    gaps = geo.region_gap(geo.outer_merge(side(left, "left"), side(right, "right")), "left", "right", name)
    return geo.to_counties(gaps, places).select("fips", "msa", name)


def cancel_add_by_state(
    tables: PanelTables,
    adds: BrandRule,
    cancels: BrandRule,
    merchant: str,
    add_days: tuple[dt.date, dt.date],
    cancel_days: tuple[dt.date, dt.date],
) -> DataFrame:
    """Cancels per hundred adds of one merchant's subscriptions, by state.

    The two windows differ on purpose: cancels of a recent week against adds to date.
    """
    events = tables.items.filter(F.col("merchant") == merchant)
    distinct_brands([adds, cancels])
    kinds = [
        (rule.brand, rule_holds(rule) & F.col("orderdate").between(F.lit(first), F.lit(last)))
        for rule, (first, last) in ((adds, add_days), (cancels, cancel_days))
    ]
    orders = tag_each(events, kinds, "event_kind").select("event_kind", *rollup.ORDER_KEYS).distinct()
    cohort = tables.cohort.filter(
        F.col("udate").between(F.lit(min(add_days[0], cancel_days[0])), F.lit(max(add_days[1], cancel_days[1])))
    )
    members = scope.active_members(cohort, tables.mailbox_zip, geo.mailbox_zip_padded(F.col("shiptozip")))
    placed = geo.with_region(
        scope.keep_members(orders, members), geo.zip_regions(tables.geo, geo.mailbox_zip_padded)
    )
    volume = settle(state_volume(daily_event_rates(placed, tables.panel)))
    return cancel_add_ratio(
        volume.filter(F.col("event_kind") == adds.brand), volume.filter(F.col("event_kind") == cancels.brand)
    ).orderBy(F.desc("cncl_share"))


Lines = Sequence[tuple[str, Column]]


def shared_days(
    tables: PanelTables,
    growth: Lines,
    maps: Lines,
    sectors: Sequence[str],
    dates: tuple[dt.date, dt.date] | None,
    cohort_days: Column,
) -> DataFrame:
    """Daily sums of all lines of the weekly report and the maps, in one pass over the items.

    A line is a label and the item rows it wants (its date limits included); a row is put out once per line.
    All lines share one merchant join, one combination to orders and one member join. Lines of
    the weekly report take quality merchants and members of cohort 'all' and are summed per date; lines of
    maps take all merchants of the sectors and all cohorts, are combined to mailbox-days and summed per
    date and zip. `dates` bounds the scan, `cohort_days` the cohort rows.

    Columns: line, orderdate, zip (null in lines of the weekly report), ordercount, item_count, pq.
    """
    items = tables.items if dates is None else tables.items.filter(F.col("orderdate").between(*map(F.lit, dates)))
    wanted = items.filter(reduce(or_, [holds for _, holds in (*growth, *maps)]))
    merchants = settle(scope.merchants_with_quality(tables.merchant_sector, sectors, tables.quality_merchants))
    tested = [(label, holds & F.col("is_quality")) for label, holds in growth]
    tagged = tag_each(wanted.join(merchants, "merchant"), [*tested, *maps], "line")
    weekly = F.col("line").isin(*[label for label, _ in growth])
    orders = rollup.order_rollup(
        tagged.withColumn("orderid", F.when(weekly, F.col("orderid"))), ("line", *rollup.ORDER_KEYS)
    )
    members = scope.members_of_all_reports(
        tables.cohort.filter(cohort_days), tables.mailbox_zip, geo.mailbox_zip_prefix(F.col("shiptozip"))
    )
    counted = scope.keep_members(orders, members).withColumns(
        {"copies": F.when(weekly, F.col("copies_all")).otherwise(F.col("copies")), "zip": F.when(~weekly, F.col("zip"))}
    )
    return rollup.daily_sums(counted.filter("copies > 0"), ("line", "zip"))


def report_set(
    tables: PanelTables,
    series: Sequence[WeeklySeries],
    rules: Sequence[BrandRule],
    focus: BrandRule,
    rivals: tuple[BrandRule, BrandRule],
    sectors: Sequence[str],
    since: dt.date,
    first_week: dt.date,
    today: dt.date,
    gap_name: str = "gap",
    calendar: DataFrame | None = None,
    latest: dt.date | None = None,
    horizon_days: int | None = HORIZON_DAYS,
) -> dict[str, DataFrame]:
    """The four results shown together: growth, share, gap map and contribution map.

    Growth and both maps come from one pass over the items (`shared_days`), share from one of its own, because
    it counts items of all mailboxes. The calendar is one more pass over the dates where series need it;
    without `latest` and calendar, the last date is.
    """
    calendar = calendar_for(tables, series, since, calendar)
    distinct_brands(rivals)
    latest = _latest(tables, calendar, latest)

    years = None if _starts_a_year(since) else scope.fact_years(calendar, since)

    def complete(day: str) -> Column:
        """Days of the weekly report: complete, and in a year with orders on or after `since`."""
        counts = F.col(day) >= F.lit(since) if years is None else year_start(F.col(day)).isin(years)
        return timeframe.settled_by(latest, day=day) & counts

    periods, cohort_periods = map_periods(latest, today, "orderdate"), map_periods(latest, today, "udate")
    growth = [
        (f"growth {s.rule.brand}", rule_holds(s.rule) & complete("orderdate") & weekly_day(s)) for s in series
    ]
    gap = [(f"gap {rule.brand}", rule_holds(rule) & periods["current"]) for rule in rivals]
    contribution = [(f"contribution {name}", rule_holds(focus) & holds) for name, holds in periods.items()]
    cohort_days = ((F.col("cohort") == "all") & complete("udate")) | cohort_periods["current"] | cohort_periods["prior"]
    days = settle(shared_days(tables, growth, [*gap, *contribution], sectors, pass_dates(since, latest), cohort_days))

    def of_report(report: str, column: str) -> DataFrame:
        own = days.filter(F.col("line").startswith(f"{report} "))
        return own.withColumn(column, F.expr(f"substring(line, {len(report) + 2})")).drop("line")

    daily = settle(rollup.per_panel_days(of_report("growth", "brand"), tables.panel))
    gap_zips = rollup.zip_days_total(of_report("gap", "brand"), tables.panel)
    contribution_zips = rollup.zip_days_total(of_report("contribution", "period"), tables.panel, ["period"])
    return {
        "growth": growth_of_days(daily, series, since, today, calendar, horizon_days, latest),
        "share": weekly_market_share(tables, rules, sectors, today, first_week),
        "gap_map": gap_of_zips(gap_zips, *rivals, tables.geo, gap_name),
        "contribution_map": contribution_of_zips(settle(contribution_zips), tables.geo),
    }


def weekly_day(series: WeeklySeries) -> Column:
    """Days a series can use: every day, or anchor days."""
    return F.lit(True) if series.daily else falls_on(F.col("orderdate"), smooth.ANCHOR)


def pass_dates(since: dt.date, latest: dt.date | None) -> tuple[dt.date, dt.date] | None:
    """First and last date that the weekly report or a map can use, for the scan; None where the fact is empty."""
    if latest is None:
        return None
    settled = latest - dt.timedelta(days=timeframe.SETTLING_DAYS)
    window = latest - dt.timedelta(days=timeframe.WINDOW_FIRST_DAY + timeframe.YEAR_SHIFT)
    return min(dt.date(since.year, 1, 1), window), settled


def write_reports(reports: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Write each report as its own parquet dataset and return where it went."""
    paths = {name: f"{folder}/{name}" for name in reports}
    for name, report in reports.items():
        report.write.mode("overwrite").parquet(paths[name])
    return paths


