"""Kept layouts and state: plans without exchanges, refreshed days, merged sets, intervals, rejects."""

import datetime as dt
import os
import random
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelmetrics.operators import rollup, scope, timeframe
from panelmetrics.operators.colocate import KEYS, colocated
from panelmetrics.operators.membership import interval_months, keep_in_intervals, member_intervals
from panelmetrics.operators.order_sets import counted_sets, merged_sets, order_sets
from panelmetrics.operators.rules import BrandRule, Clause
from panelmetrics.plans import WeeklySeries, daily_state, weekly_growth
from panelmetrics.sources import checked_codes, checked_dates, read_checked_code_list

SATURDAY = dt.date(2020, 8, 29)
RED = BrandRule("Red", (Clause(("RED %",)),))
ALL = BrandRule("All", (Clause(("%",)),))
SERIES = [WeeklySeries(RED), WeeklySeries(ALL, daily=True)]
SINCE = dt.date(2018, 1, 1)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(make_tables, item):
    chance = random.Random(3)
    days = [SATURDAY - dt.timedelta(days=n) for n in range(0, 800)]
    items = [
        item(
            chance.choice(days), chance.choice(["red widget", "blue rod", None]), mailbox=chance.randrange(12), order=n // 2,
            price=chance.randrange(1, 30), merchant=chance.choice(["Shop", "Other"]),
        )
        for n in range(3000)
    ]
    cohort = [(m, day, "all") for m in range(12) for day in days if (day.toordinal() // 90 + m) % 4]
    cohort += [(m, day, "new") for m in range(0, 12, 3) for day in days[:200]]
    return make_tables(
        items=items,
        panel=[(day, 100 + day.day) for day in days],
        quality_merchants=[("Shop",), ("Other",)],
        merchant_sector=[("Shop", "Food"), ("Other", "Food")],
        mailbox_zip=[(n, f"1000{n % 3}-7") for n in range(11)] + [(11, "a"), (11, "b")],
        cohort=cohort,
        geo=[("10000", "1001", "A", "NY")],
    )


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


def test_members_are_joined_within_buckets(spark, tables, tmp_path):
    """No exchange between the bucketed tables and the joined and combined rows."""
    kept = colocated(tables.items, tables.cohort, tables.mailbox_zip, "t_located", str(tmp_path), buckets=5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = kept.kept_items(F.col("itemdescription").isNotNull())
        days = joined.groupBy(*KEYS, "itemdescription").agg(F.sum("copies").alias("copies"))
        assert "SortMergeJoin" in plan_of(days) and "Exchange" not in plan_of(days)
        members = scope.active_members(tables.cohort, tables.mailbox_zip, F.substring("shiptozip", 1, 5))
        assert "Exchange" in plan_of(scope.keep_members(tables.items, members))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    columns = sorted(joined.columns)
    plain = scope.keep_members(tables.items.filter("itemdescription is not null"), members)
    assert rows_of(joined.select(columns)) == rows_of(plain.select(columns))
    only = scope.active_members(tables.cohort.filter("cohort = 'all'"), tables.mailbox_zip, F.substring("shiptozip", 1, 5))
    by_all = kept.kept_items(cohort_all=True).select(columns)
    assert rows_of(by_all) == rows_of(scope.keep_members(tables.items, only).select(columns))


def test_intervals_give_the_same_members_with_fewer_rows(tables):
    members = scope.active_members(tables.cohort, tables.mailbox_zip)
    intervals = member_intervals(members)
    columns = sorted([*tables.items.columns, "copies", "zip"])
    by_interval = keep_in_intervals(tables.items, intervals).select(columns)
    assert rows_of(by_interval) == rows_of(scope.keep_members(tables.items, members).select(columns))
    moved, days = interval_months(intervals).count(), members.count()
    assert days > 5000 and moved * 15 < days


def test_intervals_part_at_gaps_and_changes(spark):
    day = dt.date(2020, 1, 30)
    days = [(1, day + dt.timedelta(days=n), "z", 1 if n < 5 else 2) for n in (0, 1, 2, 4, 5, 6)] + [(2, None, "z", 1), (2, day, None, 1)]
    found = member_intervals(spark.createDataFrame(days, "mailboxid long, orderdate date, zip string, copies int"))
    spans = sorted((r.mailboxid, r.copies, (r.first_day - day).days, (r.last_day - day).days) for r in found.collect())
    assert spans == [(1, 1, 0, 2), (1, 1, 4, 4), (1, 2, 5, 6), (2, 1, 0, 0)]
    assert interval_months(found.filter("mailboxid = 1 and copies = 1")).count() == 3


def partitions(folder):
    return {p.name: sorted(f.name for f in p.iterdir()) for p in Path(folder).iterdir() if p.is_dir()}


def test_a_late_order_rewrites_one_day(spark, tables, item, tmp_path):
    folder, today = str(tmp_path / "state"), SATURDAY + dt.timedelta(days=5)
    days = [r.orderdate for r in tables.items.select("orderdate").distinct().collect()]
    latest, late = max(days), sorted(days)[400]
    daily_state.refresh_days(tables, SERIES, ["Food"], SINCE, folder)
    before = partitions(folder)

    def both(changed):
        full = weekly_growth(changed, SERIES, ["Food"], SINCE, today, latest=latest)
        return rows_of(daily_state.growth_of_state(folder, changed, SERIES, SINCE, today, latest)), rows_of(full)

    kept, full = both(tables)
    assert kept == full and len(full) > 20
    order = spark.createDataFrame([item(late, "red widget", mailbox=1, order=99_999, price=1000)], tables.items.schema)
    more = replace(tables, items=tables.items.unionByName(order))
    prints = [daily_state.day_prints(t.items, "orderdate") for t in (tables, more)]
    assert daily_state.changed_days(*prints) == [late]
    daily_state.refresh_days(more, SERIES, ["Food"], SINCE, folder, [late])
    after = partitions(folder)
    assert {day for day in after if after[day] != before.get(day)} == {f"orderdate={late}"}
    kept, full = both(more)
    assert kept == full
    gone = replace(tables, items=tables.items.filter(F.col("orderdate") != F.lit(late)))
    daily_state.refresh_days(gone, SERIES, ["Food"], SINCE, folder, [late])
    kept, full = both(gone)
    assert kept == full
    daily_state.refresh_days(gone, SERIES, ["Food"], SINCE, folder, [])
    assert partitions(folder).keys() == after.keys()


def test_refreshed_days_need_no_calendar_of_their_own(tables, tmp_path, monkeypatch):
    def read(items):
        raise AssertionError("the items are read for a calendar")

    folder = str(tmp_path / "state")
    monkeypatch.setattr(timeframe, "calendar_of", read)
    daily_state.refresh_days(tables, SERIES, ["Food"], SINCE, folder)
    before = rows_of(daily_state.kept_days(tables.items.sparkSession, folder))
    assert len(before) > 500
    daily_state.refresh_days(tables, SERIES, ["Food"], SINCE, folder, [SATURDAY])
    assert rows_of(daily_state.kept_days(tables.items.sparkSession, folder)) == before
    with pytest.raises(AssertionError):  # members of whole years do need it
        daily_state.refresh_days(tables, SERIES, ["Food"], SINCE + dt.timedelta(days=1), folder)
    with pytest.raises(ValueError):
        daily_state.refresh_days(tables, [], ["Food"], SINCE, folder)


def test_registered_daily_state_builds_its_items_once(spark, monkeypatch):
    from checks import QUERIES

    seen, refresh, prints = [], daily_state.refresh_days, daily_state.day_prints

    def refreshed(tables, *more):
        seen.append(plan_of(tables.items))
        refresh(tables, *more)

    def printed(rows, day):
        seen.append(plan_of(rows))
        return prints(rows, day)

    monkeypatch.setattr(daily_state, "refresh_days", refreshed)
    monkeypatch.setattr(daily_state, "day_prints", printed)
    found = QUERIES["a4_daily_state"](spark, os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001"))
    assert found.count() > 0
    assert len(seen) == 4
    assert not [plan for plan in seen if "Join" in plan]


def test_changed_days_of_repeated_null_and_moved_rows(spark):
    def prints(rows):
        return daily_state.day_prints(spark.createDataFrame(rows, "orderdate date, x string"), "orderdate")

    a, b, c = (dt.date(2020, 1, n) for n in (1, 2, 3))
    before = prints([(a, "p"), (a, "q"), (b, None), (None, "r")])
    assert daily_state.changed_days(before, prints([(b, None), (a, "q"), (a, "p"), (None, "s")])) == []
    assert daily_state.changed_days(before, prints([(a, "p"), (a, "p"), (b, ""), (c, "t")])) == [a, b, c]


def test_order_sets_merge_to_distinct_counts(spark):
    chance = random.Random(8)
    ids = [0, 1, 32767, 32768, 32769, 65536, 10**12, -5, None]
    rows = [(chance.choice("ab"), n % 20, chance.choice(ids + list(range(40)))) for n in range(2000)] + [("c", 1, None)]
    frame = spark.createDataFrame(rows, "brand string, day int, orderid long")
    days = order_sets(frame, ["brand", "day"])
    weeks = merged_sets(days.withColumn("week", F.floor(F.col("day") / 7)), ["brand", "week"])
    plain = frame.filter("orderid is not null").withColumn("week", F.floor(F.col("day") / 7))
    expected = plain.groupBy("brand", "week").agg(F.countDistinct("orderid").alias("order_count"))
    assert rows_of(counted_sets(weeks, ["brand", "week"])) == rows_of(expected)
    by_brand = counted_sets(merged_sets(weeks, ["brand"]), ["brand"])
    assert rows_of(by_brand) == rows_of(plain.groupBy("brand").agg(F.countDistinct("orderid").alias("order_count")))


def test_sets_of_scattered_orders_take_no_more_than_a_word_per_order(spark):
    chance = random.Random(9)
    ids = [chance.randrange(-(2**62), 2**62) for _ in range(2000)] + [2**63 - 1, -(2**63), 63, 64, -1, -64, -65]
    frame = spark.createDataFrame([(n % 3, order) for n, order in enumerate(ids * 3)], "day int, orderid long")
    days = order_sets(frame, ["day"])
    every = merged_sets(days.withColumn("all", F.lit("all")), ["all"])
    for sets in (days, every):
        assert "SortAggregate" not in plan_of(sets)  # its sort would hold all sets of a task at once
        assert dict(sets.dtypes)["orders"] == "bigint"
    assert days.count() <= 3 * len(ids)
    assert counted_sets(every, ["all"]).first().order_count == len(set(ids))
    dense = order_sets(spark.range(64_000).select(F.lit(1).alias("day"), F.col("id").alias("orderid")), ["day"])
    assert dense.count() == 1000


@pytest.mark.parametrize("name", ["a4_order_sets", "a12_order_sets"])
def test_registered_order_sets_are_never_sorted(spark, name):
    from checks import QUERIES

    found = QUERIES[name](spark, os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001"))
    assert found.count() > 0
    assert "SortAggregate" not in plan_of(found)


def test_broken_lines_and_codes_are_rejected_with_a_reason(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text("fips,name\n1001.0,a\n,b\n56045,c\nx1,d\n7,e,f\n8\n99999,g\n100000,h\n1.5,i\n NaN ,j\n 12 ,k\n")
    found = read_checked_code_list(spark, str(path), ["fips", "name"])
    assert sorted(map(tuple, found.rows.collect())) == [("00012", "k"), ("01001", "a"), ("56045", "c"), ("99999", "g")]
    rejects = {(r.broken_line or r.name): r.reject_reason for r in found.rejects.collect()}
    assert rejects == {
        "b": "missing code", "d": "not a number", "7,e,f": "broken line", "8": "broken line", "h": "not a code", "i": "not a code",
        "j": "not a number",
    }
    assert found.rejects.count() == 7


def test_dates_are_rejected_with_a_reason(spark):
    rows = [("9-05-2020",), ("12-31-2019",), ("13-01-2020",), ("2-30-2020",), ("",), (None,), ("2020-09-05",), (" 1-02-2020 ",)]
    found = checked_dates(spark.createDataFrame(rows, "day string"), "day")
    assert sorted(r.day for r in found.rows.collect()) == [dt.date(2019, 12, 31), dt.date(2020, 1, 2), dt.date(2020, 9, 5)]
    assert sorted(r.reject_reason for r in found.rejects.collect()) == ["missing date"] * 2 + ["not a date"] * 3
    none = checked_codes(spark.createDataFrame([], "fips string"))
    assert none.rows.count() == none.rejects.count() == 0


def test_state_sums_equal_those_of_the_report(tables, tmp_path):
    folder = str(tmp_path / "sums")
    daily_state.refresh_days(tables, [WeeklySeries(ALL, daily=True)], ["Food"], SINCE, folder)
    kept = rollup.per_panel_days(daily_state.kept_days(tables.items.sparkSession, folder), tables.panel)
    assert kept.count() > 500
