"""Shape of the physical plans: scans, pushed filters, broadcasts, skew handling."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from panelmetrics.operators import rollup, scope, share, smooth, timeframe
from panelmetrics.operators.rules import (
    BrandRule,
    Clause,
    classified_texts,
    stack_brands,
    tag_brands,
    tag_brands_by_text,
)
from panelmetrics.plans import WeeklySeries, reports, weekly_market_share
from panelmetrics.session import settle
from panelmetrics.sources import date_bounds, last_order_date, order_dates, panel_tables
from panelmetrics.sources.tables import typed_items

LAST = dt.date(2020, 12, 31)
RULES = [
    BrandRule("Red", (Clause(("RED %",)),)),
    BrandRule("Widgets", (Clause(("%WIDGET",), none_of=("HOT %",)),)),
    BrandRule("Any", (Clause(("%",)),)),
]
ROWS = 60_000


@pytest.fixture(scope="module", autouse=True)
def whole_plan_strings(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Skewed tables on disk: one merchant, one mailbox-day and one item hold much of the fact."""
    folder = str(tmp_path_factory.mktemp("tables"))
    n = F.col("id")
    hot = n % 3 == 0
    day = F.date_sub(F.lit(LAST), (n % 900).cast("int"))
    items = spark.range(ROWS).select(
        F.when(hot, 0).otherwise(n % 500).alias("mailboxid"),
        n.alias("orderid"),
        F.when(hot, F.lit(dt.date(2020, 12, 5))).otherwise(day).alias("orderdate"),
        F.when(n % 5 < 2, "Hot").otherwise(F.concat(F.lit("M"), (n % 400).cast("string"))).alias("merchant"),
        F.when(hot, "red widget").otherwise(F.concat(F.lit("blue gear "), n.cast("string"))).alias("itemdescription"),
        F.lit(2).cast("decimal(12,2)").alias("itemquantity"),
        (n % 50).cast("decimal(12,2)").alias("itemprice"),
        (n % 90).cast("decimal(12,2)").alias("ordertotal"),
    )
    days = spark.range(900).select(F.date_sub(F.lit(LAST), n.cast("int")).alias("day"))
    merchants = items.select("merchant").distinct()
    frames = {
        "items": items,
        "panel": days.select(F.col("day").alias("date"), F.lit(100).cast("long").alias("panel")),
        "quality_merchants": merchants,
        "merchant_sector": merchants.withColumn("sector", F.lit("Food")),
        "mailbox_zip": spark.range(500).select(n.alias("mailboxid"), F.lit("10001-2").alias("shiptozip")),
        "cohort": days.crossJoin(spark.range(500)).select(
            n.alias("mailboxid"), F.col("day").alias("udate"), F.lit("all").alias("cohort")
        ),
        "geo": spark.range(1).select(
            F.lit("10001").alias("zipcode"), F.lit("1").alias("fips"), F.lit("A").alias("msa"), F.lit("NY").alias("state_abbrev")
        ),
    }
    for name, frame in frames.items():
        frame.repartition(4).write.parquet(f"{folder}/{name}")
    return panel_tables(spark, folder=folder)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def fact_scans(frame):
    return sum("FileScan" in line and "/items" in line for line in plan_of(frame).splitlines())


def executed(frame):
    """Final plan after the frame has run."""
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    return plan_of(frame)


@pytest.fixture
def large_sides(spark):
    """Settings under which no side is small and partitions of the fixture count as large."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def brand_days(tables, series):
    calendar = timeframe.calendar_of(tables.items)
    return reports.brand_days(tables, series, ["Food"], dt.date(2019, 1, 1), calendar, LAST)


def test_brands_are_tagged_in_one_scan(tables):
    assert fact_scans(tag_brands(tables.items, RULES)) == 1
    assert fact_scans(stack_brands(tables.items, RULES)) == len(RULES)


def test_weekly_metrics_read_the_fact_once_for_all_brands(tables):
    frame = brand_days(tables, [WeeklySeries(rule) for rule in RULES])
    assert fact_scans(frame) == 1
    plan = plan_of(frame)
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "/items" in line)
    assert "LessThanOrEqual(orderdate,2020-12-28)" in scan
    # The cohort's first day reaches the items through the join on dates.
    assert "GreaterThanOrEqual(orderdate,2019-01-01)" in scan
    assert "ordertotal" not in plan


def test_market_share_prunes_by_date_and_reads_once(tables):
    frame = weekly_market_share(tables, RULES, ["Food"], LAST, dt.date(2020, 7, 1))
    assert fact_scans(frame) == 1
    plan = plan_of(frame)
    assert "GreaterThanOrEqual(orderdate,2020-07-05)" in plan
    assert "LessThanOrEqual(orderdate,2020-12-19)" in plan
    assert "mailboxid" not in plan


def test_a_fact_partitioned_by_date_is_pruned(tables, spark, tmp_path):
    tables.items.repartition("orderdate").write.partitionBy("orderdate").parquet(str(tmp_path / "items"))
    dated = replace(tables, items=typed_items(spark.read.parquet(str(tmp_path / "items"))))
    plan = plan_of(weekly_market_share(dated, RULES, ["Food"], LAST, dt.date(2020, 7, 1)))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "/items" in line)
    assert "PartitionFilters: [isnotnull(orderdate" in scan
    assert ">= 2020-07-05)" in scan and "<= 2020-12-19)" in scan
    weekly = plan_of(reports.brand_days(dated, [WeeklySeries(RULES[0])], ["Food"], dt.date(2019, 1, 1), None, LAST))
    scan = next(line for line in weekly.splitlines() if "FileScan" in line and "/items" in line)
    assert "dayofweek(orderdate" in scan[scan.index("PartitionFilters") : scan.index("PushedFilters")]


def test_item_texts_are_classified_in_generated_code(tables):
    for line in plan_of(tag_brands(tables.items, RULES)).splitlines():
        if "Generate explode" in line:
            assert "lambda" not in line


def test_merchant_lists_are_joined_without_moving_the_fact(tables):
    merchants = scope.eligible_merchants(tables.merchant_sector, ["Food"], tables.quality_merchants)
    plan = plan_of(scope.in_merchants(tables.items, merchants))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_share_of_total_needs_no_global_window(tables):
    sales = tables.items.groupBy("merchant").agg(F.sum("itemprice").cast("double").alias("sales"))
    plan = plan_of(share.share_of_total(sales, "sales"))
    assert "Window" not in plan and "BroadcastNestedLoopJoin" in plan


def test_trailing_windows_run_per_brand_on_days(tables):
    series = [WeeklySeries(rule, daily=True) for rule in RULES]
    plan = plan_of(smooth.trailing_sums(brand_days(tables, series)))
    window = plan[plan.index("Window [") :]
    assert "hashpartitioning(brand" in window
    assert "SinglePartition" not in window


def test_items_are_combined_before_they_move(tables):
    """Below the first exchange over the fact there is a partial aggregate."""
    lines = plan_of(rollup.order_rollup(tag_brands(tables.items, RULES))).splitlines()
    exchange = next(n for n, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    assert "partial_sum" in lines[exchange + 1]


def test_a_hot_merchant_is_split_when_the_list_is_too_large_to_broadcast(tables, large_sides):
    merchants = scope.eligible_merchants(tables.merchant_sector, ["Food"], tables.quality_merchants)
    kept = scope.in_merchants(tables.items, merchants)
    assert "SortMergeJoin(skew=true)" in executed(rollup.order_rollup(tag_brands(kept, RULES)))


def test_a_hot_merchant_is_split_at_the_sector_join(tables, large_sides):
    kept = scope.in_sectors(tables.items, tables.merchant_sector, ["Food"])
    assert "SortMergeJoin(skew=true)" in executed(rollup.order_rollup(tag_brands(kept, RULES)))


def test_a_hot_mailbox_day_is_split_at_the_member_join(tables, large_sides):
    members = scope.active_members(tables.cohort, tables.mailbox_zip)
    orders = rollup.order_rollup(tag_brands(tables.items, RULES[2:]))
    frame = rollup.daily_rollup(scope.keep_members(orders, members), tables.panel)
    assert "SortMergeJoin(skew=true)" in executed(frame)


def test_results_do_not_depend_on_the_join_strategy(tables, spark, request):
    series = [WeeklySeries(rule) for rule in RULES]
    broadcast = sorted(map(tuple, brand_days(tables, series).collect()))
    request.getfixturevalue("large_sides")
    shuffled = sorted(map(tuple, brand_days(tables, series).collect()))
    assert broadcast == shuffled and broadcast


def test_market_share_looks_up_merchants_for_counts_only(tables, large_sides):
    """No exchange of item rows by merchant: merchants are joined to the aggregated counts."""
    frame = weekly_market_share(tables, RULES, ["Food"], LAST, dt.date(2020, 7, 1))
    lines = plan_of(frame).splitlines()
    depth = next(n for n, line in enumerate(lines) if "FileScan" in line and "/items" in line)
    moves = [line for line in lines[:depth] if "Exchange hashpartitioning(merchant" in line]
    counts = next(n for n, line in enumerate(lines) if "HashAggregate" in line and "count(distinct orderid" in line)
    assert len(moves) == 1 and lines.index(moves[0]) < counts


def test_the_merchant_list_gives_the_same_rows_under_any_join(tables, spark, request):
    merchants = scope.eligible_merchants(tables.merchant_sector, ["Food"], tables.quality_merchants).filter("merchant <> 'M1'")
    kept = scope.in_merchants(tables.items, merchants).count()
    request.getfixturevalue("large_sides")
    assert kept == scope.in_merchants(tables.items, merchants).count() == tables.items.filter("merchant <> 'M1'").count()


def test_a_known_last_date_saves_the_pass_over_the_dates(tables, spark):
    """With `latest` given, the gap report reads the items in one job's scan only."""
    red, blue = RULES[:2]
    known = reports.gap_by_county(tables, red, blue, ["Food"], LAST, latest=LAST)
    looked_up = reports.gap_by_county(tables, red, blue, ["Food"], LAST)
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, looked_up.collect()))


def test_source_decimals_keep_their_scale(spark):
    row = spark.sql(
        "select 1L as mailboxid, 1L as orderid, date '2020-01-01' as orderdate, 'm' as merchant, 'i' as itemdescription, "
        "1.235BD as itemquantity, 2.5D as itemprice, cast(3 as decimal(12,2)) as ordertotal"
    )
    typed = typed_items(row)
    assert [str(v) for v in typed.select("itemquantity", "itemprice", "ordertotal").first()] == ["1.235", "2.50", "3.00"]


def moves_over(plan: str, scan: str) -> list[str]:
    """Exchanges above a scan, by the indentation of the plan's lines."""
    lines = plan.splitlines()
    at = next(n for n, line in enumerate(lines) if "FileScan" in line and scan in line)

    def depth(line: str) -> int:
        return len(line) - len(line.lstrip(" :+-*"))

    above, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            above.append(line.strip(" :+-*"))
    return [line for line in above if line.startswith("Exchange hashpartitioning")]


def test_the_cohort_is_moved_twice_at_most(tables, large_sides):
    members = scope.active_members(tables.cohort, tables.mailbox_zip)
    orders = rollup.order_rollup(tag_brands(tables.items, RULES[2:]))
    assert len(moves_over(plan_of(scope.keep_members(orders, members)), "/cohort")) == 2


def settled_plans(monkeypatch):
    """Plans of the frames that reports settle, as they are built."""
    plans = []

    def recording(frame):
        plans.append(plan_of(frame))
        return settle(frame)

    for module in (reports, scope):
        monkeypatch.setattr(module, "settle", recording)
    return plans


def item_scans(plans):
    """Scans of the fact that read columns."""
    lines = (line for plan in plans for line in plan.splitlines())
    return sum("FileScan" in line and "/items" in line and "ReadSchema: struct<>" not in line for line in lines)


def set_arguments(**more):
    series = [WeeklySeries(RULES[0]), WeeklySeries(RULES[2], daily=True)]
    return {
        "series": series, "rules": RULES[:2], "focus": RULES[2], "rivals": (RULES[0], RULES[2]), "sectors": ["Food"],
        "since": dt.date(2019, 1, 1), "first_week": dt.date(2020, 1, 5), "today": dt.date(2021, 1, 2), "horizon_days": None, **more,
    }


def test_report_set_reads_the_items_twice(tables, monkeypatch):
    """One pass for growth and both maps, one for share; the calendar is given."""
    days = settle(timeframe.calendar_of(tables.items))
    plans = settled_plans(monkeypatch)
    found = reports.report_set(tables, **set_arguments(calendar=days, latest=LAST))
    assert item_scans([*plans, *map(plan_of, found.values())]) == 2
    scan = next(line for plan in plans for line in plan.splitlines() if "FileScan" in line and "/items" in line)
    assert "GreaterThanOrEqual(orderdate,2019-01-01)" in scan and "LessThanOrEqual(orderdate,2020-12-28)" in scan


@pytest.mark.parametrize("since", [dt.date(2019, 1, 1), dt.date(2019, 7, 1)])
def test_report_set_equals_its_reports(tables, since):
    given = set_arguments(since=since)
    found = {name: frame.collect() for name, frame in reports.report_set(tables, **given).items()}
    first = (given["sectors"], since, given["today"])
    apart = {
        "growth": reports.weekly_growth(tables, given["series"], *first, horizon_days=None),
        "share": weekly_market_share(tables, given["rules"], ["Food"], given["today"], given["first_week"]),
        "gap_map": reports.gap_by_county(tables, *given["rivals"], ["Food"], given["today"]),
        "contribution_map": reports.contribution_by_county(tables, given["focus"], ["Food"], given["today"]),
    }
    assert found == {name: frame.collect() for name, frame in apart.items()}
    assert all(found.values())


def test_last_date_is_found_without_reading_a_column(spark, tables, tmp_path):
    by_day, plain, stamps, none = (str(tmp_path / n) for n in ("by_day", "plain", "stamps", "none"))
    few = tables.items.filter("orderid < 2000")
    few.repartition("orderdate").write.partitionBy("orderdate").parquet(by_day)
    few.write.parquet(plain)
    few.withColumn("orderdate", F.col("orderdate").cast("timestamp")).write.parquet(stamps)
    few.limit(0).write.parquet(none)
    first, last = few.agg(F.min("orderdate"), F.max("orderdate")).first()
    for folder in (by_day, plain, stamps):
        assert tuple(date_bounds(spark, folder).first()) == (first, last)
        assert last_order_date(spark, folder) == last
        assert order_dates(spark, folder).count() == few.select("orderdate").distinct().count()
    assert last_order_date(spark, none) is None
    assert "ReadSchema: struct<>" in plan_of(date_bounds(spark, by_day))
    assert "ReadSchema: struct<>" in plan_of(order_dates(spark, by_day))
    pushed = plan_of(date_bounds(spark, plain))
    assert "PushedAggregation: [MIN(orderdate), MAX(orderdate)]" in pushed
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_classified_texts_are_joined_to_one_scan(tables):
    """Patterns run on distinct texts; the pass over the items holds no pattern."""
    texts = settle(classified_texts(tables.items, RULES[:2]))
    frame = tag_brands_by_text(tables.items, RULES[:2], texts)
    assert fact_scans(frame) == 1
    assert "widget" not in plan_of(frame).lower()
    key = ["brand", "orderid", "orderdate"]
    assert sorted(frame.select(*key).collect()) == sorted(tag_brands(tables.items, RULES[:2]).select(*key).collect())


def test_hot_text_is_split_when_texts_are_shuffled(large_sides, tables):
    plan = executed(tag_brands_by_text(tables.items, RULES))
    assert "skew=true" in plan
