import pytest
from pyspark.sql import functions as F

from panelmetrics.operators import churn, geo, share


@pytest.fixture(scope="module")
def rates(spark):
    def make(name, **values):
        rows = [(None if msa == "none" else msa, rate) for msa, rate in values.items()]
        return spark.createDataFrame(rows, f"msa string, {name} double")

    return make


def test_outer_merge_keeps_missing_keys_apart(rates):
    merged = geo.outer_merge(rates("current", A=2.0, B=3.0, none=1.0), rates("prior", A=1.0, C=4.0, none=5.0))
    rows = {(r.msa, r.current, r.prior) for r in merged.collect()}
    assert rows == {("A", 2.0, 1.0), ("B", 3.0, None), ("C", None, 4.0), (None, 1.0, None), (None, None, 5.0)}


def test_change_and_growth_percent(rates):
    merged = geo.outer_merge(rates("current", A=2.0, B=3.0), rates("prior", A=1.0, C=4.0))
    rows = {r.msa: (r.change, r.yygrowth) for r in geo.region_change(merged).collect()}
    assert rows["A"] == (1.0, 100.0)
    assert rows["B"][0] == 3.0 and rows["B"][1] == pytest.approx(29999900.0)
    assert rows["C"] == (-4.0, None)


def test_share_counts_sales_without_a_region(rates):
    frame = rates("current", A=1.0, none=3.0)
    assert {(r.msa, r.perc) for r in share.share_of_total(frame, "current").collect()} == {("A", 0.25), (None, 0.75)}


def test_gap_floors_the_missing_side(rates):
    merged = geo.outer_merge(rates("a", X=2.0), rates("b", Y=3.0))
    gaps = {r.msa: r.gap for r in geo.region_gap(merged, "a", "b", "gap").collect()}
    assert gaps == {"X": 2.0 - 1e-18, "Y": 1e-18 - 3.0}


def test_regions_spread_to_their_counties(spark, rates):
    counties = spark.createDataFrame(
        [("1001", "A"), ("1003", "A"), ("1003", "A"), (None, "B"), ("9", None)], "fips string, msa string"
    )
    frame = rates("gap", A=1.0, B=2.0, none=9.0)
    rows = sorted((r.fips, r.msa, r.gap) for r in geo.to_counties(frame, counties).collect())
    assert rows == [("00000", "B", 2.0), ("01001", "A", 1.0), ("01003", "A", 1.0)]


def test_no_total_no_rows(spark, rates):
    empty = spark.createDataFrame([], "total double")
    assert geo.attach_scalar(rates("current", A=1.0), empty).count() == 0


def test_unmatched_zip_keeps_its_row(spark):
    rows = spark.createDataFrame([("00042",), ("99999",), (None,)], "zip string")
    table = spark.createDataFrame([("42", "A", "NY")], "zipcode string, msa string, state_abbrev string")
    placed = geo.with_region(rows, geo.zip_regions(table)).collect()
    assert {(r.zip, r.msa, r.geo_copies) for r in placed} == {("00042", "A", 1), ("99999", None, 1), (None, None, 1)}


def test_zip_paddings_differ_on_missing_codes(spark):
    table = spark.createDataFrame([(None, "A", "NY")], "zipcode string, msa string, state_abbrev string")
    assert geo.zip_regions(table).first().zip == "00000"
    assert geo.zip_regions(table, geo.mailbox_zip_padded).first().zip is None


def test_ratio_needs_both_sides(spark):
    def volume(*rows):
        return spark.createDataFrame(list(rows), "state_abbrev string, volume double")

    adds = volume(("NY", 50.0), ("CA", 10.0), (None, 5.0), ("TX", 4.0))
    cancels = volume(("NY", 5.0), (None, 5.0), ("TX", 0.0), ("FL", 2.0))
    rows = [tuple(r) for r in churn.cancel_add_ratio(adds, cancels).collect()]
    assert rows == [("NY", 50.0, 5.0, 10.0)]


def test_state_volume_adds_daily_rates(spark):
    import datetime as dt

    days = [dt.date(2020, 1, 1), dt.date(2020, 1, 2)]
    events = spark.createDataFrame(
        [("adds", days[0], 1, "A", "NY"), ("adds", days[0], 1, "A", "NY"), ("adds", days[0], 2, "B", "NY"),
         ("adds", days[1], 3, "A", "NY"), ("adds", days[1], 4, None, None)],
        "event_kind string, orderdate date, orderid long, msa string, state_abbrev string",
    )
    panel = spark.createDataFrame([(days[0], 100), (days[1], 200)], "date date, panel long")
    volumes = churn.state_volume(churn.daily_event_rates(events, panel))
    assert {(r.state_abbrev, r.volume) for r in volumes.collect()} == {("NY", 250.0), (None, 50.0)}
    assert volumes.filter(F.col("event_kind") != "adds").count() == 0


def test_rates_of_a_very_large_panel_keep_their_digits(spark):
    import datetime as dt

    days = [dt.date(2020, 1, 1) + dt.timedelta(days=n) for n in range(30)]
    events = spark.createDataFrame(
        [("adds", day, n, "A", "NY") for n, day in enumerate(days)],
        "event_kind string, orderdate date, orderid long, msa string, state_abbrev string",
    )
    panel = spark.createDataFrame([(day, 700_000_000) for day in days], "date date, panel long")
    volume = churn.state_volume(churn.daily_event_rates(events, panel)).first().volume
    assert volume == pytest.approx(30 * 10_000 / 700_000_000, rel=1e-12)
