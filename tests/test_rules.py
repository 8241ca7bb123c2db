import datetime as dt
import random
from functools import reduce
from operator import or_

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelmetrics.functions import any_like
from panelmetrics.operators.rules import (
    BrandRule,
    Clause,
    distinct_brands,
    rule_holds,
    stack_brands,
    tag_brands,
    tag_brands_by_text,
)
from panelmetrics.plans import published
from panelmetrics.plans.published import ADDS, CANCELS, OTHER_GROWTH, SHARE_RULES, TRULY_FOCUS

NEW = "2019-06-01"
EARLY = "2015-06-01"


@pytest.fixture(scope="module")
def brands_of(spark, make_tables, item):
    """Brands of one item under a set of rules."""

    def find(rules, text, merchant="Safeway", day=NEW):
        rows = make_tables(items=[item(day, text, merchant=merchant)]).items
        return sorted(row.brand for row in tag_brands(rows, rules).collect())

    return find


def test_unknown_merchant_is_dropped_by_an_exclusion_list(make_tables, item):
    items = make_tables(items=[item(NEW, merchant=None), item(NEW, merchant="Etsy"), item(NEW, merchant="Shop")]).items
    rule = BrandRule("x", (Clause(("%",)),), excluded_merchants=("Etsy",))
    assert [row.merchant for row in items.filter(rule_holds(rule)).collect()] == ["Shop"]
    inside = BrandRule("x", (Clause(("%",), excluded_merchants=("Etsy",)),))
    assert [row.merchant for row in items.filter(rule_holds(inside)).collect()] == ["Shop"]


def test_override_escapes_exclusion_and_date_floor(brands_of):
    rule = BrandRule(
        "x",
        (
            Clause(("OLD %",), excluded_merchants=("Loose",), since=dt.date(2016, 1, 1)),
            Clause(("%gizmo",), merchant="Loose"),
        ),
    )
    assert brands_of([rule], "old gizmo", "Loose", EARLY) == ["x"]
    assert brands_of([rule], "old plate", "Loose") == []
    assert brands_of([rule], "old gizmo", "Other", EARLY) == []
    assert brands_of([rule], "old plate", "Other") == ["x"]


def test_an_item_can_have_several_brands_and_both_forms_agree(spark, make_tables, item):
    texts = ["red widget", "blue widget", "old gear", "RED ring", None, "hot rod"]
    items = make_tables(items=[item(NEW, text, order=n) for n, text in enumerate(texts)]).items
    rules = [
        BrandRule("Red", (Clause(("RED %",), none_of=("%RING",)),)),
        BrandRule("Widgets", (Clause(("%widget",)),)),
        BrandRule("Any", (Clause(("%",)),)),
    ]
    one_pass = sorted((row.brand, row.orderid) for row in tag_brands(items, rules).collect())
    stacked = sorted((row.brand, row.orderid) for row in stack_brands(items, rules).collect())
    assert one_pass == stacked
    assert [brand for brand, order in one_pass if order == 0] == ["Any", "Red", "Widgets"]
    assert ("Any", 4) not in one_pass


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    text=st.text("abAB %x!", min_size=0, max_size=12),
    pattern=st.text("abAB%!", min_size=1, max_size=6),
)
def test_case_insensitive_like_is_like_on_lower_case(spark, text, pattern):
    row = spark.range(1).select(
        F.lit(text).ilike(pattern).alias("a"), F.lower(F.lit(text)).like(pattern.lower()).alias("b")
    ).first()
    assert row.a == row.b


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    text=st.text("abAB %x!_\\éİ", min_size=0, max_size=12),
    patterns=st.lists(st.text("abAB%!_é", min_size=1, max_size=7), min_size=1, max_size=6),
)
def test_grouping_patterns_by_piece_changes_nothing(spark, text, patterns):
    column = F.lit(text)
    row = spark.range(1).select(
        any_like(column, patterns).alias("a"), reduce(or_, [column.ilike(p) for p in patterns]).alias("b")
    ).first()
    assert row.a == row.b


def test_published_patterns_agree_with_plain_like(spark, make_tables, item):
    words = ["Hard", "Seltzer", "Bud", "Light", "BL", "Bon", "&", "VIV", "V!V", "Corona", "spike", "eltze", "High Noon "]
    random.seed(3)
    texts = [" ".join(random.choices(words, k=random.randrange(1, 5))) for _ in range(400)]
    items = make_tables(items=[item(NEW, text, order=n) for n, text in enumerate(texts)]).items
    text = F.col("itemdescription")
    for patterns in (published.BUD_LIGHT, published.BON_VIV_SHARE, published.CORONA, published.ANY_SELTZER):
        plain = reduce(or_, [text.ilike(p) for p in patterns])
        assert items.filter(any_like(text, patterns) != plain).count() == 0
        assert 0 < items.filter(plain).count() < len(texts)


@pytest.mark.parametrize(
    ("text", "merchant", "day", "expected"),
    [
        ("Truly Spiked & Sparkling", "Safeway", NEW, ["Truly"]),
        ("TRULY french", "Safeway", NEW, []),
        ("Truly French Toast", "Safeway", NEW, ["Truly"]),
        ("Truly Grass Fed Butter", "Safeway", NEW, []),
        ("Truly Soft Everyday Sheet Set", "Safeway", NEW, []),
        ("Truly Hard Seltzer", "Walmart", NEW, []),
        ("Truly Hard Seltzer", "TJ Maxx", NEW, ["Truly"]),
        ("Truly Hard Seltzer", "Safeway", EARLY, []),
        ("12pk Truly Berry Spiked", "Hannaford", EARLY, ["Truly"]),
        ("White Claw Hard Seltzer", "Safeway", NEW, ["White Claw"]),
        ("White Claw Hard Seltzer", "TJ Maxx", NEW, []),
        ("Variety White Claw", "Safeway", NEW, ["White Claw"]),
        ("Bud Light Seltzer", "Safeway", NEW, ["Bud Light Seltzer"]),
        ("BL Hard Seltze", "Safeway", NEW, ["Bud Light Seltzer"]),
        ("BL Hard Seltzer", "Safeway", NEW, ["Other Seltzers"]),
        ("Bon & V!V Spiked Seltzer", "Safeway", NEW, ["BON & VIV"]),
        ("Bon Viv Hard Seltzer", "Safeway", NEW, ["BON & VIV", "Other Seltzers"]),
        ("Corona Refresca Spike", "Safeway", NEW, ["Corona Hard Seltzer"]),
        ("Coron. Hard Seltzer", "Safeway", NEW, ["Corona Hard Seltzer", "Other Seltzers"]),
        ("Smirnoff Seltzer", "QVC", NEW, ["Smirnoff Spiked Seltzer"]),
        ("Smirnoff Seltzer", "TJ Maxx", NEW, ["Smirnoff Spiked Seltzer"]),
        ("High Noon Sun Sips", "QVC", NEW, ["High Noon Sun Sips"]),
        ("High Noon (Ramen) Bowl", "Safeway", NEW, []),
        ("Case High Noon Seltzer", "Hannaford", EARLY, ["High Noon Sun Sips"]),
        ("Hard Seltzer", "QVC", NEW, ["Other Seltzers"]),
        ("Spiked Seltzer", "TJ Maxx", NEW, []),
    ],
)
def test_published_share_rules(brands_of, text, merchant, day, expected):
    assert brands_of(SHARE_RULES, text, merchant, day) == sorted(expected)


@pytest.mark.parametrize(
    ("text", "merchant", "expected"),
    [
        ("Smirnoff Seltzer", "Safeway", True),
        ("Smirnoff Seltzer", "TJ Maxx", False),
        ("High Noon Seltzer", "Hannaford", True),
        ("Case High Noon Seltzer", "Hannaford", True),
        ("Case High Noon Seltzer", "Safeway", False),
        ("Some Hard Seltzer", "Safeway", True),
        ("Truly Hard Seltzer", "Safeway", False),
        ("White Claw Hard Seltzer", "Safeway", False),
        ("Bon VIV drink", "Safeway", True),
        ("The Bon VIV drink", "Safeway", False),
    ],
)
def test_published_other_group(brands_of, text, merchant, expected):
    assert bool(brands_of([OTHER_GROWTH], text, merchant)) is expected


def test_published_focus_rule_needs_a_kind(brands_of):
    assert brands_of([TRULY_FOCUS], "truly wild berry") == ["Truly"]
    assert brands_of([TRULY_FOCUS], "Truly Variety Pack", day=EARLY) == ["Truly"]
    assert brands_of([TRULY_FOCUS], "Truly Unruly") == []
    assert brands_of([TRULY_FOCUS], "The Truly Variety") == []
    assert brands_of([TRULY_FOCUS], "Truly Variety Pack", "QVC") == []


def test_published_subscription_events(brands_of):
    assert brands_of([ADDS, CANCELS], "thanks for joining netflix!") == ["adds"]
    assert brands_of([ADDS, CANCELS], "Welcome back to Netflix, your plan is 2 screens at a time") == ["adds"]
    assert brands_of([ADDS, CANCELS], "We've Cancelled your 4 screens at a time plan") == ["cancels"]
    assert brands_of([ADDS, CANCELS], "2 screens at a time") == ["adds"]
    assert brands_of([ADDS, CANCELS], "netflix subscription renewed") == []


def test_published_exclusion_lists_differ_as_published():
    assert len(published.EXCLUDED) == 23
    assert set(published.EXCLUDED_PLUS) - set(published.EXCLUDED) == {"TJ Maxx"}
    assert set(published.EXCLUDED) - set(published.EXCLUDED_LESS) == {"QVC"}
    assert set(published.EXCLUDED_SWAPPED) == set(published.EXCLUDED_LESS) | {"TJ Maxx"}
    assert len(published.SUBSCRIPTION_ADDS) == 22
    assert len(published.SUBSCRIPTION_CANCELS) == 20


def test_rules_of_one_name_all_count(make_tables, item):
    rules = [BrandRule("X", (Clause(("RED %",)),)), BrandRule("X", (Clause(("%WIDGET",)),))]
    items = make_tables(items=[item("2020-01-01", "red widget"), item("2020-01-01", "red gear")]).items
    tagged = tag_brands(items, rules).select("brand", "itemdescription")
    stacked = stack_brands(items, rules).select("brand", "itemdescription")
    assert sorted(tagged.collect()) == sorted(stacked.collect()) and tagged.count() == 3


def test_reports_refuse_rules_of_one_name():
    with pytest.raises(ValueError, match="share a name"):
        distinct_brands([BrandRule("X", (Clause(("RED %",)),)), BrandRule("X", (Clause(("%WIDGET",)),))])


def test_tags_by_text_equal_tags_by_row(make_tables, item):
    """Floors of several clauses, rules of one name, unknown texts, merchants and dates."""
    rules = [
        BrandRule(
            "Old",
            (
                Clause(("OLD %",), excluded_merchants=("Loose",), since=dt.date(2019, 1, 1)),
                Clause(("%gizmo",), since=dt.date(2016, 1, 1)),
                Clause(("%rod",), merchant="Loose"),
            ),
            excluded_merchants=("Etsy",),
        ),
        BrandRule("Any", (Clause(("%",), since=dt.date(2017, 1, 1)),)),
        BrandRule("Any", (Clause(("%o%",)),)),
    ]
    rows = [
        item(day, text, merchant=merchant)
        for day in ("2015-06-01", "2016-06-01", "2018-06-01", "2019-06-01", None)
        for text in ("old gizmo", "OLD rod", "red rod", "plate", None, "")
        for merchant in ("Shop", "Loose", "Etsy", None)
    ]
    items = make_tables(items=rows).items
    key = ["brand", "orderdate", "itemdescription", "merchant"]
    by_row, by_text = (sorted(map(repr, f(items, rules).select(*key).collect())) for f in (tag_brands, tag_brands_by_text))
    assert by_row == by_text
    assert tag_brands_by_text(make_tables().items, rules).count() == 0
