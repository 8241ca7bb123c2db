"""The published reports: fixed values for every parameter, and one function per report."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame

from ..operators.rules import BrandRule, Clause
from ..sources import PanelTables
from . import reports
from .reports import WeeklySeries

# ---------------------------------------------------------------------------
# Fixed values. Sectors, merchant lists, item patterns and dates decide the
# published numbers and have to be kept as they are, misspellings included.
# ---------------------------------------------------------------------------

SECTORS = ("Food", "Online Platform", "Mass Merchant", "Flowers/Gifts/Jewelry/Alcohol", "Payment Processor")

EXCLUDED = (
    "Etsy", "eBay", "Shutterfly", "Target", "FTD", "HSN", "Dillard's", "Costco", "JCPenney", "HomeAdvisor",
    "BJ's Wholesale Club", "Shari's Berries", "Sears", "zulily", "Overstock.com", "Walmart", "Wish",
    "PropertyRoom.com", "Fingerhut", "Blue Nile", "Hallmark", "Hollar", "QVC",
)
EXCLUDED_PLUS = (*EXCLUDED, "TJ Maxx")
EXCLUDED_LESS = tuple(m for m in EXCLUDED if m != "QVC")
EXCLUDED_SWAPPED = (*EXCLUDED_LESS, "TJ Maxx")

LOOSE_MERCHANT = "Hannaford"
COHORT_SINCE = dt.date(2018, 1, 1)
SHARE_SINCE = dt.date(2016, 1, 1)
SHARE_FIRST_WEEK = dt.date(2018, 7, 1)

TRULY = ("Truly%",)
TRULY_KINDS = ("%spiked%", "%eltz%", "%variet%", "%Lemonade%", "%Wild%berry%")
TRULY_OTHER_GOODS = (
    "Truly Grass Fed%",
    "Truly Yours by Tofutti Dessert Cones%",
    "Truly French",
    "Truly Natural Vitamin C%",
    "Truly Vegan%",
    "Truly Soft%Sheet Set%",
    "Truly Chocolate Milk%",
    "Truly Simple Beef%",
)
TRULY_LOOSE = ("%Truly%Spiked%",)
TRULY_SINGLES = ("Truly%eltz%", "Truly%Spiked%", "Truly%Variety%")
WHITE_CLAW = ("White Claw%", "%White Claw%")
BUD_LIGHT = ("%BL%eltze", "%Bud Light%eltze%", "%Bud%eltze%", "%BudLight%eltze%")
BON_VIV = ("%Bon%&%Viv%", "%Bon%&%V!%", "%BON%V!V%", "Bon%Viv%")
BON_VIV_SHARE = ("%Bon%&%Viv%", "%Bon%&%V!%", "%BON%V!V%", "%BON%VIV%", "Bon%Viv%")
CORONA = ("%Corona%eltze%", "%Corona%spike", "%Coron%eltze%", "%eltze%Corona%")
SMIRNOFF = ("%Smirnoff%eltze%",)
HIGH_NOON = ("High Noon %",)
HIGH_NOON_OTHER_GOODS = ("High Noon (Ramen)%", "Tibetan High Noon%")
HIGH_NOON_LOOSE = ("%High Noon%Spiked%", "%High Noon%eltze%")
ANY_SELTZER = ("%Hard%eltze%", "%Spike%eltze%")
NAMED_SELTZERS = (
    "White Claw%",
    "%White Claw%",
    "%Bon%&%Viv%",
    "%Bon%&%V!%",
    "%BON%V!V%",
    "%BL%eltze",
    "%Bud Light%eltze%",
    "%Bud%eltze%",
    "Truly%",
    "%Corona%eltze%",
    "Smirnoff%eltze%",
    "High Noon %",
)
LEADING_SELTZERS = ("White Claw%", "%White Claw%", "Truly%")

SUBSCRIPTION_MERCHANT = "Netflix"
SUBSCRIPTION_ADDS = (
    "Thanks for joining Netflix!",
    "Thanks for coming back to Netflix!",
    "Thanks for joining Netflix, you plan is%screens at a time",
    "Welcome back to Netflix, your plan is%screens at a time",
    "Thanks for joining Netflix, you plan is Standard",
    "Welcome back to Netflix, your plan is Standard",
    "Welcome back to Netflix, your plan is Basic",
    "Thanks for joining Netflix, you plan is Premium",
    "Thanks for joining Netflix, you plan is % screens at a time",
    "Welcome back to Netflix, your plan is Premium",
    "Thanks for joining Netflix, you plan is Basic",
    "Welcome back to Netflix, your plan is % screen at a time",
    "Thanks for joining Netflix, you plan is % screen at a time",
    "Welcome back to Netflix, your plan is % screens at a time",
    "welcome to Netflix!",
    "welcome back to Netflix!",
    "Thanks for joining Netflix.",
    "Welcome back to Netflix!",
    "Netflix subscription",
    "Umlimited Streaming",
    "% screens at a time",
    "% screen at a time",
)
SUBSCRIPTION_CANCELS = (
    "we've canceled your membership",
    "we've cancelled your membership",
    "we've cancelled your Netflix Account",
    "we've cancelled your Standard plan",
    "your membership has been cancelled",
    "we've cancelled your Unlimited Streaming plan",
    "We've cancelled your membership",
    "We're cancelling your membership",
    "we've canceled your Netflix Account",
    "We are cancelling your membership",
    "we are cancelling your membership",
    "we've cancelled your 2 screens at a time plan",
    "we've cancelled your Basic plan",
    "we've cancelled your Netflix account",
    "we've cancelled your 1 screen at a time plan",
    "we've cancelled your % screens at a time plan",
    "we've cancelled your Netflix Account. This change will be effective%",
    "Netflix cancellation",
    "We have cancelled your membership",
    "we've cancelled your Premium plan",
)
ADD_DAYS = (dt.date(2016, 1, 1), dt.date(2020, 9, 5))
CANCEL_DAYS = (dt.date(2020, 8, 23), dt.date(2020, 8, 29))

# ---------------------------------------------------------------------------
# Rules built from the values above.
# ---------------------------------------------------------------------------


def _listed(brand: str, patterns: tuple[str, ...], excluded: tuple[str, ...], **more) -> BrandRule:
    """Share rule of one clause under the common date floor."""
    return BrandRule(brand, (Clause(patterns, excluded_merchants=excluded, since=SHARE_SINCE, **more),))


TRULY_FOCUS = BrandRule("Truly", (Clause(TRULY, and_any_of=TRULY_KINDS),), excluded_merchants=EXCLUDED)
WHITE_CLAW_GROWTH = BrandRule("White Claw", (Clause(WHITE_CLAW),), excluded_merchants=EXCLUDED)
WHITE_CLAW_GAP = BrandRule("White Claw", (Clause(WHITE_CLAW),), excluded_merchants=EXCLUDED_PLUS)
OTHER_GROWTH = BrandRule(
    "Other Seltzers",
    (
        Clause(BUD_LIGHT),
        Clause(BON_VIV),
        Clause(CORONA),
        Clause(SMIRNOFF),
        Clause(HIGH_NOON, none_of=HIGH_NOON_OTHER_GOODS),
        Clause(HIGH_NOON_LOOSE, merchant=LOOSE_MERCHANT),
        Clause(ANY_SELTZER, none_of=LEADING_SELTZERS),
    ),
    excluded_merchants=EXCLUDED_PLUS,
)

GROWTH_SERIES = (
    WeeklySeries(TRULY_FOCUS),
    WeeklySeries(OTHER_GROWTH, daily=True),
    WeeklySeries(WHITE_CLAW_GROWTH),
)

SHARE_RULES = (
    BrandRule(
        "Truly",
        (
            Clause(TRULY, none_of=TRULY_OTHER_GOODS, excluded_merchants=EXCLUDED, since=SHARE_SINCE),
            Clause(TRULY_LOOSE, merchant=LOOSE_MERCHANT),
        ),
        singleton_any_of=TRULY_SINGLES,
    ),
    _listed("White Claw", WHITE_CLAW, EXCLUDED_PLUS),
    _listed("Bud Light Seltzer", BUD_LIGHT, EXCLUDED_PLUS),
    _listed("BON & VIV", BON_VIV_SHARE, EXCLUDED_PLUS),
    _listed("Corona Hard Seltzer", CORONA, EXCLUDED_PLUS),
    _listed("Smirnoff Spiked Seltzer", SMIRNOFF, EXCLUDED_LESS),
    BrandRule(
        "High Noon Sun Sips",
        (
            Clause(HIGH_NOON, none_of=HIGH_NOON_OTHER_GOODS, excluded_merchants=EXCLUDED_SWAPPED, since=SHARE_SINCE),
            Clause(HIGH_NOON_LOOSE, merchant=LOOSE_MERCHANT),
        ),
    ),
    _listed("Other Seltzers", ANY_SELTZER, EXCLUDED_SWAPPED, none_of=NAMED_SELTZERS),
)

ADDS = BrandRule("adds", (Clause(SUBSCRIPTION_ADDS),))
CANCELS = BrandRule("cancels", (Clause(SUBSCRIPTION_CANCELS),))


# ---------------------------------------------------------------------------
# The reports. `today` is the run date.
# ---------------------------------------------------------------------------


def focus_brand_growth(tables: PanelTables, today: dt.date, latest: dt.date | None = None) -> DataFrame:
    """Weekly metrics of the focus brand; its week start is called orderdate."""
    report = reports.weekly_growth(tables, GROWTH_SERIES[:1], SECTORS, COHORT_SINCE, today, latest=latest)
    return report.withColumnRenamed("weekstart", "orderdate")


def brand_growth(
    tables: PanelTables, today: dt.date, legacy_price_yoy: bool = False, latest: dt.date | None = None
) -> DataFrame:
    """Weekly metrics of the focus brand, its main rival and all others.

    `legacy_price_yoy` gives the price growth of the others as once published, see
    `operators.yoy.weekly_metrics`.
    """
    series = [replace(s, legacy_price_yoy=legacy_price_yoy and s.daily) for s in GROWTH_SERIES]
    return reports.weekly_growth(tables, series, SECTORS, COHORT_SINCE, today, latest=latest)


def market_share(tables: PanelTables, today: dt.date) -> DataFrame:
    """Weekly shares of all brands; its weeks follow from `today` alone."""
    return reports.weekly_market_share(tables, SHARE_RULES, SECTORS, today, SHARE_FIRST_WEEK)


def growth_contribution(tables: PanelTables, today: dt.date, latest: dt.date | None = None) -> DataFrame:
    return reports.contribution_by_county(tables, TRULY_FOCUS, SECTORS, today, latest=latest)


def rival_gap(tables: PanelTables, today: dt.date, latest: dt.date | None = None) -> DataFrame:
    return reports.gap_by_county(tables, TRULY_FOCUS, WHITE_CLAW_GAP, SECTORS, today, name="truly", latest=latest)


def cancel_add_ratio(tables: PanelTables) -> DataFrame:
    """Cancels against adds by state; its days are fixed."""
    return reports.cancel_add_by_state(tables, ADDS, CANCELS, SUBSCRIPTION_MERCHANT, ADD_DAYS, CANCEL_DAYS)


def dashboard(
    tables: PanelTables, today: dt.date, calendar: DataFrame | None = None, latest: dt.date | None = None
) -> dict[str, DataFrame]:
    """The four results shown together."""
    return reports.report_set(
        tables,
        GROWTH_SERIES,
        SHARE_RULES,
        TRULY_FOCUS,
        (TRULY_FOCUS, WHITE_CLAW_GAP),
        SECTORS,
        COHORT_SINCE,
        SHARE_FIRST_WEEK,
        today,
        gap_name="truly",
        calendar=calendar,
        latest=latest,
    )
