"""Ratio and normalisation expressions, all in double after exact decimal sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a panel-normalised measure becomes when it is missing.
NORMALISED_FLOOR = 0.0001


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that gives null, not an error, on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def growth(current: Column, prior: Column) -> Column:
    return ratio(current, prior) - 1


def per_panel(amount: Column, panel: Column, per: int) -> Column:
    """Amount per so many panel members."""
    return ratio(amount.cast("double") * F.lit(float(per)), panel)


def or_else(value: Column, default: float) -> Column:
    return F.coalesce(value, F.lit(default))


def ordered_sum(value: Column) -> Column:
    """Sum of doubles, smallest first, so that it does not depend on the order rows arrive in.

    Nothing is rounded before the sum. The values of a group are gathered: it is meant for frames
    that are small by their keys (dates, regions), not for items. Null without a value.
    """
    values = F.sort_array(F.collect_list(value.cast("double")))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda total, v: total + v))
