"""Geography: zip to region, period and brand merges by region, regions to counties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blank_padded, first_five, growth, left_padded, or_else

# Stand-ins that keep a region with one missing side in the result.
GROWTH_EPSILON = 0.00001
GAP_FLOOR = 0.000000000000000001


def zip_regions(geo: DataFrame, pad: Callable[[Column], Column] = blank_padded) -> DataFrame:
    """Distinct (zip, region, state) with the number of rows each stands for."""
    return geo.groupBy(pad(F.col("zipcode")).alias("zip"), "msa", "state_abbrev").agg(
        F.count(F.lit(1)).cast("int").alias("geo_copies")
    )


def with_region(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Region and state of each row's zip; rows without a match keep nulls and count once."""
    return rows.join(regions, "zip", "left").withColumn("geo_copies", F.coalesce("geo_copies", F.lit(1)))


def with_each_region(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """As `with_region`, but a row per geography row behind the zip instead of their number."""
    placed = with_region(rows, regions).withColumn("geo_copy", F.explode(F.sequence(F.lit(1), "geo_copies")))
    return placed.drop("geo_copy", "geo_copies")


def mailbox_zip_prefix(code: Column) -> Column:
    """Zip key of the sales maps."""
    return first_five(code)


def mailbox_zip_padded(code: Column) -> Column:
    """Zip key of the event map."""
    return left_padded(code)


def outer_merge(left: DataFrame, right: DataFrame, key: str = "msa") -> DataFrame:
    """All keys of both sides, once where they match; null keys never match each other."""
    moved = right.withColumnRenamed(key, "right_key")
    return (
        left.join(moved, F.col(key) == F.col("right_key"), "full")
        .withColumn(key, F.coalesce(F.col(key), F.col("right_key")))
        .drop("right_key")
    )


def region_change(merged: DataFrame) -> DataFrame:
    """Absolute change and growth percent from `current` and `prior` rates.

    A region new this year gets a very large growth percent; one that vanished gets null.
    """
    growth_percent = growth(F.col("current"), or_else(F.col("prior"), 0.0) + F.lit(GROWTH_EPSILON)) * 100
    return merged.select(
        "msa",
        "current",
        "prior",
        (or_else(F.col("current"), 0.0) - or_else(F.col("prior"), 0.0)).alias("change"),
        F.round(growth_percent, 2).alias("yygrowth"),
    )


def region_gap(merged: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Difference of two brands' rates per region."""
    return merged.select(
        "msa", (or_else(F.col(left), GAP_FLOOR) - or_else(F.col(right), GAP_FLOOR)).alias(name)
    )


def attach_scalar(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a frame of at most one row on every row; no rows if that frame is empty."""
    return rows.crossJoin(F.broadcast(one_row))


def to_counties(by_region: DataFrame, geo: DataFrame) -> DataFrame:
    """Each region's figures once per county; rows without a region have no county."""
    counties = geo.select("fips", "msa").distinct()
    return counties.join(by_region, "msa").withColumn("fips", blank_padded(F.col("fips")))
