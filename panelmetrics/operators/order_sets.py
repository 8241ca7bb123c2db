"""Distinct orders as sets that can be merged: weeks add up from days without going back to the items.

A set is kept as bits, one word per block of 64 order ids that has an order in it, so it is exact, merges by OR
and counts by its bits. There are never more words than distinct orders: a set takes at most a small row per
order, whatever the ids, and one per 64 orders where ids are dense. Words combine before they move, and a task
that groups them can spill, as their rows are small and of fixed size.

Rows without an order id are in no set, as `countDistinct` leaves them out; a group without any order has no
rows here (and no count of 0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Fixed value: the bits of a long are the orders of a block.
BLOCK_BITS = 6


def order_sets(rows: DataFrame, keys: Sequence[str], order: str = "orderid") -> DataFrame:
    """One row (keys, bucket, orders) per group and block of 64 order ids that occur in it."""
    known = rows.filter(F.col(order).isNotNull())
    number = F.col(order).cast("long")
    bucket = F.shiftright(number, BLOCK_BITS).alias("bucket")
    place = number.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    return known.groupBy(*keys, bucket).agg(F.bit_or(bit).alias("orders"))


def merged_sets(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sets of coarser groups: `keys` are columns or expressions' names of the sets' rows."""
    return sets.groupBy(*keys, "bucket").agg(F.bit_or("orders").alias("orders"))


def counted_sets(sets: DataFrame, keys: Sequence[str], name: str = "order_count") -> DataFrame:
    """Distinct orders of each group."""
    return sets.groupBy(*keys).agg(F.sum(F.bit_count("orders")).alias(name))
