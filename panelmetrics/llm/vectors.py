"""Vectors of whole numbers: which rows have one, how they move, exact squared distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 24  # components are held inside, so that squared distances of 4096 of them fit a long
EXACT = 1 << 19  # below it, sums over up to 4096 components are exact as doubles


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are present and finite."""

    def odd(x: Column) -> Column:
        return x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))

    return vector.isNotNull() & ~F.exists(vector, odd)


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component x, as doubles; beyond LIMIT it is LIMIT with its sign."""

    def whole(x: Column) -> Column:
        number = F.floor(F.least(F.greatest(x.cast("double") * F.lit(float(scale)), F.lit(-float(LIMIT))), F.lit(float(LIMIT))))
        return number.cast("int")

    return F.transform(vector, whole)


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list or binary column of int32 numbers, as int64."""
    if pa.types.is_binary(column.type):
        held = np.frombuffer(b"".join(column.to_pylist()), np.int32)
    else:
        held = column.flatten().to_numpy(zero_copy_only=False)
    return held.reshape(len(column), width).astype(np.int64)


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every entry, as int64."""
    most = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if most < EXACT:
        left, right = points.astype(np.float64), entries.astype(np.float64)
        crossed = (left * left).sum(axis=1)[:, None] - 2 * (left @ right.T) + (right * right).sum(axis=1)[None, :]
        return crossed.astype(np.int64)
    return np.stack([((points - e) ** 2).sum(axis=1) for e in entries], axis=1)


def floored_means(sums: DataFrame, keys: list[str]) -> list:
    """Rows (keys, dim, mean) from rows (keys, dim, total, n): the exact floor of sum over count.

    As many rows as there are entries times dimensions come to the driver, whatever the input.
    """
    total, n = F.sum(F.col("total").cast("decimal(38,0)")), F.sum(F.col("n").cast("decimal(38,0)"))
    summed = sums.groupBy(*keys, "dim").agg(total.alias("total"), n.alias("n"))
    rest = F.pmod(F.col("total"), F.col("n"))
    mean = ((F.col("total") - rest) / F.col("n")).cast("long")
    return summed.select(*keys, "dim", mean.alias("mean")).collect()


def sum_rows(held: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(entry, dim, total, n) of every entry with a count, from sums (entry, dim)."""
    some = np.flatnonzero(counts)
    width = held.shape[1]
    return (
        np.repeat(some, width).astype(np.int32),
        np.tile(np.arange(width, dtype=np.int32), len(some)),
        held[some].ravel(),
        np.repeat(counts[some], width),
    )
