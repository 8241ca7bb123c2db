"""Dates of a stored fact, found without reading its date column.

Where the table is partitioned by the date, dates are partition values: Spark fills them in, and the scan reads no
column. Elsewhere the largest and least date stand in the statistics of the Parquet footers, and Spark is asked for
the aggregate itself (aggregate push-down), so it reads footers only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

# Settings of a session of its own, so that those of the caller stay as they are.
FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def is_partition_column(spark: SparkSession, folder: str, column: str) -> bool:
    """Whether the files of a folder lack the column, so that it comes from the names of their directories."""
    return column not in spark.read.option("recursiveFileLookup", "true").parquet(folder).columns


def date_bounds(spark: SparkSession, folder: str, column: str = "orderdate") -> DataFrame:
    """One row (first, last): the least and the greatest date of a Parquet table."""
    bounds = [F.min(column).alias("first"), F.max(column).alias("last")]
    rows = spark.read.parquet(folder)
    if is_partition_column(spark, folder, column):
        return rows.agg(*bounds)
    if not isinstance(rows.schema[column].dataType, DateType):  # footers have no usable statistics of timestamps
        return rows.select(F.col(column).cast("date").alias(column)).agg(*bounds)
    session = spark.newSession()
    for key, value in FOOTERS.items():
        session.conf.set(key, value)
    return session.read.parquet(folder).agg(*bounds)


def last_order_date(spark: SparkSession, folder: str, column: str = "orderdate") -> dt.date | None:
    """The last date of a stored fact, for the `latest` of the reports; None for an empty table.

    A date kept as a timestamp costs a pass over that column.
    """
    last = date_bounds(spark, folder, column).first()["last"]
    return last if last is None or isinstance(last, dt.date) else dt.date.fromisoformat(str(last))


def order_dates(spark: SparkSession, folder: str, column: str = "orderdate") -> DataFrame:
    """Distinct order dates of a stored fact, for the `calendar` of the reports.

    Where the fact is partitioned by the date no column is read; elsewhere it is one pass over the date column.
    """
    dates = spark.read.parquet(folder).select(F.col(column).cast("date").alias("orderdate"))
    return dates.filter(F.col("orderdate").isNotNull()).distinct()
