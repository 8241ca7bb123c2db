"""Code lists kept as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import number_padded


def read_code_list(spark: SparkSession, path: str, column: str = "fips") -> DataFrame:
    """CSV with a numeric code column: rows without a code go, codes become five digits.

    The column is read as text and cast, so no inference pass over the file is needed
    and codes written as 1001.0 are accepted.
    """
    rows = spark.read.csv(path, header=True)
    return rows.na.drop(subset=[column]).withColumn(column, number_padded(F.col(column).cast("double")))
