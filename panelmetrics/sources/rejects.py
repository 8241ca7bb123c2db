"""Input rows that can't be used, kept apart with the reason."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import number_padded
from ..session import settle

REASON = "reject_reason"
BROKEN = "broken_line"
# Fixed value: dates in text are written month first.
DATE_FORMAT = "M-dd-yyyy"


@dataclass(frozen=True)
class Checked:
    """Rows that passed all tests, and the others as they came with `reject_reason`."""

    rows: DataFrame
    rejects: DataFrame


def checked(rows: DataFrame, tests: Sequence[tuple[str, Column]], cleaned: dict[str, Column]) -> Checked:
    """Rows by tests (reason, what is wrong), the first that holds counts; good rows get the columns of `cleaned`.

    A test that is null counts as passed.
    """
    flagged = rows.withColumn(REASON, F.coalesce(*[F.when(wrong, F.lit(reason)) for reason, wrong in tests]))
    good = flagged.filter(F.col(REASON).isNull()).drop(REASON)
    return Checked(good.withColumns(cleaned), flagged.filter(F.col(REASON).isNotNull()))


def checked_codes(rows: DataFrame, column: str = "fips") -> Checked:
    """Rows with a code of up to five digits, padded to five; rejected are missing codes, other texts and other numbers."""
    text = F.trim(F.col(column))
    number = text.try_cast("double")
    tests = [
        ("missing code", F.col(column).isNull() | (text == "")),
        ("not a number", number.isNull() | F.isnan(number)),
        ("not a code", (number < 0) | (number >= 100_000) | (number != F.floor(number))),
    ]
    return checked(rows, tests, {column: number_padded(number)})


def checked_dates(rows: DataFrame, column: str) -> Checked:
    """Rows with a date written month first, as dates; rejected are missing ones and texts that are no date."""
    day = F.try_to_date(F.trim(F.col(column)), DATE_FORMAT)
    tests = [("missing date", F.col(column).isNull() | (F.trim(F.col(column)) == "")), ("not a date", day.isNull())]
    return checked(rows, tests, {column: day})


def read_checked_code_list(spark: SparkSession, path: str, columns: Sequence[str], column: str = "fips") -> Checked:
    """A CSV code list as `read_code_list` reads it, with the lines it can't use.

    `columns` are all columns of the file, read as text. A line with more or fewer fields is rejected as a broken line,
    and comes with its text in `broken_line`.
    """
    schema = StructType([StructField(name, StringType()) for name in (*columns, BROKEN)])
    # settled: one pass for both frames, and Spark does not read the text of broken lines by itself
    lines = settle(spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN))
    codes = checked_codes(lines.filter(F.col(BROKEN).isNull()), column)
    broken = lines.filter(F.col(BROKEN).isNotNull()).withColumn(REASON, F.lit("broken line"))
    return Checked(codes.rows.drop(BROKEN), codes.rejects.unionByName(broken))
