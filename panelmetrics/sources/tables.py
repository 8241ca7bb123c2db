"""The logical tables every report reads.

| table             | columns                                                                    |
|-------------------|----------------------------------------------------------------------------|
| items             | mailboxid, orderid, orderdate, merchant, itemdescription, itemquantity,    |
|                   | itemprice, ordertotal                                                      |
| panel             | date, panel (several rows a date)                                          |
| quality_merchants | merchant                                                                   |
| merchant_sector   | merchant, sector, distribtype (optional)                                   |
| mailbox_zip       | mailboxid, shiptozip (one or more rows a mailbox)                          |
| cohort            | mailboxid, udate, cohort                                                   |
| geo               | zipcode, fips, msa, state_abbrev                                           |
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = "decimal(12,2)"
QUANTITY = "decimal(18,6)"


@dataclass(frozen=True)
class PanelTables:
    items: DataFrame
    panel: DataFrame
    quality_merchants: DataFrame
    merchant_sector: DataFrame
    mailbox_zip: DataFrame
    cohort: DataFrame
    geo: DataFrame


def typed_items(items: DataFrame) -> DataFrame:
    """Item rows with the types the reports rely on: real dates and exact money.

    Decimals keep the scale of the source; of other numbers, money becomes decimals of two places and
    quantities (which may be weights) of six.
    """

    def exact(name: str, kind: str) -> Column:
        column = F.col(name)
        return (column if isinstance(items.schema[name].dataType, DecimalType) else column.cast(kind)).alias(name)

    return items.select(
        F.col("mailboxid").cast("long").alias("mailboxid"),
        F.col("orderid").cast("long").alias("orderid"),
        F.col("orderdate").cast("date").alias("orderdate"),
        "merchant",
        "itemdescription",
        exact("itemquantity", QUANTITY),
        exact("itemprice", MONEY),
        exact("ordertotal", MONEY),
    )


def panel_tables(spark: SparkSession, names: Mapping[str, str] | None = None, folder: str | None = None) -> PanelTables:
    """Load the tables from the catalogue, or from parquet directories under `folder`.

    `names` maps a logical table to its catalogue or directory name where they differ.
    """
    names = names or {}

    def load(table: str) -> DataFrame:
        name = names.get(table, table)
        return spark.read.parquet(f"{folder}/{name}") if folder else spark.table(name)

    loaded = {table: load(table) for table in PanelTables.__dataclass_fields__}
    loaded["items"] = typed_items(loaded["items"])
    loaded["panel"] = loaded["panel"].withColumn("date", F.col("date").cast("date"))
    loaded["cohort"] = loaded["cohort"].withColumn("udate", F.col("udate").cast("date"))
    return PanelTables(**loaded)
