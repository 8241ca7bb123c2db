"""Panel tables derived from a retail star schema (orders, lineitem, part, supplier, ...).

Used by the benches and checks. No join carries a hint: the sides grow with the data, so
Spark's own size threshold and adaptive execution decide which of them to broadcast. Parts
and suppliers are joined first because rules on item text and merchant filter them, which
thins the line items before the large join with orders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import MONEY, PanelTables, typed_items


@dataclass(frozen=True)
class StarSchemaTables:
    panel_tables: PanelTables
    event_tables: PanelTables


def star_schema_tables(spark: SparkSession, folder: str) -> StarSchemaTables:
    """Order items for the sales reports, and the event stream for cancel/add ratios."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    orders = table("orders").withColumn("day", F.col("o_orderdate").cast("date"))
    suppliers = table("supplier")
    nations = table("nation")
    regions = table("region")
    customers = table("customer")
    events = table("events").withColumn("day", F.col("ts").cast("date"))

    items = typed_items(
        table("lineitem")
        .join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("mailboxid"),
            F.col("o_orderkey").alias("orderid"),
            F.col("day").alias("orderdate"),
            F.col("s_name").alias("merchant"),
            F.col("p_name").alias("itemdescription"),
            F.col("l_quantity").alias("itemquantity"),
            F.col("l_extendedprice").alias("itemprice"),
            F.col("o_totalprice").alias("ordertotal"),
        )
    )
    panel = orders.groupBy(F.col("day").alias("date"), F.col("o_orderpriority").alias("slice")).agg(
        (F.lit(100) + F.countDistinct("o_custkey")).alias("panel")
    )
    merchant_sector = (
        suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_name").alias("merchant"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("distribtype"),
        )
    )
    zip_number = F.col("c_nationkey") * 397 + 501
    mailbox_zip = customers.select(
        F.col("c_custkey").alias("mailboxid"),
        F.concat(F.lpad(zip_number.cast("string"), 5, "0"), F.lit("-1234")).alias("shiptozip"),
    ).unionByName(
        customers.filter("c_acctbal < 0").select(
            F.col("c_custkey").alias("mailboxid"), F.lit("99999-0000").alias("shiptozip")
        )
    )

    def cohort_rows(frame: DataFrame, mailbox: str, kind: str) -> DataFrame:
        return frame.select(
            F.col(mailbox).alias("mailboxid"), F.col("day").alias("udate"), F.lit(kind).alias("cohort")
        ).distinct()

    placed = nations.filter("n_nationkey < 23").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    # A zip that lies in two counties has two rows.
    counties = F.when(F.col("n_nationkey") % 5 == 3, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1)))
    geo = (
        placed.withColumn("county", F.explode(counties))
        .select(
            (F.col("n_nationkey") * 397 + 501).cast("string").alias("zipcode"),
            (F.col("n_nationkey") * 1000 + F.col("county")).cast("string").alias("fips"),
            F.concat(F.lit("MSA_"), (F.col("n_nationkey") % 10).cast("string")).alias("msa"),
            F.substring("r_name", 1, 2).alias("state_abbrev"),
        )
    )
    sales = PanelTables(
        items=items,
        panel=panel,
        quality_merchants=suppliers.filter("s_acctbal > 500").select(F.col("s_name").alias("merchant")),
        merchant_sector=merchant_sector,
        mailbox_zip=mailbox_zip,
        cohort=cohort_rows(orders.filter("o_orderstatus <> 'F'"), "o_custkey", "all").unionByName(
            cohort_rows(orders.filter("o_orderpriority = '1-URGENT'"), "o_custkey", "urgent")
        ),
        geo=geo,
    )
    event_items = events.select(
        F.col("user_id").alias("mailboxid"),
        F.col("event_id").alias("orderid"),
        F.col("day").alias("orderdate"),
        F.when(F.col("value") < 40, "Streamer").otherwise("Shop").alias("merchant"),
        F.col("event_type").alias("itemdescription"),
        F.lit(1).cast(MONEY).alias("itemquantity"),
        F.col("value").cast(MONEY).alias("itemprice"),
        F.col("value").cast(MONEY).alias("ordertotal"),
    )
    event_tables = PanelTables(
        items=event_items,
        panel=events.groupBy(F.col("day").alias("date")).agg(F.countDistinct("user_id").alias("panel")),
        quality_merchants=event_items.select("merchant").distinct(),
        merchant_sector=event_items.select("merchant", F.lit("Streaming").alias("sector")).distinct(),
        mailbox_zip=mailbox_zip,
        cohort=cohort_rows(events.filter("event_type <> 'view'"), "user_id", "all").unionByName(
            cohort_rows(events.filter("event_type = 'click'"), "user_id", "click")
        ),
        geo=geo,
    )
    return StarSchemaTables(sales, event_tables)
