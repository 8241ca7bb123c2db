"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmetrics.plans import write_reports
from panelmetrics.session import shared_folder
from panelmetrics.sources import date_bounds, order_dates, read_code_list

from .base import Inputs, check, with_views
from .metrics import MARKET_SHARE_SQL, market_share
from .reports import REPORT_SET_SQL, published_set


def _new_folder(t: Inputs) -> str:
    return f"{shared_folder(t.spark)}/checks-{uuid.uuid4().hex}"


@check(
    "s1_table_scan",
    with_views("""SELECT mailboxid, orderid, orderdate, merchant, itemdescription, CAST(itemquantity AS DOUBLE) AS itemquantity,
  CAST(itemprice AS DOUBLE) AS itemprice, CAST(ordertotal AS DOUBLE) AS ordertotal FROM fact_items"""),
)
def table_scan(t: Inputs) -> DataFrame:
    money = ("itemquantity", "itemprice", "ordertotal")
    return t.sales.items.withColumns({c: F.col(c).cast("double") for c in money})


@check(
    "s2_dimension_csv",
    "SELECT printf('%05d', c_custkey) AS code, c_name FROM customer WHERE c_acctbal >= 0",
)
def dimension_csv(t: Inputs) -> DataFrame:
    path = _new_folder(t)
    code = F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("code")
    t.raw("customer").select(code, "c_name").write.csv(path, header=True)
    return read_code_list(t.spark, path, "code")


@check("s3_result_hand_off", MARKET_SHARE_SQL)
def result_hand_off(t: Inputs) -> DataFrame:
    return t.spark.read.parquet(write_reports({"share": market_share(t)}, _new_folder(t))["share"])


@check("s4_report_set", REPORT_SET_SQL)
def report_set(t: Inputs) -> DataFrame:
    paths = write_reports(published_set(t), _new_folder(t))
    frames = {name: t.spark.read.parquet(path) for name, path in paths.items()}

    def figures(report: str, group: str, key: str, value: str) -> DataFrame:
        return frames[report].select(
            F.lit(report).alias("report"),
            F.col(group).alias("grp"),
            F.col(key).cast("string").alias("key"),
            F.col(value).alias("value"),
        )

    return (
        figures("growth", "brand", "weekstart", "yy_sales")
        .unionByName(figures("share", "brand", "odate", "perc"))
        .unionByName(figures("gap_map", "msa", "fips", "gap"))
        .unionByName(figures("contribution_map", "msa", "fips", "contrib"))
    )


def stored_items(t: Inputs) -> str:
    """The fact written to a folder of its own."""
    path = _new_folder(t)
    t.sales.items.repartitionByRange("orderdate").write.parquet(path)
    return path


BOUNDS_SQL = with_views("SELECT min(orderdate) AS first, max(orderdate) AS last FROM fact_items")


@check("p13_dates_of_footers", BOUNDS_SQL)
def dates_of_footers(t: Inputs) -> DataFrame:
    return date_bounds(t.spark, stored_items(t))


@check(
    "p13_dates_of_partitions",
    with_views("""SELECT CAST(date_trunc('month', min(orderdate)) AS DATE) AS first,
  CAST(date_trunc('month', max(orderdate)) AS DATE) AS last FROM fact_items"""),
)
def dates_of_partitions(t: Inputs) -> DataFrame:
    months = F.trunc("orderdate", "month").alias("month")
    path = _new_folder(t)
    t.sales.items.select("orderid", months).repartition("month").write.partitionBy("month").parquet(path)
    return date_bounds(t.spark, path, "month")


@check("j12_calendar_of_stored_fact", with_views("SELECT DISTINCT orderdate FROM fact_items WHERE orderdate IS NOT NULL"))
def calendar_of_stored_fact(t: Inputs) -> DataFrame:
    return order_dates(t.spark, stored_items(t))
