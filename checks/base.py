"""Registry, parameters and the SQL side of the input views."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from panelmetrics.operators.rules import BrandRule, Clause
from panelmetrics.sources import PanelTables, star_schema_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BUILDERS: dict[str, Callable[[Inputs], DataFrame]] = {}


@dataclass(frozen=True)
class Inputs:
    spark: SparkSession
    folder: str
    sales: PanelTables
    events: PanelTables

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


_INPUTS: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, folder: str) -> Inputs:
    """The lazily built input tables; only their definitions are kept."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _INPUTS:
        derived = star_schema_tables(spark, folder)
        _INPUTS[key] = Inputs(spark, folder, derived.panel_tables, derived.event_tables)
    return _INPUTS[key]


def check(name: str, sql: str | None = None):
    """Register a query over `Inputs` and its SQL twin."""

    def add(build: Callable[[Inputs], DataFrame]):
        BUILDERS[name] = build
        QUERIES[name] = lambda spark, folder: build(inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


# Parameters of the registered queries. TODAY stands for the run date.
TODAY = dt.date(2001, 8, 1)
SINCE = dt.date(1998, 1, 1)
MIDYEAR = dt.date(1998, 7, 1)
RULE_SINCE = dt.date(1999, 1, 1)
SECTORS = ("ASIA", "EUROPE", "AMERICA")
EXCLUDED = ("Supplier#000000001", "Supplier#000000002")
LOOSE = "Supplier#000000005"
ADD_DAYS = (dt.date(2024, 1, 1), dt.date(2024, 1, 30))
CANCEL_DAYS = (dt.date(2024, 1, 20), dt.date(2024, 1, 26))

ALL = BrandRule("All", (Clause(("%",)),), excluded_merchants=EXCLUDED)
RED_ALL = BrandRule("Red", (Clause(("RED %",)),), excluded_merchants=EXCLUDED)
BLUE_ALL = BrandRule("Blue", (Clause(("BLUE %",)),), excluded_merchants=EXCLUDED)
RED = BrandRule(
    "Red",
    (
        Clause(
            ("RED %",),
            and_any_of=("%WIDGET", "%RING", "%GEAR"),
            none_of=("RED RING%",),
            excluded_merchants=EXCLUDED,
            since=RULE_SINCE,
        ),
    ),
    singleton_any_of=("RED W%", "%GEAR"),
)
BLUE = BrandRule("Blue", (Clause(("BLUE %",), excluded_merchants=EXCLUDED),))
OLD = BrandRule(
    "Old",
    (
        Clause(("OLD %",), excluded_merchants=(*EXCLUDED, LOOSE), since=RULE_SINCE),
        Clause(("%GIZMO",), merchant=LOOSE),
    ),
)
WIDGETS = BrandRule("Widgets", (Clause(("%WIDGET",), none_of=("RED %",), excluded_merchants=EXCLUDED[:1]),))
RULES = (RED, BLUE, OLD, WIDGETS)
ADDS = BrandRule("adds", (Clause(("SIGN%", "%CHASE")),))
CANCELS = BrandRule("cancels", (Clause(("ERR%", "cancelled")),))

SECTORS_SQL = "('ASIA', 'EUROPE', 'AMERICA')"
EXCLUDED_SQL = "('Supplier#000000001', 'Supplier#000000002')"
RED_SQL = f"""(itemdescription ILIKE 'RED %'
  AND (itemdescription ILIKE '%WIDGET' OR itemdescription ILIKE '%RING' OR itemdescription ILIKE '%GEAR')
  AND itemdescription NOT ILIKE 'RED RING%' AND merchant NOT IN {EXCLUDED_SQL} AND orderdate >= DATE '1999-01-01')"""
BLUE_SQL = f"(itemdescription ILIKE 'BLUE %' AND merchant NOT IN {EXCLUDED_SQL})"
OLD_SQL = """((itemdescription ILIKE 'OLD %' AND orderdate >= DATE '1999-01-01'
   AND merchant NOT IN ('Supplier#000000001', 'Supplier#000000002', 'Supplier#000000005'))
  OR (merchant = 'Supplier#000000005' AND itemdescription ILIKE '%GIZMO'))"""
WIDGETS_SQL = """(itemdescription ILIKE '%WIDGET' AND itemdescription NOT ILIKE 'RED %'
  AND merchant NOT IN ('Supplier#000000001'))"""

VIEWS = """
fact_items AS (
  SELECT o_custkey AS mailboxid, o_orderkey AS orderid, CAST(o_orderdate AS DATE) AS orderdate, s_name AS merchant,
         p_name AS itemdescription, CAST(l_quantity AS DECIMAL(12,2)) AS itemquantity,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS itemprice, CAST(o_totalprice AS DECIMAL(12,2)) AS ordertotal
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey),
panel_dynamic AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS slice,
         CAST(100 + count(DISTINCT o_custkey) AS BIGINT) AS panel FROM orders GROUP BY 1, 2),
panel_by_date AS (SELECT date, max(panel) AS panel FROM panel_dynamic GROUP BY 1),
quality_merchants AS (SELECT s_name AS merchant FROM supplier WHERE s_acctbal > 500),
sector_all AS (
  SELECT s_name AS merchant, r_name AS sector, n_name AS distribtype
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
userzips AS (
  SELECT c_custkey AS mailboxid, concat(lpad(CAST(c_nationkey * 397 + 501 AS VARCHAR), 5, '0'), '-1234') AS shiptozip
  FROM customer
  UNION ALL SELECT c_custkey, '99999-0000' FROM customer WHERE c_acctbal < 0),
single_zip AS (
  SELECT mailboxid, substring(shiptozip, 1, 5) AS zip FROM userzips
  WHERE mailboxid IN (SELECT mailboxid FROM userzips GROUP BY mailboxid HAVING count(*) = 1)),
cohort_list AS (
  SELECT DISTINCT o_custkey AS mailboxid, CAST(o_orderdate AS DATE) AS udate, 'all' AS cohort
  FROM orders WHERE o_orderstatus <> 'F'
  UNION ALL SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE), 'urgent' FROM orders
  WHERE o_orderpriority = '1-URGENT'),
zip_level_info AS (
  SELECT CAST(n_nationkey * 397 + 501 AS VARCHAR) AS zipcode, CAST(n_nationkey * 1000 + county AS VARCHAR) AS fips,
         concat('MSA_', CAST(n_nationkey % 10 AS VARCHAR)) AS msa, substring(r_name, 1, 2) AS state_abbrev
  FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES (1), (3)) AS counties(county)
    ON county = 1 OR n_nationkey % 5 = 3
  WHERE n_nationkey < 23),
zip_msa AS (SELECT right(concat('00000', coalesce(zipcode, '')), 5) AS zip, msa, state_abbrev FROM zip_level_info),
fact_events AS (
  SELECT user_id AS mailboxid, event_id AS orderid, CAST(ts AS DATE) AS orderdate,
         CASE WHEN value < 40 THEN 'Streamer' ELSE 'Shop' END AS merchant, event_type AS itemdescription FROM events),
event_panel AS (SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS panel FROM events GROUP BY 1),
event_cohort AS (
  SELECT DISTINCT user_id AS mailboxid, CAST(ts AS DATE) AS udate, 'all' AS cohort FROM events WHERE event_type <> 'view'
  UNION ALL SELECT DISTINCT user_id, CAST(ts AS DATE), 'click' FROM events WHERE event_type = 'click'),
sector_merchants AS (SELECT merchant FROM sector_all WHERE sector IN ('ASIA', 'EUROPE', 'AMERICA')),
latest AS (SELECT max(orderdate) AS day FROM fact_items),
clean_cohort AS (
  SELECT * FROM cohort_list WHERE cohort = 'all' AND year(udate) IN
    (SELECT DISTINCT year(orderdate) FROM fact_items WHERE orderdate >= DATE '1998-01-01')),
scoped AS (
  SELECT f.*, z.zip FROM fact_items f
  JOIN (SELECT DISTINCT merchant FROM quality_merchants) q ON f.merchant = q.merchant
  JOIN single_zip z ON f.mailboxid = z.mailboxid
  JOIN clean_cohort c ON f.mailboxid = c.mailboxid AND f.orderdate = c.udate
  WHERE f.merchant IN (SELECT merchant FROM sector_merchants))"""


def with_views(body: str, *ctes: str) -> str:
    return "WITH" + ",\n".join([VIEWS, *ctes]) + "\n" + body


def daily_cte(name: str, brand: str, condition: str) -> str:
    """Daily metrics of one brand by the published definition."""
    return f"""{name} AS (
  SELECT '{brand}' AS brand, orderdate, max(panel) AS panel,
         CAST(count(DISTINCT orderid) AS DOUBLE) AS ordercount, CAST(sum(item_count) AS DOUBLE) AS item_count,
         CAST(sum(pq) AS DOUBLE) AS pq,
         CAST(count(DISTINCT orderid) AS DOUBLE) * 1000.0::DOUBLE / CAST(max(panel) AS DOUBLE) AS pnl_ordercount,
         CAST(sum(item_count) AS DOUBLE) * 1000.0::DOUBLE / CAST(max(panel) AS DOUBLE) AS pnl_itemcount,
         CAST(sum(pq) AS DOUBLE) * 1000.0::DOUBLE / CAST(max(panel) AS DOUBLE) AS pnlpq
  FROM (SELECT mailboxid, orderdate, orderid, max(panel) AS panel, sum(itemquantity) AS item_count,
               sum(itemprice * itemquantity) AS pq
        FROM scoped JOIN panel_by_date ON orderdate = date WHERE {condition} GROUP BY 1, 2, 3)
  GROUP BY orderdate)"""


ALL_SQL = f"merchant NOT IN {EXCLUDED_SQL}"
RED_ALL_SQL = f"(itemdescription ILIKE 'RED %' AND merchant NOT IN {EXCLUDED_SQL})"
BLUE_ALL_SQL = f"(itemdescription ILIKE 'BLUE %' AND merchant NOT IN {EXCLUDED_SQL})"
DAILY_ALL = daily_cte("daily", "All", ALL_SQL)

# The dated order rows of a sales map: cohort of one calendar year, geography attached.
MAP_ROWS = """map_rows AS (
  SELECT f.*, z.zip, g.msa, g.state_abbrev, p.panel
  FROM fact_items f JOIN panel_by_date p ON f.orderdate = p.date
  JOIN cohort_list c ON f.mailboxid = c.mailboxid AND f.orderdate = c.udate
  JOIN single_zip z ON f.mailboxid = z.mailboxid LEFT JOIN zip_msa g ON z.zip = g.zip
  WHERE f.merchant IN (SELECT merchant FROM sector_merchants))"""
# The rows of the total of all regions: no geography, as published.
TOTAL_ROWS = """total_rows AS (
  SELECT f.*, z.zip, p.panel
  FROM fact_items f JOIN panel_by_date p ON f.orderdate = p.date
  JOIN cohort_list c ON f.mailboxid = c.mailboxid AND f.orderdate = c.udate
  JOIN single_zip z ON f.mailboxid = z.mailboxid
  WHERE f.merchant IN (SELECT merchant FROM sector_merchants))"""
CURRENT_WINDOW = """orderdate <= (SELECT day FROM latest) - 3 AND orderdate >= (SELECT day FROM latest) - 33
  AND year(orderdate) = year(DATE '2001-08-01' - 14)"""
PRIOR_WINDOW = """orderdate <= (SELECT day FROM latest) - 3 - 364 AND orderdate >= (SELECT day FROM latest) - 33 - 364
  AND year(orderdate) = year(DATE '2001-08-01' - 379)"""


def region_rate(name: str, condition: str, by: str = "msa", rows: str = "map_rows") -> str:
    """Revenue per ten thousand panel members per region, by the published definition."""
    regions = "msa, state_abbrev, " if rows == "map_rows" else ""
    return f"""{name} AS (
  SELECT {by}, coalesce(CAST(sum(pq) AS DOUBLE) * 10000.0::DOUBLE / CAST(max(panel) AS DOUBLE), 0.0001::DOUBLE) AS rate
  FROM (SELECT mailboxid, orderdate, zip, {regions}orderid, max(panel) AS panel,
               sum(itemprice * itemquantity) AS pq
        FROM {rows} WHERE {condition} GROUP BY ALL)
  GROUP BY {by})"""
