"""Funnel tables derived from a star schema (``customer``, ``orders``, ``lineitem``).

The derivation gives a shrinking funnel with users who never registered, rides
whose user has no signup, payments without a ride and rides paid more than once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfall.sources.tables import TableSet

# The columns the derivation reads.
STAR_SCHEMAS = {
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz,"
    " o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_linenumber int, l_extendedprice double, l_returnflag string,"
    " l_linestatus string",
}

# Fixed values of the derivation, as Spark SQL expressions.
APP_DOWNLOADS = (
    "c_custkey AS app_download_key",
    """CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'ios'
            WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'android'
            ELSE 'web' END AS platform""",
    """CAST(make_date(2021, CAST(1 + c_custkey % 12 AS INT), CAST(1 + c_custkey % 28 AS INT)) AS TIMESTAMP_NTZ)
       + IF(c_custkey % 2 = 0, INTERVAL '390' MINUTE, INTERVAL '1410' MINUTE) AS download_ts""",
)
SIGNED_UP = "c_custkey % 4 <> 0"
SIGNUPS = (
    "c_custkey AS user_id",
    "c_custkey AS session_id",
    "get(array('18-24', '25-34', '35-44', '45-54', 'Unknown'), c_nationkey % 6) AS age_range",
)
IS_RIDE = "(o_custkey % 4 <> 0 AND o_custkey % 5 <> 1) OR o_orderkey % 101 = 0"
ACCEPTED = "(o_orderpriority <> '5-LOW')"
FINISHED = f"({ACCEPTED} AND o_orderstatus = 'F')"
RIDE_REQUESTS = (
    "o_orderkey AS ride_id",
    "o_custkey AS user_id",
    f"IF({ACCEPTED}, o_orderkey % 97, NULL) AS driver_id",
    "o_orderdate AS request_ts",
    f"IF({ACCEPTED}, o_orderdate + INTERVAL '3' MINUTE, NULL) AS accept_ts",
    f"IF({FINISHED}, o_orderdate + INTERVAL '10' MINUTE, NULL) AS pickup_ts",
    f"""IF({FINISHED}, o_orderdate + IF(o_orderkey % 3 = 0, INTERVAL '75' MINUTE, INTERVAL '40' MINUTE), NULL)
        AS dropoff_ts""",
    f"IF(NOT {FINISHED}, o_orderdate + INTERVAL '5' MINUTE, NULL) AS cancel_ts",
)
# A payment belongs to a finished ride, or to an order that is no ride at all.
IS_PAID = "dropoff_ts IS NOT NULL OR (ride_id IS NULL AND l_orderkey % 211 = 0)"
TRANSACTIONS = (
    "l_orderkey AS ride_id",
    "l_extendedprice AS purchase_amount_usd",
    "IF(l_returnflag = 'R', 'Decline', 'Approved') AS charge_status",
)


def transactions(lineitem: DataFrame, rides: DataFrame) -> DataFrame:
    lines = lineitem.where("l_linenumber = 1")
    ends = rides.select("ride_id", "dropoff_ts")
    return lines.join(ends, F.col("l_orderkey") == F.col("ride_id"), "left").where(IS_PAID).selectExpr(*TRANSACTIONS)


def reviews(lineitem: DataFrame, rides: DataFrame) -> DataFrame:
    lines = lineitem.where("l_linenumber = 2 AND l_linestatus = 'F'").selectExpr("l_orderkey AS ride_id")
    finished = rides.where("dropoff_ts IS NOT NULL").select("ride_id", "user_id")
    return lines.join(finished, "ride_id")


class StarTables(TableSet):
    """The five tables, each derived when a job first asks for it."""

    def __init__(self, customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> None:
        self._customer, self._orders, self._lineitem = customer, orders, lineitem

    @cached_property
    def app_downloads(self) -> DataFrame:
        return self._customer.selectExpr(*APP_DOWNLOADS)

    @cached_property
    def signups(self) -> DataFrame:
        return self._customer.where(SIGNED_UP).selectExpr(*SIGNUPS)

    @cached_property
    def ride_requests(self) -> DataFrame:
        return self._orders.where(IS_RIDE).selectExpr(*RIDE_REQUESTS)

    @cached_property
    def transactions(self) -> DataFrame:
        return transactions(self._lineitem, self.ride_requests)

    @cached_property
    def reviews(self) -> DataFrame:
        return reviews(self._lineitem, self.ride_requests)


def from_star(spark: SparkSession, sf_dir: str) -> StarTables:
    """Read with declared schemas: no job is spent on looking into file footers."""
    return StarTables(
        **{
            name: spark.read.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
            for name, schema in STAR_SCHEMAS.items()
        }
    )
