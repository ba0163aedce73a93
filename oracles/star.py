"""Derivation of the five funnel tables, as common table expressions."""

STAR = """
app_downloads AS (
  SELECT c_custkey AS app_download_key,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'ios'
              WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'android'
              ELSE 'web' END AS platform,
         CAST(make_date(2021, CAST(1 + c_custkey % 12 AS INTEGER), CAST(1 + c_custkey % 28 AS INTEGER)) AS TIMESTAMP)
           + CASE WHEN c_custkey % 2 = 0 THEN INTERVAL '390' MINUTE ELSE INTERVAL '1410' MINUTE END AS download_ts
  FROM customer
),
signups AS (
  SELECT c_custkey AS user_id, c_custkey AS session_id,
         CASE c_nationkey % 6 WHEN 0 THEN '18-24' WHEN 1 THEN '25-34' WHEN 2 THEN '35-44'
                              WHEN 3 THEN '45-54' WHEN 4 THEN 'Unknown' END AS age_range
  FROM customer
  WHERE c_custkey % 4 <> 0
),
order_state AS (
  SELECT o_orderkey, o_custkey, o_orderdate,
         o_orderpriority <> '5-LOW' AS acc,
         o_orderpriority <> '5-LOW' AND o_orderstatus = 'F' AS fin
  FROM orders
  WHERE (o_custkey % 4 <> 0 AND o_custkey % 5 <> 1) OR o_orderkey % 101 = 0
),
ride_requests AS (
  SELECT o_orderkey AS ride_id, o_custkey AS user_id,
         CASE WHEN acc THEN o_orderkey % 97 END AS driver_id,
         o_orderdate AS request_ts,
         CASE WHEN acc THEN o_orderdate + INTERVAL '3' MINUTE END AS accept_ts,
         CASE WHEN fin THEN o_orderdate + INTERVAL '10' MINUTE END AS pickup_ts,
         CASE WHEN fin AND o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '75' MINUTE
              WHEN fin THEN o_orderdate + INTERVAL '40' MINUTE END AS dropoff_ts,
         CASE WHEN NOT fin THEN o_orderdate + INTERVAL '5' MINUTE END AS cancel_ts
  FROM order_state
),
transactions AS (
  SELECT l_orderkey AS ride_id, l_extendedprice AS purchase_amount_usd,
         CASE WHEN l_returnflag = 'R' THEN 'Decline' ELSE 'Approved' END AS charge_status
  FROM lineitem LEFT JOIN ride_requests ON l_orderkey = ride_id
  WHERE l_linenumber = 1 AND (dropoff_ts IS NOT NULL OR (ride_id IS NULL AND l_orderkey % 211 = 0))
),
reviews AS (
  SELECT l_orderkey AS ride_id, user_id
  FROM lineitem INNER JOIN ride_requests ON l_orderkey = ride_id
  WHERE dropoff_ts IS NOT NULL AND l_linenumber = 2 AND l_linestatus = 'F'
)""".strip()
