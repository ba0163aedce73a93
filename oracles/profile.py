"""Check SQL for the profiling jobs."""

from stepfall.sources.tables import SCHEMAS


def _profile() -> str:
    listed = ", ".join(f"('{table}', '{c}')" for table, schema in SCHEMAS.items() for c in schema.names)
    sizes = " UNION ALL ".join(f"SELECT '{table}' AS table_name, count(*) AS row_count FROM {table}" for table in SCHEMAS)
    return f"""
SELECT l.table_name, l.column_name, s.row_count
FROM (VALUES {listed}) AS l(table_name, column_name)
JOIN ({sizes}) AS s ON s.table_name = l.table_name"""


def _preview(table: str) -> str:
    return f"SELECT * FROM {table} ORDER BY {', '.join(f'{c} ASC NULLS FIRST' for c in SCHEMAS[table].names)} LIMIT 10"


PROFILE: dict[str, str] = {
    "table_profile": _profile(),
    **{f"table_preview_{table}": _preview(table) for table in SCHEMAS},
    "dropoff_date_range": """
SELECT CAST(min(CAST(dropoff_ts AS DATE)) AS TIMESTAMP) AS "min",
       CAST(max(CAST(dropoff_ts AS DATE)) AS TIMESTAMP) AS "max"
FROM ride_requests""",
    "downloads_total": """
SELECT (SELECT count(*) FROM app_downloads) AS total_users_app_downloaded,
       (SELECT count(*) FROM (SELECT DISTINCT app_download_key FROM app_downloads
                              WHERE app_download_key IS NOT NULL)) AS total_users_distinct""",
    "signups_total": """
SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id FROM signups WHERE user_id IS NOT NULL)) AS total_users_distinct,
       (SELECT count(*) FROM signups WHERE user_id IS NOT NULL) AS total_users""",
    "rides_total": """
SELECT (SELECT count(*) FROM ride_requests) AS total_rides_requested,
       (SELECT count(*) FROM (SELECT DISTINCT ride_id FROM ride_requests WHERE ride_id IS NOT NULL)) AS total_rides_distinct""",
    "ride_status_totals": """
SELECT (SELECT count(*) FROM ride_requests) AS total_rides_requested,
       (SELECT count(*) FROM ride_requests WHERE accept_ts IS NOT NULL) AS total_rides_accepted,
       (SELECT count(*) FROM ride_requests WHERE dropoff_ts IS NOT NULL) AS total_rides_completed""",
    "completed_rides_strict": """
SELECT count(*) AS total_rides_completed
FROM ride_requests
WHERE cancel_ts IS NULL AND pickup_ts IS NOT NULL AND dropoff_ts IS NOT NULL
  AND request_ts IS NOT NULL AND accept_ts IS NOT NULL""",
    "requesting_users": """
SELECT (SELECT count(*) FROM ride_requests) AS total_rides_requested,
       (SELECT count(*) FROM (SELECT DISTINCT user_id FROM ride_requests WHERE user_id IS NOT NULL)) AS total_users_distinct""",
    "completed_users": """
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_rides_requested, count(user_id) AS total_users_distinct
FROM (SELECT user_id, count(*) AS n FROM ride_requests
      WHERE cancel_ts IS NULL AND dropoff_ts IS NOT NULL AND request_ts IS NOT NULL AND accept_ts IS NOT NULL
      GROUP BY user_id)""",
    "avg_ride_seconds": """
SELECT round(CAST(sum(date_diff('microsecond', pickup_ts, dropoff_ts)) AS DOUBLE) / 1000000
             / nullif(count(date_diff('microsecond', pickup_ts, dropoff_ts)), 0), 6) AS avg_time_of_ride
FROM ride_requests""",
    "avg_ride_minutes": """
SELECT round(CAST(sum(date_diff('microsecond', pickup_ts, dropoff_ts)) AS DOUBLE) / 60000000
             / nullif(count(date_diff('microsecond', pickup_ts, dropoff_ts)), 0), 6) AS avg_time_of_ride_in_minutes
FROM ride_requests""",
    "accepted_rides": """
SELECT count(*) AS total_rides_accepted FROM ride_requests
WHERE driver_id IS NOT NULL AND accept_ts IS NOT NULL""",
    "accepted_not_cancelled": """
SELECT count(*) AS total_rides_accepted FROM ride_requests
WHERE cancel_ts IS NULL AND driver_id IS NOT NULL AND accept_ts IS NOT NULL""",
    "payments_approved": """
SELECT count(*) AS total_rides_with_payment, 
       CAST(round(sum(TRY_CAST(purchase_amount_usd AS DECIMAL(20, 6))), 2) AS DOUBLE) AS total_payment_collected
FROM transactions WHERE charge_status = 'Approved'""",
    "rides_per_platform": """
SELECT d.platform, count(r.ride_id) AS total_ride_requests_per_platform
FROM ride_requests r
LEFT JOIN signups s ON s.user_id = r.user_id
LEFT JOIN app_downloads d ON d.app_download_key = s.session_id
GROUP BY d.platform
ORDER BY 2 DESC""",
    "signup_to_request_dropoff": """
SELECT total_signups, users_requesting_rides, total_signups - users_requesting_rides AS dropoff,
       round(CAST(total_signups - users_requesting_rides AS DOUBLE) / nullif(total_signups, 0), 4) AS dropoff_percent
FROM (SELECT (SELECT count(user_id) FROM signups) AS total_signups,
             (SELECT count(DISTINCT user_id) FROM ride_requests) AS users_requesting_rides)""",
    "user_ride_completed": """
SELECT user_id, CAST(bool_or(dropoff_ts IS NOT NULL) AS INTEGER) AS ride_completed
FROM ride_requests GROUP BY user_id ORDER BY user_id NULLS LAST LIMIT 5""",
    "user_ride_completed_all": """
SELECT user_id, CAST(bool_or(dropoff_ts IS NOT NULL) AS INTEGER) AS ride_completed
FROM ride_requests GROUP BY user_id""",
    "user_ride_rollup": """
SELECT count(*) AS total_users_ride_requested, CAST(sum(done) AS BIGINT) AS total_users_ride_completed
FROM (SELECT user_id, CASE WHEN count(dropoff_ts) > 0 THEN 1 ELSE 0 END AS done FROM ride_requests GROUP BY user_id)""",
    "request_cancel_rate": """
SELECT asked AS users_requesting_rides, gone AS users_cancelling,
       round(CAST(gone AS DOUBLE) / nullif(asked, 0), 4) AS cancel_rate
FROM (SELECT count(DISTINCT user_id) AS asked,
             count(DISTINCT user_id) FILTER (WHERE cancel_ts IS NOT NULL AND pickup_ts IS NULL) AS gone
      FROM ride_requests)""",
}
