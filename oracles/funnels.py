"""Check SQL for the whole-population funnels."""

# Distinct keys, plus one when rows with a NULL key exist: the groups of a GROUP BY.
_GROUPS = "count(DISTINCT {key}) + coalesce(max(CASE WHEN {key} IS NULL THEN 1 ELSE 0 END), 0)"


def _groups(key: str, source: str) -> str:
    return f"(SELECT {_GROUPS.format(key=key)} FROM {source})"


def _some(key: str, source: str) -> str:
    """Like ``_groups`` with a filter in ``source``, but NULL when there are no rides at all."""
    return f"(SELECT CASE WHEN (SELECT count(*) FROM ride_requests) > 0 THEN {_GROUPS.format(key=key)} END FROM {source})"


def _later(key: str) -> dict[str, str]:
    return {
        "ride_requested": _groups(key, "ride_requests"),
        "ride_accepted": _some(key, "ride_requests WHERE accept_ts IS NOT NULL"),
        "ride_completed": _some(key, "ride_requests WHERE dropoff_ts IS NOT NULL"),
        "payment": _groups(
            f"rides.{key}",
            "transactions LEFT JOIN ride_requests AS rides ON rides.ride_id = transactions.ride_id"
            " WHERE charge_status = 'Approved'",
        ),
        "review": _groups(key, "reviews"),
    }


def _steps(counts: dict[str, str], value: str) -> str:
    rows = [
        f"SELECT CAST({i} AS INTEGER) AS funnel_step, '{name}' AS funnel_name, CAST({count} AS BIGINT) AS {value}"
        for i, (name, count) in enumerate(counts.items(), start=1)
    ]
    return " UNION ALL ".join(rows)


USER_STEPS = _steps(
    {
        "app_download": "(SELECT count(DISTINCT app_download_key) FROM app_downloads)",
        "sign_up": "(SELECT count(DISTINCT user_id) FROM signups)",
        **_later("user_id"),
    },
    "user_count",
)
RIDE_STEPS = _steps({"app_download": "0", "sign_up": "0", **_later("ride_id")}, "ride_count")


def _compared(steps: str, value: str, base: str, other: str) -> str:
    """``other`` picks the step to compare with, by position among the steps kept."""
    return f"""
SELECT a.funnel_step, a.funnel_name, a.{value}, b.{value} AS "{base}", b.{value} - a.{value} AS diff,
       round(CAST(a.{value} AS DOUBLE) / nullif(b.{value}, 0), 4) AS conversion_rate,
       round(1 - CAST(a.{value} AS DOUBLE) / nullif(b.{value}, 0), 4) AS dropoff_percent
FROM (SELECT *, row_number() OVER (ORDER BY funnel_step) AS pos FROM ({steps})) AS a
LEFT JOIN (SELECT *, row_number() OVER (ORDER BY funnel_step) AS pos FROM ({steps})) AS b ON b.pos = {other}
ORDER BY a.funnel_step"""


def _share(table: str, key: str, count: str, total: str, share: str) -> str:
    return f"""
SELECT {key}, {count}, {total}, round(CAST({count} AS DOUBLE) / nullif({total}, 0), 4) AS {share}
FROM (SELECT {key}, count(*) AS {count}, (SELECT count(*) FROM {table}) AS {total} FROM {table} GROUP BY {key})"""


_REACHED = f"SELECT * FROM ({RIDE_STEPS}) WHERE ride_count > 0"

FUNNELS: dict[str, str] = {
    "user_steps": USER_STEPS,
    "ride_steps": RIDE_STEPS,
    "user_funnel_pct_previous": _compared(USER_STEPS, "user_count", "lag", "a.pos - 1"),
    "user_funnel_pct_top": _compared(USER_STEPS, "user_count", "first_value", "1"),
    "ride_funnel_pct_previous": _compared(_REACHED, "ride_count", "lag", "a.pos - 1"),
    "ride_funnel_pct_top": _compared(_REACHED, "ride_count", "first_value", "1"),
    "segment_share_platform": _share(
        "app_downloads", "platform", "downloads", "total_downloads", "pct_of_downloads"
    ),
    "segment_share_age": _share("signups", "age_range", "signups", "total_signups", "pct_of_signups"),
}
