"""Check SQL for the segmented jobs: row-level joins, ride counts looked up by equality."""

_CELL = "platform, age_range, download_dt"
_WHO = """d.platform AS platform, coalesce(s.age_range, 'Not Specified') AS age_range,
       CAST(d.download_ts AS DATE) AS download_dt"""
_HOME = "LEFT JOIN signups s ON s.user_id = f.user_id LEFT JOIN app_downloads d ON d.app_download_key = s.session_id"

# One row per fact row and matching signup, with the cell it falls into.
_DOWNLOADS = f"""SELECT d.app_download_key, {_WHO}
FROM app_downloads d LEFT JOIN signups s ON s.session_id = d.app_download_key"""
_SIGNUPS = f"""SELECT s.user_id, {_WHO}
FROM signups s LEFT JOIN app_downloads d ON d.app_download_key = s.session_id"""
_RIDES = f"SELECT f.user_id, f.accept_ts, f.dropoff_ts, {_WHO} FROM ride_requests f {_HOME}"
_PAYMENTS = f"""SELECT f.user_id, {_WHO}
FROM transactions t LEFT JOIN ride_requests f ON f.ride_id = t.ride_id {_HOME}
WHERE t.charge_status = 'Approved'"""
_REVIEWS = f"SELECT f.user_id, {_WHO} FROM reviews f {_HOME}"


def _distinct(rows: str, key: str, name: str) -> str:
    return f"SELECT count(DISTINCT {key}) AS {name}, {_CELL} FROM ({rows}) GROUP BY {_CELL}"


def _per_cell(rows: str, name: str, where: str = "true") -> str:
    return f"SELECT count(*) AS {name}, {_CELL} FROM ({rows}) WHERE {where} GROUP BY {_CELL}"


def _per_user(rows: str, name: str) -> str:
    return f"SELECT user_id, {_CELL}, count(*) AS {name} FROM ({rows}) GROUP BY user_id, {_CELL}"


_STATUS = f"""SELECT user_id, {_CELL},
       CAST(bool_or(accept_ts IS NOT NULL) AS INTEGER) AS ride_accepted,
       CAST(bool_or(dropoff_ts IS NOT NULL) AS INTEGER) AS ride_completed
FROM ({_RIDES}) GROUP BY user_id, {_CELL}"""

# step name -> (users per cell, fact rows per cell)
_STEPS = {
    "app_download": (_distinct(_DOWNLOADS, "app_download_key", "n"), None),
    "sign_up": (_distinct(_SIGNUPS, "user_id", "n"), None),
    "ride_requested": (_per_cell(_STATUS, "n"), _per_cell(_RIDES, "n")),
    "ride_accepted": (
        f"SELECT sum(ride_accepted) AS n, {_CELL} FROM ({_STATUS}) GROUP BY {_CELL}",
        _per_cell(_RIDES, "n", "accept_ts IS NOT NULL"),
    ),
    "ride_completed": (
        f"SELECT sum(ride_completed) AS n, {_CELL} FROM ({_STATUS}) GROUP BY {_CELL}",
        _per_cell(_RIDES, "n", "dropoff_ts IS NOT NULL"),
    ),
    "payment": (_per_cell(_per_user(_PAYMENTS, "p"), "n"), _per_cell(_PAYMENTS, "n")),
    "review": (_per_cell(_per_user(_REVIEWS, "p"), "n"), _per_cell(_REVIEWS, "n")),
}


def _user_steps() -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS funnel_step, '{name}' AS funnel_name, CAST(n AS BIGINT) AS user_count, {_CELL}"
        f" FROM ({users})"
        for i, (name, (users, _)) in enumerate(_STEPS.items(), start=1)
    )


def _extract() -> str:
    lookups = " UNION ALL ".join(
        f"SELECT '{name}' AS funnel_name, n, {_CELL} FROM ({rows})" for name, (_, rows) in _STEPS.items() if rows
    )
    return f"""
SELECT u.funnel_step, u.funnel_name, u.platform, u.age_range, u.download_dt, u.user_count, r.n AS ride_count
FROM ({_user_steps()}) AS u
LEFT JOIN ({lookups}) AS r
  ON r.funnel_name = u.funnel_name AND r.platform = u.platform
 AND r.age_range = u.age_range AND r.download_dt = u.download_dt
ORDER BY u.funnel_step, u.platform NULLS LAST, u.age_range NULLS LAST, u.download_dt NULLS LAST"""


def _compared(base: str, other: str) -> str:
    """``other`` picks the step to compare with, by position among the steps of the cell."""
    same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in _CELL.split(", "))
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {_CELL} ORDER BY funnel_step) AS pos FROM ({_user_steps()})"
    return f"""
SELECT a.funnel_step, a.funnel_name, a.user_count, a.platform, a.age_range, a.download_dt, b.user_count AS "{base}",
       b.user_count - a.user_count AS diff,
       round(CAST(a.user_count AS DOUBLE) / nullif(b.user_count, 0), 4) AS conversion_rate,
       round(1 - CAST(a.user_count AS DOUBLE) / nullif(b.user_count, 0), 4) AS dropoff_percent
FROM ({ranked}) AS a LEFT JOIN ({ranked}) AS b ON {same} AND b.pos = {other}"""


EXTRACT: dict[str, str] = {
    "cell_funnel_pct_previous": _compared("lag", "a.pos - 1"),
    "cell_funnel_pct_top": _compared("first_value", "1"),
    "seg_app_download": _distinct(_DOWNLOADS, "app_download_key", "total_users_app_downloaded"),
    "seg_sign_up": _distinct(_SIGNUPS, "user_id", "total_users_signed_up"),
    "seg_user_ride_status": _STATUS,
    "seg_user_payment": _per_user(_PAYMENTS, "total_rides_with_payment"),
    "seg_user_review": _per_user(_REVIEWS, "total_reviews_per_user"),
    "seg_user_steps": _user_steps(),
    "seg_rides_requested": _per_cell(_RIDES, "total_rides_requested"),
    "seg_rides_accepted": _per_cell(_RIDES, "total_rides_accepted", "accept_ts IS NOT NULL"),
    "seg_rides_completed": _per_cell(_RIDES, "total_rides_completed", "dropoff_ts IS NOT NULL"),
    "seg_rides_paid": _per_cell(_PAYMENTS, "total_rides_with_payment"),
    "seg_rides_reviewed": _per_cell(_REVIEWS, "total_rides_with_review"),
    "funnel_extract": _extract(),
    "funnel_extract_by_days": _extract(),
    "funnel_extract_read_back": _extract(),
}
