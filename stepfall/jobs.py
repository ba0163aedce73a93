"""All jobs by name. Each takes the five tables and returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from stepfall.plans import extract, funnels, profile, refresh
from stepfall.sources.sinks import replace_extract, scratch_folder
from stepfall.sources.tables import SCHEMAS, TableSet

Job = Callable[[TableSet], DataFrame]


def _preview(table: str, ordered: bool = False) -> Job:
    return lambda t: profile.table_preview(getattr(t, table), ordered=ordered)


def funnel_extract_by_days(t: TableSet) -> DataFrame:
    """The extract of a state that took the rows in batches."""
    spark = t.signups.sparkSession
    return refresh.absorbed_by_day(t, spark, scratch_folder(spark))


def funnel_extract_read_back(t: TableSet) -> DataFrame:
    """The extract as handed over: written by steps, its steps replaced, and read from the files."""
    job = extract.funnel_extract(t)
    path = scratch_folder(t.signups.sparkSession)
    replace_extract(job.where("funnel_step > 1"), path, partition_by=["funnel_step"])
    replace_extract(job.where("funnel_step < 4"), path, partition_by=["funnel_step"])
    return job.sparkSession.read.schema(job.schema).parquet(path).select(*job.columns)


_PROFILE: tuple[Job, ...] = (
    profile.table_profile,
    profile.dropoff_date_range,
    profile.downloads_total,
    profile.signups_total,
    profile.rides_total,
    profile.ride_status_totals,
    profile.completed_rides_strict,
    profile.requesting_users,
    profile.completed_users,
    profile.avg_ride_seconds,
    profile.avg_ride_minutes,
    profile.accepted_rides,
    profile.accepted_not_cancelled,
    profile.payments_approved,
    profile.rides_per_platform,
    profile.signup_to_request_dropoff,
    profile.user_ride_completed,
    profile.user_ride_rollup,
    profile.request_cancel_rate,
)
_FUNNELS: tuple[Job, ...] = (
    funnels.user_steps,
    funnels.ride_steps,
    funnels.user_funnel_pct_previous,
    funnels.user_funnel_pct_top,
    funnels.ride_funnel_pct_previous,
    funnels.ride_funnel_pct_top,
    funnels.segment_share_platform,
    funnels.segment_share_age,
)
_EXTRACT: tuple[Job, ...] = (
    extract.seg_app_download,
    extract.seg_sign_up,
    extract.seg_user_ride_status,
    extract.seg_user_payment,
    extract.seg_user_review,
    extract.seg_user_steps,
    extract.seg_rides_requested,
    extract.seg_rides_accepted,
    extract.seg_rides_completed,
    extract.seg_rides_paid,
    extract.seg_rides_reviewed,
    extract.funnel_extract,
    extract.cell_funnel_pct_previous,
    extract.cell_funnel_pct_top,
    funnel_extract_by_days,
    funnel_extract_read_back,
)

JOBS_BY_NAME: dict[str, Job] = {
    **{job.__name__: job for job in (*_PROFILE, *_FUNNELS, *_EXTRACT)},
    **{f"table_preview_{table}": _preview(table) for table in SCHEMAS},
    "user_ride_completed_all": lambda t: profile.user_ride_completed(t, n=None),
}

#: Forms whose rows do not vary from run to run, for checks; the previews above read ten rows and no more.
REPEATABLE: dict[str, Job] = {f"table_preview_{table}": _preview(table, ordered=True) for table in SCHEMAS}
