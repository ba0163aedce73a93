"""Segmented counts per cell: platform, age range, day of the download."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.operators import (
    CELL,
    Step,
    payments_per_user,
    pct_of_previous,
    pct_of_top,
    reviews_per_user,
    rides_per_user,
    stack_facts,
    step_table,
)
from stepfall.operators.activity import MARKS
from stepfall.operators.grain import attach, download_counts, homes, people, placed
from stepfall.plans.funnels import step
from stepfall.sources.tables import TableSet


def _rides(t: TableSet) -> DataFrame:
    return rides_per_user(t.ride_requests)


def _payments(t: TableSet) -> DataFrame:
    return payments_per_user(t.transactions, t.riders(), t.hot_rows)


def _reviews(t: TableSet) -> DataFrame:
    return reviews_per_user(t.reviews)


def users_with_cell(t: TableSet, *facts: Callable[[TableSet], DataFrame]) -> DataFrame:
    """Counts per user, fact and cell, over the given facts."""
    return attach(stack_facts(*[f(t) for f in facts]), t.cells(), in_place=t.hot_rows is None)


def _users(mark: str) -> Column:
    return F.count(F.when(F.col(mark) > 0, 1)).alias(f"{mark}_users")


def _rows(mark: str) -> Column:
    return F.sum(F.col(mark) * F.col("copies")).alias(f"{mark}_rows")


def marks_per_cell(users: DataFrame) -> DataFrame:
    """Per cell and mark: how many users have it, and how many fact rows carry it.

    Each mark comes from one fact, where a user has one row, so rows with the
    mark are users with the mark.
    """
    present = [m for m in MARKS if m in users.columns]
    return users.groupBy(*CELL).agg(*[_users(m) for m in present], *[_rows(m) for m in present])


def cells(t: TableSet, *facts: Callable[[TableSet], DataFrame]) -> DataFrame:
    return marks_per_cell(users_with_cell(t, *facts))


# --- users per cell -------------------------------------------------------


def _download_counts(t: TableSet) -> DataFrame:
    where = homes(t.app_downloads)
    return download_counts(placed(people(t.signups), where, t.hot_rows), where)


def signup_counts(cells: DataFrame) -> DataFrame:
    """A user has one row per cell, so counting them counts distinct users."""
    return cells.groupBy(*CELL).agg(F.count("user_id").alias("users"), F.sum("copies").alias("rows"))


def _signup_counts(t: TableSet) -> DataFrame:
    return signup_counts(t.cells())


def seg_app_download(t: TableSet) -> DataFrame:
    return _download_counts(t).select(F.col("users").alias("total_users_app_downloaded"), *CELL)


def seg_sign_up(t: TableSet) -> DataFrame:
    return _signup_counts(t).select(F.col("users").alias("total_users_signed_up"), *CELL)


def seg_user_ride_status(t: TableSet) -> DataFrame:
    return users_with_cell(t, _rides).select(
        "user_id",
        *CELL,
        (F.col("accepted") > 0).cast("int").alias("ride_accepted"),
        (F.col("completed") > 0).cast("int").alias("ride_completed"),
    )


def seg_user_payment(t: TableSet) -> DataFrame:
    return users_with_cell(t, _payments).select(
        "user_id", *CELL, (F.col("payments") * F.col("copies")).alias("total_rides_with_payment")
    )


def seg_user_review(t: TableSet) -> DataFrame:
    return users_with_cell(t, _reviews).select(
        "user_id", *CELL, (F.col("reviews") * F.col("copies")).alias("total_reviews_per_user")
    )


# --- rides per cell -------------------------------------------------------


def _ride_rows(t: TableSet, facts: Callable[[TableSet], DataFrame], mark: str, name: str) -> DataFrame:
    """Fact rows per cell, for the cells that have any."""
    rows = F.col(f"{mark}_rows")
    return cells(t, facts).where(rows > 0).select(rows.alias(name), *CELL)


def seg_rides_requested(t: TableSet) -> DataFrame:
    return _ride_rows(t, _rides, "requests", "total_rides_requested")


def seg_rides_accepted(t: TableSet) -> DataFrame:
    return _ride_rows(t, _rides, "accepted", "total_rides_accepted")


def seg_rides_completed(t: TableSet) -> DataFrame:
    return _ride_rows(t, _rides, "completed", "total_rides_completed")


def seg_rides_paid(t: TableSet) -> DataFrame:
    """Approved payments, not distinct rides."""
    return _ride_rows(t, _payments, "payments", "total_rides_with_payment")


def seg_rides_reviewed(t: TableSet) -> DataFrame:
    """Reviews, not distinct rides."""
    return _ride_rows(t, _reviews, "reviews", "total_rides_with_review")


# --- step tables ----------------------------------------------------------


def cell_steps(downloads: DataFrame, signups: DataFrame, marks: DataFrame) -> DataFrame:
    """Every step of every cell with its user count and its ride count.

    All facts are counted per user first, attributed in one join and counted per
    cell in one aggregate; the ride count travels on the same row instead of
    being looked up. A step exists in a cell only where its own source has rows.
    """
    no_rides = F.lit(None).cast("bigint")
    asked = F.col("requests_rows") > 0

    def first(number: int) -> list[Step]:
        return [step(number, F.col("rows") > 0, F.col("users"), no_rides)]

    def later(number: int, mark: str, exists: Column | None = None) -> Step:
        rows = F.col(f"{mark}_rows")
        return step(number, rows > 0 if exists is None else exists, F.col(f"{mark}_users"), rows)

    return step_table(
        [
            (downloads, first(1)),
            (signups, first(2)),
            (
                marks,
                [
                    later(3, "requests", asked),
                    later(4, "accepted", asked),
                    later(5, "completed", asked),
                    later(6, "payments"),
                    later(7, "reviews"),
                ],
            ),
        ],
        ["exists", "user_count", "ride_rows"],
        CELL,
    ).where("exists")


def _cell_steps(t: TableSet) -> DataFrame:
    return cell_steps(_download_counts(t), _signup_counts(t), cells(t, _rides, _payments, _reviews))


def seg_user_steps(t: TableSet) -> DataFrame:
    return _cell_steps(t).select("funnel_step", "funnel_name", "user_count", *CELL)


def cell_funnel_pct_previous(t: TableSet) -> DataFrame:
    """Each step of a cell against the one before it that the cell has."""
    return pct_of_previous(seg_user_steps(t), "user_count", by=CELL)


def cell_funnel_pct_top(t: TableSet) -> DataFrame:
    """Each step of a cell against the first one that the cell has."""
    return pct_of_top(seg_user_steps(t), "user_count", by=CELL)


def dashboard(steps: DataFrame) -> DataFrame:
    """The dashboard extract of ``cell_steps``.

    ``ride_count`` is NULL, not 0, where the step has no ride rows in the cell,
    and NULL for cells without platform or date, which no lookup by equality finds.
    """
    found = F.col("platform").isNotNull() & F.col("download_dt").isNotNull()
    ride_count = F.when(found, F.nullif(F.col("ride_rows"), F.lit(0)))
    order = ("funnel_step", *CELL)
    return steps.select("funnel_step", "funnel_name", *CELL, "user_count", ride_count.alias("ride_count")).orderBy(
        *[F.col(c).asc_nulls_last() for c in order]
    )


def funnel_extract(t: TableSet) -> DataFrame:
    return dashboard(_cell_steps(t))
