"""Whole-population funnels at user grain and at ride grain, and segment shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.operators import (
    Step,
    ever_flags,
    payments_per_user,
    pct_of_previous,
    pct_of_top,
    reached,
    ride_reach,
    segment_share,
    step_table,
)
from stepfall.operators.activity import ACCEPTED, COMPLETED, PAID, REQUESTED, REVIEWED
from stepfall.sources.tables import TableSet

# The step names of every funnel.
STEP_NAMES = {
    1: "app_download",
    2: "sign_up",
    3: "ride_requested",
    4: "ride_accepted",
    5: "ride_completed",
    6: "payment",
    7: "review",
}


def step(number: int, *values: Column) -> Step:
    return Step(number, STEP_NAMES[number], values)


def _groups() -> Column:
    """How many keys a grouped frame holds. A NULL key counts, as a group does."""
    return F.count(F.lit(1)).alias("n")


def user_steps(t: TableSet) -> DataFrame:
    """``(funnel_step, funnel_name, user_count)``. The rides are read once for steps 3 to 5."""
    riders = ever_flags(
        t.ride_requests,
        "user_id",
        {"accepted": F.col("accept_ts").isNotNull(), "completed": F.col("dropoff_ts").isNotNull()},
    )
    rides = riders.agg(
        _groups(), F.sum("accepted").alias("accepted"), F.sum("completed").alias("completed")
    )
    payers = payments_per_user(t.transactions, t.riders(), t.hot_rows)
    n = F.col("n")
    return step_table(
        [
            (t.app_downloads.agg(F.count_distinct("app_download_key").alias("n")), [step(1, n)]),
            (t.signups.agg(F.count_distinct("user_id").alias("n")), [step(2, n)]),
            (rides, [step(3, n), step(4, F.col("accepted")), step(5, F.col("completed"))]),
            (payers.agg(_groups()), [step(6, n)]),
            (t.reviews.select("user_id").distinct().agg(_groups()), [step(7, n)]),
        ],
        ["user_count"],
    )


def ride_steps(t: TableSet) -> DataFrame:
    """``(funnel_step, funnel_name, ride_count)``; the first two steps have no rides.

    Payments whose ride is unknown make up one further group of step 6.
    """
    requested, paid = reached(REQUESTED), reached(PAID)
    known = requested & F.col("ride_id").isNotNull()
    stray = F.coalesce(F.max(F.when(paid & ~known, 1)), F.lit(0))

    def requesters(bit: int) -> Column:
        """NULL when there are no rides at all."""
        return F.sum(F.when(requested, F.when(reached(bit), 1).otherwise(0)))

    totals = ride_reach(t.ride_requests, t.transactions, t.reviews).agg(
        F.count_if(requested).alias("requested"),
        requesters(ACCEPTED).alias("accepted"),
        requesters(COMPLETED).alias("completed"),
        (F.count_if(paid & known) + stray).alias("paid"),
        F.count_if(reached(REVIEWED)).alias("reviewed"),
    )
    none = F.lit(0).cast("bigint")
    counts = [none, none, *[F.col(c) for c in totals.columns]]
    return step_table([(totals, [step(i, n) for i, n in enumerate(counts, start=1)])], ["ride_count"])


def user_funnel_pct_previous(t: TableSet) -> DataFrame:
    return pct_of_previous(user_steps(t), "user_count")


def user_funnel_pct_top(t: TableSet) -> DataFrame:
    return pct_of_top(user_steps(t), "user_count")


def reached_rides(t: TableSet) -> DataFrame:
    """Steps that rides can reach. The empty ones go before any comparison between steps."""
    return ride_steps(t).where(F.col("ride_count") > 0)


def ride_funnel_pct_previous(t: TableSet) -> DataFrame:
    return pct_of_previous(reached_rides(t), "ride_count")


def ride_funnel_pct_top(t: TableSet) -> DataFrame:
    return pct_of_top(reached_rides(t), "ride_count")


def segment_share_platform(t: TableSet) -> DataFrame:
    return segment_share(t.app_downloads, "platform", "downloads", "total_downloads", "pct_of_downloads")


def segment_share_age(t: TableSet) -> DataFrame:
    return segment_share(t.signups, "age_range", "signups", "total_signups", "pct_of_signups").orderBy(
        F.col("age_range").asc_nulls_last()
    )
