"""Profiling jobs over the five tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.functions import all_present, day_start, ratio4, seconds_between
from stepfall.operators import attribute, ever_flags
from stepfall.operators.activity import approved
from stepfall.sources.tables import TableSet


def _rows() -> Column:
    return F.count(F.lit(1))


def table_profile(t: TableSet) -> DataFrame:
    """Every column of every table, with the table's row count."""

    def listing(name: str, df: DataFrame) -> DataFrame:
        columns = F.array(*[F.lit(c) for c in df.columns])
        return df.agg(_rows().alias("row_count")).select(
            F.lit(name).alias("table_name"), F.explode(columns).alias("column_name"), "row_count"
        )

    return reduce(DataFrame.unionByName, [listing(name, df) for name, df in t.items()])


def table_preview(df: DataFrame, n: int = 10, ordered: bool = False) -> DataFrame:
    """Any ``n`` rows, or the first ``n`` by all columns when the choice must not vary."""
    return (df.orderBy(*df.columns) if ordered else df).limit(n)


def dropoff_date_range(t: TableSet) -> DataFrame:
    """First and last day with a drop-off. The day is cut once, after the minimum and maximum."""
    return t.ride_requests.agg(
        day_start(F.min("dropoff_ts")).alias("min"), day_start(F.max("dropoff_ts")).alias("max")
    )


def downloads_total(t: TableSet) -> DataFrame:
    return t.app_downloads.agg(
        _rows().alias("total_users_app_downloaded"),
        F.count_distinct("app_download_key").alias("total_users_distinct"),
    )


def signups_total(t: TableSet) -> DataFrame:
    return t.signups.agg(
        F.count_distinct("user_id").alias("total_users_distinct"), F.count("user_id").alias("total_users")
    )


def rides_total(t: TableSet) -> DataFrame:
    return t.ride_requests.agg(
        _rows().alias("total_rides_requested"), F.count_distinct("ride_id").alias("total_rides_distinct")
    )


def ride_status_totals(t: TableSet) -> DataFrame:
    return t.ride_requests.agg(
        _rows().alias("total_rides_requested"),
        F.count("accept_ts").alias("total_rides_accepted"),
        F.count("dropoff_ts").alias("total_rides_completed"),
    )


def completed_rides_strict(t: TableSet) -> DataFrame:
    return t.ride_requests.where(
        F.col("cancel_ts").isNull() & all_present("request_ts", "accept_ts", "pickup_ts", "dropoff_ts")
    ).agg(_rows().alias("total_rides_completed"))


def _rides_and_users(rides: DataFrame) -> DataFrame:
    return rides.agg(
        _rows().alias("total_rides_requested"), F.count_distinct("user_id").alias("total_users_distinct")
    )


def requesting_users(t: TableSet) -> DataFrame:
    return _rides_and_users(t.ride_requests)


def completed_users(t: TableSet) -> DataFrame:
    return _rides_and_users(
        t.ride_requests.where(
            F.col("cancel_ts").isNull() & all_present("request_ts", "accept_ts", "dropoff_ts")
        )
    )


def _mean_seconds(rides: DataFrame) -> Column:
    return F.avg(seconds_between(rides["pickup_ts"], rides["dropoff_ts"]))


def avg_ride_seconds(t: TableSet) -> DataFrame:
    """Mean pick-up to drop-off time. Summed as decimals, so the order of rows does not matter."""
    rides = t.ride_requests
    return rides.agg(F.round(_mean_seconds(rides).cast("double"), 6).alias("avg_time_of_ride"))


def avg_ride_minutes(t: TableSet) -> DataFrame:
    rides = t.ride_requests
    return rides.agg(
        F.round(_mean_seconds(rides).cast("double") / 60, 6).alias("avg_time_of_ride_in_minutes")
    )


def accepted_rides(t: TableSet) -> DataFrame:
    return t.ride_requests.where(all_present("driver_id", "accept_ts")).agg(
        _rows().alias("total_rides_accepted")
    )


def accepted_not_cancelled(t: TableSet) -> DataFrame:
    return t.ride_requests.where(
        all_present("driver_id", "accept_ts") & F.col("cancel_ts").isNull()
    ).agg(_rows().alias("total_rides_accepted"))


def payments_approved(t: TableSet) -> DataFrame:
    """Amounts are summed as decimals of six places, so the total does not depend on the order of rows.

    Amounts that are no such decimal (NaN, infinities, 10^14 and more) count as payments and add nothing.
    """
    amount = F.col("purchase_amount_usd").try_cast("decimal(20,6)")
    return approved(t.transactions).agg(
        _rows().alias("total_rides_with_payment"),
        F.round(F.sum(amount), 2).cast("double").alias("total_payment_collected"),
    )


def rides_per_platform(t: TableSet) -> DataFrame:
    per_user = t.ride_requests.groupBy("user_id").agg(F.count("ride_id").alias("rides"))
    return (
        attribute(per_user, t.signups, t.app_downloads, by=("platform",))
        .groupBy("platform")
        .agg(F.sum(F.col("rides") * F.col("copies")).alias("total_ride_requests_per_platform"))
        .orderBy(F.col("total_ride_requests_per_platform").desc_nulls_first(), "platform")
    )


def signup_to_request_dropoff(t: TableSet) -> DataFrame:
    requesting = t.ride_requests.agg(F.count_distinct("user_id")).scalar()
    signed, asked = F.col("total_signups"), F.col("users_requesting_rides")
    return (
        t.signups.agg(F.count("user_id").alias("total_signups"))
        .withColumn("users_requesting_rides", requesting)
        .withColumn("dropoff", signed - asked)
        .withColumn("dropoff_percent", ratio4(signed - asked, signed))
    )


def _completed_by_user(t: TableSet) -> DataFrame:
    return ever_flags(t.ride_requests, "user_id", {"ride_completed": F.col("dropoff_ts").isNotNull()})


def user_ride_completed(t: TableSet, n: int | None = 5) -> DataFrame:
    """Did the user ever complete a ride? The first ``n`` users, or all of them with ``n=None``."""
    users = _completed_by_user(t)
    return users if n is None else users.orderBy(F.col("user_id").asc_nulls_last()).limit(n)


def user_ride_rollup(t: TableSet) -> DataFrame:
    return _completed_by_user(t).agg(
        _rows().alias("total_users_ride_requested"),
        F.sum("ride_completed").alias("total_users_ride_completed"),
    )


def request_cancel_rate(t: TableSet) -> DataFrame:
    """Share of requesting users who ever cancelled before being picked up."""
    cancelled = F.col("cancel_ts").isNotNull() & F.col("pickup_ts").isNull()
    users = ever_flags(
        t.ride_requests.where(F.col("user_id").isNotNull()), "user_id", {"cancelled": cancelled}
    )
    return users.agg(
        _rows().alias("users_requesting_rides"),
        F.coalesce(F.sum("cancelled"), F.lit(0)).alias("users_cancelling"),
    ).withColumn("cancel_rate", ratio4(F.col("users_cancelling"), F.col("users_requesting_rides")))
