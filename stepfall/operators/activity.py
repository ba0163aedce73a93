"""Facts reduced to one row per key before anything else is done with them.

Each fact is aggregated right at its scan, with partial aggregates before the
shuffle, so a key holding a large part of the rows costs no more than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.operators.skew import LEAST, split_join

# Fixed value: the status of a payment that counts.
APPROVED = "Approved"
MARKS = ("requests", "accepted", "completed", "payments", "reviews")

# One bit per thing that can happen to a ride.
REQUESTED, ACCEPTED, COMPLETED, PAID, REVIEWED = 1, 2, 4, 8, 16


def approved(transactions: DataFrame) -> DataFrame:
    return transactions.where(F.col("charge_status") == APPROVED)


# --- per user -------------------------------------------------------------


def rides_per_user(rides: DataFrame) -> DataFrame:
    return rides.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count("accept_ts").alias("accepted"),
        F.count("dropoff_ts").alias("completed"),
    )


def payments_per_ride(transactions: DataFrame) -> DataFrame:
    return approved(transactions).groupBy("ride_id").agg(F.count(F.lit(1)).alias("n"))


def payments_per_user(transactions: DataFrame, rides: DataFrame, least: int | None = LEAST) -> DataFrame:
    """Approved payments by the ride's ``user_id``; those no ride matches go under NULL.

    Payments are counted per ride before the join: the preserved side then holds
    one row per ride id, however often a ride (or no ride at all) was charged. A ride id that
    holds a large part of at least ``least`` rides is dealt to many tasks.
    """
    riders = rides.select("ride_id", "user_id")
    matched = split_join(riders, payments_per_ride(transactions), "ride_id", keep="few", least=least)
    return matched.groupBy("user_id").agg(F.sum("n").alias("payments"))


def reviews_per_user(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("user_id").agg(F.count(F.lit(1)).alias("reviews"))


def stack_facts(*per_user: DataFrame) -> DataFrame:
    """Facts under one another, up to one row per user and fact; other facts' marks are NULL.

    All parts come out of a shuffle on ``user_id``, which the union keeps: a join
    on ``user_id`` that follows moves none of them again.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), per_user)


# --- per ride -------------------------------------------------------------


def _bit(ts: str, bit: int) -> Column:
    return F.when(F.col(ts).isNotNull(), bit).otherwise(0)


def ride_reach(rides: DataFrame, transactions: DataFrame, reviews: DataFrame) -> DataFrame:
    """``(ride_id, reach)``: a bit per thing that happened to the ride.

    Rides, payments and reviews all carry ``ride_id``, so stacking them and
    grouping once replaces the join between payments and rides.
    """
    happened = F.lit(REQUESTED) + _bit("accept_ts", ACCEPTED) + _bit("dropoff_ts", COMPLETED)
    parts = (
        rides.select("ride_id", happened.alias("reach")),
        approved(transactions).select("ride_id", F.lit(PAID).alias("reach")),
        reviews.select("ride_id", F.lit(REVIEWED).alias("reach")),
    )
    return reduce(DataFrame.unionByName, parts).groupBy("ride_id").agg(F.bit_or("reach").alias("reach"))


def reached(bit: int) -> Column:
    return F.col("reach").bitwiseAND(bit) != 0
