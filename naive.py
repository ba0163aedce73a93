"""The step-by-step forms of three headline jobs, for comparison only.

One scan per step, joins at row grain, ride counts joined back by equality.
``bench.py`` times them beside the jobs in ``stepfall`` and the tests require
both to agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.operators import CELL, pct_of_previous
from stepfall.operators.activity import approved
from stepfall.operators.grain import age_label
from stepfall.plans.funnels import STEP_NAMES
from stepfall.sources import TableSet


def _rows() -> Column:
    return F.count(F.lit(1)).alias("n")


def _number(frames: dict[int, DataFrame], value: str, *keys: str) -> DataFrame:
    """Frames with a count ``n``, tagged with their step."""
    tagged = [
        df.select(
            F.lit(i).alias("funnel_step"), F.lit(STEP_NAMES[i]).alias("funnel_name"), *keys, F.col("n").alias(value)
        )
        for i, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, tagged)


def _groups(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().agg(_rows())


def _ever(rides: DataFrame, key: str, ts: str) -> DataFrame:
    reached = F.max(F.when(F.col(ts).isNotNull(), 1).otherwise(0))
    return rides.groupBy(key).agg(reached.alias("hit")).agg(F.sum("hit").alias("n"))


def _later(t: TableSet, key: str) -> dict[int, DataFrame]:
    rides = t.ride_requests
    paid = approved(t.transactions).withColumnRenamed("ride_id", "paid_ride")
    matched = paid.join(rides, paid["paid_ride"] == F.col("ride_id"), "left")
    return {
        3: _groups(rides, key),
        4: _ever(rides, key, "accept_ts"),
        5: _ever(rides, key, "dropoff_ts"),
        6: _groups(matched, key),
        7: _groups(t.reviews, key),
    }


def user_funnel_pct_previous(t: TableSet) -> DataFrame:
    frames = {
        1: t.app_downloads.agg(F.count_distinct("app_download_key").alias("n")),
        2: t.signups.agg(F.count_distinct("user_id").alias("n")),
        **_later(t, "user_id"),
    }
    return pct_of_previous(_number(frames, "user_count"), "user_count")


def ride_funnel_pct_previous(t: TableSet) -> DataFrame:
    steps = _number(_later(t, "ride_id"), "ride_count").where("ride_count > 0")
    return pct_of_previous(steps, "ride_count")


def _with_cell(facts: DataFrame, t: TableSet) -> DataFrame:
    homes = t.app_downloads.select(
        F.col("app_download_key").alias("session_id"), "platform", F.col("download_ts").cast("date").alias("download_dt")
    )
    people = t.signups.select("user_id", "session_id", "age_range")
    return facts.join(people, "user_id", "left").join(homes, "session_id", "left").withColumn("age_range", age_label())


def funnel_extract(t: TableSet) -> DataFrame:
    homes = t.app_downloads.select(
        "app_download_key", "platform", F.col("download_ts").cast("date").alias("download_dt")
    )
    people = t.signups.withColumnRenamed("session_id", "app_download_key")
    downloads = homes.join(people, "app_download_key", "left").withColumn("age_range", age_label())
    signed_up = people.join(homes, "app_download_key", "left").withColumn("age_range", age_label())

    def rides() -> DataFrame:
        return _with_cell(t.ride_requests, t)

    def status(ts: str) -> DataFrame:
        hit = F.max(F.when(F.col(ts).isNotNull(), 1).otherwise(0)).alias("hit")
        return rides().groupBy("user_id", *CELL).agg(hit).groupBy(*CELL).agg(F.sum("hit").alias("n"))

    def paid() -> DataFrame:
        return _with_cell(approved(t.transactions).join(t.ride_requests, "ride_id", "left"), t)

    def reviewed() -> DataFrame:
        return _with_cell(t.reviews, t)

    def users(df: DataFrame) -> DataFrame:
        return df.select("user_id", *CELL).distinct().groupBy(*CELL).agg(_rows())

    def rows(df: DataFrame) -> DataFrame:
        return df.groupBy(*CELL).agg(_rows())

    steps = _number(
        {
            1: downloads.groupBy(*CELL).agg(F.count_distinct("app_download_key").alias("n")),
            2: signed_up.groupBy(*CELL).agg(F.count_distinct("user_id").alias("n")),
            3: users(rides()),
            4: status("accept_ts"),
            5: status("dropoff_ts"),
            6: users(paid()),
            7: users(reviewed()),
        },
        "user_count",
        *CELL,
    )
    counts = _number(
        {
            3: rows(rides()),
            4: rows(rides().where(F.col("accept_ts").isNotNull())),
            5: rows(rides().where(F.col("dropoff_ts").isNotNull())),
            6: rows(paid()),
            7: rows(reviewed()),
        },
        "ride_count",
        *CELL,
    ).drop("funnel_name")
    order = ("funnel_step", *CELL)
    return (
        steps.join(counts, ["funnel_step", *CELL], "left")
        .select("funnel_step", "funnel_name", *CELL, "user_count", "ride_count")
        .orderBy(*[F.col(c).asc_nulls_last() for c in order])
    )
