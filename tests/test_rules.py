"""One small case per rule of the funnel and the extract."""

from functools import lru_cache

import pytest
from builders import as_dicts, at, download, paid, ride, signup, tables
from pyspark.sql import functions as F

from stepfall.operators import pct_of_previous, pct_of_top, segment_share
from stepfall.plans import extract, funnels, profile
from stepfall.sources import FunnelTables


def by_step(df, value):
    return {r["funnel_step"]: r[value] for r in df.collect()}


@lru_cache(maxsize=1)
def extract_rows(t):
    return as_dicts(extract.funnel_extract(t))


def cell_rows(t, step):
    return [r for r in extract_rows(t) if r["funnel_step"] == step]


def test_empty_steps_leave_before_the_window(spark):
    t = tables(spark, ride_requests=[ride(1, 1, accept=True, dropoff=True), ride(2, 1, accept=True), ride(3, 2)])
    previous = as_dicts(funnels.ride_funnel_pct_previous(t))
    assert [r["funnel_step"] for r in previous] == [3, 4, 5]
    assert previous[0]["lag"] is None and previous[0]["conversion_rate"] is None
    top = as_dicts(funnels.ride_funnel_pct_top(t))
    assert {r["first_value"] for r in top} == {3}


def test_payments_without_a_ride_form_one_group(spark):
    t = tables(
        spark,
        ride_requests=[ride(1, 10, accept=True, dropoff=True)],
        transactions=[paid(1), paid(1), paid(98), paid(99), paid(None), paid(97, status="Decline")],
    )
    assert by_step(funnels.user_steps(t), "user_count")[6] == 2
    assert by_step(funnels.ride_steps(t), "ride_count")[6] == 2


def test_funnel_counts_paid_rides_and_extract_counts_payments(spark):
    t = tables(
        spark,
        app_downloads=[download(10)],
        signups=[signup(10)],
        ride_requests=[ride(1, 10, accept=True, dropoff=True)],
        transactions=[paid(1), paid(1)],
        reviews=[(1, 10), (1, 10)],
    )
    counts = by_step(funnels.ride_steps(t), "ride_count")
    assert (counts[6], counts[7]) == (1, 1)
    assert [(r["user_count"], r["ride_count"]) for r in cell_rows(t, 6)] == [(1, 2)]
    assert [(r["user_count"], r["ride_count"]) for r in cell_rows(t, 7)] == [(1, 2)]


def test_cell_without_accepted_rides(spark):
    t = tables(spark, app_downloads=[download(10)], signups=[signup(10)], ride_requests=[ride(1, 10)])
    assert [(r["user_count"], r["ride_count"]) for r in cell_rows(t, 3)] == [(1, 1)]
    assert [(r["user_count"], r["ride_count"]) for r in cell_rows(t, 4)] == [(0, None)]
    assert [(r["user_count"], r["ride_count"]) for r in cell_rows(t, 5)] == [(0, None)]
    assert cell_rows(t, 6) == cell_rows(t, 7) == []
    assert as_dicts(extract.seg_rides_accepted(t)) == []


def test_users_without_signup_keep_their_rides(spark):
    t = tables(spark, ride_requests=[ride(1, 10, accept=True), ride(2, 10)])
    assert cell_rows(t, 3) == [
        {
            "funnel_step": 3,
            "funnel_name": "ride_requested",
            "platform": None,
            "age_range": "Not Specified",
            "download_dt": None,
            "user_count": 1,
            "ride_count": None,
        }
    ]
    assert [r["total_rides_requested"] for r in as_dicts(extract.seg_rides_requested(t))] == [2]
    assert as_dicts(profile.rides_per_platform(t)) == [{"platform": None, "total_ride_requests_per_platform": 2}]


def test_missing_age_and_its_label_share_a_cell(spark):
    t = tables(
        spark,
        app_downloads=[download(1), download(2)],
        signups=[signup(1, age=None), signup(2, age="Not Specified")],
        ride_requests=[ride(1, 1), ride(2, 2)],
    )
    assert [(r["age_range"], r["user_count"], r["ride_count"]) for r in cell_rows(t, 3)] == [("Not Specified", 2, 2)]
    assert [r["user_count"] for r in cell_rows(t, 1)] == [2]


def test_unknown_is_an_answer(spark):
    t = tables(
        spark,
        app_downloads=[download(1), download(2)],
        signups=[signup(1, age="Unknown"), signup(2, age=None)],
    )
    assert sorted(r["age_range"] for r in cell_rows(t, 2)) == ["Not Specified", "Unknown"]
    assert [r["age_range"] for r in as_dicts(funnels.segment_share_age(t))] == ["Unknown", None]


def test_no_rides_at_all(spark):
    t = tables(spark, app_downloads=[download(1)], signups=[signup(1)])
    users = by_step(funnels.user_steps(t), "user_count")
    assert users == {1: 1, 2: 1, 3: 0, 4: None, 5: None, 6: 0, 7: 0}
    assert by_step(funnels.ride_steps(t), "ride_count") == {1: 0, 2: 0, 3: 0, 4: None, 5: None, 6: 0, 7: 0}
    assert as_dicts(funnels.ride_funnel_pct_previous(t)) == []


def test_nulls_sort_last_ascending_and_first_descending(spark):
    t = tables(
        spark,
        app_downloads=[download(1, "web"), download(2, None), download(3, "ios")],
        signups=[signup(1), signup(2), signup(3)],
        ride_requests=[ride(i, u) for i, u in enumerate([1, 2, 3])],
    )
    assert [r["platform"] for r in cell_rows(t, 3)] == ["ios", "web", None]
    df = spark.createDataFrame([(1,), (None,), (2,)], "n int")
    assert [r["n"] for r in df.orderBy(F.col("n").desc_nulls_first()).collect()] == [None, 2, 1]


def test_output_names(spark):
    t = tables(spark)
    assert profile.dropoff_date_range(t).columns == ["min", "max"]
    tail = ["diff", "conversion_rate", "dropoff_percent"]
    assert funnels.user_funnel_pct_previous(t).columns == ["funnel_step", "funnel_name", "user_count", "lag", *tail]
    assert funnels.ride_funnel_pct_previous(t).columns == ["funnel_step", "funnel_name", "ride_count", "lag", *tail]
    assert extract.funnel_extract(t).columns == [
        "funnel_step",
        "funnel_name",
        "platform",
        "age_range",
        "download_dt",
        "user_count",
        "ride_count",
    ]


def test_download_day_is_cut_not_shifted(spark):
    """23:30 belongs to its own day, 24 hours and 30 minutes later to the next but one."""
    t = tables(spark, app_downloads=[download(1), download(2, minutes=30), download(3, minutes=1470)])
    assert [str(r["download_dt"]) for r in cell_rows(t, 1)] == ["2021-03-01", "2021-03-02", "2021-03-03"]


def test_one_session_shared_by_several_signups(spark):
    t = tables(
        spark,
        app_downloads=[download(1)],
        signups=[signup(1, 1, "18-24"), signup(2, 1, "18-24"), signup(3, 1, "25-34")],
    )
    assert [(r["age_range"], r["user_count"]) for r in cell_rows(t, 1)] == [("18-24", 1), ("25-34", 1)]
    assert [(r["age_range"], r["user_count"]) for r in cell_rows(t, 2)] == [("18-24", 2), ("25-34", 1)]


def test_repeated_signup_counts_rides_once_per_copy(spark):
    t = tables(
        spark,
        app_downloads=[download(1), download(2)],
        signups=[signup(1, 1), signup(1, 2)],
        ride_requests=[ride(1, 1), ride(2, 1)],
    )
    assert [(r["user_count"], r["ride_count"]) for r in cell_rows(t, 3)] == [(1, 4)]


def test_cancel_rate(spark):
    t = tables(
        spark,
        ride_requests=[
            ride(1, 1, cancel=True),
            ride(2, 1, accept=True, dropoff=True),
            ride(3, 2, accept=True, dropoff=True),
            ride(4, 3, cancel=True, pickup=True),
            ride(5, None, cancel=True),
        ],
    )
    assert as_dicts(profile.request_cancel_rate(t)) == [
        {"users_requesting_rides": 3, "users_cancelling": 1, "cancel_rate": 0.3333}
    ]


def test_payment_total_does_not_depend_on_the_order(spark):
    """Binary sums of these amounts differ between the two layouts."""
    rides = spark.range(0, 300_000, 1, 1)
    amount = (F.lit(0.1) + F.col("id") % 997 / 7 + F.when(F.col("id") % 1000 == 0, 1e9).otherwise(0.0)).alias("purchase_amount_usd")
    paid_rides = rides.select(F.col("id").alias("ride_id"), amount, F.lit("Approved").alias("charge_status"))
    base = dict(tables(spark).items())
    totals = {
        tuple(profile.payments_approved(FunnelTables(**{**base, "transactions": layout})).first())
        for layout in (paid_rides, paid_rides.repartition(7), paid_rides.orderBy("purchase_amount_usd"))
    }
    assert len(totals) == 1


def test_amounts_that_are_no_decimals_add_nothing(spark):
    t = tables(spark, transactions=[paid(1, 2.5), paid(2, float("nan")), paid(3, float("inf")), paid(4, None)])
    assert tuple(profile.payments_approved(t).first()) == (4, 2.5)


def test_preview_and_top_users(spark):
    t = tables(spark, ride_requests=[ride(i, 20 - i, dropoff=i % 2 == 0) for i in range(12)])
    assert profile.table_preview(t.ride_requests).count() == 10
    assert [r["ride_id"] for r in profile.table_preview(t.ride_requests, 3, ordered=True).collect()] == [0, 1, 2]
    assert [tuple(r) for r in profile.user_ride_completed(t).collect()] == [(9, 0), (10, 1), (11, 0), (12, 1), (13, 0)]
    assert profile.user_ride_completed(t, n=None).count() == 12


def test_operators_work_on_any_frame(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 4), (3, "b", 1)], "pos int, kind string, n bigint")
    assert [r["lag"] for r in pct_of_previous(df, "n", order="pos").collect()] == [None, 10, 4]
    assert [r["conversion_rate"] for r in pct_of_top(df, "n", order="pos").collect()] == [1.0, 0.4, 0.1]
    shares = segment_share(df, "kind", "rows", "all_rows", "share")
    assert {r["kind"]: r["share"] for r in shares.collect()} == {"a": 0.3333, "b": 0.6667}


@pytest.fixture(scope="module")
def star(spark):
    from stepfall.sources import from_star

    return from_star(spark, "/root/testdata/sf0.01")


def test_derived_tables_have_unique_keys(star):
    for df, key in (
        (star.app_downloads, "app_download_key"),
        (star.signups, "user_id"),
        (star.signups, "session_id"),
        (star.ride_requests, "ride_id"),
    ):
        total, distinct = df.agg(F.count("*"), F.count_distinct(key)).first()
        assert total == distinct


def test_the_same_fact_counted_in_several_ways(star):
    totals = profile.ride_status_totals(star).first()
    steps = by_step(funnels.ride_steps(star), "ride_count")
    assert totals["total_rides_completed"] == steps[5]
    assert totals["total_rides_completed"] == profile.completed_rides_strict(star).first()[0]
    assert totals["total_rides_completed"] == profile.accepted_not_cancelled(star).first()[0]
    assert totals["total_rides_accepted"] == steps[4] == profile.accepted_rides(star).first()[0]
    users = by_step(funnels.user_steps(star), "user_count")
    assert users[5] == profile.completed_users(star).first()["total_users_distinct"]
    rollup = profile.user_ride_rollup(star).first()
    assert (rollup[0], rollup[1]) == (users[3], users[5])
    assert users[3] >= users[4] >= users[5]


def test_segments_add_up(star):
    shares = as_dicts(funnels.segment_share_platform(star))
    assert sum(r["downloads"] for r in shares) == shares[0]["total_downloads"] == star.app_downloads.count()
    assert sum(r["pct_of_downloads"] for r in shares) == pytest.approx(1, abs=1e-3)
    platforms = as_dicts(profile.rides_per_platform(star))
    assert sum(r["total_ride_requests_per_platform"] for r in platforms) == star.ride_requests.count()
    users = by_step(funnels.user_steps(star), "user_count")
    per_step = extract.seg_user_steps(star).groupBy("funnel_step").agg(F.sum("user_count").alias("n"))
    assert by_step(per_step, "n") == users


def test_recorded_extract_sizes(star):
    """Fixed values of the derived tables: rows, users, rides, rows without ride count."""
    got = (
        extract.funnel_extract(star)
        .groupBy("funnel_step")
        .agg(F.count("*"), F.sum("user_count"), F.sum("ride_count"), F.count_if(F.col("ride_count").isNull()))
    )
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {
        1: (792, 1500, None, 792),
        2: (729, 1125, None, 729),
        3: (641, 956, 9045, 1),
        4: (641, 947, 7269, 4),
        5: (641, 844, 2374, 50),
        6: (419, 525, 933, 1),
        7: (352, 422, 645, 1),
    }


def test_times(spark):
    rows = [
        (1, 1, 1, at(0), at(3), at(10), at(20), None),
        (2, 1, 1, at(0), at(3), at(10), at(41), None),
        (3, 1, 1, at(0), at(3), None, at(41), None),
    ]
    t = tables(spark, ride_requests=rows)
    assert profile.avg_ride_seconds(t).first()[0] == 1230.0
    assert profile.avg_ride_minutes(t).first()[0] == 20.5
    assert str(profile.dropoff_date_range(t).first()["max"]) == "2021-03-02 00:00:00"
