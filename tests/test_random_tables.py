"""All jobs against their check SQL on random tables with broken keys, NULLs and hot keys."""

import pytest
from builders import as_dicts, duck_tables, random_rows, stored_tables, tables
from checks import duck_result, settings, spark_result

import naive
from oracles import JOBS
from stepfall.jobs import JOBS_BY_NAME, REPEATABLE
from stepfall.plans import extract, funnels

SEEDS = (1, 2)


@pytest.fixture(scope="module", params=SEEDS)
def both(request, spark, tmp_path_factory):
    rows = random_rows(request.param)
    return stored_tables(spark, tmp_path_factory.mktemp("tables"), rows), duck_tables(rows)


@pytest.mark.parametrize("name", sorted(JOBS_BY_NAME))
def test_matches(both, name):
    t, con = both
    assert spark_result({**JOBS_BY_NAME, **REPEATABLE}[name](t)) == duck_result(con, JOBS[name])


@pytest.mark.parametrize("name", ["funnel_extract", "user_steps", "rides_per_platform", "seg_user_payment"])
def test_matches_without_broadcasts(spark, both, name):
    """The plans of a cluster: every join sorts and merges, nothing is coalesced away."""
    t, con = both
    plans = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    with settings(spark, plans):
        assert spark_result(JOBS_BY_NAME[name](t)) == duck_result(con, JOBS[name])


@pytest.mark.parametrize(
    "job, step_by_step",
    [
        (funnels.user_funnel_pct_previous, naive.user_funnel_pct_previous),
        (funnels.ride_funnel_pct_previous, naive.ride_funnel_pct_previous),
        (extract.funnel_extract, naive.funnel_extract),
    ],
)
def test_agrees_with_the_step_by_step_form(both, job, step_by_step):
    t, _ = both
    assert spark_result(job(t)) == spark_result(step_by_step(t))


def test_all_tables_empty(spark):
    t = tables(spark)
    con = duck_tables({})
    for name in ("user_steps", "ride_steps", "ride_funnel_pct_previous", "funnel_extract", "avg_ride_seconds"):
        assert spark_result(JOBS_BY_NAME[name](t)) == duck_result(con, JOBS[name]), name
    assert as_dicts(JOBS_BY_NAME["signup_to_request_dropoff"](t)) == [
        {"total_signups": 0, "users_requesting_rides": 0, "dropoff": 0, "dropoff_percent": None}
    ]
