"""Tables stored by their keys, and counts from file footers."""

import uuid

import pytest
from builders import duck_tables, random_rows, stored_tables
from checks import duck_result, settings, spark_result
from pyspark.sql import functions as F

from oracles import JOBS
from stepfall.jobs import JOBS_BY_NAME
from stepfall.operators import payments_per_user
from stepfall.operators.grain import homes, people, placed
from stepfall.plans import extract, profile
from stepfall.sources import read_buckets, read_files, write_buckets, write_extract

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def _lines(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip(" :+-") for line in plan.splitlines()]


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    rows, folder = random_rows(6), tmp_path_factory.mktemp("stored")
    database = f"rides_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}/db'")
    write_buckets(stored_tables(spark, folder / "in", rows), database, root=str(folder / "buckets"))
    yield read_buckets(spark, database), duck_tables(rows)
    spark.sql(f"DROP DATABASE {database} CASCADE")


@pytest.mark.parametrize("name", ["funnel_extract", "user_funnel_pct_previous", "ride_funnel_pct_previous", "seg_user_payment", "seg_app_download", "rides_per_platform"])
def test_jobs_on_buckets(spark, bucketed, name):
    t, con = bucketed
    with settings(spark, NO_BROADCAST):
        assert spark_result(JOBS_BY_NAME[name](t)) == duck_result(con, JOBS[name])


def test_joins_find_their_rows_in_place(spark, bucketed):
    """No exchange below signups and downloads, payments and rides, and facts and cells."""
    t, _ = bucketed
    joins = [
        placed(people(t.signups), homes(t.app_downloads), t.hot_rows),
        payments_per_user(t.transactions, t.riders(), t.hot_rows),
        extract.users_with_cell(t, extract._rides),
        extract.users_with_cell(t, extract._reviews),
    ]
    with settings(spark, NO_BROADCAST):
        for df in joins:
            lines = _lines(df)
            join = next(i for i, line in enumerate(lines) if line.startswith("SortMergeJoin"))
            assert not [line for line in lines[join:] if line.startswith("Exchange")], lines
        assert not [line for line in _lines(extract._rides(t)) if line.startswith("Exchange")]


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_counts_and_bounds_from_footers(spark, tmp_path, fmt):
    rows = random_rows(3)
    plain = stored_tables(spark, tmp_path / "in", rows)
    for name, df in plain.items():
        write_extract(df, str(tmp_path / fmt / name), fmt)
    t = read_files(spark, str(tmp_path / fmt), fmt, footers=True)
    bounds = t.ride_requests.agg(F.count(F.lit(1)).alias("n"), F.min("ride_id").alias("lo"), F.max("ride_id").alias("hi"))
    for df in (profile.table_profile(t), bounds):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedAggregation: [COUNT(*)" in plan
    assert spark_result(profile.table_profile(t)) == spark_result(profile.table_profile(plain))
    known = [r[0] for r in rows["ride_requests"] if r[0] is not None]
    assert tuple(bounds.first()) == (len(rows["ride_requests"]), min(known), max(known))
    # Where footers do not tell (distinct keys, NULLs, times), rows are read.
    con = duck_tables(rows)
    for name in ("downloads_total", "dropoff_date_range", "ride_status_totals", "payments_approved", "funnel_extract"):
        assert spark_result(JOBS_BY_NAME[name](t)) == duck_result(con, JOBS[name]), name
    again = read_files(spark, str(tmp_path / fmt), fmt)
    assert "PushedAggregation" not in profile.table_profile(again)._jdf.queryExecution().executedPlan().toString()


def test_text_formats_are_read_in_full(spark, tmp_path):
    rows = random_rows(3)
    for name, df in stored_tables(spark, tmp_path / "in", rows).items():
        write_extract(df, str(tmp_path / "csv" / name), "csv")
    t = read_files(spark, str(tmp_path / "csv"), "csv", footers=True)
    assert t.ride_requests.count() == len(rows["ride_requests"])
