"""Readers, writer and session settings."""

import datetime as dt

import pytest
from builders import as_dicts, download, duck_tables, paid, random_rows, ride, signup, stored_tables, tables
from checks import duck_result, spark_result
from pyspark.sql import functions as F

from oracles import JOBS
from stepfall.plans import extract, funnels
from stepfall.sources import SCHEMAS, FunnelTables, empty_tables, from_star, read_catalog, read_files, tune, write_extract

ROWS = {
    "app_downloads": [download(10), download(11, None)],
    "signups": [signup(10), signup(11, age=None)],
    "ride_requests": [ride(1, 10, accept=True, dropoff=True), ride(2, 11)],
    "transactions": [paid(1)],
    "reviews": [(1, 10)],
}


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_file_formats(spark, tmp_path, fmt):
    t = tables(spark, **ROWS)
    for name, df in t.items():
        write_extract(df, str(tmp_path / name), fmt)
    back = read_files(spark, str(tmp_path), fmt)
    for name, df in back.items():
        assert df.dtypes == [(f.name, f.dataType.simpleString()) for f in SCHEMAS[name]]
    assert spark_result(extract.funnel_extract(back)) == spark_result(extract.funnel_extract(t))


def _write_csv(t, folder, header=True, columns=lambda names: names, change=lambda name, df: df):
    for name, df in t.items():
        change(name, df).select(*columns(df.columns)).write.csv(str(folder / name), header=header)


def test_own_csv_output_is_read_back(spark, tmp_path):
    """The header line is no row."""
    t = tables(spark, **ROWS)
    for name, df in t.items():
        write_extract(df, str(tmp_path / name), fmt="csv")
    back = read_files(spark, str(tmp_path), "csv")
    assert back.ride_requests.count() == 2
    for job in (funnels.user_steps, funnels.ride_steps):
        assert spark_result(job(back)) == spark_result(job(t))


def test_csv_columns_go_by_name(spark, tmp_path):
    t = tables(spark, **ROWS)
    _write_csv(t, tmp_path, columns=lambda names: names[::-1])
    assert spark_result(funnels.user_steps(read_files(spark, str(tmp_path), "csv"))) == spark_result(funnels.user_steps(t))


def test_csv_without_header_goes_by_position(spark, tmp_path):
    t = tables(spark, **ROWS)
    _write_csv(t, tmp_path, header=False)
    back = read_files(spark, str(tmp_path), "csv", header="false")
    assert spark_result(funnels.user_steps(back)) == spark_result(funnels.user_steps(t))


def test_csv_files_that_disagree_on_the_header_fail(spark, tmp_path):
    t = tables(spark, **ROWS)
    _write_csv(t, tmp_path)
    reviews = tmp_path / "reviews"
    t.reviews.select("user_id", "ride_id").write.csv(str(reviews), header=True, mode="append")
    with pytest.raises(Exception, match="(?i)header"):
        read_files(spark, str(tmp_path), "csv").reviews.collect()


def _text_keys(name, df):
    keys = {"app_download_key", "session_id", "user_id", "ride_id", "driver_id"}
    return df.select(*[F.concat(F.lit("k"), F.col(c)).alias(c) if c in keys else F.col(c) for c in df.columns])


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_text_keys_in_text_files(spark, tmp_path, fmt):
    t = tables(spark, **ROWS)
    for name, df in t.items():
        write_extract(_text_keys(name, df), str(tmp_path / name), fmt)
    back = read_files(spark, str(tmp_path), fmt, key_type="string")
    assert spark_result(funnels.user_steps(back)) == spark_result(funnels.user_steps(t))
    with pytest.raises(Exception, match="(?i)is no bigint|malformed|parse"):
        read_files(spark, str(tmp_path), fmt).ride_requests.collect()


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_malformed_field_fails(spark, tmp_path, fmt):
    t = tables(spark, **ROWS)
    for name, df in t.items():
        bad = df.withColumn("purchase_amount_usd", F.lit("ten")) if name == "transactions" else df
        write_extract(bad, str(tmp_path / name), fmt)
    back = read_files(spark, str(tmp_path), fmt)
    with pytest.raises(Exception, match="(?i)is no double|malformed|parse"):
        back.transactions.collect()
    lenient = read_files(spark, str(tmp_path), fmt, mode="PERMISSIVE")
    assert [r["purchase_amount_usd"] for r in lenient.transactions.collect()] == [None]


def test_missing_csv_column_is_reported(spark, tmp_path):
    _write_csv(tables(spark, **ROWS), tmp_path, columns=lambda names: names[:-1])
    with pytest.raises(ValueError, match="lacks columns"):
        read_files(spark, str(tmp_path), "csv")


def test_keys_of_unlike_type_are_reported(spark):
    t = dict(tables(spark, **ROWS).items())
    signups = t["signups"].withColumn("user_id", F.col("user_id").cast("string"))
    with pytest.raises(ValueError, match=r"ride_requests.user_id \(integer\) and signups.user_id \(string\)"):
        FunnelTables(**{**t, "signups": signups})
    narrow = t["signups"].withColumn("user_id", F.col("user_id").cast("int"))
    FunnelTables(**{**t, "signups": narrow})


def test_catalog(spark):
    t = tables(spark, **ROWS)
    for name, df in t.items():
        df.createOrReplaceTempView(name)
    try:
        assert spark_result(funnels.user_steps(read_catalog(spark))) == spark_result(funnels.user_steps(t))
    finally:
        for name in SCHEMAS:
            spark.catalog.dropTempView(name)


def test_text_keys(spark, tmp_path):
    """Keys are opaque: any type that joins by equality will do."""
    rows = random_rows(5)
    t = stored_tables(spark, tmp_path, rows)
    keys = {"app_download_key", "session_id", "user_id", "ride_id", "driver_id"}
    text = FunnelTables(
        **{
            name: df.select(
                *[F.concat(F.lit("k"), F.col(c)).alias(c) if c in keys else F.col(c) for c in df.columns]
            )
            for name, df in t.items()
        }
    )
    con = duck_tables(rows)
    for job, key in ((extract.funnel_extract, "funnel_extract"), (funnels.ride_steps, "ride_steps")):
        assert spark_result(job(text)) == duck_result(con, JOBS[key])


def test_missing_column_is_reported(spark):
    t = empty_tables(spark)
    with pytest.raises(ValueError, match="signups lacks columns"):
        FunnelTables(**{**dict(t.items()), "signups": t.signups.drop("age_range")})


def test_write_parquet_by_step(spark, tmp_path):
    df = extract.funnel_extract(tables(spark, **ROWS))
    path = str(tmp_path / "out")
    write_extract(df, path, partition_by=["funnel_step"])
    back = spark.read.parquet(path)
    assert spark_result(back) == spark_result(df)
    assert back.where("funnel_step = 3").count() == 2
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        write_extract(df, path)


def test_write_csv(spark, tmp_path):
    df = extract.funnel_extract(tables(spark, **ROWS))
    path = str(tmp_path / "out")
    write_extract(df, path, fmt="csv", mode="overwrite")
    back = spark.read.schema(df.schema).csv(path, header=True)
    assert spark_result(back) == spark_result(df)
    assert as_dicts(back)[0]["download_dt"] == dt.date(2021, 3, 1)


def test_tune_keeps_what_the_session_sets(spark):
    key = "spark.sql.adaptive.skewJoin.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        assert tune(spark).conf.get(key) == "false"
    finally:
        spark.conf.set(key, before)


def test_star_reads_only_what_a_job_needs(spark):
    plan = funnels.segment_share_platform(from_star(spark, "/root/testdata/sf0.001"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "struct<c_mktsegment:string>" in text
    assert "c_custkey" not in text
