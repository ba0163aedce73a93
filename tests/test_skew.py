"""One key holds a third of the rows: results stay whole and the load is split."""

import pytest
from builders import random_rows, stored_tables
from checks import settings
from pyspark.sql import functions as F

from stepfall.operators import payments_per_user, split_join
from stepfall.operators.grain import cells_of, download_counts, homes, people, placed, user_cells
from stepfall.plans import extract, funnels
from stepfall.sources import SCHEMAS, FunnelTables
from stepfall.sources.star import StarTables

N = 120_000
SMALL_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


def final_plan(df) -> str:
    """The plan adaptive execution ended with, after running it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def hot(column, value=1):
    """A third of the rows get one value."""
    return F.when(F.col("id") % 3 == 0, F.lit(value)).otherwise(column)


def typed(df, name):
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])


@pytest.fixture(scope="module")
def skewed(spark):
    ids = spark.range(0, N, 1, 8)
    moment = F.lit("2021-05-01 10:00:00").cast("timestamp_ntz")
    frames = {
        "app_downloads": ids.select(
            F.col("id").alias("app_download_key"), F.lit("ios").alias("platform"), moment.alias("download_ts")
        ),
        "signups": ids.select(
            F.col("id").alias("user_id"), hot(F.col("id")).alias("session_id"), F.lit("18-24").alias("age_range")
        ),
        "ride_requests": ids.select(
            F.col("id").alias("ride_id"),
            hot(F.col("id")).alias("user_id"),
            F.lit(1).alias("driver_id"),
            *[moment.alias(c) for c in ("request_ts", "accept_ts", "pickup_ts", "dropoff_ts")],
            F.lit(None).alias("cancel_ts"),
        ),
        "transactions": ids.select(
            hot(F.col("id")).alias("ride_id"), F.lit(1.5).alias("purchase_amount_usd"), F.lit("Approved").alias("charge_status")
        ),
        "reviews": ids.select(F.col("id").alias("ride_id"), hot(F.col("id"), None).alias("user_id")),
    }
    return FunnelTables(**{name: typed(df, name) for name, df in frames.items()})


def test_hot_session_is_split(spark, skewed):
    with settings(spark, SMALL_SKEW):
        cells = user_cells(skewed.signups, skewed.app_downloads)
        plan = final_plan(cells)
        assert "SortMergeJoin(skew=true)" in plan
        assert cells.count() == N


def test_hot_order_of_the_star_schema_is_split(spark):
    ids = spark.range(0, N, 1, 8)
    orders = ids.select(
        F.col("id").alias("o_orderkey"),
        (F.col("id") * 4 + 1).alias("o_custkey"),
        F.lit("F").alias("o_orderstatus"),
        F.lit("2021-05-01 10:00:00").cast("timestamp_ntz").alias("o_orderdate"),
        F.lit("1-URGENT").alias("o_orderpriority"),
    )
    lineitem = ids.select(
        hot(F.col("id"), 3).alias("l_orderkey"),
        F.lit(1).alias("l_linenumber"),
        F.lit(2.0).alias("l_extendedprice"),
        F.lit("N").alias("l_returnflag"),
        F.lit("F").alias("l_linestatus"),
    )
    customer = ids.selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey", "'BUILDING' AS c_mktsegment")
    star = StarTables(customer, orders, lineitem)
    # Sizes are those of compressed shuffle files, and a repeated key compresses well.
    tiny = {
        **SMALL_SKEW,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    }
    with settings(spark, tiny):
        plan = final_plan(funnels.user_steps(star))
    assert "SortMergeJoin(skew=true)" in plan


def test_hot_user_and_hot_ride_stay_whole(spark, skewed):
    third = N // 3
    rest = N - third
    users = {r[0]: r[2] for r in funnels.user_steps(skewed).collect()}
    # User 1 is the hot one and has rides of its own too; NULL is the hot reviewer.
    assert users == {1: N, 2: N, 3: rest, 4: rest, 5: rest, 6: rest, 7: rest + 1}
    rides = {r[0]: r[2] for r in funnels.ride_steps(skewed).collect()}
    assert rides == {1: 0, 2: 0, 3: N, 4: N, 5: N, 6: rest, 7: N}
    got = {
        (r["funnel_step"], r["platform"]): (r["user_count"], r["ride_count"])
        for r in extract.funnel_extract(skewed).collect()
    }
    assert got[(3, "ios")] == (rest, N)
    assert got[(6, "ios")] == (rest, N)
    assert got[(7, "ios")] == (rest, rest)
    assert got[(7, None)] == (1, None)


def test_partial_aggregates_come_before_the_shuffle(spark, skewed):
    """A hot key then moves once per task. The ride funnel needs that one shuffle and no join."""
    plan = funnels.ride_steps(skewed)._jdf.queryExecution().executedPlan().toString()
    lines = [line.strip(" :+-") for line in plan.splitlines()]
    at = [i for i, line in enumerate(lines) if line.startswith("Exchange hashpartitioning(ride_id")]
    assert len(at) == 1
    assert "partial_bit_or" in lines[at[0] + 1]
    assert "Join" not in plan


def test_facts_are_shuffled_once_by_user(spark, skewed):
    """The union of per-user facts keeps its partitioning, so the attribution join adds no exchange to it."""
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        facts = extract.cells(skewed, extract._rides, extract._payments, extract._reviews)
        plan = facts._jdf.queryExecution().executedPlan().toString()
        lines = [line.strip(" :+-") for line in plan.splitlines()]
        by_user = [line for line in lines if line.startswith("Exchange hashpartitioning(user_id")]
        # rides, payments, reviews; user cells once to build them and once for the join.
        assert len(by_user) == 5
        got = {(r["platform"]): (r["requests_users"], r["requests_rows"], r["payments_rows"]) for r in facts.collect()}
    assert got["ios"] == (N - N // 3, N, N)


def test_a_key_repeated_on_both_sides_makes_no_pairs(spark):
    """4,000 signups and 4,000 downloads of one key: the join meets one download row per cell."""
    n = 4_000
    ids = spark.range(0, n, 1, 4)
    moment = F.lit("2021-05-01 10:00:00").cast("timestamp_ntz")
    one = F.col("id") % 1 + 1
    downloads = ids.select(one.alias("app_download_key"), F.lit("ios").alias("platform"), moment.alias("download_ts"))
    signups = ids.select(F.col("id").alias("user_id"), one.alias("session_id"), F.lit("18-24").alias("age_range"))
    downloads, signups = typed(downloads, "app_downloads"), typed(signups, "signups")
    with settings(spark, SMALL_SKEW):
        cells = user_cells(signups, downloads)
        plan = cells._jdf.queryExecution().executedPlan().toString()
        join = plan.index("SortMergeJoin")
        assert "partial_count" in plan[join:], "downloads are grouped below the join"
        assert placed(people(signups), homes(downloads)).count() == n
        got = cells.agg(F.count("*"), F.min("copies"), F.max("copies")).first()
    assert tuple(got) == (n, n, n)


def test_user_tables_move_once_in_the_extract(spark, tmp_path):
    stored = stored_tables(spark, tmp_path, random_rows(4))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        lines = [line.strip(" :+-") for line in final_plan(extract.funnel_extract(stored)).splitlines()]
    scans = [line for line in lines if "FileScan" in line or "Scan parquet" in line]
    for column in ("app_download_key", "age_range"):
        assert sum(f"{column}#" in line for line in scans) == 1, column
    moves = [line for line in lines if line.startswith("Exchange hashpartitioning(")]
    # Two reduced tables move once more to meet the pieces of hot keys, and the counted downloads once after their join.
    assert len(moves) <= 15
    # Signups by their key, and downloads by theirs after grouping.
    assert sum(line.startswith("Exchange hashpartitioning(session_id") and "platform" not in line.split(", ")[1] for line in moves) <= 2


def test_user_cells_are_computed_once(spark, tmp_path):
    """The extract counts the cells of signups and joins facts to them: one exchange serves both."""
    stored = stored_tables(spark, tmp_path, random_rows(3))
    for limit in ("-1", "10MB"):
        with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": limit}):
            plan = final_plan(extract.funnel_extract(stored))
        reused = [line for line in plan.splitlines() if "ReusedExchange" in line]
        assert any("hashpartitioning(user_id" in line and "download_dt" in line for line in reused)


def test_only_hot_keys_are_broadcast(spark, skewed):
    """With the size limit off, what is broadcast is a list of 64 keys at most; there is no cross join."""
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        searched = type("Searched", (FunnelTables,), {"hot_rows": 1000})(**dict(skewed.items()))
        plan = extract.funnel_extract(searched)._jdf.queryExecution().executedPlan().toString()
        small = extract.funnel_extract(skewed)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in small and "approx_top_k" not in small
    lines = [line.strip(" :+-") for line in plan.splitlines()]
    sent = [lines[i + 1 : i + 4] for i, line in enumerate(lines) if line.startswith("BroadcastExchange")]
    assert sent and all(any(line.startswith("GlobalLimit 64") for line in below) for below in sent)
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def largest_share(df):
    """The part of a joined frame's rows that one task holds: a row stays in the task that joined it."""
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes) / sum(sizes)


#: Joins sort and merge in as many tasks as stated, and adaptive execution neither merges nor splits them.
PLAIN = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.mark.parametrize("keep", ["many", "few"])
@pytest.mark.parametrize("least", [1, 10**9])
def test_split_join_is_a_left_join(spark, keep, least):
    ids = spark.range(0, 6000, 1, 4)
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 50).when(F.col("id") % 5 > 0, F.col("id"))
    many = ids.select(key.cast("bigint").alias("k"), (F.col("id") % 10).alias("v"))
    few = spark.range(0, 9000, 2).select(F.when(F.col("id") != 8, F.col("id")).alias("k"), F.col("id").alias("w"))
    few = few.unionByName(spark.createDataFrame([(7, -1), (7, -2), (None, -3)], "k long, w long"))
    got = split_join(many, few, "k", keep=keep, least=least)
    want = many.join(few, "k", "left") if keep == "many" else few.join(many, "k", "left")
    assert pairs(got, "k", "v", "w") == pairs(want, "k", "v", "w")
    for none in (many.where("false"), few.where("false")):
        other = (none, few) if none.columns == many.columns else (many, none)
        kept = other[0] if keep == "many" else other[1]
        assert split_join(*other, "k", keep=keep, least=least).count() == kept.count()


def test_hot_session_is_dealt_to_many_tasks(spark, skewed):
    """Without any help of adaptive execution. A third of the signups come from one session."""
    where = homes(skewed.app_downloads)
    with settings(spark, PLAIN):
        plain, split = (placed(people(skewed.signups), where, least=n) for n in (10**9, 1000))
        assert largest_share(plain) > 0.33 and largest_share(split) < 0.12
        assert pairs(cells_of(plain), "user_id", "platform", "copies") == pairs(cells_of(split), "user_id", "platform", "copies")


def test_hot_session_has_few_rows_when_downloads_are_counted(spark, skewed):
    """The join's rows are reduced in its tasks, so that no task reads the session's signups together."""
    where = homes(skewed.app_downloads)
    with settings(spark, PLAIN):
        counts = download_counts(placed(people(skewed.signups), where, least=1000), where)
        plan = counts._jdf.queryExecution().executedPlan().toString()
        lines = [line.strip(" :+-") for line in plan.splitlines()]
        above = [i for i, line in enumerate(lines) if line.startswith("Exchange hashpartitioning(session_id") and "partial_collect_set" in lines[i + 1]]
        assert above and any("SortMergeJoin" in line for line in lines[above[0] :])
        got = counts.agg(F.sum("users"), F.sum("rows")).first()
    # Every key once; the rows of keys by the ages of their signups, one each here.
    assert tuple(got) == (N, N)


def test_ride_repeated_on_both_sides(spark):
    """A third of rides and of payments have one ride id: counts multiply, and no task joins more than its share."""
    ids = spark.range(0, N, 1, 8)
    moment = F.lit("2021-05-01 10:00:00").cast("timestamp_ntz")
    rides = ids.select(hot(F.col("id"), 5).alias("ride_id"), F.col("id").alias("user_id"), moment.alias("request_ts"))
    paid = ids.select(hot(F.col("id") + 60_000, 5).alias("ride_id"), F.lit(2.0).alias("purchase_amount_usd"), F.lit("Approved").alias("charge_status"))
    with settings(spark, PLAIN):
        for least in (1000, 10**9):
            users = payments_per_user(paid, rides, least=least)
            by_user = {r["user_id"]: r["payments"] for r in users.where("user_id IS NULL OR user_id IN (0, 3, 5, 60001, 119999)").collect()}
            # Of users 0 and 3 the ride is the hot one; payments beyond the last ride are under NULL.
            assert by_user == {0: N // 3, 3: N // 3, 5: N // 3, 60_001: 1, 119_999: 1, None: 40_000}
            total = users.agg(F.sum("payments")).first()[0]
            assert total == 40_000 * 40_000 + 40_000 + 40_000 + N // 3
        riders = rides.select("ride_id", "user_id")
        counted = paid.groupBy("ride_id").count()
        assert largest_share(split_join(riders, counted, "ride_id", keep="few", least=10**9)) > 0.25
        assert largest_share(split_join(riders, counted, "ride_id", keep="few", least=1000)) < 0.12
