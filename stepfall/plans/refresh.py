"""The extract, kept up to date: each batch of new rows is reduced once, and the extract adds up what is left.

A batch holds the rows that are new in any of the five tables: a day's, for example. ``absorb``
reduces them to counts per key and writes these as the batch's part of the state; rows of earlier batches are not
read again. Counts add up over batches, so ``extract`` needs the parts only. A payment and its
ride may come in any order and in different batches: a batch books the payments that it
brings and those that its rides explain, and takes back what was booked without a rider.

A batch counts once its commit is written, which comes last. Parts without a commit are not read; a batch
that is there already is left alone, so a failed or repeated run does no harm. ``compact``
puts all parts together as one batch, which replaces them by a single commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfall.operators.activity import payments_per_ride, reviews_per_user, rides_per_user, stack_facts
from stepfall.operators.grain import attach, cells_of, download_counts, homes, people, placed
from stepfall.operators.skew import split_join
from stepfall.plans.extract import cell_steps, dashboard, marks_per_cell, signup_counts
from stepfall.sources.tables import TableSet

COMMITS = "commits"


@dataclass(frozen=True)
class Reduced:
    """The five tables as counts per key, which add up over batches."""

    homes: DataFrame  # session_id, platform, download_dt, m
    people: DataFrame  # user_id, session_id, age_range, m
    rides: DataFrame  # user_id, requests, accepted, completed
    riders: DataFrame  # ride_id, user_id, m
    paid: DataFrame  # ride_id, n
    payments: DataFrame  # user_id, payments: may be negative, under NULL
    reviews: DataFrame  # user_id, reviews

    def items(self) -> Iterable[tuple[str, DataFrame]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]


#: Of each part, the columns that are counts; the others are its key.
COUNTS = {
    "homes": ("m",),
    "people": ("m",),
    "rides": ("requests", "accepted", "completed"),
    "riders": ("m",),
    "paid": ("n",),
    "payments": ("payments",),
    "reviews": ("reviews",),
}


def added_up(part: str, df: DataFrame) -> DataFrame:
    keys = [c for c in df.columns if c not in COUNTS[part]]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS[part]])


def booked(paid: DataFrame, riders: DataFrame) -> DataFrame:
    """``(user_id, payments)``: payments by the users of their rides; without a ride, under NULL."""
    matched = split_join(riders, paid, "ride_id", keep="few")
    return matched.groupBy("user_id").agg(F.sum(F.col("n") * F.coalesce("m", F.lit(1))).alias("payments"))


def late_rides(paid: DataFrame, before: DataFrame, new: DataFrame) -> DataFrame:
    """``(user_id, payments)`` that new rides add to payments made before them, and what they take from NULL."""
    charged = paid.join(new.select("ride_id").distinct(), "ride_id", "left_semi")
    gains = split_join(new, charged, "ride_id", keep="few").select("user_id", (F.col("n") * F.col("m")).alias("payments"))
    unknown = charged.join(before, "ride_id", "left_anti").select(F.lit(None).cast(new.schema["user_id"].dataType).alias("user_id"), (-F.col("n")).alias("payments"))
    return gains.unionByName(unknown).groupBy("user_id").agg(F.sum("payments").alias("payments"))


def reduced(t: TableSet, earlier: Reduced | None = None) -> Reduced:
    """A batch as counts. ``earlier`` is the state before it; without one, the batch is the first."""
    riders = t.ride_requests.groupBy("ride_id", "user_id").agg(F.count(F.lit(1)).alias("m"))
    paid = payments_per_ride(t.transactions)
    if earlier is None:
        payments = booked(paid, riders)
    else:
        payments = booked(paid, earlier.riders.unionByName(riders)).unionByName(late_rides(earlier.paid, earlier.riders, riders))
    return Reduced(
        homes=homes(t.app_downloads),
        people=people(t.signups).groupBy("user_id", "session_id", "age_range").agg(F.count(F.lit(1)).alias("m")),
        rides=rides_per_user(t.ride_requests),
        riders=riders,
        paid=paid,
        payments=added_up("payments", payments),
        reviews=reviews_per_user(t.reviews),
    )


def _commits(spark: SparkSession, root: str) -> list[tuple[str, list[str]]]:
    """Every committed batch and the batches it replaces: a row per batch since the last compaction."""
    try:
        rows = spark.read.schema("batch string, replaces array<string>").parquet(f"{root}/{COMMITS}/*").collect()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return []
    return [(r.batch, list(r.replaces)) for r in rows]


def batches(spark: SparkSession, root: str) -> tuple[list[str], set[str]]:
    """The batches to read, and all that were ever absorbed."""
    root = root.rstrip("/")
    found = _commits(spark, root)
    gone = {b for _, replaces in found for b in replaces}
    return sorted(b for b, _ in found if b not in gone), {b for b, _ in found}


def _folder(root: str, part: str, batch: str) -> str:
    return f"{root}/{part}/batch={batch}"


def _write(root: str, batch: str, parts: Reduced, replaces: list[str]) -> None:
    for part, df in parts.items():
        df.write.mode("overwrite").parquet(_folder(root, part, batch))
    spark = parts.homes.sparkSession
    commit = spark.createDataFrame([(batch, replaces)], "batch string, replaces array<string>").coalesce(1)
    commit.write.mode("overwrite").parquet(f"{root}/{COMMITS}/{batch}")


def state(spark: SparkSession, root: str) -> Reduced | None:
    """All committed parts, one under the other; ``None`` before the first batch."""
    root = root.rstrip("/")
    live, _ = batches(spark, root)
    if not live:
        return None
    return Reduced(**{part: spark.read.parquet(*[_folder(root, part, b) for b in live]) for part in COUNTS})


def absorb(spark: SparkSession, root: str, batch: str, new: TableSet) -> bool:
    """Take a batch of new rows into the state below ``root``; false if it is there already.

    ``batch`` names it, in letters, digits and ``-_``. Batches are absorbed one at a time, in any order of
    days. Reads the batch's rows and, to match payments with rides, ride ids and users of the state.
    """
    if not batch.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"a batch is named in letters, digits, - and _, not {batch!r}")
    root = root.rstrip("/")
    if batch in batches(spark, root)[1]:
        return False
    _write(root, batch, reduced(new, state(spark, root)), [])
    return True


def compact(spark: SparkSession, root: str) -> str | None:
    """Put all parts together as one; the old ones are no longer read and may be removed. The new batch's name."""
    root = root.rstrip("/")
    live, _ = batches(spark, root)
    now = state(spark, root)
    if now is None or len(live) < 2:
        return None
    batch = f"compact-{uuid.uuid4().hex}"
    _write(root, batch, Reduced(**{part: added_up(part, df) for part, df in now.items()}), live)
    return batch


def extract_of(now: Reduced) -> DataFrame:
    """``funnel_extract`` of the rows that went into ``now``."""
    whole = {part: added_up(part, df) for part, df in now.items() if part not in ("riders", "paid")}
    who = whole["people"].withColumnRenamed("m", "times")
    found = placed(who, whole["homes"])
    cells = cells_of(found, times=F.col("times"))
    facts = stack_facts(whole["rides"], whole["payments"].where("payments > 0"), whole["reviews"])
    marks = marks_per_cell(attach(facts, cells))
    return dashboard(cell_steps(download_counts(found, whole["homes"]), signup_counts(cells), marks))


def extract(spark: SparkSession, root: str) -> DataFrame:
    """The dashboard extract of all batches absorbed below ``root``."""
    now = state(spark, root.rstrip("/"))
    if now is None:
        raise ValueError(f"no batch has been absorbed below {root}")
    return extract_of(now)


def by_day(t: TableSet, days: int) -> list[TableSet]:
    """The rows of ``t`` in ``days`` batches: rides and downloads by their date, the others by a hash of their rows."""
    from stepfall.sources.tables import SCHEMAS, FunnelTables

    dated = {"app_downloads": "download_ts", "ride_requests": "request_ts"}

    def part(name: str, df: DataFrame, day: int) -> DataFrame:
        number = F.datediff(F.col(dated[name]).cast("date"), F.lit("1970-01-01")) if name in dated else F.xxhash64(*df.columns)
        return df.where(F.pmod(F.coalesce(number, F.lit(0)), F.lit(days)) == day)

    return [FunnelTables(**{name: part(name, getattr(t, name), day) for name in SCHEMAS}) for day in range(days)]


def absorbed_by_day(t: TableSet, spark: SparkSession, root: str, days: int = 3) -> DataFrame:
    """The extract of ``t``, whose rows come in ``days`` batches; the first ones are put together on the way."""
    for day, rows in enumerate(by_day(t, days)):
        absorb(spark, root, f"day-{day}", rows)
        if day == 1:
            compact(spark, root)
    return extract(spark, root)


