"""Changes of grain: flags per key, and the segment cell a user belongs to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.functions import day_of, flag
from stepfall.operators.skew import LEAST, split_join

# The columns of a cell, and the label of a missing age range.
CELL = ("platform", "age_range", "download_dt")
NO_AGE = "Not Specified"


def age_label() -> Column:
    """The stated age range; a missing one gets its own label, apart from 'Unknown'."""
    return F.coalesce(F.col("age_range"), F.lit(NO_AGE)).alias("age_range")


def ever_flags(df: DataFrame, keys: str | Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """One row per key with a 0/1 column per condition: did any of its rows meet it?"""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(*[F.max(flag(c)).alias(name) for name, c in conditions.items()])


def homes(downloads: DataFrame) -> DataFrame:
    """``(session_id, platform, download_dt, m)``: the cells a download key stands in, and with how many rows.

    What joins to downloads then meets each cell of its key once, however often the key repeats.
    """
    return (
        downloads.select(
            F.col("app_download_key").alias("session_id"), "platform", day_of(F.col("download_ts")).alias("download_dt")
        )
        .groupBy("session_id", "platform", "download_dt")
        .agg(F.count(F.lit(1)).alias("m"))
    )


def people(signups: DataFrame) -> DataFrame:
    return signups.select("user_id", "session_id", age_label())


def placed(who: DataFrame, where: DataFrame, least: int | None = LEAST) -> DataFrame:
    """``(session_id, *who, *CELL, m)``: every signup beside the cells of its download, if any (else ``m`` is NULL).

    ``who`` is what ``people`` gives, ``where`` what ``homes`` gives. From ``least`` signups on, sessions that hold
    a large part of them are looked for, and dealt to many tasks; with ``None`` both sides are joined as they lie.
    """
    if least is None:
        return split_join(who, where, "session_id", least=None)
    # The join drops NULL keys on this side. Phrased over ``m``, that filter stays above the
    # aggregate, so a plan that also counts the homes themselves scans and groups them once.
    key = F.when(F.col("m") > 0, F.col("session_id"))
    return split_join(who, where.withColumn("session_id", key), "session_id", least=least)


def cells_of(found: DataFrame, by: Sequence[str] = CELL, times: Column | int = 1) -> DataFrame:
    """``(user_id, *by, copies)`` of what ``placed`` gives; each of its rows counts ``times``."""
    times = times if isinstance(times, Column) else F.lit(times)
    return found.groupBy("user_id", *by).agg(F.sum(F.coalesce("m", F.lit(1)) * times).alias("copies"))


def user_cells(signups: DataFrame, downloads: DataFrame, by: Sequence[str] = CELL, least: int | None = LEAST) -> DataFrame:
    """``(user_id, *by, copies)``: the cells of each user, by the user's signups.

    ``copies`` is how many pairs of signup and download rows put the user there (1 when keys
    are unique), so a later join on ``user_id`` can count as if it had met each one.
    """
    return cells_of(placed(people(signups), homes(downloads), least), by)


def download_counts(found: DataFrame, where: DataFrame) -> DataFrame:
    """``(*CELL, users, rows)``: distinct download keys per cell, and pairs of download row and age.

    The age range is that of the key's signups. Keys with signups come out of ``found``, the join
    that ``cells_of`` reads too; those without are all keys of ``where`` (``homes``) less those found there, so
    neither table moves a second time. What is found is reduced in the tasks of the join
    before it moves: a key with any number of signups has one row per cell and task then.
    """
    cell = ["platform", "download_dt"]
    # Signups without a download go after the aggregate, not before, and ``user_id`` is counted although
    # any count will do: the join then is the same as in ``cells_of``, and one exchange serves both.
    matched = (
        found.groupBy("session_id", *cell)
        .agg(F.max("m").alias("m"), F.collect_set("age_range").alias("ages"), F.count("user_id").alias("signups"))
        .where("m > 0 AND signups >= 0")
    )

    def entry(age: Column, sign: int) -> Column:
        return F.struct(age.alias("age_range"), F.lit(sign).alias("sign"))

    ages = F.concat(F.transform("ages", lambda age: entry(age, 1)), F.array(entry(F.lit(NO_AGE), -1)))
    moved = matched.select(*cell, F.explode(ages).alias("age"), "m").select(
        *cell, "age.age_range", F.col("age.sign").cast("bigint").alias("users"), (F.col("age.sign") * F.col("m")).alias("rows")
    )
    whole = where.select(
        *cell,
        F.lit(NO_AGE).alias("age_range"),
        F.when(F.col("session_id").isNotNull(), 1).otherwise(0).cast("bigint").alias("users"),
        F.col("m").alias("rows"),
    )
    return whole.unionByName(moved).groupBy(*CELL).agg(F.sum("users").alias("users"), F.sum("rows").alias("rows")).where("rows > 0")


def attach(facts: DataFrame, cells: DataFrame, by: Sequence[str] = CELL, in_place: bool = False) -> DataFrame:
    """Add the cells of ``cells_of``, and ``copies``, to facts that carry ``user_id``; ``in_place`` if both are stored by it."""
    # The join drops NULL users on this side. Phrased over ``copies``, that filter stays above the
    # aggregate, and a plan that also counts the cells themselves computes them only once.
    user = F.col("user_id") if in_place else F.when(F.col("copies") > 0, F.col("user_id"))
    joined = facts.join(cells.withColumn("user_id", user), "user_id", "left")
    cell = [age_label() if c == "age_range" else F.col(c) for c in by]
    return joined.select(*facts.columns, *cell, F.coalesce("copies", F.lit(1)).alias("copies"))


def attribute(
    facts: DataFrame, signups: DataFrame, downloads: DataFrame, by: Sequence[str] = CELL
) -> DataFrame:
    """Add the user's cell and ``copies`` to facts that carry ``user_id``.

    Facts without a signup stay, under NULL platform and date. Pass facts already
    reduced to one row per user: the join then moves users, not fact rows.
    """
    return attach(facts, user_cells(signups, downloads, by), by)
