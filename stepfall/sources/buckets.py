"""The tables stored by the keys they are joined on, so that joins and counts find them in place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stepfall.sources.tables import SCHEMAS, FunnelTables, TableSet

#: By which key each table is stored. ``riders`` are the rides once more, with their two keys only.
LAYOUT = {
    "app_downloads": "app_download_key",
    "signups": "session_id",
    "ride_requests": "user_id",
    "transactions": "ride_id",
    "reviews": "user_id",
}
RIDERS, CELLS = ("riders", "ride_id"), ("user_cells", "user_id")


@dataclass(frozen=True)
class BucketedTables(FunnelTables):
    """Tables in buckets, with rides by ride as well, and with the cells of users worked out when they were stored.

    Rows of a key lie in one bucket, so hot keys are not dealt out: that would move what
    is in place. Where a key holds a large part of a table, leave it unbucketed.
    """

    stored_riders: DataFrame
    stored_cells: DataFrame

    hot_rows = None

    def riders(self) -> DataFrame:
        return self.stored_riders

    def cells(self) -> DataFrame:
        return self.stored_cells


def write_buckets(t: TableSet, database: str, buckets: int | None = None, root: str | None = None) -> None:
    """Store the tables in ``database``, each key's rows in one of ``buckets`` files, replacing tables of the same names.

    ``buckets`` is by default the number of shuffle partitions: what is stored then lies as a
    shuffle would lay it. ``root`` puts the files below a folder of one's own.
    """
    spark = t.signups.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    frames = {name: (getattr(t, name), key) for name, key in LAYOUT.items()}
    frames[RIDERS[0]] = (t.riders(), RIDERS[1])
    frames[CELLS[0]] = (t.cells(), CELLS[1])
    for name, (frame, key) in frames.items():
        # One task per bucket, and so one file.
        writer = frame.repartition(buckets, key).write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key)
        if root:
            writer = writer.option("path", f"{root.rstrip('/')}/{name}")
        writer.saveAsTable(f"{database}.{name}")


def read_buckets(spark: SparkSession, database: str) -> BucketedTables:
    """The tables that ``write_buckets`` stored."""
    frames = {name: spark.table(f"{database}.{name}") for name in SCHEMAS}
    return BucketedTables(**frames, stored_riders=spark.table(f"{database}.{RIDERS[0]}"), stored_cells=spark.table(f"{database}.{CELLS[0]}"))


