"""Small funnel tables for tests."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from stepfall.sources import SCHEMAS, FunnelTables, read_files

T0 = dt.datetime(2021, 3, 1, 23, 30)


def at(minutes: int) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def ride(ride_id, user_id, *, accept=False, dropoff=False, cancel=False, pickup=None, driver=None):
    pickup = dropoff if pickup is None else pickup
    return (
        ride_id,
        user_id,
        driver if driver is not None else (7 if accept else None),
        at(0),
        at(3) if accept else None,
        at(10) if pickup else None,
        at(50) if dropoff else None,
        at(5) if cancel else None,
    )


def download(key, platform="ios", minutes=0):
    return (key, platform, at(minutes))


def signup(user_id, session_id=None, age="18-24"):
    return (user_id, user_id if session_id is None else session_id, age)


def paid(ride_id, amount=10.0, status="Approved"):
    return (ride_id, amount, status)


def tables(spark: SparkSession, **rows: list[tuple]) -> FunnelTables:
    return FunnelTables(
        **{name: spark.createDataFrame(rows.get(name, []), schema).coalesce(1) for name, schema in SCHEMAS.items()}
    )


_ARROW_TYPES = {
    "bigint": pa.int64(),
    "string": pa.string(),
    "timestamp_ntz": pa.timestamp("us"),
    "double": pa.float64(),
}


def stored_tables(spark: SparkSession, folder: Path, rows: dict[str, list[tuple]]) -> FunnelTables:
    """The tables as Parquet folders, read back with the library's reader."""
    for name, schema in SCHEMAS.items():
        columns = list(zip(*rows[name])) if rows.get(name) else [[] for _ in schema]
        arrays = [
            pa.array(values, _ARROW_TYPES[f.dataType.simpleString()]) for values, f in zip(columns, schema)
        ]
        (folder / name).mkdir(parents=True)
        pq.write_table(pa.Table.from_arrays(arrays, schema.names), folder / name / "part-0.parquet")
    return read_files(spark, str(folder))


def as_dicts(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]


_DUCK_TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE"}


def duck_tables(rows: dict[str, list[tuple]]) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name, schema in SCHEMAS.items():
        columns = ", ".join(f"{f.name} {_DUCK_TYPES[f.dataType.simpleString()]}" for f in schema)
        con.execute(f"CREATE TABLE {name} ({columns})")
        if rows.get(name):
            marks = ", ".join("?" * len(schema))
            con.executemany(f"INSERT INTO {name} VALUES ({marks})", rows[name])
    return con


def random_rows(seed: int) -> dict[str, list[tuple]]:
    """Tables in poor shape: repeated keys, NULL keys, unmatched keys, one hot user and one hot ride."""
    rng = random.Random(seed)

    def key(top: int, null: float = 0.1):
        if rng.random() < null:
            return None
        return 1 if rng.random() < 0.3 else rng.randint(1, top)

    def maybe(value, chance=0.6):
        return value if rng.random() < chance else None

    def day():
        return at(rng.randint(0, 3) * 720)

    ages = ["18-24", "25-34", "Unknown", None]
    platforms = ["ios", "android", "web", None]
    rides = []
    for _ in range(rng.randint(20, 60)):
        start = rng.randint(0, 5000)
        rides.append(
            (
                key(25),
                key(12),
                maybe(rng.randint(1, 5)),
                maybe(at(start), 0.9),
                maybe(at(start + 3)),
                maybe(at(start + 10)),
                maybe(at(start + rng.randint(11, 90)), 0.5),
                maybe(at(start + 5), 0.3),
            )
        )
    return {
        "app_downloads": [
            (key(15), rng.choice(platforms), maybe(day(), 0.9)) for _ in range(rng.randint(5, 25))
        ],
        "signups": [(key(12), key(15), rng.choice(ages)) for _ in range(rng.randint(5, 20))],
        "ride_requests": rides,
        "transactions": [
            (key(35), rng.randint(100, 9000) / 100, rng.choice(["Approved", "Approved", "Decline", None]))
            for _ in range(rng.randint(10, 40))
        ],
        "reviews": [(key(35), key(15)) for _ in range(rng.randint(5, 30))],
    }
