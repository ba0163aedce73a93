"""The five input tables: schemas and readers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfall.operators.grain import user_cells
from stepfall.operators.skew import LEAST


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "app_downloads": _schema(
        app_download_key=T.LongType(),
        platform=T.StringType(),
        download_ts=T.TimestampNTZType(),
    ),
    "signups": _schema(
        user_id=T.LongType(),
        session_id=T.LongType(),
        age_range=T.StringType(),
    ),
    "ride_requests": _schema(
        ride_id=T.LongType(),
        user_id=T.LongType(),
        driver_id=T.LongType(),
        request_ts=T.TimestampNTZType(),
        accept_ts=T.TimestampNTZType(),
        pickup_ts=T.TimestampNTZType(),
        dropoff_ts=T.TimestampNTZType(),
        cancel_ts=T.TimestampNTZType(),
    ),
    "transactions": _schema(
        ride_id=T.LongType(),
        purchase_amount_usd=T.DoubleType(),
        charge_status=T.StringType(),
    ),
    "reviews": _schema(
        ride_id=T.LongType(),
        user_id=T.LongType(),
    ),
}


class TableSet:
    """The inputs every plan takes, as attributes named like the tables."""

    app_downloads: DataFrame
    signups: DataFrame
    ride_requests: DataFrame
    transactions: DataFrame
    reviews: DataFrame

    #: From how many rows on joins look for keys that hold a large part of them; ``None``: never.
    hot_rows: ClassVar[int | None] = LEAST

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        for name in SCHEMAS:
            yield name, getattr(self, name)

    def riders(self) -> DataFrame:
        """``(ride_id, user_id)`` of every ride."""
        return self.ride_requests.select("ride_id", "user_id")

    def cells(self) -> DataFrame:
        """``(user_id, *CELL, copies)`` of every user with a signup."""
        return user_cells(self.signups, self.app_downloads, least=self.hot_rows)


# The keys that jobs join by equality.
KEY_PAIRS = (
    ("signups.session_id", "app_downloads.app_download_key"),
    ("ride_requests.user_id", "signups.user_id"),
    ("reviews.user_id", "signups.user_id"),
    ("transactions.ride_id", "ride_requests.ride_id"),
    ("reviews.ride_id", "ride_requests.ride_id"),
)
KEYS = frozenset(name.split(".")[1] for pair in KEY_PAIRS for name in pair) | {"driver_id"}


@dataclass(frozen=True)
class FunnelTables(TableSet):
    """Tables at hand. Keys may be of any type that joins by equality, alike on both sides of a join."""

    app_downloads: DataFrame
    signups: DataFrame
    ride_requests: DataFrame
    transactions: DataFrame
    reviews: DataFrame

    def __post_init__(self) -> None:
        for name, frame in self.items():
            missing = [c for c in SCHEMAS[name].names if c not in frame.columns]
            if missing:
                raise ValueError(f"table {name} lacks columns {missing}")
        for pair in KEY_PAIRS:
            a, b = (_key_kind(getattr(self, table).schema[column].dataType) for table, column in (x.split(".") for x in pair))
            if a != b:
                raise ValueError(f"{pair[0]} ({a}) and {pair[1]} ({b}) are joined but differ in type")


def _key_kind(kind: T.DataType) -> str:
    """Integers join whatever their width; other types must be the same."""
    return "integer" if isinstance(kind, T.IntegralType) else kind.simpleString()


def declared(name: str, key_type: str) -> T.StructType:
    kind = T.StructType.fromDDL(f"key {key_type}")[0].dataType
    return T.StructType([T.StructField(f.name, kind if f.name in KEYS else f.dataType) for f in SCHEMAS[name]])


def _parsed(table: str, field: T.StructField, strict: bool) -> Column:
    """A text field in its declared type; text that is none of it fails the query, if ``strict``."""
    text = F.col(f"`{field.name}`")
    value = text.try_cast(field.dataType)
    if strict:
        said = F.concat(F.lit(f"{table}.{field.name} is no {field.dataType.simpleString()}: "), text)
        value = F.when(text.isNotNull() & value.isNull(), F.raise_error(said).cast(field.dataType)).otherwise(value)
    return value.alias(field.name)


#: What makes Spark read Parquet and ORC through readers that can answer aggregates from file footers.
_FOOTERS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,text"}
_PUSHED = ("spark.sql.parquet.aggregatePushdown", "spark.sql.orc.aggregatePushdown")


def read_files(
    spark: SparkSession, root: str, fmt: str = "parquet", key_type: str = "bigint", footers: bool = False, **options: str
) -> FunnelTables:
    """Read ``root/<table>`` for each table.

    Parquet and ORC carry their own types, which are kept. Text formats are read
    with the declared types, and keys as ``key_type``; a field that does not parse
    fails the query instead of turning into NULL. CSV files have a header line, as
    ``write_extract`` leaves it, and columns are found by its names; files of one
    table must agree on it. With ``header="false"`` columns go by position. An option
    given here wins over these settings.

    With ``footers``, row counts and the least and greatest numbers and dates of whole Parquet and ORC tables come
    from the files' footers, and no row is read for them; other queries read as ever. This
    switches aggregate push-down on in the session. Text formats have no footers and are read.

    Call ``tune(spark)`` before, or set the session's adaptive execution yourself:
    hot keys count on it.
    """
    if footers and fmt in ("parquet", "orc"):
        before = {key: spark.conf.get(key) for key in _FOOTERS}
        for key, value in (_FOOTERS | dict.fromkeys(_PUSHED, "true")).items():
            spark.conf.set(key, value)
        try:
            return read_files(spark, root, fmt, key_type, **options)
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)
    strict = {"mode": "FAILFAST"} if fmt in ("csv", "json") else {}
    strict |= {"header": "true", "enforceSchema": "false"} if fmt == "csv" else {}
    settings = strict | {k: str(v) for k, v in options.items()}
    by_name = fmt == "csv" and settings["header"].lower() == "true"

    def read(name: str) -> DataFrame:
        reader, schema = spark.read.format(fmt).options(**settings), declared(name, key_type)
        path = f"{root.rstrip('/')}/{name}"
        if not by_name:
            return (reader.schema(schema) if strict else reader).load(path)
        raw = reader.load(path)
        missing = [c for c in schema.names if c not in raw.columns]
        if missing:
            raise ValueError(f"table {name} lacks columns {missing}")
        return raw.select(*[_parsed(name, field, settings["mode"].upper() == "FAILFAST") for field in schema])

    return FunnelTables(**{name: read(name) for name in SCHEMAS})


def read_catalog(spark: SparkSession, database: str | None = None) -> FunnelTables:
    """The tables of a database, or of the session. As with ``read_files``, call ``tune(spark)`` before."""
    prefix = f"{database}." if database else ""
    return FunnelTables(**{name: spark.table(f"{prefix}{name}") for name in SCHEMAS})


def empty_tables(spark: SparkSession) -> FunnelTables:
    return FunnelTables(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})
