"""Text files with bad records: the good rows as tables, the others with file, record and reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfall.sources.tables import SCHEMAS, FunnelTables, declared

BROKEN = "_broken"
REJECT_COLUMNS = ("table_name", "file", "record", "reason")


def _raw_csv(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """Fields as text, by the header's names; ``BROKEN`` holds lines with too many or too few fields."""
    reader = spark.read.options(**{"header": "true", **options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    names = [c for c in reader.csv(path).columns if c != BROKEN]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, BROKEN)])
    return reader.schema(schema).csv(path)


def _raw_json(spark: SparkSession, path: str, names: list[str], options: dict[str, str]) -> DataFrame:
    """Fields as text; ``BROKEN`` holds lines that are no JSON object."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, BROKEN)])
    settings = {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, settings).alias("r"), F.col("_metadata.file_path").alias("_file")).select("r.*", "_file")


def _wrong(field: T.StructField) -> Column:
    text = F.col(f"`{field.name}`")
    said = F.concat(F.lit(f"{field.name} is no {field.dataType.simpleString()}: "), text)
    return F.when(text.isNotNull() & text.try_cast(field.dataType).isNull(), said)


def read_with_rejects(
    spark: SparkSession, root: str, fmt: str, key_type: str = "bigint", **options: str
) -> tuple[FunnelTables, DataFrame]:
    """``(tables, rejects)`` of ``root/<table>`` in CSV with a header line, or in JSON lines.

    A row is good if its line parses and each field is empty or of the declared type, as in the strict
    ``read_files``; good rows and rejects together are all rows. ``rejects`` has ``table_name``, ``file``,
    ``record`` (the line, or its fields as JSON) and ``reason`` (the first field that does not parse). Both are lazy: a query
    that needs the tables only does not look for rejects.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"{fmt} files carry their own types: read_files takes them")
    frames, rejects = {}, []
    for name in SCHEMAS:
        schema, path = declared(name, key_type), f"{root.rstrip('/')}/{name}"
        if fmt == "csv":
            raw = _raw_csv(spark, path, options)
            missing = [c for c in schema.names if c not in raw.columns]
            if missing:
                raise ValueError(f"table {name} lacks columns {missing}")
            raw = raw.withColumn("_file", F.col("_metadata.file_path"))
        else:
            raw = _raw_json(spark, path, schema.names, options)
        broken = F.when(F.col(BROKEN).isNotNull(), F.lit("the line does not parse"))
        judged = raw.withColumn("_reason", F.coalesce(broken, *[_wrong(f) for f in schema]))
        good = judged.where("_reason IS NULL")
        frames[name] = good.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])
        fields = F.to_json(F.struct(*[F.col(f"`{c}`") for c in schema.names]))
        record = F.coalesce(F.col(BROKEN), fields).alias("record")
        rejects.append(judged.where("_reason IS NOT NULL").select(F.lit(name).alias("table_name"), F.col("_file").alias("file"), record, F.col("_reason").alias("reason")))
    return FunnelTables(**frames), reduce(DataFrame.unionByName, rejects)
