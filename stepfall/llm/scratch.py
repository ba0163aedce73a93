"""Intermediate tables in the shared folder, and row filters that move few rows.

``settle`` writes a frame below ``spark.checkpoint.dir`` and reads it back: what
follows neither recomputes it nor depends on the executors that made it. The
folder belongs to the cluster; its owner clears ``stepfall-*`` when a run is over.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 64 bits in a row filter. The broadcast side has at most this many rows, whatever the corpus holds.
FILTER_WORDS = 1 << 18
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, for clusters where it is not installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="stepfall-code-")) / "stepfall.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted((root / "stepfall").rglob("*.py")):
                out.write(file, file.relative_to(root))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; in local mode, where neither is set, a new one, which the session keeps."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stepfall-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stepfall-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Characters of a digest at the start of a row key.
_DIGEST = 64


def row_key(id_col: str, *columns: str) -> Column:
    """What tells rows apart where ids may be NULL or repeated: a digest of ``columns``, and the id."""
    parts = [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-")) for c in columns]
    return F.concat(F.sha2(F.concat(*parts), 256), F.coalesce(F.concat(F.lit(":"), F.col(id_col).cast("string")), F.lit("")))


def id_of(key: Column, kind: object) -> Column:
    """The id in a row key, as of type ``kind``."""
    return F.when(F.length(key) > _DIGEST, F.substring(key, _DIGEST + 2, (1 << 31) - 1)).cast(kind)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bit(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_WORDS)), F.expr("shiftleft(1L, cast(_sf_h & 63 as int))")


def maybe_in(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``df`` with ``_sf_maybe``: false only where ``key`` is not in the one column of ``keys``.

    The filter is a bit table of fixed size, so it may be broadcast at any
    corpus size; with very many keys it only lets more rows through.
    """
    word, bit = _bit(F.col(keys.columns[0]))
    table = (
        keys.withColumn("_sf_h", F.xxhash64(keys.columns[0]))
        .groupBy(word.alias("_sf_word"))
        .agg(F.bit_or(bit).alias("_sf_bits"))
    )
    word, bit = _bit(key)
    return (
        df.withColumn("_sf_h", F.xxhash64(key))
        .withColumn("_sf_word", word)
        .join(F.broadcast(table), "_sf_word", "left")
        .withColumn("_sf_maybe", F.coalesce(F.col("_sf_bits").bitwiseAND(bit) != 0, F.lit(False)))
        .drop("_sf_h", "_sf_word", "_sf_bits")
    )


def rows_with(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in the one column of ``keys``; others mostly stay where they are."""
    near = maybe_in(df, F.col(key), keys).where("_sf_maybe").drop("_sf_maybe")
    wanted = keys.select(F.col(keys.columns[0]).alias("_sf_key"))
    return near.join(wanted, F.col(key).eqNullSafe(F.col("_sf_key")), "left_semi")


def rows_without(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in ``keys``; only rows near a key are joined."""
    marked = maybe_in(df, F.col(key), keys)
    unwanted = keys.select(F.col(keys.columns[0]).alias("_sf_key"))
    checked = marked.where("_sf_maybe").join(unwanted, F.col(key).eqNullSafe(F.col("_sf_key")), "left_anti")
    return marked.where("NOT _sf_maybe").unionByName(checked).drop("_sf_maybe")
