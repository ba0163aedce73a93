"""From raw documents to token ids, in stages that each read what the one before kept.

Language ID drops documents without a language; exact and near copies leave one
document of each group; the mix repeats and cuts sources to their budgets; the last
stage encodes what is left. Every stage but the last returns the columns of
``documents``. Rejected rows are found on slim tables; texts are not shuffled but
for copies and the mix. Ids may be NULL or repeated: verdicts hold for an id with its
text (and what else they rest on), not for all rows of an id. Empty tables give empty
tables, and columns beyond those of ``documents`` are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfall.llm import bpe
from stepfall.llm.exact_dedup import drop_exact_duplicates
from stepfall.llm.language import identify
from stepfall.llm.mixing import mixed_documents
from stepfall.llm.ngram_join import drop_near_duplicates
from stepfall.llm.scratch import row_key, rows_without, settle, ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without a language. Where no row declares one, nothing tells languages apart, and all stay."""
    ship(spark)
    if docs.where(F.col("lang").isNotNull()).isEmpty():
        return docs
    keyed = docs.withColumn("_sf_row", row_key("doc_id", "text", "lang", "source"))
    rejected = settle(identify(keyed, "_sf_row").where(~F.col("kept")).select("doc_id").distinct(), "rejected")
    return rows_without(keyed, "_sf_row", rejected).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the first row of equal texts; NULL texts count as empty, and NULL ids come last."""
    ship(spark)
    return drop_exact_duplicates(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the first row of texts that links connect; rows without words have no links and stay."""
    ship(spark)
    return drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts rows to their source's budget; ``n_chars``, where there is one, is that of the text left."""
    mixed = mixed_documents(docs)
    if "n_chars" not in docs.columns:
        return mixed
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's token count and digests; NULL texts count as empty."""
    ship(spark)
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express near duplicates and token ids; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = settle(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
