"""The registered queries of this folder and their check SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfall.llm import alignment, bpe, chat, exact_dedup, language, mixing, ngram_join, periodic, personal_data, pieces, quality, token_counts, toxicity
from stepfall.llm.scratch import shared_folder, ship
from stepfall.llm.text import words

Job = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select(*quality.COLUMNS)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language ID where markup declares languages and addresses have suffixes."""
    pages = language.page_evidence(_table(spark, sf_dir, "pages"))
    found = language.identify(pages, id_col="page_id", declared_col="declared", address_col="address")
    return found.withColumnRenamed("doc_id", "page_id")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(personal_data.find(_table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/stepfall-{uuid.uuid4().hex}"
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return token_counts.through_three_batches(spark, folder, documents, labels)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.unquoted(_table(spark, sf_dir, "conversations"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a tenth of the documents, chosen by a hash of the id, a stretch is first made to repeat up to the end."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("hash"))
    chosen = documents.withColumn("words", F.when(F.col("hash") % 10 == 0, words("text")))
    repeated = periodic.with_repeated_tail(F.col("words"), F.floor(F.col("hash") / 10))
    text = F.when(F.size("words") > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))
    return periodic.collapsed(chosen.select("doc_id", text.alias("text")))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.measures(_table(spark, sf_dir, "documents"))


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Job] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mixing": op2_source_mixing,
    "op3_ngram_join": op3_ngram_join,
    "op4_language_id": op4_language_id,
    "language_of_pages": language_of_pages,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_personal_data": op6_personal_data,
    "op7_token_counts": op7_token_counts,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_piece_bpe": op13_piece_bpe,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE_SQL,
    "op2_source_mixing": mixing.ORACLE_SQL,
    "op7_token_counts": token_counts.ORACLE_SQL,
    "op8_chat_formatting": chat.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
}
