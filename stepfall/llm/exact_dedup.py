"""Exact duplicates by exchanging Golomb-coded fingerprints.

1. Each partition of the input is a chunk. A chunk sorts the distinct
   fingerprints of its texts and sends each owner (a range of fingerprint values)
   the Golomb code of that owner's part.
2. An owner decodes, finds the fingerprints that more than one chunk holds, and
   returns a bitmap to every chunk that sent it a code.
3. A chunk reads its bitmaps; rows whose fingerprint is marked, or repeats inside
   the chunk, are suspects. Only the texts of suspects are shuffled and compared.

Fingerprints have ten bits more than the row count needs, so about one row in a
thousand is a suspect for nothing. A text that a third of all rows share is one
fingerprint per chunk in step 2 and one text per task (partial aggregation) in step 3.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfall.llm import golomb
from stepfall.llm.scratch import maybe_in, rows_with, settle, shuffle_partitions
from stepfall.llm.text import one_spaced

#: Fingerprints that one owner is meant to hold.
ROWS_PER_OWNER = 1 << 20
SPARE_BITS = 10


def _row_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).alias("doc_id"), one_spaced(text_col).alias("text"))
    return text.select(
        "doc_id",
        F.sha2("text", 256).alias("sha"),
        F.xxhash64("text").alias("print"),
        F.spark_partition_id().alias("chunk"),
        F.monotonically_increasing_id().alias("row"),
    )


def _prints(frame: pd.DataFrame, bits: int) -> np.ndarray:
    return frame["print"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits)


def suspects(rows: DataFrame, id_cols: list[str], owner_rows: int = ROWS_PER_OWNER) -> DataFrame:
    """The ``id_cols`` of rows whose ``print`` (a 64-bit hash) another row may share. Needs ``chunk``."""
    spark, n = rows.sparkSession, rows.count()
    bits = min(63, n.bit_length() + SPARE_BITS)
    owners_wanted = max(shuffle_partitions(spark), n // owner_rows)
    owner_bits = min(bits, max(1, (owners_wanted - 1).bit_length()))
    low_bits = bits - owner_bits

    def send(chunk: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(_prints(chunk, bits))
        owners = (values >> np.uint64(low_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        parts = np.split(values, cuts[1:])
        codes = [golomb.encode(v, int(owners[at]) << low_bits) for at, v in zip(cuts, parts, strict=True)]
        return pd.DataFrame({"owner": owners[cuts], "chunk": int(chunk["chunk"].iloc[0]), "code": codes})

    def answer(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
        base = int(key[0]) << low_bits
        lists = [golomb.decode(code, base) for code in sent["code"]]
        values, where, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        shared = (counts > 1)[where]
        maps = [np.packbits(m).tobytes() for m in np.split(shared, np.cumsum([len(v) for v in lists])[:-1])]
        return pd.DataFrame({"owner": key[0], "chunk": sent["chunk"], "shared": maps})

    def mark(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        values, where, counts = np.unique(_prints(chunk, bits), return_inverse=True, return_counts=True)
        flags = counts > 1
        owners = (values >> np.uint64(low_bits)).astype(np.int64)
        for owner, bitmap in zip(answers["owner"], answers["shared"], strict=True):
            lo, hi = np.searchsorted(owners, [owner, owner + 1])
            flags[lo:hi] |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=hi - lo).astype(bool)
        return chunk.loc[flags[where], id_cols]

    slim = rows.select("chunk", "print")
    codes = slim.groupBy("chunk").applyInPandas(send, "owner long, chunk int, code binary")
    answers = codes.groupBy("owner").applyInPandas(answer, "owner long, chunk int, shared binary")
    kept = rows.select("chunk", "print", *id_cols)
    schema = rows.select(*id_cols).schema
    return kept.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(mark, schema)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows (without text), and the classes of two or more equal texts, verified byte by byte."""
    rows = settle(_row_chunks(docs, id_col, text_col), "rows")
    found = settle(suspects(rows, ["doc_id", "row", "sha"]), "suspects")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nominated = found.groupBy("sha").agg(first, F.count(F.lit(1)).alias("size"))
    texts = rows_with(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", found.select("doc_id").distinct()
    ).select(one_spaced("text").alias("text"))
    # Grouping by the text itself compares bytes; copies of a text meet in the map tasks first.
    compared = texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    verified = (
        compared.select(F.sha2("text", 256).alias("sha"), "copies")
        .join(nominated, "sha")
        .select(
            "sha",
            F.col("first.doc_id").alias("keep_id"),
            F.col("first.row").alias("keep_row"),
            F.when(F.col("size") == F.col("copies"), F.col("size"))
            .otherwise(F.raise_error(F.lit("texts and fingerprints disagree")).cast("long"))
            .alias("group_size"),
        )
    )
    return rows, settle(verified, "classes")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    Texts are equal when identical after each run of ASCII white space became one
    space; NULL counts as empty, and empty texts are copies of each other. The row
    with the smallest id stays (NULL ids come last; of rows that repeat both id and
    text, one). An empty table gives no rows; other columns are not looked at.
    """
    rows, classes = _classes(docs, id_col, text_col)
    return rows.join(classes, "sha", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of equal texts. Rows that are no copies do not move."""
    rows, classes = _classes(docs, id_col, text_col)
    copies = settle(rows.join(classes, "sha").select("sha", "doc_id", "row", "keep_row"), "copies")
    pairs = copies.groupBy("sha", "doc_id").agg(F.max(F.col("row") == F.col("keep_row")).alias("stays"))
    sha = F.sha2(one_spaced(text_col), 256)
    marked = maybe_in(docs, sha, classes.select("sha")).withColumn("_sf_sha", sha)
    known = pairs.select(F.col("sha").alias("_sf_key"), F.col("doc_id").alias("_sf_id"), "stays")
    near = (
        marked.where("_sf_maybe")
        .join(known, (F.col("_sf_sha") == F.col("_sf_key")) & F.col(id_col).eqNullSafe(F.col("_sf_id")), "left")
        .where("stays IS NULL OR stays")
        .dropDuplicates([id_col, "_sf_sha"])
    )
    return marked.where("NOT _sf_maybe").select(*docs.columns).unionByName(near.select(*docs.columns))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""
