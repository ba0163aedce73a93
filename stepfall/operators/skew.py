"""Joins in which one key may hold a large part of a side.

Adaptive execution splits a hot key only while nothing later relies on how the join
is partitioned, and only on the preserved side of an outer join. ``split_join`` does not
depend on that: it finds the hot keys, deals their rows to several pieces, and
gives every piece a copy of the other side's few rows for the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from one in ``MOST`` rows on, so that there are at most this many; a smaller table than ``LEAST`` rows has none.
MOST, LEAST = 64, 1_000_000
#: Counters of the sketch that looks for hot keys. Its counts are off by one in about 3,000 rows at most.
COUNTERS = 4096


def hot_keys(df: DataFrame, key: str, most: int = MOST, least: int = LEAST) -> DataFrame:
    """``(key, share)``: keys with at least one in ``most`` rows of ``df``, and their share of the rows.

    One pass that keeps a sketch of fixed size per task and moves nothing else. At most ``most`` rows
    come out, whatever ``df`` holds. Keys close to the limit may or may not be among them. NULL
    is never among them.
    """
    sketch = df.where(F.col(key).isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(`{key}`, {most}, {COUNTERS})").alias("top")
    )
    found = sketch.select("rows", F.inline("top")).where((F.col("count") * most >= F.col("rows")) & (F.col("rows") >= least))
    return found.select(F.col("item").alias(key), (F.col("count") / F.col("rows")).alias("share")).limit(most)


def _is_small(df: DataFrame, least: int) -> bool:
    """By the optimizer's estimate, at eight bytes a row. What it cannot estimate is not small."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 8 * least


def _pieces(share: Column, tasks: int) -> Column:
    """Into how many pieces a hot key goes: eight times its share of the tasks, so that tasks get about as many rows each."""
    return F.when(share > 0, F.ceil(8 * tasks * F.least(share, F.lit(1.0)))).otherwise(1).cast("int")


def split_join(
    many: DataFrame, few: DataFrame, key: str, keep: str = "many", most: int = MOST, least: int | None = LEAST
) -> DataFrame:
    """``many`` and ``few`` joined on ``key``; rows of the ``keep`` side without a partner stay, with NULLs.

    ``many`` may hold any number of rows per key, unlike in columns other than the key; ``few`` should hold few, as a
    hot key's rows there are copied to its pieces. The result is that of a plain left join, with
    ``key`` first. NULL keys of ``many``, which find no partner, are dealt out likewise. With ``least``
    ``None`` it is a plain join, for sides that lie by their key already; so it is, without a search for hot
    keys, where the optimizer takes ``many`` for smaller than ``least`` rows.
    """
    if keep not in ("many", "few"):
        raise ValueError(f"keep is 'many' or 'few', not {keep!r}")
    if least is None or _is_small(many, least):
        return many.join(few, key, "left") if keep == "many" else few.join(many, key, "left")
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(many, key, most, least).withColumnRenamed(key, "_hot"))
    pieces = _pieces(F.col("share"), tasks)
    deal = F.xxhash64(*[F.col(f"`{c}`") for c in many.columns])
    piece = F.when(F.col(key).isNull(), F.pmod(deal, F.lit(tasks))).otherwise(F.pmod(deal, pieces))
    many = many.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_piece", piece.cast("int")).drop("_hot", "share")
    copies = few.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    if keep == "many":
        return many.join(copies.drop("_hot", "share"), [key, "_piece"], "left").drop("_piece")
    # A hot key is there in ``many``, so a piece of it without a partner is one that got no rows.
    joined = copies.drop("share").join(many.withColumn("_met", F.lit(True)), [key, "_piece"], "left")
    return joined.where("_hot IS NULL OR _met").drop("_piece", "_hot", "_met")
