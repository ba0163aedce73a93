"""A mix of sources at target weights, cut to each source's word budget.

Documents get a hash-random key. The keys are uniform, so equal ranges of key
values split a source into parts of nearly equal size: a part is one range of the
sort within the source. Prefix sums have two levels, of the parts' totals within a
source and of the documents within a part, so that no task holds a source. The
budget is filled with whole epochs first; the last epoch takes documents in key
order and cuts the one in which the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfall.llm.scratch import settle
from stepfall.llm.text import SPACES, WORD, whole, word_count

#: Weights by rank of the source (code point order, NULL last), repeated.
WEIGHTS = (1, 2, 3)
#: A source is repeated this often at most.
MAX_EPOCHS = 3
#: Documents meant to be in one part of a source.
PART_ROWS = 4096
#: Copies of one row at a cut that one task writes.
COPIES = 4096
SEED = "mix"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, n, source_size, target)`` from one row per source with ``n`` and ``source_size``.

    A source gets ``level * weight`` words, or ``max_epochs`` times its size if
    that is less. Sources in the order of cap / weight reach their cap first, so
    the level follows from sums over that order. The windows run over sources, of
    which a task can hold many millions.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rank = F.row_number().over(by_name) - 1
    weighted = (
        sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), rank % len(weights)).cast("long"))
        .withColumn("cap", max_epochs * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    before = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    levelled = weighted.withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    # The level of the first source below its cap holds for all that follow; levels computed further on are lower.
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped") | final.isNull(), F.col("cap").cast("double")).otherwise(final * F.col("weight"))
    return levelled.select("source", "n", "source_size", target.alias("target"))


def _key(id_col: str, text_col: str) -> Column:
    """Random by id and text, so that rows without an id, or with one that repeats, spread like others."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{SEED}:"), name, F.lit(":"), F.md5(whole(text_col))))


def _in_order(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Rows without text, with their source's ``epochs`` and the words ``left`` of its last epoch when they are reached.

    Rows of one source, id and text that one task reads are one row here, with their number as ``copies``.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
        _key(id_col, text_col).alias("key"),
        F.spark_partition_id().alias("task"),
    )
    sized = settle(rows.groupBy("source", "key", "doc_id", "size", "task").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    budgets = (
        targets(totals, weights, max_epochs)
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("parts", F.ceil(F.col("n") / part_rows))
    )
    budgets = settle(budgets.withColumnRenamed("source", "source_"), "budgets")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    parted = sized.join(budgets, F.col("source").eqNullSafe(F.col("source_"))).withColumn(
        "part", F.floor(place * F.col("parts") / F.lit(1 << 32)).cast("long")
    )
    parted = settle(parted.select("doc_id", "source", "size", "copies", "task", "key", "part", "source_size", "target", "epochs", "rest"), "parts")
    words = F.col("size") * F.col("copies")
    sums = parted.groupBy("source", "part").agg(F.sum(words).alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(
        sums.select(
            F.col("source").alias("source_"),
            F.col("part").alias("part_"),
            F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("offset"),
        ),
        "offsets",
    )
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "task").rowsBetween(Window.unboundedPreceding, -1)
    ranked = parted.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    placed = ranked.join(offsets, F.col("source").eqNullSafe(F.col("source_")) & (F.col("part") == F.col("part_")))
    left = F.greatest(F.lit(0), F.col("rest") - F.col("offset") - F.col("inside"))
    return placed.select("doc_id", "source", "key", "size", "copies", "source_size", "target", "epochs", left.cast("long").alias("left"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row; ``taken`` counts repeats.

    Sources without a name are one source, last in order. NULL and empty texts
    have size 0 and nothing taken. Rows that repeat, or have no id, are taken as rows
    of their own. An empty table gives no rows; other
    columns are not looked at. The same rows always give the same mix. ``options``:
    ``weights``, ``max_epochs``, ``part_rows``.
    """
    order = _in_order(docs, id_col, text_col, source_col, **options)
    copy = order.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("copy") * F.col("size")))
    taken = F.col("epochs") * F.col("size") + rest
    return copy.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object
) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last time cut to the words taken.

    A source's cut is one place in its order, so documents are told by their key and
    texts do not move. Where several rows of one id and text stand at the cut, as many of them
    are taken as the budget asks for; if other columns differ, those of the least row. Rows
    without words are never taken; an empty table gives no rows.
    """
    order = _in_order(docs, id_col, text_col, source_col, **options)
    last = F.max(F.when(F.col("left") > 0, F.struct("key", "left"))).alias("_sf_cut")
    cuts = order.groupBy(F.col("source").alias("_sf_source")).agg(F.first("epochs").alias("_sf_epochs"), last)
    cuts = settle(cuts, "cuts")
    keyed = docs.join(cuts, F.col(source_col).eqNullSafe(F.col("_sf_source"))).withColumn("_sf_key", _key(id_col, text_col))
    rest = F.when(F.col("_sf_key") < F.col("_sf_cut.key"), 1).otherwise(0)
    times = (F.col("_sf_epochs") + rest).cast("int")
    some = keyed.where((times > 0) & F.col(text_col).rlike(WORD))
    taken = some.withColumn("_sf_time", F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
    # At the cut: what is left for a row and those equal to it, as whole texts and the beginning of one more.
    there = keyed.where(F.col("_sf_key") == F.col("_sf_cut.key")).withColumn("_sf_size", word_count(text_col)).where("_sf_size > 0")
    least = F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_sf_row")
    one = there.groupBy("_sf_source", "_sf_size", "_sf_cut.left").agg(least, F.count(F.lit(1)).alias("copies"))
    one = one.withColumn("words", F.least(F.col("copies") * F.col("_sf_size"), "left"))
    # Copies are told apart in blocks, so that many of them do not come out of one task.
    blocks = one.withColumn("_sf_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.col("_sf_size") / COPIES))))
    blocks = blocks.repartition("_sf_source", "_sf_block")
    first = F.col("_sf_block") * COPIES * F.col("_sf_size")
    here = F.least(F.col("words") - first, COPIES * F.col("_sf_size"))
    starts = F.sequence(F.lit(0).cast("long"), here - 1, F.col("_sf_size"))
    cut = blocks.select("_sf_row", "_sf_size", here.alias("here"), F.explode(starts).alias("start"))
    cut = cut.select("_sf_row.*", "_sf_size", F.least(F.col("here") - F.col("start"), "_sf_size").alias("_sf_words"))
    parts = F.regexp_extract_all(F.col(text_col), F.lit(f"(?:{SPACES})?{WORD}"), F.lit(0))
    short = F.array_join(F.slice(parts, F.lit(1), F.col("_sf_words").cast("int")), "")
    text = F.when(F.col("_sf_words") >= F.col("_sf_size"), F.col(text_col)).otherwise(short)
    return taken.unionByName(cut.withColumn(text_col, text).select(*docs.columns))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(WEIGHTS)} AS weight,
         {MAX_EPOCHS} * source_size AS cap, (SELECT sum(size) FROM d)::BIGINT AS total
  FROM s
), levels AS (
  -- The level is right when the sources it caps are those it was computed for.
  SELECT max(level) AS level FROM (
    SELECT a.cap / a.weight AS edge,
           (any_value(a.total) - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0))
           / sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS level
    FROM r a, r b GROUP BY a.source, a.cap, a.weight)
  WHERE level < edge
), b AS (
  SELECT source, source_size, CASE WHEN cap / weight > level THEN level * weight ELSE cap END::DOUBLE AS target
  FROM r, levels
), e AS (
  SELECT *, floor(round(target) / source_size)::BIGINT AS epochs,
         round(target)::BIGINT - floor(round(target) / source_size)::BIGINT * source_size AS rest
  FROM b
), p AS (
  SELECT d.*, source_size, target, epochs, rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM p
"""
