"""Conversations without quotes: what a message quotes is linked to the message it comes from.

Lines that begin with ``>`` are quotes, their level the number of ``>``; consecutive lines
of a level are a passage. Passages and lines are normalised and hashed, and each hash
looks for the latest earlier message of the conversation that says the same in its own
words. Own text counts as a whole, by runs between quotes, and by lines.

The search is an as-of join without pairs: originals and quotes with the same hash are laid
out by turn, and each quote takes the last original before it, first within a block of
turns, then over the blocks. So a line that a conversation repeats without end costs no
more than its number of turns, in blocks of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfall.llm.scratch import rows_with, settle
from stepfall.llm.text import SPACES, whole

#: Turns in one block of the search.
BLOCK_TURNS = 4096
QUOTE = r"^[ \t]*>[ \t>]*"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), SPACES, " "))


def _lines(messages: DataFrame) -> DataFrame:
    """One row per line: ``(row, conv_id, turn, at, level, body, said)``."""
    lines = messages.select("row", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    mark = F.regexp_extract("line", QUOTE, 0)
    body = F.regexp_replace("line", QUOTE, "")
    return lines.select("row", "conv_id", "turn", "at", F.regexp_count(mark, F.lit(">")).alias("level"), body.alias("body")).withColumn(
        "said", _normal(F.col("body"))
    )


def _runs(lines: DataFrame) -> DataFrame:
    """Passages of one level: ``(row, conv_id, turn, level, run, lines, said)``; ``lines`` are the normalised lines with words."""
    by_line = Window.partitionBy("row").orderBy("at")
    first = (F.col("level") != F.coalesce(F.lag("level").over(by_line), F.lit(-1))).cast("int")
    runs = lines.withColumn("first", first).withColumn("run", F.sum("first").over(by_line))
    said = F.when(F.col("said") != "", F.struct("at", "said"))
    grouped = runs.groupBy("row", "conv_id", "turn", "level", "run").agg(F.sort_array(F.collect_list(said)).alias("said"))
    return grouped.withColumn("lines", F.col("said.said")).withColumn("said", F.array_join("lines", " ")).where("said <> ''")


def _units(runs: DataFrame, own: bool) -> DataFrame:
    """Hashes of passages (``part`` 0) and, of passages with several lines, of their lines (1); own text also as a whole."""
    units = F.concat(
        F.array(F.struct(F.lit(0).alias("part"), F.col("said").alias("said"))),
        F.when(F.size("lines") > 1, F.transform("lines", lambda line: F.struct(F.lit(1).alias("part"), line.alias("said")))).otherwise(
            F.array().cast("array<struct<part:int,said:string>>")
        ),
    )
    out = runs.where("level = 0" if own else "level > 0").select("row", "conv_id", "turn", "level", F.explode(units).alias("u"))
    out = out.select("row", "conv_id", "turn", "level", "u.part", "u.said")
    if own:
        wholes = runs.where("level = 0").groupBy("row", "conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("run", "said"))).alias("all"))
        out = out.unionByName(
            wholes.where(F.size("all") > 1).select(
                "row", "conv_id", "turn", F.lit(0).alias("level"), F.lit(0).alias("part"), F.array_join("all.said", " ").alias("said")
            )
        )
    return out.withColumn("hash", F.md5("said")).drop("said")


def _sources(quotes: DataFrame, originals: DataFrame) -> DataFrame:
    """``(conv_id, hash, turn, source)``: the latest turn before ``turn`` whose own text has the hash."""
    keys = ["conv_id", "hash", "turn"]
    wanted = quotes.select(*keys).distinct().withColumn("own", F.lit(None).cast("long")).withColumn("asks", F.lit(True))
    said = originals.select(*keys).distinct().withColumn("own", F.col("turn").cast("long")).withColumn("asks", F.lit(False))
    laid = settle(wanted.unionByName(said).withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS)), "laid")
    # Own text of the same turn comes after the question, so a message does not quote itself.
    inside = Window.partitionBy("conv_id", "hash", "block").orderBy("turn", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    near = laid.withColumn("near", F.max("own").over(inside)).where("asks")
    blocks = laid.groupBy("conv_id", "hash", "block").agg(F.max("own").alias("own"))
    before = Window.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = blocks.select("conv_id", "hash", "block", F.max("own").over(before).alias("far"))
    return near.join(far, ["conv_id", "hash", "block"]).select(*keys, F.coalesce("near", "far").alias("source")).where("source IS NOT NULL")


def _threads(links: DataFrame) -> DataFrame:
    """``(conv_id, turn, thread, depth)`` of linked turns: the first message up the chain, and how far it is."""
    up = settle(links.select("conv_id", "turn", F.col("source").alias("thread"), F.lit(1).cast("long").alias("depth")), "up")
    while True:
        further = up.select(F.col("conv_id"), F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        jumped = up.join(further, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("next").isNotNull().alias("moved"),
        )
        jumped = settle(jumped, "up")
        up = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return up


def unquoted(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, body, message, quoted_lines, deepest, reply_to, thread, depth)`` per message.

    ``reply_to`` is the turn that the message's quotes come from: passages go before
    single lines, low levels before deep ones, late turns before early ones; NULL if
    nothing is found. ``thread`` is the turn the replies lead back to and ``depth`` the
    number of replies. In the order of ``thread``, ``turn`` each message follows the one
    it answers. ``body`` is the text without quotes, ``message`` the same in chat format.

    NULL texts are empty; messages without a conversation or turn are kept and not
    linked; repeated messages are rows of their own with the same links; an empty table
    gives no rows; other columns are not looked at.
    """
    slim = conversations.select("conv_id", "turn", "role", whole("text").alias("text"))
    rows = settle(slim.withColumn("row", F.monotonically_increasing_id()), "messages")
    quoting = rows.where(F.col("text").rlike(rf"(?m){QUOTE}"))
    quoted = settle(_lines(quoting), "quoted")
    keyed = "conv_id IS NOT NULL AND turn IS NOT NULL"
    quotes = settle(_units(_runs(quoted.where(keyed)), own=False), "quotes")
    talks = quotes.select("conv_id").distinct()
    originals = _units(_runs(_lines(rows_with(rows.where(keyed), "conv_id", talks))), own=True)
    found = quotes.join(_sources(quotes, originals), ["conv_id", "hash", "turn"])
    best = F.min(F.struct(F.col("level"), F.col("part"), (-F.col("source")).alias("late")))
    links = settle(found.groupBy("conv_id", "turn").agg((-best["late"]).alias("source")), "links")
    threads = _threads(links).join(links, ["conv_id", "turn"]).withColumnRenamed("conv_id", "conv_").withColumnRenamed("turn", "turn_")
    texts = quoted.groupBy("row").agg(
        F.sum((F.col("level") > 0).cast("int")).cast("long").alias("quoted_lines"),
        F.max("level").cast("long").alias("deepest"),
        F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("at", "body")))).alias("kept"),
    )
    body = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept.body", "\n"))
    return (
        rows.join(texts, "row", "left")
        .join(threads, (F.col("conv_id") == F.col("conv_")) & (F.col("turn") == F.col("turn_")), "left")
        .select(
            "conv_id", "turn", "role",
            F.trim(body).alias("body"),
            F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.trim(body), F.lit("\n<|end|>\n")).alias("message"),
            F.coalesce("quoted_lines", F.lit(0)).cast("long").alias("quoted_lines"),
            F.coalesce("deepest", F.lit(0)).cast("long").alias("deepest"),
            F.col("source").alias("reply_to"),
            F.coalesce("thread", "turn").cast("long").alias("thread"),
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        )
    )


ORACLE_SQL = rf"""
WITH RECURSIVE l AS (
  SELECT c.conv_id, c.turn, g.i AS pos, string_split(coalesce(text, ''), chr(10))[g.i] AS line
  FROM conversations c, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i) g
), p AS (
  SELECT conv_id, turn, pos, len(regexp_extract_all(regexp_extract(line, '{QUOTE}'), '>')) AS level,
         regexp_replace(line, '{QUOTE}', '') AS body
  FROM l
), n AS (
  SELECT *, trim(regexp_replace(lower(body), '{SPACES}', ' ', 'g'), ' ') AS said,
         pos - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY pos) AS run
  FROM p
), runs AS (
  SELECT conv_id, turn, level, min(pos) AS pos, string_agg(said, ' ' ORDER BY pos) AS said, count(*) AS n
  FROM n WHERE said <> '' GROUP BY conv_id, turn, level, run
), units AS (
  SELECT conv_id, turn, level, 0 AS part, said FROM runs
  UNION ALL SELECT n.conv_id, n.turn, n.level, 1, n.said FROM n WHERE said <> ''
  UNION ALL SELECT conv_id, turn, 0, 0, string_agg(said, ' ' ORDER BY pos) FROM runs WHERE level = 0 GROUP BY conv_id, turn
), links AS (
  SELECT conv_id, turn, arg_min(source, (level, part, -source)) AS source FROM (
    SELECT q.conv_id, q.turn, q.level, q.part, o.turn AS source
    FROM units q JOIN units o ON q.conv_id = o.conv_id AND q.said = o.said AND q.level > 0 AND o.level = 0 AND o.turn < q.turn)
  GROUP BY conv_id, turn
), up AS (
  SELECT conv_id, turn, source AS thread, 1 AS depth FROM links
  UNION ALL SELECT u.conv_id, u.turn, k.source, depth + 1 FROM up u JOIN links k ON u.conv_id = k.conv_id AND u.thread = k.turn
), roots AS (
  SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM up GROUP BY conv_id, turn
), texts AS (
  SELECT conv_id, turn, trim(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (level = 0), ''), ' ') AS body,
         count(*) FILTER (level > 0) AS quoted_lines, max(level) AS deepest
  FROM p GROUP BY conv_id, turn
)
SELECT c.conv_id, c.turn, c.role, t.body, '<|' || coalesce(c.role, '') || '|>' || chr(10) || t.body || chr(10) || '<|end|>' || chr(10) AS message,
       t.quoted_lines, t.deepest, k.source AS reply_to, coalesce(r.thread, c.turn) AS thread, coalesce(r.depth, 0)::BIGINT AS depth
FROM conversations c JOIN texts t ON c.conv_id = t.conv_id AND c.turn = t.turn
LEFT JOIN links k ON c.conv_id = k.conv_id AND c.turn = k.turn
LEFT JOIN roots r ON c.conv_id = r.conv_id AND c.turn = r.turn
"""
