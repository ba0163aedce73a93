"""Token totals by source, language and tokenizer, kept up to date by signed deltas.

A batch of events (inserts, deletes, revised texts) becomes ledger rows: plus what a
document counts now, minus what it counted before. The ledger's sums per source,
language and tokenizer are the batch's rollup, and the totals are the sum of all
rollups; texts counted once are not read again.

Every batch has a folder of its own, and a commit mark written last. A batch that
is committed is skipped, one that broke off is written anew, and totals see committed
batches only, so a batch may be sent any number of times.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfall.llm.scratch import rows_with, settle
from stepfall.llm.text import WORD, whole

# Tokenizers by version, as patterns of one token.
TOKENIZERS = {"words-1": WORD, "pieces-1": r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}
KEYS = ("source", "lang", "tokenizer")
INSERT, DELETE, REVISE = "insert", "delete", "revise"


def tokens(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


class TokenLedger:
    """Ledger, rollups and commit marks below one folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, tokenizers: Mapping[str, str] = TOKENIZERS) -> None:
        self.spark, self.folder, self.tokenizers = spark, folder.rstrip("/"), dict(tokenizers)

    def _path(self, part: str, batch: str) -> str:
        return f"{self.folder}/{part}/batch={batch}"

    def is_committed(self, batch: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path('commits', batch)}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def batches(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        names = [status.getPath().getName().removeprefix("batch=") for status in system.listStatus(path)]
        return sorted(name for name in names if self.is_committed(name))

    def _read(self, part: str) -> DataFrame | None:
        paths = [self._path(part, batch) for batch in self.batches()]
        return self.spark.read.option("basePath", f"{self.folder}/{part}").parquet(*paths) if paths else None

    def counted(self, events: DataFrame) -> DataFrame:
        """What each inserted or revised document counts, a row for each tokenizer."""
        text = whole("text")
        counts = F.array(*[F.struct(F.lit(v).alias("tokenizer"), tokens(text, p).alias("tokens")) for v, p in self.tokenizers.items()])
        known = (F.col("op") == INSERT) | (F.col("op") == REVISE) & F.col("doc_id").isNotNull()
        rows = events.where(known).select("doc_id", "source", "lang", F.explode(counts).alias("c"))
        return rows.select("doc_id", *KEYS[:2], "c.tokenizer", "c.tokens", F.lit(1).cast("long").alias("docs"))

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply events ``(doc_id, op, source, lang, text)``; False if the batch was committed before.

        A document's last state is what the ledger sums to; deletes and revisions take
        it back, whichever tokenizers, source or language it was counted under. Deleting
        an unknown id takes back nothing, and revising one inserts it. Rows that share an id count as
        rows of their own; a delete or a revision takes back all of them, so a revising
        batch sends every row that the id has from then on. Events without an id can
        only insert: other ones find nothing and are left out. NULL texts count no tokens.
        """
        if self.is_committed(batch):
            return False
        delta = self.counted(events)
        before = self._read("ledger")
        changed = events.where(F.col("op") != INSERT).where("doc_id IS NOT NULL").select("doc_id").distinct()
        if before is not None:
            known = rows_with(before, "doc_id", changed).groupBy("doc_id", *KEYS)
            known = known.agg((-F.sum("tokens")).alias("tokens"), (-F.sum("docs")).alias("docs")).where("docs <> 0")
            delta = delta.unionByName(known)
        ledger = self._path("ledger", batch)
        delta.write.mode("overwrite").parquet(ledger)
        written = self.spark.read.schema(delta.schema).parquet(ledger)
        rollup = written.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        rollup.write.mode("overwrite").parquet(self._path("rollups", batch))
        self.spark.range(0).write.mode("overwrite").parquet(self._path("commits", batch))
        return True

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens)`` over all committed batches; NULL keys are groups of their own."""
        rollups = self._read("rollups")
        if rollups is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
        sums = rollups.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0")


# Fixed value: marks that the second edition of a text does without.
MARKS = r"[#*$%&|<>]"

ORACLE_SQL = rf"""
WITH d AS (
  SELECT source, lang, CASE WHEN doc_id IS NULL THEN coalesce(text, '') ELSE regexp_replace(coalesce(text, ''), '{MARKS}', '', 'g') END AS body
  FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
), c AS (
  {" UNION ALL ".join(f"SELECT source, lang, '{v}' AS tokenizer, len(regexp_extract_all(body, '{p}')) AS n FROM d" for v, p in TOKENIZERS.items())}
)
SELECT source, lang, tokenizer, count(*) AS docs, sum(n)::BIGINT AS tokens FROM c GROUP BY ALL
"""


def through_three_batches(spark: SparkSession, folder: str, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents come in, ids with marks in a text are revised, those labelled toxic go; one batch is sent twice."""
    ledger = TokenLedger(spark, folder)
    event = lambda op, text, rows=documents: rows.select("doc_id", F.lit(op).alias("op"), "source", "lang", text.alias("text"))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    gone = toxic.select("doc_id", F.lit(DELETE).alias("op"), *[F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text")])
    ids = settle(documents.where(F.col("text").rlike(MARKS) & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "marked")
    marked = event(REVISE, F.regexp_replace(whole("text"), MARKS, ""), rows_with(documents, "doc_id", ids))
    ledger.commit("1-load", event(INSERT, F.col("text")))
    ledger.commit("2-revise", marked)
    ledger.commit("3-delete", gone)
    ledger.commit("2-revise", marked)
    return ledger.totals()
