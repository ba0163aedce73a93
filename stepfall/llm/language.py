"""Language of documents from several kinds of evidence, joined by Bayes' rule.

* Text: naive Bayes over hashed byte trigrams, fitted on a bounded sample of
  labelled rows. Trigrams of one text are not independent, so their mean counts as
  ``TEXT_WEIGHT`` trigrams at most.
* Declared language (markup, headers, metadata): how often each language is declared
  as each value, counted over all rows.
* Address: the share of each language on the host, shrunk towards its address suffix,
  which is shrunk towards the whole corpus. Rows count with their text posterior.

Languages beyond the text table are one class. Its rows are named by what they declare,
else by what most of such rows on their host declare.

Counts are grouped aggregations over every row. A host with a third of all rows is
summed in the map tasks; host rows join back to documents without their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.llm.scratch import settle
from stepfall.llm.text import whole

#: Labelled rows the text model is fitted on, about; the labels with a column of their own; its hash range.
SAMPLE_ROWS = 20_000
MAX_LANGUAGES = 64
BUCKETS = 1 << 15
TEXT_WEIGHT = 60.0
#: Rows that a prior counts as when it smooths the level below.
PRIOR_ROWS = 20.0
#: Chance that a declaration says nothing.
DECLARED_NOISE = 0.05
MIN_TRIGRAMS, MIN_PROBABILITY = 1, 0.5
UNKNOWN = "und"
#: The class of all languages that are not in the text table.
OTHER = "(other)"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)]
_BLOCK = 1 << 20


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the trigrams that hold a letter, in blocks; anything else in ASCII is a blank."""
    raw = _FOLD[np.frombuffer(b" " + text.encode("utf-8", "replace") + b" ", np.uint8)]
    for at in range(0, max(0, len(raw) - 2), _BLOCK):
        part = raw[at : at + _BLOCK + 2]
        code = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
        blank = (part[:-2] == 32).astype(np.uint8) + (part[1:-1] == 32) + (part[2:] == 32)
        yield (code[blank < 3] * np.uint32(0x9E3779B1)) >> np.uint32(17)


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages as rows for ``identify``: ``(page_id, text, declared, address)``."""
    body = F.regexp_replace(whole("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    declared = F.nullif(F.regexp_extract(whole("html"), r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1), F.lit(""))
    return pages.select("page_id", body.alias("text"), F.lower(declared).alias("declared"), F.col("url").alias("address"))


def _host(address: Column) -> Column:
    host = F.regexp_extract(F.lower(address), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.nullif(host, F.lit(""))


def _suffix(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1), F.lit(""))


def _sample(labelled: DataFrame, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` of ``(key, text, label, hash)``, with the class a label is fitted in as ``label``.

    Labels are counted over all rows. Those with most rows are classes of their own, the others one class, ``OTHER``.
    Classes share the sample evenly; what small ones leave goes to the larger ones. Each has one row at least.
    """
    counts = settle(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("least")), "labels")
    top = counts.where(F.col("label") != OTHER).orderBy(F.desc("n"), "label").limit(MAX_LANGUAGES).select("label").collect()
    named = F.when(F.col("label").isin([r.label for r in top]), F.col("label")).otherwise(F.lit(OTHER)).alias("label")
    sizes = counts.groupBy(named).agg(F.sum("n").alias("n"), F.min("least").alias("least")).orderBy("n", "label").collect()
    left, limit = sample_rows, F.lit(-1)
    for i, (label, n, least) in enumerate(sizes):
        quota = min(n, left / (len(sizes) - i))
        left -= quota
        limit = F.when(F.col("label") == label, max(least, int(quota / n * (1 << 32)) - 1)).otherwise(limit)
    return labelled.select("key", "text", named, "hash").where(F.col("hash") <= limit).drop("hash")


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Labels and the log probability of each bucket under each, from rows of ``key``, ``text`` and ``label``.

    Labels beyond the ``MAX_LANGUAGES`` with most rows share the last one, ``OTHER``.
    Rows are sampled by the hash of key and text, about as many of each class. Only bucket
    counts reach the driver, of known size at most.
    """
    labelled = rows.where("label IS NOT NULL").withColumn("hash", F.xxhash64("key", "text").bitwiseAND((1 << 32) - 1))
    sample = _sample(labelled, sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = sums.setdefault(label, np.zeros(BUCKETS, np.int64))
                for buckets in trigrams(text):
                    own += np.bincount(buckets, minlength=BUCKETS)
        for label, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"label": [label] * len(at), "bucket": at.astype(np.int32), "n": own[at]})

    counted = sample.select("label", "text").mapInArrow(count, "label string, bucket int, n long")
    counted = settle(counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")), "counts")
    labels = sorted(r.label for r in counted.select("label").distinct().collect())
    if OTHER in labels:
        labels = [*(label for label in labels if label != OTHER), OTHER]
    table = np.ones((BUCKETS, len(labels)))
    for label, bucket, n in counted.toPandas().itertuples(index=False):
        table[bucket, labels.index(label)] += n
    table = np.log(table / table.sum(axis=0))
    if len(labels) > 1 and labels[-1] == OTHER:
        table[:, -1] += _handicap(sample, labels, table)
    return labels, table


def _handicap(sample: DataFrame, labels: list[str], table: np.ndarray) -> float:
    """What ``OTHER`` gets per trigram: many languages in one class fit each of its texts worse than a language its own.

    Midway between what the best known language is ahead by on known and on other texts of the sample.
    """
    scored = _scored(sample.withColumn("other", F.col("label") == OTHER), table).where(F.col("trigrams") >= MIN_TRIGRAMS)
    best = F.array_max(F.slice("likely", 1, len(labels) - 1))
    ahead = (best - F.get("likely", len(labels) - 1)) / F.least(F.col("trigrams").cast("double"), F.lit(TEXT_WEIGHT))
    means = [r.ahead for r in scored.groupBy("other").agg(F.avg(ahead).alias("ahead")).collect()]
    return sum(means) / len(means)


def _scored(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """Rows without their text: the number of trigrams and the text's log likelihoods."""
    weights = rows.sparkSession.sparkContext.broadcast(table.astype(np.float32))
    keep = [f for f in rows.schema.fields if f.name not in ("text", "label")]
    names = [f.name for f in keep]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.value
        for batch in batches:
            sizes, likely = [], []
            for text in batch["text"]:
                n, total = 0, np.zeros(known.shape[1])
                for buckets in trigrams(text.as_py()):
                    n += len(buckets)
                    total += known[buckets].sum(axis=0, dtype=np.float64)
                sizes.append(n)
                likely.append((total * (min(n, TEXT_WEIGHT) / max(1, n))).tolist())
            columns = [*(batch[name] for name in names), pa.array(sizes, pa.int64()), pa.array(likely, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "trigrams", "likely"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return rows.select(*names, "text").mapInArrow(score, f"{kinds}, trigrams long, likely array<double>")


def _softmax(logs: Column) -> Column:
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def _shares(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    sums = [F.sum(F.get("share", i)).alias(f"s{i}") for i in range(size)]
    return df.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"s{i}" for i in range(size)]).alias("share"))


def _shrunk(counts: Column, prior: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(counts, prior, lambda n, p: (n + PRIOR_ROWS * p) / (total + PRIOR_ROWS))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", address_col: str = "source",
    model: tuple[list[str], np.ndarray] | None = None, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``(doc_id, detected, probability, trigrams, kept)`` for every row.

    Without a ``model`` the text model is fitted here, with the declared languages as
    labels. Texts without a letter (NULL and empty ones too),
    or without a language of probability 0.5, get ``und`` and are not kept. A NULL
    declaration is no evidence; rows without an address share the corpus prior. Repeated
    rows count each time. A row found to be in none of the languages of the text table has
    the language it declares, or that most such rows of its host declare, or ``und``. Without any label everything is ``und``. An empty table gives
    no rows; other columns are not looked at.
    """
    host = _host(F.col(address_col))
    rows = docs.select(
        F.col(id_col).alias("key"),
        whole(text_col).alias("text"),
        F.lower(F.col(declared_col)).alias("declared"),
        host.alias("host"),
        _suffix(host).alias("suffix"),
    )
    labels, table = model or fit(rows.withColumn("label", F.col("declared")), sample_rows)
    if not labels:
        return rows.select(F.col("key").alias("doc_id"), F.lit(UNKNOWN).alias("detected"), F.lit(0.0).alias("probability"),
                           F.lit(0).cast("long").alias("trigrams"), F.lit(False).alias("kept"))
    size = len(labels)
    scored = settle(_scored(rows, table), "scored")
    if labels[-1] == OTHER:
        # Declarations of languages without a column are evidence for their class.
        beyond = F.when(~F.col("declared").isin(labels[:-1]), F.col("declared"))
        scored = scored.withColumn("beyond", beyond).withColumn("declared", F.when(beyond.isNotNull(), OTHER).otherwise(F.col("declared")))
    else:
        scored = scored.withColumn("beyond", F.lit(None).cast("string"))
    shares = scored.where(F.col("trigrams") >= MIN_TRIGRAMS).withColumn("share", _softmax(F.col("likely")))

    counts = settle(_shares(shares, ["host", "suffix", "declared"], size), "counts")
    # At most MAX_LANGUAGES sums reach the driver.
    sums = counts.agg(*[F.coalesce(F.sum(F.get("share", i)), F.lit(0.0)).alias(f"s{i}") for i in range(size)]).first()
    spoken = F.array(*[F.lit(float(n)) for n in sums])
    world = F.array(*[F.lit((n + PRIOR_ROWS / size) / (sum(sums) + PRIOR_ROWS)) for n in sums])
    suffixes = _shares(counts, ["suffix"], size).select(F.col("suffix").alias("suffix_"), _shrunk(F.col("share"), world).alias("p_suffix"))
    hosts = _shares(counts, ["host", "suffix"], size).join(suffixes, F.col("suffix").eqNullSafe(F.col("suffix_")))
    hosts = hosts.select(
        F.col("host").alias("host_"),
        F.when(F.col("host").isNull(), F.col("p_suffix")).otherwise(_shrunk(F.col("share"), F.col("p_suffix"))).alias("p_host"),
    )
    hosts = settle(hosts, "hosts")
    # P(declared | language) = declared with the language / all rows of the language, but for the noise.
    declared = _shares(counts.where("declared IS NOT NULL"), ["declared"], size).select(
        F.col("declared").alias("declared_"),
        F.zip_with("share", spoken, lambda n, all_: F.lit(DECLARED_NOISE) + (1 - DECLARED_NOISE) * n / (all_ + 1)).alias("p_declared"),
    )
    declared = settle(declared, "declared")

    joined = (
        scored.join(hosts, F.col("host").eqNullSafe(F.col("host_")), "left")
        .join(declared, F.col("declared") == F.col("declared_"), "left")
        .withColumn("prior", F.coalesce("p_host", world))
        .withColumn("said", F.coalesce("p_declared", F.array(*[F.lit(1.0)] * size)))
    )
    joined = joined.withColumn(
        "logs", F.zip_with(F.zip_with("likely", "prior", lambda a, b: a + F.log(b)), "said", lambda a, b: a + F.log(b))
    ).withColumn("posterior", _softmax(F.col("logs")))
    best = F.array_max("posterior")
    named = F.get(F.array(*map(F.lit, labels)), (F.array_position("posterior", best) - 1).cast("int"))
    if labels[-1] == OTHER:
        local = scored.where((F.col("trigrams") >= MIN_TRIGRAMS) & F.col("beyond").isNotNull() & F.col("host").isNotNull())
        local = settle(local.groupBy("host", "beyond").agg(F.sum(F.get(_softmax(F.col("likely")), size - 1)).alias("n")), "local")
        local = local.groupBy(F.col("host").alias("host__")).agg(F.max(F.struct("n", "beyond"))["beyond"].alias("local"))
        joined = joined.join(local, F.col("host") == F.col("host__"), "left")
        named = F.when(named != OTHER, named).otherwise(F.coalesce("beyond", "local"))
    kept = (F.col("trigrams") >= MIN_TRIGRAMS) & (best >= MIN_PROBABILITY) & named.isNotNull()
    return joined.select(
        F.col("key").alias("doc_id"),
        F.when(kept, named).otherwise(F.lit(UNKNOWN)).alias("detected"),
        F.when(F.col("trigrams") >= MIN_TRIGRAMS, best).otherwise(F.lit(0.0)).alias("probability"),
        "trigrams",
        kept.alias("kept"),
    )
