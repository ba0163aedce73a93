"""Severity of toxic language by cumulative-link ordinal regression on hashed words.

Grades are ordered, and P(grade > k) = logistic(w.x - cut_k): one weight per word bucket
serves every threshold, and the cuts rise. The model is fitted on a bounded sample of
labelled rows; scoring reads every text once and moves none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.llm.scratch import settle
from stepfall.llm.text import whole

BUCKETS = 1 << 18
#: Labelled rows to fit on, about; what a bucket needs to be fitted: rows of the sample, and its score test.
SAMPLE_ROWS, MIN_DOCS, MIN_SCORE = 20_000, 3, 3.0
#: Lengths of the word beginnings that are features too, so that inflected forms share a weight.
STEMS = (4, 5)
#: Steps of the fit, their size, the weight decay (as a number of rows), and the widest step between cuts (a logarithm;
#: without rows of the highest grade, that cut has no bound of its own).
ROUNDS, RATE, DECAY, WIDEST = 300, 0.1, 0.2, 3.0
GRADES = 3
#: The share of clean texts that may be called toxic, and the chance below which none is.
FALSE_ALARMS, LEAST_ALARM = 0.008, 0.05
_WORD = re.compile(r"[^\W\d_]+")
_LINES = 1 << 16


def buckets(text: str) -> np.ndarray:
    """Distinct buckets of the words of a whole text (runs of letters, lower case) and of their beginnings."""
    found: set[str] = set()
    for at in range(0, len(text), _LINES):
        # A word that straddles two blocks belongs to the block it begins in.
        stop = at + _LINES
        while stop < len(text) and text[stop - 1].isalpha() and text[stop].isalpha():
            stop += 1
        start = at
        while 0 < start < len(text) and text[start - 1].isalpha() and text[start].isalpha():
            start += 1
        found.update(_WORD.findall(text[start:stop].lower()))
    if not found:
        return np.empty(0, np.int32)
    found.update([f"{word[:n]}_" for word in found for n in STEMS if len(word) > n])
    words = np.array(list(found), object)
    return np.unique(pd.util.hash_array(words, categorize=False) % np.uint64(BUCKETS)).astype(np.int32)


def grade(toxic: Column, quality: Column) -> Column:
    """0: not toxic; 1: toxic words in a text that is otherwise good; 2: toxic and of low quality."""
    return F.when(toxic == 0, 0).when(quality == 1, 1).otherwise(2)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    cuts: np.ndarray
    #: From which P(grade > 0) on a text is called toxic.
    alarm: float = 0.5

    def above(self, at: np.ndarray) -> np.ndarray:
        """P(grade > k) for each cut, given a text's buckets."""
        return 1 / (1 + np.exp(np.clip(self.cuts - pulled(self.weights, at), -700, 700)))


def pulled(weights: np.ndarray, at: np.ndarray) -> float:
    """A text's score: the weights of its buckets, of unit length together, so that ten strong words are not ten times one."""
    own = weights[at]
    return float(own.sum(dtype=np.float64) / np.sqrt(max(1, np.count_nonzero(own))))


def _likelihood(score: np.ndarray, cuts: np.ndarray, grades: np.ndarray, times: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the log likelihood: by each row's score, and by each cut. A row counts ``times``."""
    one, own = np.ones((len(score), 1)), np.arange(len(score))
    above = np.clip(1 / (1 + np.exp(np.clip(cuts - score[:, None], -30, 30))), 1e-9, 1 - 1e-9)
    edges, slope = np.hstack([one, above, 0 * one]), np.hstack([0 * one, above * (1 - above), 0 * one])
    chance = np.maximum(edges[own, grades] - edges[own, grades + 1], 1e-9)
    upper, lower = times * slope[own, grades] / chance, times * slope[own, grades + 1] / chance
    by_cut = [lower[grades == k].sum() - upper[grades == k + 1].sum() for k in range(len(cuts))]
    return upper - lower, np.array(by_cut)


def _quotas(counts: dict[int, int], rows: int) -> dict[int, float]:
    """Of each grade, the share to sample: rare grades whole, the others evenly from what is left."""
    shares, left = {}, rows
    for i, grade_ in enumerate(sorted(counts, key=counts.__getitem__)):
        shares[grade_] = min(1.0, left / (len(counts) - i) / max(1, counts[grade_]))
        left -= int(shares[grade_] * counts[grade_])
    return shares


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(row, grade, share, at)`` of about ``rows`` labelled documents, chosen by a hash of their id; ``at`` are their buckets.

    Grades that are rare are sampled in full; ``share`` says how many of the row's grade
    are. The ids chosen are few, so they are sent to the documents instead of the other way. An id
    counts once: of repeated labels the most severe, of repeated documents one.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = settle(known.groupBy("doc_id").agg(F.max(grade(F.col("toxic"), F.col("quality"))).alias("grade")), "graded")
    shares = _quotas({r["grade"]: r["count"] for r in known.groupBy("grade").count().collect()}, rows)
    share = F.get(F.array(*[F.lit(float(shares.get(k, 1.0))) for k in range(GRADES)]), F.col("grade"))
    chosen = known.withColumn("share", share).where(F.xxhash64("doc_id").bitwiseAND((1 << 32) - 1) < F.col("share") * (1 << 32))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [buckets(text.as_py()) for text in batch["text"]]
            kept = [batch["doc_id"], batch["grade"], batch["share"]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.int32()))], ["doc_id", "grade", "share", "at"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "share", "text")
    rows_read = joined.mapInArrow(read, f"doc_id {id_kind}, grade int, share double, at array<int>")
    one = rows_read.groupBy("doc_id").agg(F.max("grade").alias("grade"), F.max("share").alias("share"), F.min("at").alias("at"))
    return one.select("grade", "share", "at").withColumn("row", F.monotonically_increasing_id())


def _ascent(features: list[np.ndarray], grades: np.ndarray, times: np.ndarray, cuts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, their weights, and cuts: maximum likelihood with weight decay, by Adam on all rows at once."""
    lengths = np.array([len(f) for f in features])
    rows, unit = np.repeat(np.arange(len(features)), lengths), np.repeat(1 / np.sqrt(np.maximum(1, lengths)), lengths)
    used, columns = np.unique(np.concatenate(features), return_inverse=True)
    # Parameters: the weights, the first cut, and the logarithms of the steps to the next cuts.
    m, n = len(used), times.sum()
    theta = np.concatenate([np.zeros(m), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        steps = np.exp(theta[m + 1 :])
        cuts = theta[m] + np.concatenate([[0.0], np.cumsum(steps)])
        score = np.bincount(rows, weights=theta[columns] * unit, minlength=len(grades))
        pull, by_cut = _likelihood(score, cuts, grades, times)
        tails = np.cumsum(by_cut[::-1])[::-1]
        by_weight = np.bincount(columns, weights=pull[rows] * unit, minlength=m) - DECAY * theta[:m]
        gradient = np.concatenate([by_weight, tails[:1], tails[1:] * steps]) / n
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta = theta + RATE * (1 - t / rounds) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        theta[m + 1 :] = np.minimum(theta[m + 1 :], WIDEST)
    return used, theta[:m], theta[m] + np.concatenate([[0.0], np.cumsum(np.exp(theta[m + 1 :]))])


def _alarm(features: list[np.ndarray], grades: np.ndarray, times: np.ndarray, cuts: np.ndarray, rounds: int) -> float:
    """P(toxic) that ``FALSE_ALARMS`` of the clean rows reach, each judged by a model fitted without its half of the rows."""
    chance, halves = np.empty(len(grades)), np.arange(len(grades)) % 2
    for half in (0, 1):
        fit_on = np.flatnonzero(halves != half)
        if not any(len(features[i]) for i in fit_on):
            return 0.5
        used, weights, own = _ascent([features[i] for i in fit_on], grades[fit_on], times[fit_on], cuts, rounds)
        dense = np.zeros(BUCKETS)
        dense[used] = weights
        for i in np.flatnonzero(halves == half):
            chance[i] = 1 / (1 + np.exp(np.clip(own[0] - pulled(dense, features[i]), -700, 700)))
    clean = np.flatnonzero(grades == 0)
    order = clean[np.argsort(-chance[clean])]
    over = np.searchsorted(np.cumsum(times[order]), FALSE_ALARMS * times[clean].sum(), "right")
    return float(np.clip(chance[order[min(over, len(order) - 1)]] if len(order) else 0.5, LEAST_ALARM, 0.5))


def fit(sampled: DataFrame, rounds: int = ROUNDS) -> Model:
    """Maximum likelihood on the sample, and the chance from which a text is called toxic.

    Only buckets that depart from the model without words are fitted (score test,
    computed by Spark); the others are noise, of which a long text would add up a lot. Rows are
    stripped of the others where they lie; the driver gets the fitted buckets of the sample's
    rows, a few each. A row counts for all of its grade that were not sampled.
    """
    sampled = settle(sampled, "sample")
    levels, weights = GRADES - 1, np.zeros(BUCKETS)
    counts, shares = np.zeros(GRADES), np.ones(GRADES)
    for r in sampled.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.max("share").alias("share")).collect():
        counts[r["grade"]], shares[r["grade"]] = r["n"], r["share"]
    n = int(counts.sum())
    if not n:
        return Model(weights.astype(np.float32), np.arange(30.0, 30.0 + levels))

    def plain_cuts(of: np.ndarray) -> np.ndarray:
        share = (np.cumsum(of[::-1])[::-1][1:] + 0.5 * np.arange(levels, 0, -1)) / (of.sum() + levels)
        return np.log((1 - share) / share)

    # Without words a row's pull depends on its grade only.
    pulls, _ = _likelihood(np.zeros(GRADES), plain_cuts(counts), np.arange(GRADES))
    spread = max(float(counts @ pulls**2) / max(1, n), 1e-12)
    pull = F.get(F.array(*[F.lit(float(p)) for p in pulls]), F.col("grade"))
    sums = sampled.select(F.explode("at").alias("bucket"), pull.alias("pull")).groupBy("bucket")
    sums = sums.agg(F.count(F.lit(1)).alias("docs"), F.sum("pull").alias("pull"))
    tested = sums.where((F.col("docs") >= MIN_DOCS) & (F.abs("pull") >= MIN_SCORE * F.sqrt(F.col("docs") * spread)))
    # One row per bucket at most, of a fixed number of buckets.
    fitted = np.zeros(BUCKETS, bool)
    fitted[[r["bucket"] for r in tested.select("bucket").collect()]] = True

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.sort(x[fitted[x]]) for x in (np.asarray(row.as_py(), np.int64) for row in batch["at"])]
            held = pa.array([len(x) > 0 for x in at])
            stripped = [batch["row"], batch["grade"], pa.array(at, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(stripped, ["row", "grade", "at"]).filter(held)

    got = sampled.select("row", "grade", "at").mapInArrow(strip, "row bigint, grade int, at array<int>").toPandas().sort_values("row")
    scale = 1 / shares * (n / (counts / shares).sum())
    cuts = plain_cuts(counts * scale)
    if got.empty:
        return Model(weights.astype(np.float32), cuts)
    # Rows without any fitted bucket all score the same: one stands for those of a grade, with their number as weight.
    bare = counts - np.bincount(got["grade"], minlength=GRADES)
    features = [np.asarray(at, np.int64) for at in got["at"]] + [np.empty(0, np.int64)] * GRADES
    grades = np.concatenate([got["grade"].to_numpy(np.int64), np.arange(GRADES)])
    times = np.concatenate([np.ones(len(got)), bare]) * scale[grades]
    alarm = _alarm(features, grades, times, cuts, rounds)
    used, found, cuts = _ascent(features, grades, times, cuts, rounds)
    weights[used] = found
    return Model(weights.astype(np.float32), cuts, alarm)


def severity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, model: Model | None = None
) -> DataFrame:
    """``(doc_id, expected_severity, grade, p_toxic, toxic)`` for every row of ``docs``.

    ``expected_severity`` is the mean grade; ``toxic`` whether the chance of a grade above 0 reaches the
    model's ``alarm``, and ``grade`` the likeliest of the grades that this leaves. ``labels`` has
    ``doc_id``, ``toxic`` and ``quality``; without labels every text is clean. NULL and
    empty texts have no words and score as such. Repeated rows are rows of their own, ids
    may be NULL, an empty table gives no rows, and other columns are not looked at.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    fitted = model or fit(sample(slim, labels, sample_rows))
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    id_kind = slim.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = np.array([shared.value.above(buckets(text.as_py())) for text in batch["text"]]).reshape(-1, GRADES - 1)
            chances = -np.diff(above, prepend=1.0, append=0.0, axis=1)
            toxic = above[:, 0] >= shared.value.alarm
            grades = np.where(toxic, 1 + chances[:, 1:].argmax(axis=1), 0).astype(np.int32)
            columns = [above.sum(axis=1), grades, above[:, 0], toxic]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, columns)], ["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    return slim.mapInArrow(score, f"doc_id {id_kind}, expected_severity double, grade int, p_toxic double, toxic boolean")
