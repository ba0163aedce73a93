"""Host-level quality: rule failures per host, shrunk towards all hosts, judge the host's documents.

Every document is measured inside its row, without a shuffle. Hosts add up how
many of their documents fail each rule. A host with few documents says little, so
its rate is shrunk with a beta prior fitted to the rates of all hosts by moments
(empirical Bayes). A host whose shrunk rate of any rule passes ``HOST_LIMIT``
takes its remaining documents with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.llm.scratch import settle
from stepfall.llm.text import WORD, whole, words

# Fixed values of the measures.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = r"[#*$%&|<>]"

#: Rules a host is judged by; a document fails one where the expression holds.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "5 * n_dup_lines > n_lines",
}
#: Rules that also fail the document by themselves.
BASE = ("short", "repeats")
HOST_LIMIT = 0.5
#: Bounds of the prior's weight in documents, for hosts that are all alike or all different.
PRIOR_WEIGHT = (1.0, 1000.0)


def _repeat_words(starts: Column) -> Column:
    """Words covered by windows that begin at the given (rising) positions."""
    steps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.lit(WINDOW), b - a))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)`` per document.

    Windows are compared by 64-bit hashes of their words. Only texts in which a
    hash occurs twice sort their windows.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), whole(text_col).alias("text"))
    split = text.select(
        "doc_id",
        "host",
        words("text").alias("words"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    # Slicing inside a lambda would copy the array each time; getting single elements does not.
    window = lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + j) for j in range(WINDOW)])
    none = F.array().cast("array<bigint>")
    hashed = split.withColumn("hashes", F.transform("words", lambda word: F.xxhash64(word))).withColumn(
        "windows",
        F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), window)).otherwise(none),
    )
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = hashed.withColumn(
        "places", F.when(again, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    same = lambda place, j: place["h"] == F.get(F.col("places"), j)["h"]
    starts = F.transform(
        "places", lambda place, j: F.when(F.coalesce(same(place, j - 1), F.lit(False)) | F.coalesce(same(place, j + 1), F.lit(False)), place["i"])
    )
    started = placed.withColumn("starts", F.sort_array(F.array_compact(starts)))
    return started.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda total, word: total + F.length(word)).alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeat_words(F.col("starts")), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def host_rates(measured: DataFrame) -> DataFrame:
    """Per host: ``n`` documents, and for each rule the failures ``k_*`` and the shrunk rate ``p_*``.

    Rates of all hosts give the prior's mean m and variance v; its weight is
    m(1-m)/v - 1, held inside ``PRIOR_WEIGHT``.
    """
    fails = [F.sum(F.expr(f"cast({rule} AS bigint)")).alias(f"k_{name}") for name, rule in RULES.items()]
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *fails)
    hosts = settle(hosts, "hosts")
    rate = {name: F.col(f"k_{name}") / F.col("n") for name in RULES}
    moments = [m(r).alias(f"{k}_{name}") for name, r in rate.items() for k, m in (("mean", F.avg), ("var", F.var_pop))]
    prior = hosts.agg(F.struct(*moments).alias("prior")).scalar()
    low, high = (F.lit(x) for x in PRIOR_WEIGHT)
    for name in RULES:
        mean, variance = prior[f"mean_{name}"], prior[f"var_{name}"]
        weight = F.when(variance > 0, F.greatest(low, F.least(high, mean * (1 - mean) / variance - 1))).otherwise(high)
        rate[name] = (F.col(f"k_{name}") + weight * mean) / (F.col("n") + weight)
    return hosts.withColumns({f"p_{name}": shrunk for name, shrunk in rate.items()})


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures, ``base_failed``, ``host_failed`` and ``kept`` for every row.

    NULL and empty texts have no words and fail. Documents without a host are
    judged as one host. Repeated rows count as often as they occur; an empty table
    gives no rows; other columns are not looked at.
    """
    measured = settle(measure(docs, id_col, text_col, host_col), "measures")
    rates = host_rates(measured)
    bad = F.greatest(*[F.col(f"p_{name}") for name in RULES]) > HOST_LIMIT
    verdicts = rates.select(F.col("host").alias("host_"), bad.alias("host_failed"))
    base = F.expr(" OR ".join(f"({RULES[name]})" for name in BASE))
    return (
        measured.join(verdicts, F.col("host").eqNullSafe(F.col("host_")), "left")
        .drop("host_")
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    )


def _oracle() -> str:
    fails = ",\n".join(f"sum(CASE WHEN {rule} THEN 1 ELSE 0 END) AS k_{name}" for name, rule in RULES.items())
    low, high = PRIOR_WEIGHT

    def shrunk(name: str) -> str:
        m, v = f"(SELECT avg(k_{name} / n) FROM hosts)", f"(SELECT var_pop(k_{name} / n) FROM hosts)"
        weight = f"CASE WHEN {v} > 0 THEN greatest({low}, least({high}, {m} * (1 - {m}) / {v} - 1)) ELSE {high} END"
        return f"(k_{name} + ({weight}) * {m}) / (n + ({weight}))"

    return rf"""
WITH w AS (
  SELECT doc_id, source AS host, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
         len(regexp_extract_all(coalesce(text, ''), '{SYMBOLS}')) AS n_symbols,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, ws[i:i + {WINDOW - 1}] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM twice, range({WINDOW}) r(o) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, host, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), hosts AS (
  SELECT host, count(*) AS n, {fails} FROM m GROUP BY host
), verdicts AS (
  SELECT host, greatest({", ".join(shrunk(name) for name in RULES)}) > {HOST_LIMIT} AS host_failed FROM hosts
), judged AS (
  SELECT m.*, {" OR ".join(f"({RULES[name]})" for name in BASE)} AS base_failed, host_failed
  FROM m JOIN verdicts v ON m.host IS NOT DISTINCT FROM v.host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM judged
"""


ORACLE_SQL = _oracle()
COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
