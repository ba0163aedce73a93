import random

import duckdb
import pytest
from conftest import AWKWARD
from pyspark.sql import functions as F

from stepfall.llm.token_counts import ORACLE_SQL, TokenLedger, through_three_batches

ONE = {"words-1": r"[^\x20\x09-\x0D]+"}


def _events(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, op string, source string, lang string, text string")


def _totals(ledger):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in ledger.totals().collect()}


@pytest.fixture
def ledger(spark, tmp_path):
    return TokenLedger(spark, str(tmp_path), ONE)


def test_inserts_deletes_and_revisions(spark, ledger):
    assert _totals(ledger) == {}
    ledger.commit("1", _events(spark, [(1, "insert", "a", "en", "x y z"), (2, "insert", "a", "en", "x"), (3, "insert", None, None, None)]))
    assert _totals(ledger) == {("a", "en", "words-1"): (2, 4), (None, None, "words-1"): (1, 0)}
    ledger.commit("2", _events(spark, [(1, "revise", "b", "en", "x y"), (3, "delete", None, None, None), (9, "delete", None, None, None)]))
    assert _totals(ledger) == {("a", "en", "words-1"): (1, 1), ("b", "en", "words-1"): (1, 2)}
    ledger.commit("3", _events(spark, [(1, "revise", "b", "en", "q"), (2, "revise", "a", "fr", "l m n o")]))
    assert _totals(ledger) == {("b", "en", "words-1"): (1, 1), ("a", "fr", "words-1"): (1, 4)}


def test_a_batch_counts_once(spark, ledger):
    rows = _events(spark, [(1, "insert", "a", "en", "x y")])
    assert ledger.commit("1", rows) and not ledger.commit("1", rows)
    assert _totals(ledger) == {("a", "en", "words-1"): (1, 2)}


def test_a_broken_batch_is_not_seen_and_is_written_anew(spark, ledger, tmp_path):
    """Ledger and rollup were written, the mark was not."""
    rows = _events(spark, [(1, "insert", "a", "en", "x y")])
    ledger.commit("1", rows)
    (tmp_path / "commits" / "batch=1" / "_SUCCESS").unlink()
    assert _totals(ledger) == {}
    assert ledger.commit("1", rows)
    assert _totals(ledger) == {("a", "en", "words-1"): (1, 2)}


def test_a_new_tokenizer_stands_beside_the_old_one(spark, ledger, tmp_path):
    ledger.commit("1", _events(spark, [(1, "insert", "a", "en", "x-y z")]))
    newer = TokenLedger(spark, str(tmp_path), ONE | {"letters-1": "[a-z]"})
    newer.commit("2", _events(spark, [(1, "revise", "a", "en", "x-y z")]))
    assert _totals(newer) == {("a", "en", "words-1"): (1, 2), ("a", "en", "letters-1"): (1, 3)}


def test_awkward_rows(spark, ledger, awkward, nothing):
    ledger.commit("0", nothing.withColumn("op", F.lit("insert")))
    assert _totals(ledger) == {}
    ledger.commit("1", awkward.withColumn("op", F.lit("insert")))
    totals = _totals(ledger)
    assert sum(docs for docs, _ in totals.values()) == len(AWKWARD)
    assert totals[(None, "en", "words-1")][0] == 0 or totals[(None, "en", "words-1")] == (1, 2)
    ledger.commit("2", awkward.withColumn("op", F.lit("delete")))
    assert _totals(ledger) == {}


def test_repeated_and_missing_ids(spark, docs, tmp_path):
    """A revision sends all rows of an id; rows without an id only come in."""
    labels = spark.createDataFrame([(9, 1)], "doc_id long, toxic long")
    made = docs([(5, "a # b c"), (5, "x y z"), (None, "a # b"), (None, "q"), (9, "gone #"), (7, "l m"), (7, "l m")])
    got = through_three_batches(spark, str(tmp_path / "l"), made, labels).where("tokenizer = 'words-1'").collect()
    assert [(r.docs, r.tokens) for r in got] == [(6, 3 + 3 + 3 + 1 + 2 + 2)]


def test_check_sql_on_random_tables(spark, docs, tmp_path):
    for seed in (1, 2):
        rng = random.Random(seed)
        rows = [(rng.choice([None, *range(12)]), rng.choice([None, "", "a # b", "x y", "p q$ r", "w"]), rng.choice(["en", None]), rng.choice(["s", "t", None])) for _ in range(60)]
        labels = [(rng.choice([None, *range(12)]), rng.choice([0, 1, None])) for _ in range(8)]
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
        con.execute("CREATE TABLE labels (doc_id BIGINT, toxic BIGINT)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
        con.executemany("INSERT INTO labels VALUES (?, ?)", labels)
        want = sorted(con.execute(f"SELECT source, lang, tokenizer, docs, tokens FROM ({ORACLE_SQL})").fetchall(), key=str)
        df = spark.createDataFrame(labels, "doc_id long, toxic long")
        got = through_three_batches(spark, str(tmp_path / f"r{seed}"), docs(rows), df).collect()
        assert sorted(((r.source, r.lang, r.tokenizer, r.docs, r.tokens) for r in got), key=str) == want
