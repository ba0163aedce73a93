import random

import brute
import duckdb
import pytest
from conftest import AWKWARD
from pyspark.sql import functions as F

from stepfall.llm.mixing import ORACLE_SQL, mix, mixed_documents, targets
from stepfall.llm.text import word_count


def _rows(seed, sources):
    rng = random.Random(seed)
    rows = []
    for name, docs in sources.items():
        rows += [(len(rows) + k, " ".join(["w"] * rng.randint(0, 40)), "en", name) for k in range(docs)]
    return rows


SOURCES = {"a": 40, "b": 3, "é": 7, None: 20, "B": 1, "c": 300, "d": 2}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1}, {"x": 5, None: 5, "y": 5, "z": 5}, {"a": 0, "b": 7}])
def test_targets_match_brute_force(spark, sizes):
    df = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n long, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    assert got == pytest.approx(brute.targets(sizes))


@pytest.mark.parametrize("part_rows", [4096, 5])
def test_budgets_are_met(docs, part_rows):
    rows = _rows(1, SOURCES)
    got = mix(docs(rows), part_rows=part_rows).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.words(text))
    want = brute.targets(sizes)
    taken = {}
    for r in got:
        assert r.size == len(brute.words(rows[r.doc_id][1])) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.target == pytest.approx(want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert {s: abs(taken[s] - want[s]) <= 1 for s in want} == dict.fromkeys(want, True)
    partial = [r for r in got if r.size and r.taken % r.size]
    assert len(partial) <= len(sizes)


def test_reruns_and_layouts_agree(docs):
    rows = _rows(2, SOURCES)
    first = {r.doc_id: r.taken for r in mix(docs(rows, 1)).collect()}
    assert first == {r.doc_id: r.taken for r in mix(docs(rows[::-1], 7), part_rows=9).collect()}


def test_documents_hold_the_words_taken(docs):
    rows = _rows(3, SOURCES)
    shares = {r.doc_id: r.taken for r in mix(docs(rows)).collect() if r.taken}
    mixed = mixed_documents(docs(rows)).withColumn("own", word_count("text"))
    assert {r.doc_id: r.words for r in mixed.groupBy("doc_id").agg(F.sum("own").alias("words")).collect()} == shares


def test_cut_text_is_a_beginning(docs):
    rows = [(0, "  one\n two  three\tfour five", "en", "a"), (1, "x " * 1000, "en", "b")]
    for r in mixed_documents(docs(rows)).collect():
        assert rows[r.doc_id][1].startswith(r.text)


def test_awkward_rows(awkward):
    rows = mix(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r.taken == 0 for r in rows if r.doc_id in (1, 2, 3))
    left = mixed_documents(awkward)
    assert left.columns == awkward.columns and {r.doc_id for r in left.collect()} <= {4, 5, 6, 7, 8, 9}


def test_empty_table_and_no_words(docs, nothing):
    assert mix(nothing).collect() == [] and mixed_documents(nothing).collect() == []
    only = docs([(1, ""), (2, None)])
    assert [r.taken for r in mix(only).collect()] == [0, 0] and mixed_documents(only).collect() == []


def _broken_ids(seed, n=200):
    """Ids that are NULL or repeat, some with the same text, some with another."""
    rng = random.Random(seed)
    return [(rng.choice([None, None, 1, 2, *range(3, 40)]), " ".join(["w"] * rng.choice([0, 1, 3, 3, 7, 20])), "en", rng.choice(["a", "a", "b", None])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_budgets_of_null_and_repeated_ids(docs, seed):
    rows = _broken_ids(seed)
    sizes, taken, words = {}, {}, {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.words(text))
    want = {s: round(t) for s, t in brute.targets(sizes).items()}
    for r in mix(docs(rows)).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    for r in mixed_documents(docs(rows)).collect():
        words[r.source] = words.get(r.source, 0) + len(brute.words(r.text))
    assert taken == want == words


@pytest.mark.parametrize("seed", [1, 2])
def test_check_sql_with_null_and_repeated_ids(docs, seed):
    rows = _broken_ids(seed)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLE_SQL})").fetchall()
    got = [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mix(docs(rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
