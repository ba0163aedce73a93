import brute
import numpy as np
import pytest
from conftest import AWKWARD
from pyspark.sql import functions as F

from stepfall.llm import golomb
from stepfall.llm.exact_dedup import drop_exact_duplicates, exact_duplicates, suspects
from stepfall.llm.scratch import maybe_in, rows_with, rows_without


@pytest.mark.parametrize("n", [0, 1, 2, 17, 5_000, 200_000])
@pytest.mark.parametrize("top", [2**20, 2**63])
def test_codes_decode_to_what_was_encoded(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(top // 2, top, n, dtype=np.uint64))
    code = golomb.encode(values, top // 2)
    assert np.array_equal(golomb.decode(code, top // 2), values)
    if n == 5_000 and top == 2**20:
        assert len(code) < 2 * n  # about log2(gap) + 1.5 bits each, not 64


def test_matches_brute_force(docs):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 5))) for _ in range(300)]
    rows = [(i, t.replace(" ", rng.choice([" ", "\n", "\t "]))) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_duplicates(docs(rows, 5)).collect()}
    assert got == brute.exact(rows)
    kept = {r.doc_id for r in exact_duplicates(docs(rows, 5)).where("kept").collect()}
    assert kept == {keep for keep, _, _ in brute.exact(rows).values()}
    assert {r.doc_id for r in drop_exact_duplicates(docs(rows, 5)).collect()} == kept


def test_awkward_rows(awkward):
    rows = exact_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert by_id[1] == [(1, 2, True)] and by_id[2] == [(1, 2, False)]
    assert by_id[3] == [(3, 1, True)]
    assert sorted(by_id[5]) == [(5, 3, False), (5, 3, True)] and by_id[6] == [(5, 3, False)]
    left = drop_exact_duplicates(awkward)
    assert left.columns == awkward.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 5, 7, 9]


def test_rows_without_an_id_come_last(docs):
    got = exact_duplicates(docs([(None, "x y"), (None, "x  y"), (3, "x y"), (None, "z"), (None, "z")])).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.kept) for r in got if r.group_size == 3) == [(False, 3, True), (True, 3, False), (True, 3, False)]
    assert sorted(r.kept for r in got if r.group_size == 2) == [False, True]
    assert drop_exact_duplicates(docs([(None, "z"), (None, "z"), (1, "q")])).count() == 2


def test_empty_table(nothing):
    assert exact_duplicates(nothing).collect() == [] and drop_exact_duplicates(nothing).collect() == []


def test_most_rows_are_no_suspects(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("print"), (F.col("id") % 7).cast("int").alias("chunk"))
    twice = rows.unionByName(rows.where("id < 50").withColumn("chunk", F.lit(3)))
    found = {r.id for r in suspects(twice, ["id"]).collect()}
    assert set(range(50)) <= found and len(found) < 150


def test_row_filters(spark):
    df, keys = spark.range(1000), spark.range(0, 1000, 10).select(F.col("id").alias("k"))
    assert sorted(r.id for r in rows_with(df, "id", keys).collect()) == list(range(0, 1000, 10))
    assert rows_without(df, "id", keys).count() == 900
    assert maybe_in(df, F.col("id"), keys).where("_sf_maybe").count() < 150
