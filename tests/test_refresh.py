"""The extract of rows that come in batches equals that of all rows, however they are split."""

import random

import pytest
from builders import duck_tables, random_rows, tables
from checks import duck_result, spark_result

from oracles import JOBS
from stepfall.plans import extract, refresh
from stepfall.sources import SCHEMAS


def _split(rows, seed, parts):
    """Every row into any batch, so payments come before and after their rides, and signups after both."""
    rng = random.Random(seed)
    out = [{name: [] for name in SCHEMAS} for _ in range(parts)]
    for name, some in rows.items():
        for row in some:
            out[rng.randrange(parts)][name].append(row)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_split_gives_the_full_extract(spark, tmp_path, seed):
    rows = random_rows(seed)
    want = duck_result(duck_tables(rows), JOBS["funnel_extract"])
    root = str(tmp_path / "state")
    for i, part in enumerate(_split(rows, seed, 4)):
        assert refresh.absorb(spark, root, f"day-{i}", tables(spark, **part))
        if i == 2:
            refresh.compact(spark, root)
    assert spark_result(refresh.extract(spark, root)) == want
    assert refresh.compact(spark, root) and len(refresh.batches(spark, root)[0]) == 1
    assert spark_result(refresh.extract(spark, root)) == want


def test_after_each_batch_the_extract_is_that_of_the_rows_so_far(spark, tmp_path):
    parts, so_far = _split(random_rows(7), 7, 3), {name: [] for name in SCHEMAS}
    for i, part in enumerate(parts):
        so_far = {name: so_far[name] + part[name] for name in SCHEMAS}
        refresh.absorb(spark, str(tmp_path), f"b{i}", tables(spark, **part))
        assert spark_result(refresh.extract(spark, str(tmp_path))) == duck_result(duck_tables(so_far), JOBS["funnel_extract"])


def test_a_batch_counts_once_and_broken_ones_not_at_all(spark, tmp_path, monkeypatch):
    rows = random_rows(4)
    first, second = (tables(spark, **part) for part in _split(rows, 4, 2))
    root = str(tmp_path)
    with pytest.raises(ValueError, match="no batch"):
        refresh.extract(spark, root)
    assert refresh.absorb(spark, root, "a", first) and not refresh.absorb(spark, root, "a", first)
    alone = spark_result(refresh.extract(spark, root))
    # The second batch breaks off after some of its parts.
    parts = refresh.COUNTS
    monkeypatch.setattr(refresh.Reduced, "items", lambda self: [(name, getattr(self, name)) for name in list(parts)[:3]] + [("reviews", None)])
    with pytest.raises(AttributeError):
        refresh.absorb(spark, root, "b", second)
    monkeypatch.undo()
    assert spark_result(refresh.extract(spark, root)) == alone and refresh.batches(spark, root)[0] == ["a"]
    assert refresh.absorb(spark, root, "b", second)
    assert spark_result(refresh.extract(spark, root)) == duck_result(duck_tables(rows), JOBS["funnel_extract"])
    # After compaction, batches that are part of it still count as absorbed.
    refresh.compact(spark, root)
    assert not refresh.absorb(spark, root, "b", second) and refresh.compact(spark, root) is None
    with pytest.raises(ValueError, match="named"):
        refresh.absorb(spark, root, "a/b", second)


def test_a_batch_reads_its_own_rows_and_ids_of_the_state(spark, tmp_path):
    """Of earlier batches, only ride ids, users and payment counts are read, and what is written is the batch's own."""
    rows = random_rows(8)
    first, second = _split(rows, 8, 2)
    root = str(tmp_path)
    refresh.absorb(spark, root, "a", tables(spark, **first))
    before = refresh.state(spark, root)
    new = refresh.reduced(tables(spark, **second), before)
    for name, df in new.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        read = {part for part in refresh.COUNTS if f"/{part}/" in " ".join(df.inputFiles())}
        assert read <= ({"riders", "paid"} if name == "payments" else set()), (name, plan)
    size = sum(f.stat().st_size for f in (tmp_path / "rides").rglob("*.parquet"))
    refresh.absorb(spark, root, "b", tables(spark))
    assert sum(f.stat().st_size for f in (tmp_path / "rides").rglob("*.parquet")) < 2.5 * size


def test_empty_batches(spark, tmp_path):
    refresh.absorb(spark, str(tmp_path), "none", tables(spark))
    assert spark_result(refresh.extract(spark, str(tmp_path))) == spark_result(extract.funnel_extract(tables(spark)))
    rows = random_rows(9)
    refresh.absorb(spark, str(tmp_path), "all", tables(spark, **rows))
    assert spark_result(refresh.extract(spark, str(tmp_path))) == duck_result(duck_tables(rows), JOBS["funnel_extract"])
