"""Every registered job against its check SQL on the derived tables."""

import pytest
from checks import duck_result, duck_types, spark_result, star_connection

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.01"
# Spark type -> type names of the check engine.
SAME_TYPE = {
    "bigint": {"BIGINT", "NUMBER"},
    "int": {"INTEGER", "NUMBER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR", "STRING"},
    "date": {"DATE", "Date"},
    "timestamp_ntz": {"TIMESTAMP", "DATETIME"},
}


@pytest.fixture(scope="module")
def con():
    return star_connection(SF_DIR)


def test_every_query_has_check_sql():
    assert set(entry.queries()) - set(entry.CORPUS_QUERIES) == set(entry.oracle_sql()) - set(entry.CORPUS_ORACLES)
    assert set(entry.CORPUS_ORACLES) <= set(entry.CORPUS_QUERIES)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.CORPUS_QUERIES)))
def test_matches(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql()[name]
    columns, rows = spark_result(df)
    assert (columns, rows) == duck_result(con, sql)
    assert rows
    types = duck_types(con, sql)
    assert {c: k for c, k in df.dtypes if types[c] not in SAME_TYPE[k]} == {}


def test_entry(spark):
    assert entry.entry(spark).count() == 7
