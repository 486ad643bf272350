"""Every registered query against its SQL on the same tables."""

import pytest

import __spark_entry__ as entry
import checking

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return checking.oracle_connection(data)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    columns, rows = checking.spark_rows(df)
    if name not in ORACLES:
        assert rows
        return
    want_columns, want = checking.oracle_rows(con, ORACLES[name])
    assert columns == want_columns
    assert checking.spark_kinds(df) == checking.oracle_kinds(con, ORACLES[name])
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
