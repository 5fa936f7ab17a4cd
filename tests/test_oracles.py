"""Every query that SQL can express, against DuckDB; the others run and have a stable schema."""

import pytest

from credalyt.catalog import ORACLES, QUERIES
from tests.compare import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, data, name):
    same(QUERIES[name](spark, data), data, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_without_optional_parts(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() == 10
