"""Every registered query of the package against its SQL; those without SQL run and keep their schema."""

import pytest

from parlance.plans import registry
from tests.compare import DATA, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    columns, rows = rows_of(registry.QUERIES[name](spark, DATA))
    expected_columns, expected = rows_of_sql(registry.ORACLES[name])
    assert columns == expected_columns
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.columns
    df.collect()


def test_entry_point():
    import __spark_entry__ as entry

    assert registry.FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
