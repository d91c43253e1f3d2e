"""Each registered query against DuckDB on the same tables."""

import pytest

from helpers import rows_of, rows_of_sql
from weirflow.plans import catalog, workloads  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, small, duck, name):
    df = catalog.queries()[name](spark, small)
    names, want = rows_of_sql(duck, catalog.oracle_sql()[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs_and_repeats(spark, small, name):
    df = catalog.queries()[name](spark, small)
    first = rows_of(df)
    assert first and first == rows_of(catalog.queries()[name](spark, small))


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
