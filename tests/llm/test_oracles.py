"""Queries that SQL can express, against DuckDB; the others run over whole tables and repeat."""

import pytest

from helpers import rows_of, rows_of_sql
from weirflow.llm.oracle import oracle_sql
from weirflow.llm.queries import queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, small, duck, name):
    df = queries()[name](spark, small)
    names, want = rows_of_sql(duck, oracle_sql()[name])
    assert sorted(df.columns) == names and rows_of(df) == want


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_repeats(spark, small, name):
    table = "pages" if name.startswith(("op3_", "op10_")) else "documents"
    df = queries()[name](spark, small)
    first = rows_of(df)
    assert len(first) == spark.read.parquet(f"{small}/{table}.parquet").count()
    assert first == rows_of(queries()[name](spark, small))


def test_entry_lists_all():
    import __spark_entry__ as e

    assert set(queries()) | {"pipeline"} <= set(e.queries())
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 14)}
