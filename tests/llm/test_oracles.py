"""Operators that SQL can express, beside DuckDB."""

import oracle
import pytest

from plumbline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, sf_dir, name):
    found = queries.queries()[name](spark, sf_dir).toPandas()
    assert oracle.difference(found, oracle.duck(sf_dir).execute(queries.oracle_sql()[name]).df()) is None
