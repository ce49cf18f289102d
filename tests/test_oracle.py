"""Every registered query beside its DuckDB SQL."""

import oracle
import pytest

from plumbline import registry

registry.load_all()
ROWS_ONLY = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, sf_dir, con, name):
    found = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert oracle.difference(found, con.execute(registry.ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", [n for n in ROWS_ONLY if n != "function_types"])
def test_rows_only(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
