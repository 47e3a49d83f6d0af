"""Every registered query against its SQL, and the driver contract."""

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from tidecast.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.oracle_sql())
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    result = QUERIES[name](spark, sf_dir)
    expected = duck.sql(contract.oracle_sql()[name])
    kinds = {
        "bigint": "BIGINT",
        "int": "INTEGER",
        "double": "DOUBLE",
        "string": "VARCHAR",
        "timestamp_ntz": "TIMESTAMP",
    }
    assert {c: kinds[t] for c, t in result.dtypes} == {
        c: str(t) for c, t in zip(expected.columns, expected.types)
    }
    assert differences(result.toPandas(), expected.df()) == []


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["target", "term", "lag", "coef", "n_obs", "status"]
    assert result.count() == 10
