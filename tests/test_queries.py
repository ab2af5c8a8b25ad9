"""Every query with SQL gives DuckDB's rows; every other one runs."""

import pytest

from florascope.plans import registry
from tests.compare import same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(name, spark, duck, sf_dir):
    assert same(registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark, sf_dir):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.columns and df.toPandas().notna().any().any()


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["yr", "tier", "n"] and df.count() > 0
