import pytest

from tests.compare import connect, same
from tidemark.plans import queries as plans


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_duckdb(spark, data_dir, con, name):
    same(plans.QUERIES[name](spark, data_dir), con, plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_oracle_runs(spark, data_dir, name):
    assert plans.QUERIES[name](spark, data_dir).columns


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
