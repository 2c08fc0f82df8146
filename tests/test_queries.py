"""Every core query against its SQL on the smallest tables."""

import pytest

from tests.compare import assert_same, connect
from veridant.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data_dir, con, name):
    assert_same(QUERIES[name](spark, data_dir), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    assert df.columns and df.count() > 0


def test_entry_has_rows(spark, data_dir):
    assert registry.FLAGSHIP(spark, data_dir).count() > 0
