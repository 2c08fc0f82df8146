"""The text queries on empty tables and on tables with nulls, repeats and clashing columns."""

import pytest

from tests.dirty import dirty_tables, empty_tables
from veridant.llm.queries import QUERIES


@pytest.fixture(scope="module")
def empty(spark, data_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    empty_tables(spark, data_dir, d)
    return d


@pytest.fixture(scope="module")
def dirty(spark, data_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("dirty"))
    dirty_tables(spark, data_dir, d)
    return d


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_repeats_and_extra_columns_change_nothing(spark, data_dir, dirty, name):
    columns = [c for c in QUERIES[name](spark, data_dir).columns if c != "container_id"]
    want = sorted((tuple(r) for r in QUERIES[name](spark, data_dir).select(*columns).collect()), key=repr)
    assert sorted((tuple(r) for r in QUERIES[name](spark, dirty).select(*columns).collect()), key=repr) == want
