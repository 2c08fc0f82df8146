"""Every text query on the smallest tables, against its SQL where there is one."""

import pytest

from tests.compare import assert_same, connect
from veridant.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, data_dir, name):
    assert_same(QUERIES[name](spark, data_dir), connect(data_dir), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, data_dir, name):
    assert QUERIES[name](spark, data_dir).count() > 0


def test_containers_hold_every_token_once(spark, data_dir):
    from pyspark.sql import functions as F

    from veridant.llm.packing import count_tokens

    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    sizes = count_tokens(docs, "doc_id", "text").groupBy("doc_id").agg(F.max("n_tokens").alias("n"))
    packed = QUERIES["p8_containers"](spark, data_dir)
    assert packed.agg(F.sum("part_size")).first()[0] == sizes.agg(F.sum("n")).first()[0]
    worst = packed.groupBy("container_id", "capacity").agg(F.sum("part_size").alias("held")).filter("held > capacity").count()
    assert worst == 0
