"""Copies of the test tables with hostile additions."""

import os

from pyspark.sql import functions as F


def empty_tables(spark, source, target):
    for f in os.listdir(source):
        spark.read.parquet(f"{source}/{f}").limit(0).coalesce(1).write.mode("overwrite").parquet(f"{target}/{f}")


def dirty_tables(spark, source, target):
    """Repeated rows, a row of nulls, and columns with names that operators use."""
    for f in os.listdir(source):
        t = spark.read.parquet(f"{source}/{f}")
        nulls = spark.createDataFrame([tuple(None for _ in t.columns)], t.schema)
        more = t.unionByName(t.limit(40)).unionByName(nulls)
        clash = {c: F.lit("clash") for c in ("kind", "best", "sec", "code", "reason", "exp10", "utc_time", "ending", "at", "key", "shard") if c not in t.columns}
        more.withColumns(clash).coalesce(2).write.mode("overwrite").parquet(f"{target}/{f}")
