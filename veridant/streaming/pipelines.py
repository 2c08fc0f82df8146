"""Incremental inputs: windows with watermarks, first deliveries, newest vintages, key counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_landing(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, ts: str, by: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are dropped by the engine."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, ts: str, user: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n"))


def first_deliveries(events: DataFrame, ts: str, key: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def upsert_latest(target: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the newest row of each key in versions of a Parquet table.

    A batch is merged with the newest complete version into the version of its own number, so a batch
    that is run again after a failure overwrites its own output and nothing else.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = sorted(int(s.getPath().getName()) for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getPath().getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        earlier = [v for v in done if v < number]
        rows = batch if not earlier else batch.unionByName(spark.read.parquet(f"{target}/{earlier[-1]}"))
        rest = [c for c in batch.columns if c not in keys and c not in order]
        best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("b"))
        best.select(*[k for k in keys], *[F.col(f"b.{c}").alias(c) for c in [*order, *rest]]).select(*batch.columns).write.mode("overwrite").parquet(f"{target}/{number}")

    return merge
