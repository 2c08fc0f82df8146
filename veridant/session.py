"""Sessions, table access, durable cut points and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side may be broadcast by `small_side`.
BROADCAST_LIMIT = 8 << 20
#: Bytes up to which a table of few files is shuffled over the cores by `spread`.
SPREAD_LIMIT = 256 << 20


def build_session(app: str = "veridant", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; `conf` overrides any setting."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, as a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The session's own folder below spark.checkpoint.dir; only a session on one machine without it takes a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "veridant-checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, if the session can still do it."""
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001 - the session is over, and with it what could remove the folder
        pass


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder as a table, in a job of its own, and read it from there.

    For what several branches of a plan use, and what must survive the loss of executors. The folder is
    spark.checkpoint.dir of the session; only a session on one machine without it takes a temporary folder,
    any other raises. Tables are compressed, read by column, and removed when the program ends.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """`df` marked for broadcast if `rows` x `row_bytes` is within `limit`, else unchanged.

    `rows` must be a proven bound or a count; beyond the limit the join shuffles.
    """
    return F.broadcast(df) if rows * row_bytes <= limit else df


def spread(df: DataFrame, limit: int = SPREAD_LIMIT) -> DataFrame:
    """`df` over all cores if it is small and its scan has fewer splits than there are cores, else unchanged.

    The engine makes splits small enough for all cores where files can be parted; this is for tables of a few small files,
    whose work costs much more than a shuffle of at most `limit` bytes. Plans the scan, but runs no job.
    """
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(plan.optimizedPlan().stats().sizeInBytes())) <= limit
    return df.repartition(cores) if small and plan.toRdd().getNumPartitions() < cores else df
