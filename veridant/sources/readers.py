"""Readers and writers of artifacts and provider payloads."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from veridant.functions.timeparse import parse_instant

SPAN_SCHEMA = (
    "id string, type string, ticker string, source_document_id string, document_type string, period string, section_name string, section_number string, section_key string, "
    "section_instance int, span_index int, start_char int, end_char int, text string, text_hash string, char_count int, section_detection_confidence string, section_detection_method string, schema_version string"
)
MACRO_PAYLOAD = "observations array<struct<date:string,value:string,vintage:string,realtime_start:string,realtime_end:string>>"
BARS_PAYLOAD = "symbol string, historical array<struct<date:string,open:double,high:double,low:double,close:double,volume:bigint,change:double,changePercent:double>>"
AGGREGATES_PAYLOAD = "ticker string, results array<struct<t:bigint,o:double,h:double,l:double,c:double,v:bigint,vw:double,n:bigint>>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line under a fixed schema.

    A local path that is missing gives an empty relation, blank lines are skipped, a malformed line fails the read.
    """
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, replacing what was there; other characters than ASCII are kept."""
    df.write.mode("overwrite").json(path)


def digest(text: F.Column) -> F.Column:
    return F.sha2(text, 256)


def safe_number(text) -> F.Column:
    """Finite number of a text, else null; `.` and blanks are missing."""
    v = F.nullif(F.trim(text.cast("string")), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def macro_observations(payloads: DataFrame, series_key: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Macro payloads to observations; a window filters by date, `.` values are dropped."""
    o = payloads.select(series_key, F.explode("observations").alias("o"))
    o = o.select(series_key, F.col("o.date").alias("phenomenon_time"), safe_number(F.col("o.value")).alias("value"), F.coalesce("o.vintage", "o.realtime_start").alias("vintage"))
    o = o.filter("value IS NOT NULL")
    if start:
        o = o.filter(F.col("phenomenon_time") >= start)
    return o.filter(F.col("phenomenon_time") <= end) if end else o


def daily_bars(payloads: DataFrame) -> DataFrame:
    return payloads.select("symbol", F.inline("historical")).withColumnRenamed("changePercent", "changepercent")


def aggregate_bars(payloads: DataFrame) -> DataFrame:
    """Aggregates with the UTC day of their epoch milliseconds."""
    a = payloads.select("ticker", F.inline("results"))
    return a.withColumn("trade_date", F.date_from_unix_date(F.floor(F.col("t") / 86400000).cast("int")))


def artifact_manifest(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, length, digest) of the files below `root`, digested where they are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return f.select("path", "length", F.sha2("content", 256).alias("digest"))


def observation_id(series_key, phenomenon_time, vintage) -> F.Column:
    """obs: and the first 20 hex digits of the digest of the three parts."""
    return F.concat(F.lit("obs:"), F.substring(F.sha2(F.concat_ws("|", series_key, phenomenon_time, F.coalesce(vintage, F.lit(""))), 256), 1, 20))


RATIOS_PAYLOAD = "symbol string, ratios array<struct<date:string,period:string,values:map<string,double>>>"


def quarterly_ratios(payloads: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Ratio payloads to observations, one for each metric and date; values that are missing or not finite are dropped."""
    r = payloads.select("symbol", F.inline("ratios")).select("symbol", F.col("date").alias("phenomenon_time"), "period", F.explode("values").alias("canonical_metric", "value"))
    r = r.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return r.filter(F.col("canonical_metric").isin(metrics)) if metrics else r


def inline_sources(files: DataFrame, group: str, path: str, content: str) -> DataFrame:
    """(group, path, tags): of the files of a filing the one with most inline facts, the first path of equals; none without any."""
    tags = F.size(F.regexp_extract_all(content, F.lit(r"(?i)<ix:(?:nonfraction|nonnumeric)"), 0))
    b = files.filter(F.col(content).isNotNull()).select(group, path, tags.alias("tags")).filter("tags > 0")
    return b.groupBy(group).agg(F.min(F.struct((-F.col("tags")).alias("t"), F.col(path).alias("p"))).alias("b")).select(group, F.col("b.p").alias(path), (-F.col("b.t")).alias("tags"))
