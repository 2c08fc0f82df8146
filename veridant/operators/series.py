"""Bitemporal series and metric series: newest vintage, revisions, releases, growth, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first() -> Column:
    """Order of vintages: when they were known, then their vintage; nulls lowest."""
    return F.struct("known_sec", "vintage_sec")


def latest_vintage(readings: DataFrame, keys: list[str], payload: list[str], tie: str = "observation_id") -> DataFrame:
    """The newest vintage of each key, as an aggregate with map-side combination instead of a sort.

    readings: known_sec and vintage_sec beside keys and payload. Of equal vintages the greatest `tie` counts, then the
    greatest payload. Repeated rows do not matter; null keys form their own group.
    """
    best = F.max(F.struct(newest_first().alias("o"), tie, *[c for c in payload if c != tie])).alias("b")
    return readings.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in payload])


def revision_chain(readings: DataFrame, keys: list[str], tie: str = "observation_id") -> DataFrame:
    """Each vintage with the one it supersedes, in order of known time; first vintages have none.

    Vintages delivered again count once.
    """
    o = readings.select(*keys, tie, "value", "known_sec", "vintage_sec").distinct()
    w = Window.partitionBy(*keys).orderBy(F.col("known_sec").asc_nulls_first(), F.col("vintage_sec").asc_nulls_first(), F.col(tie).asc(), F.col("value").asc_nulls_first())
    return o.select(*keys, F.lag(tie).over(w).alias("superseded_id"), F.col(tie).alias("superseding_id"), F.lag("value").over(w).alias("old_value"), F.col("value").alias("new_value")).filter("superseded_id IS NOT NULL")


def release_events(readings: DataFrame, keys: list[str], tie: str = "observation_id") -> DataFrame:
    """First and newest value of each key and how many later vintages it had."""
    order = F.struct(newest_first().alias("o"), F.col(tie), F.col("value"))
    o = readings.filter("value IS NOT NULL").groupBy(*keys).agg(F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("latest_value"), (F.countDistinct(tie) - 1).alias("revision_count"))
    return o.withColumn("revision", F.round(F.col("latest_value") - F.col("first_value"), 6))


def downsample(readings: DataFrame, key: str, day: str, value: str, quarterly: Column) -> DataFrame:
    """Last reading of each month, or of each quarter where `quarterly` holds; label CYyyyyMmm or CYyyyyQq.

    Several readings of the last day: the greatest value. Null days and values are left out.
    """
    d = F.col(day)
    month = F.concat(F.lit("CY"), F.year(d).cast("string"), F.lit("M"), F.lpad(F.month(d).cast("string"), 2, "0"))
    quarter = F.concat(F.lit("CY"), F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
    r = readings.filter(d.isNotNull() & F.col(value).isNotNull()).withColumn("period", F.when(quarterly, quarter).otherwise(month))
    best = r.groupBy(key, "period").agg(F.max(F.struct(d.alias("day"), F.col(value).alias("value"))).alias("b"), F.count("*").alias("readings"))
    return best.select(key, "period", F.col("b.day").alias("last_day"), F.col("b.value").alias("value"), "readings")


def latest_contexts(points: DataFrame, series: list[str], depth: int) -> DataFrame:
    """Newest `depth` periods of each metric series, one row per distinct value, with a conflict flag.

    points: the series columns, fiscal_year, fiscal_quarter, period, value, source_sort_key, object_id. Of rows with one
    value in one period the newest filing, then the greatest id counts. A period with more than one
    distinct value conflicts. Null values are left out.
    """
    context = [*series, "fiscal_year", "fiscal_quarter", "period"]
    p = points.filter("value IS NOT NULL").groupBy(*context, "value").agg(F.max(F.struct("source_sort_key", "object_id")).alias("f"))
    w = Window.partitionBy(*series).orderBy(F.col("fiscal_year").desc_nulls_last(), F.col("fiscal_quarter").desc_nulls_last(), F.col("period").desc_nulls_last())
    ranked = p.withColumn("context_rank", F.dense_rank().over(w)).filter(F.col("context_rank") <= depth)
    same = Window.partitionBy(*context)
    return ranked.select(*series, "period", "value", F.col("f.object_id").alias("object_id"), "context_rank", (F.count("*").over(same) > 1).alias("conflict"))


def period_changes(points: DataFrame, series: list[str], step: str) -> DataFrame:
    """Change and growth between period pairs: `adjacent` quarters or years, or `year` over year.

    points: series columns, fiscal_year, fiscal_quarter (null for annual), value. Values of a period that
    agree collapse, those that differ drop the period. Growth needs a positive base and a value of
    zero or more. The pair is an equi-join on the index of the earlier period.
    """
    index = F.when(F.col("fiscal_quarter").isNull(), F.col("fiscal_year") * 10).otherwise((F.col("fiscal_year") * 4 + F.col("fiscal_quarter")) * 10 + 1)
    gap = F.when(F.col("fiscal_quarter").isNull(), 10).otherwise(10 if step == "adjacent" else 40)
    p = points.filter("value IS NOT NULL AND fiscal_year IS NOT NULL").groupBy(*series, "fiscal_year", "fiscal_quarter").agg(F.min("value").alias("value"), F.max("value").alias("top"))
    p = p.filter("value = top").select(*series, "fiscal_year", "fiscal_quarter", "value", index.alias("i"), (index - gap).alias("before"))
    prior = p.select(*series, F.col("i").alias("before"), F.col("value").alias("previous_value"))
    j = p.join(prior, [*series, "before"])
    growth = F.when((F.col("previous_value") > 0) & (F.col("value") >= 0), F.col("value") / F.col("previous_value") - 1)
    return j.select(*series, "fiscal_year", "fiscal_quarter", "previous_value", "value", (F.col("value") - F.col("previous_value")).alias("absolute_change"), growth.alias("growth_rate"))


def share_of_total(points: DataFrame, total_keys: list[str]) -> DataFrame:
    """Share of each part in the total of its keys; points: keys, scope_kind, scope_key, value."""
    total = points.filter("scope_kind = 'company' AND value > 0").groupBy(*total_keys).agg(F.min("value").alias("total"), F.max("value").alias("top")).filter("total = top").drop("top")
    parts = points.filter("scope_kind != 'company' AND value IS NOT NULL").groupBy(*total_keys, "scope_key").agg(F.max("value").alias("value"))
    return parts.join(total, total_keys).select(*total_keys, "scope_key", "value", "total", F.round(F.col("value") / F.col("total"), 6).alias("share"))


def trend(points: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """Direction of each value against the one before: up, down or flat."""
    w = Window.partitionBy(*series).orderBy(*order)
    p = points.withColumn("previous_value", F.lag("value").over(w)).filter("previous_value IS NOT NULL AND value IS NOT NULL")
    return p.withColumn("direction", F.when(F.col("value") > F.col("previous_value"), "up").when(F.col("value") < F.col("previous_value"), "down").otherwise("flat"))


def latest_points(points: DataFrame, series: str, order: str, n: int) -> DataFrame:
    """The newest n points of each series, numbered oldest first."""
    newest = Window.partitionBy(series).orderBy(F.col(order).desc(), F.col("period").desc())
    oldest = Window.partitionBy(series).orderBy(F.col(order).asc(), F.col("period").asc())
    return points.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= n).drop("__r").withColumn("position", F.row_number().over(oldest))
