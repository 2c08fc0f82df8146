"""Attributes as known at event time: validity intervals, time buckets, one equi-join.

`validity_intervals` turns the changes of each entity into half-open intervals that hold
the reading valid in them; `as_of_join` explodes the intervals into time buckets and joins
events by entity and bucket, with half-open containment.

Scale: changes are first reduced to the best one per entity and second (map-side
combination). The running best of an entity is made in two levels, inside each time bucket
and over the bests of its buckets, so a hot entity is spread over its buckets and no task
holds all of it: a bucket holds at most its seconds, an entity at most its buckets. The join
key is entity and bucket; many events of one key are split by adaptive execution, as the
other side of a key is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def validity_intervals(changes: DataFrame, entity: str, at: str, rank: list[str], bucket_sec: int = 28 * DAY) -> DataFrame:
    """Half-open intervals (entity, valid_from, valid_to, best) of the best reading so far.

    changes: one row per change, known from epoch second `at`; the best reading at a time is
    the greatest by the columns `rank` (nulls lowest) among those known by then. `best` is
    the struct of `rank`. valid_to of the last interval is null. Rows with null entity or
    `at` never become known. Equal rows count once.
    """
    best = F.struct(*rank)
    c = changes.filter(F.col(entity).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(entity).alias("entity"), F.col(at).alias("at")).agg(F.max(best).alias("best"))
    c = c.withColumn("bucket", F.floor(F.col("at") / bucket_sec))
    inside = Window.partitionBy("entity", "bucket").orderBy("at")
    c = c.withColumn("run", F.max("best").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    firsts = c.groupBy("entity", "bucket").agg(F.max("best").alias("top"), F.min("at").alias("start"))
    over = Window.partitionBy("entity").orderBy("bucket")
    firsts = firsts.select(
        "entity", "bucket", F.max("top").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"), F.lead("start").over(over).alias("next_start")
    )
    c = c.join(firsts, ["entity", "bucket"])
    # null structs sort lowest in greatest(), so an absent carry never wins
    c = c.withColumn("state", F.greatest("run", "carried"))
    c = c.withColumn("valid_to", F.coalesce(F.lead("at").over(inside), F.col("next_start")))
    return c.select("entity", F.col("at").alias("valid_from"), "valid_to", F.col("state").alias("best"))


def as_of_join(events: DataFrame, entity: str, at: str, intervals: DataFrame, bucket_sec: int = 28 * DAY, span: tuple[int, int] | None = None) -> DataFrame:
    """Events with the `best` of the interval that contains their epoch second `at`.

    Events without such an interval, or with null entity or time, get null. `span` bounds the
    buckets to explode into; if not given, the first and last event time are aggregated
    first, which costs one pass over that column. Every event row comes out once. Columns of
    events named valid_from, valid_to or best are replaced.
    """
    events = events.drop("valid_from", "valid_to", "best")
    if span is None:
        low, high = events.agg(F.min(at), F.max(at)).first()
        span = (0, 0) if low is None else (int(low), int(high))
    end = F.least(F.coalesce(F.col("valid_to") - 1, F.lit(span[1])), F.lit(span[1]))
    start = F.greatest(F.col("valid_from"), F.lit(span[0]))
    pieces = (
        intervals.withColumns({"__from": start, "__end": end})
        .filter("__from <= __end")
        .select(F.col("entity").alias("__entity"), "valid_from", "valid_to", "best", F.explode(F.sequence(F.floor(F.col("__from") / bucket_sec), F.floor(F.col("__end") / bucket_sec))).alias("__bucket"))
    )
    e = events.withColumn("__at_bucket", F.floor(F.col(at) / bucket_sec))
    contained = (F.col(at) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return e.join(pieces, (F.col(entity) == F.col("__entity")) & (F.col("__at_bucket") == F.col("__bucket")) & contained, "left").drop("__entity", "__bucket", "__at_bucket")
