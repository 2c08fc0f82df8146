"""Ranked lists: rank fusion, decay, round robin, reservation, staged rungs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rank_fusion(channels: DataFrame, item: str, channel: str, score: str, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """Sum over channels of weight / (k + rank); ties inside a channel go to the smaller item.

    Channels without a weight count 0. The ranks of one channel need its list in order, so give
    lists that were cut to what can matter.
    """
    w = Window.partitionBy(channel).orderBy(F.col(score).desc(), F.col(item).asc())
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    ranked = channels.withColumn("__r", F.row_number().over(w))
    part = F.coalesce(F.try_element_at(weight, F.col(channel)), F.lit(0.0)) / (k + F.col("__r"))
    return ranked.groupBy(item).agg(F.round(F.sum(part), 9).alias("fused"), F.count("*").alias("channels"))


def decayed_sum(df: DataFrame, group: str, item: str, score: str, decay: tuple[float, ...] = (1.0, 0.3, 0.1)) -> DataFrame:
    """Score of a group: its best items weighed by `decay` in order of rank."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(item).asc())
    d = F.array(*[F.lit(x) for x in decay])
    top = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= len(decay))
    return top.groupBy(group).agg(F.round(F.sum(F.col(score) * F.element_at(d, F.col("__r"))), 6).alias("score"), F.count("*").alias("items"))


def round_robin(df: DataFrame, group: str, order: list[Column], limit: int | None = None) -> DataFrame:
    """First of each group, then second of each, and so on; column position, cut at `limit`."""
    inside = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    if limit is not None:
        # only the first turns can be within the limit
        inside = inside.filter(F.col("turn") <= limit)
        return inside.orderBy("turn", group).limit(limit)
    return inside


def clause_routing(hits: DataFrame, clause: str, required: str, ticker: str, rank: str, k: int = RRF_K) -> DataFrame:
    """Tickers by required clauses hit, score (weight 2 if required, else 1), hits and best rank."""
    part = F.when(F.col(required), 2.0).otherwise(1.0) / (k + F.col(rank))
    return hits.groupBy(ticker).agg(F.countDistinct(F.when(F.col(required), F.col(clause))).alias("required_hits"), F.round(F.sum(part), 9).alias("score"), F.countDistinct(clause).alias("hits"), F.min(rank).alias("best_rank"))


def reserved_top(df: DataFrame, group: str, score: str, item: str, reserve: int, limit: int) -> DataFrame:
    """At most `limit` rows: the best `reserve` of every group first, then the best of the rest."""
    inside = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(item).asc())
    d = df.withColumn("reserved", F.row_number().over(inside) <= reserve)
    return d.orderBy(F.col("reserved").desc(), F.col(score).desc(), F.col(item).asc()).limit(limit)


def first_rung(rungs: list[DataFrame], item: str, score: str) -> DataFrame:
    """Union of the rungs of a relaxation ladder: each item at the first rung that finds it."""
    tagged = [r.select(item, F.col(score).alias("score"), F.lit(i).alias("rung")) for i, r in enumerate(rungs)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    return union.groupBy(item).agg(F.min(F.struct("rung", (-F.col("score")).alias("s"))).alias("b")).select(item, F.col("b.rung").alias("rung"), (-F.col("b.s")).alias("score"))
