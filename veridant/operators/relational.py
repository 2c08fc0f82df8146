"""Filters, joins, aggregates and merges of the evidence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scope_filter(df: DataFrame, **wanted: list | None) -> DataFrame:
    """Conjunction of IN filters; None or an empty list sets no filter on that column."""
    for column, values in wanted.items():
        if values:
            df = df.filter(F.col(column).isin(list(values)))
    return df


def prefix_upper_bound(prefix: str) -> str:
    """Exclusive upper bound of all texts with the prefix."""
    return prefix[:-1] + chr(ord(prefix[-1]) + 1)


def prefix_scan(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text begins with `prefix`, as a half-open range that reaches the Parquet statistics."""
    return df.filter((F.col(column) >= prefix) & (F.col(column) < prefix_upper_bound(prefix)))


def ordered_lookup(df: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """Rows of the ids, in the order asked (column position)."""
    wanted = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(ids)], f"{key} string, position int")
    return df.join(F.broadcast(wanted), key)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank; the window group limit prunes before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def modal_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent non-null value of each key; ties go to the smaller value."""
    c = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return c.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(key, F.col("b.v").alias(value), (-F.col("b.m")).alias("support"))


def key_statistics(refs: DataFrame, key: str, ticker: str, document: str, generic_from: int = 25) -> DataFrame:
    """Distinct tickers and documents of each key, weight 1/sqrt(tickers), generic flag."""
    s = refs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(ticker).alias("tickers"), F.countDistinct(document).alias("documents"), F.count("*").alias("refs"))
    return s.withColumns({"weight": F.round(1 / F.sqrt(F.greatest(F.col("tickers"), F.lit(1))), 6), "generic": F.col("tickers") >= generic_from})


def manifest_diff(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """added, removed and changed keys between two manifests with one row per key."""
    a, b = left.select(key, F.col(digest).alias("old")), right.select(key, F.col(digest).alias("new"))
    j = a.join(b, key, "full_outer")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return j.withColumn("change", state).filter("change IS NOT NULL").select(key, "change")


def canonical_upsert(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key: the smallest tuple of `columns` (nulls first), whatever the order of arrival, and the occurrences."""
    b = df.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("b"), F.count("*").alias("occurrences"))
    return b.select(*keys, *[F.col(f"b.{c}").alias(c) for c in columns], "occurrences")


def merge_keep_best(df: DataFrame, keys: list[str], maxima: list[str], first_text: str, order: list[str]) -> DataFrame:
    """Upsert as an aggregate: rows, maxima, and the first non-empty text in the given order."""
    text = F.when(F.col(first_text) != "", F.struct(*order, first_text))
    agg = df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.max(m).alias(f"max_{m}") for m in maxima], F.min(text).alias("__t"))
    return agg.withColumn(first_text, F.col(f"__t.{first_text}")).drop("__t")


def facet_intersection(refs: DataFrame, unit: str, facet: str, wanted: list[str]) -> DataFrame:
    """Units that carry every wanted facet; no facet wanted allows none."""
    hits = refs.filter(F.col(facet).isin(wanted)) if wanted else refs.filter(F.lit(False))
    return hits.groupBy(unit).agg(F.countDistinct(facet).alias("n")).filter(F.col("n") == len(set(wanted))).select(unit)


def missing_endpoints(edges: DataFrame, ends: list[str], nodes: DataFrame, node: str) -> DataFrame:
    """Edges with at least one non-null end that is no node, with the ends that are missing."""
    listed = F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("id")) for e in ends])
    ids = edges.select("edge_id", F.inline(listed)).filter("id IS NOT NULL").distinct()
    return ids.join(nodes.select(F.col(node).alias("id")).distinct(), "id", "left_anti")
