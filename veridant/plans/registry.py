"""All core queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veridant.plans import chart_queries, data_quality, evidence, merge_queries, metric_queries, projection_queries, rollups, router_queries, search_queries, spine_queries, validation_queries  # noqa: F401
from veridant.plans.data_quality_sql import ORACLE_SQL

FLAGSHIP = evidence.latest_context_depth


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return data_quality.QUERIES | evidence.QUERIES | rollups.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | evidence.SQL | rollups.SQL
