"""Evidence lineage and staged validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trace_status(objects: DataFrame, support: DataFrame) -> DataFrame:
    """complete, partial, orphan or index_only of each object, with its support counts.

    objects: object_id, object_type; support: from_object_id (the evidence), to_object_id. Quotes stand for
    themselves; a claim needs a quote; other kinds are complete with a quote, partial with a
    claim or metric only, else orphans; kinds outside the evidence model are index_only.
    """
    kinds = objects.select("object_id", "object_type").distinct()
    given = support.select(F.col("from_object_id").alias("s"), F.col("to_object_id").alias("object_id")).distinct().join(kinds.select(F.col("object_id").alias("s"), F.col("object_type").alias("k")), "s")
    counts = given.groupBy("object_id").agg(F.count_if(F.col("k") == "EvidenceQuote").alias("quotes"), F.count_if(F.col("k") == "ResearchClaim").alias("claims"), F.count_if(F.col("k") == "FinancialMetric").alias("metrics"))
    o = kinds.join(counts, "object_id", "left").na.fill(0, ["quotes", "claims", "metrics"])
    status = (
        F.when(F.col("object_type") == "EvidenceQuote", "complete")
        .when(~F.col("object_type").isin("ResearchClaim", "FinancialMetric", "FactorExposure", "NamedEntity"), "index_only")
        .when(F.col("quotes") > 0, "complete")
        .when((F.col("claims") > 0) | (F.col("metrics") > 0), "partial")
        .otherwise("orphan")
    )
    return o.withColumns({"trace_status": status, "trace_depth": F.when(F.col("quotes") > 0, 1).when(F.col("claims") > 0, 2).otherwise(0)})


def staged_rejects(spans: DataFrame) -> DataFrame:
    """First failing check of each span: schema, offsets, count, section; null stage if accepted."""
    stage = (
        F.when(F.col("id").isNull() | F.col("text").isNull() | (F.col("text") == ""), "schema")
        .when(F.col("start_char").isNull() | F.col("end_char").isNull() | (F.col("end_char") < F.col("start_char")), "offsets")
        .when(~F.col("char_count").eqNullSafe(F.length("text")), "count")
        .when(F.col("section_name").isNull(), "section")
    )
    return spans.withColumn("stage", stage)
