"""Artifacts of documents to base tables: objects, support links, edges, quality events, filings, series dimensions."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT_SCHEMA = "id string, type string, ticker string, document_type string, period string, review_status string, text string, claim_text string, quote_text string, description string, source_span_id string, supported_by_quotes array<string>, supported_by_claims array<string>, source_fact_ids array<string>, source_metric_ids array<string>"
EDGE_SCHEMA = "id string, from_id string, to_id string, relation_name string, evidence_level string, edge_class string"
EVENT_SCHEMA = "id string, stage string, reason string, severity string, ticker string"
FILING_SCHEMA = "cik string, form string, accession string, report_date string, filing_date string, url string"
# Text fields of an object in the order in which they are searched.
TEXT_FIELDS = ("text", "claim_text", "quote_text", "description")
# Reference fields of an object and the kind of link that each makes.
REFERENCES = {"supported_by_quotes": "quote", "supported_by_claims": "claim", "source_fact_ids": "fact", "source_metric_ids": "metric"}


class ObservationProvider(Protocol):
    """What a source of observations offers: its name, and the readings of a series as a DataFrame.

    The columns are series_key, phenomenon_time, value, result_time, vintage.
    """

    name: str

    def fetch(self, spark: SparkSession, series_key: str, start: str | None, end: str | None) -> DataFrame: ...


def object_rows(objects: DataFrame) -> DataFrame:
    """Objects as rows with the text that is searched; a null review status counts as not rejected.

    The newest of equal ids is not known here: repeated rows stay.
    """
    text = F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in TEXT_FIELDS])
    return objects.filter("id IS NOT NULL").withColumns({"searchable": text, "rejected": F.coalesce(F.col("review_status") == "rejected", F.lit(False))})


def support_links(objects: DataFrame) -> DataFrame:
    """(object_id, support_id, kind): one row for each reference whose target is among the objects, once."""
    refs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("ids")) for c, kind in REFERENCES.items()])
    each = objects.select(F.col("id").alias("object_id"), F.inline(refs)).select("object_id", "kind", F.explode("ids").alias("support_id")).filter("support_id != ''").distinct()
    return each.join(objects.select(F.col("id").alias("support_id")).distinct(), "support_id", "left_semi").select("object_id", "support_id", "kind")


def quality_events(*sources: DataFrame) -> DataFrame:
    """The events of all sources under one schema; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def merged_fragments(fragments: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of all fragments, the last fragment that has a key winning; of equal keys in one fragment the greatest row."""
    tagged = [f.withColumn("__at", F.lit(i)) for i, f in enumerate(fragments)]
    rows = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in rows.columns if c not in (*key, "__at")]
    best = rows.groupBy(*key).agg(F.max(F.struct("__at", *rest)).alias("b"))
    return best.select(*key, *[F.col(f"b.{c}").alias(c) for c in rest])


def period_key(form: Column, report_date: Column, filing_date: Column) -> Column:
    """CYyyyy, or CYyyyyQq for quarterly forms, of the report date or else the filing date; unknown without a year."""
    day = F.coalesce(F.nullif(report_date, F.lit("")), filing_date)
    year = F.when(day.rlike(r"^\d{4}"), F.left(day, F.lit(4))).otherwise("unknown")
    quarter = F.quarter(F.try_to_date(day))
    return F.when(form == "10-Q", F.concat(F.lit("CY"), year, F.lit("Q"), F.coalesce(quarter.cast("string"), F.lit("?")))).otherwise(F.concat(F.lit("CY"), year))


def filings_of(filings: DataFrame, cik: str, forms: list[str]) -> DataFrame:
    """All filings of the forms asked for, newest first; no form means every form."""
    f = filings.filter(F.col("cik") == cik)
    f = f.filter(F.col("form").isin(forms)) if forms else f
    return f.withColumn("period", period_key(F.col("form"), F.col("report_date"), F.col("filing_date"))).orderBy(F.col("filing_date").desc(), "accession")


def chosen_filing(filings: DataFrame, form: str, period: str | None = None) -> DataFrame:
    """The newest filing of a form for each company, or the newest of one period."""
    f = filings.filter(F.col("form") == form).withColumn("period", period_key(F.col("form"), F.col("report_date"), F.col("filing_date")))
    f = f.filter(F.col("period") == period) if period else f
    b = f.groupBy("cik").agg(F.max(F.struct("filing_date", "accession", "report_date", "url", "period")).alias("b"))
    return b.select("cik", "b.*")


def resolve_tickers(asked: DataFrame, directory: DataFrame) -> DataFrame:
    """Tickers asked for with their company number, zero-padded to ten digits; unknown ones have null. Case and blanks are ignored."""
    known = directory.select(F.upper(F.trim("ticker")).alias("__t"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik")).groupBy("__t").agg(F.min("cik").alias("cik"))
    return asked.join(known, F.upper(F.trim("ticker")) == F.col("__t"), "left").drop("__t")


def series_dimension(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The series of a seed as a relation; keys must be there and unique, frequencies known."""
    keys = [r.get("series_key") for r in rows]
    if None in keys or len(set(keys)) != len(keys):
        raise ValueError("series keys must be given and unique")
    if bad := sorted({r.get("frequency") for r in rows} - {"daily", "weekly", "monthly", "quarterly"}, key=str):
        raise ValueError(f"unknown frequencies: {bad}")
    schema = "series_key string, domain string, canonical_metric string, unit string, frequency string, provider string"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def stale_items(current: DataFrame, previous: DataFrame, unit: str, digest: str) -> DataFrame:
    """Units with inputs that are new, gone or changed since the last plan, with how many; unchanged units do not come out."""
    c = current.select(unit, "path", F.col(digest).alias("now"))
    p = previous.select(unit, "path", F.col(digest).alias("then"))
    j = c.join(p, [unit, "path"], "full").filter("NOT now <=> then")
    return j.groupBy(unit).agg(F.count_if(F.col("then").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("removed"), F.count_if(F.col("now").isNotNull() & F.col("then").isNotNull()).alias("changed"))
