"""Queries p1 to p6: data quality and alignment of the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridant.functions.periods import frequency_code, period_day
from veridant.functions.timeparse import parse_instant
from veridant.operators.asof import as_of_join, validity_intervals
from veridant.operators.orphans import current_orphans, existence_deltas, normal_key, orphan_references, orphan_report, signed_counts
from veridant.operators.regular_grid import regularize
from veridant.operators.spikes import flag_readings
from veridant.operators.timestamps import resolve_times
from veridant.operators.units import to_common_units
from veridant.session import cut_lineage, spread, table

REMOVED = ("deleted", "tombstoned", "removed")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per series: repeated rows agree, or the greatest non-null spelling counts."""
    c = table(spark, sf_dir, "series_catalog").filter("series_key IS NOT NULL")
    return c.groupBy("series_key").agg(F.max(frequency_code(F.col("frequency"))).alias("code"), F.max("canonical_metric").alias("metric"), F.max("unit").alias("unit"))


# --- 1: doubtful readings

#: Quantities that cannot be negative, by metric or unit; and rates set in steps, which may stand still.
COUNTED = "metric LIKE '%index%' OR metric LIKE '%starts%' OR metric LIKE '%claims%' OR metric LIKE '%unemployment%' OR unit IN ('index', 'persons', 'thousand units')"


def p1_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All doubtful readings with their table, field and reason."""
    o = spread(table(spark, sf_dir, "observations").select("observation_id", "series_key", "phenomenon_time", "value").filter("value IS NOT NULL"))
    o = parse_instant(o, F.col("phenomenon_time"), F.lit("UTC"), "sec").join(_catalog(spark, sf_dir), "series_key", "left")
    kind = F.when(F.col("metric").like("%price%") | F.col("series_key").like("price_close:%"), "price").when(F.col("metric") == "policy_rate", "rate_steps").when(F.expr(COUNTED), "count").otherwise("level")
    period = F.unix_date(period_day(F.col("sec"), F.coalesce("code", F.lit("D"))))
    # levels are judged and verdicts joined back, so the parsed rows are read twice
    rows = o.select(F.lit("observations").alias("table_name"), "observation_id", F.lit("value").alias("field_name"), F.col("series_key").alias("source"), period.alias("period"), "value", kind.alias("kind"))
    h = spread(table(spark, sf_dir, "ohlcv_observations").select("observation_id", "ticker", "trade_date", "close", "volume"))
    h = parse_instant(h, F.col("trade_date"), F.lit("UTC"), "sec")
    fields = F.array(F.struct(F.lit("close").alias("field_name"), F.col("close").alias("value"), F.lit("price").alias("kind")), F.struct(F.lit("volume").alias("field_name"), F.col("volume").alias("value"), F.lit("volume").alias("kind")))
    h = h.select(F.lit("ohlcv_observations").alias("table_name"), "observation_id", F.col("ticker").alias("source"), F.unix_date(period_day(F.col("sec"), F.lit("D"))).alias("period"), F.inline(fields))
    return flag_readings(cut_lineage(rows.unionByName(h)), ["table_name", "source", "field_name"], "period", "value", F.col("kind"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubtful readings of observations and daily bars."""
    return p1_readings(spark, sf_dir).select("table_name", "observation_id", "field_name").distinct()


def p1_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubtful readings by table, field and what is wrong with them: impossible, spike or stuck."""
    return p1_readings(spark, sf_dir).groupBy("table_name", "field_name", "reason").agg(F.countDistinct("observation_id").alias("readings"))


# --- 2: regular series


def p2_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every period of every series with its reading or its smoothed fill."""
    o = table(spark, sf_dir, "observations").select("series_key", "phenomenon_time", "value", F.coalesce("result_time", "vintage").alias("known")).filter("value IS NOT NULL")
    o = spread(o)
    o = parse_instant(o, F.col("phenomenon_time"), F.lit("UTC"), "sec").join(_catalog(spark, sf_dir).filter("code IS NOT NULL"), "series_key")
    return regularize(o, "series_key", "sec", "value", "code", "known")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing periods between the first and the last reading of each series."""
    return p2_grid(spark, sf_dir).filter("missing").select("series_key", F.col("period_start").cast("string").alias("period_start"))


def p2_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each series its periods and missing ones; every period must be filled with a finite value and error, and readings kept as they are."""
    g = p2_grid(spark, sf_dir)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sound = finite("filled") & finite("smoothed") & finite("std_error") & (F.col("std_error") >= 0) & (F.col("missing") == F.col("reading").isNull()) & (F.col("missing") | (F.col("filled") == F.col("reading")))
    return g.groupBy("series_key").agg(F.count("*").alias("periods"), F.count_if("missing").alias("missing"), F.bool_and(sound).alias("sound"))


# --- 3: common units


def p3_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest delivery of each chart point, with its value in common units."""
    points = table(spark, sf_dir, "chart_series_points").groupBy("series_key", "period").agg(F.max(F.struct("loaded_at", "value", "formatted_value")).alias("p"))
    points = points.select("series_key", "period", "p.value", "p.formatted_value")
    units = table(spark, sf_dir, "chart_series").groupBy("series_key").agg(F.max("unit").alias("unit"))
    return to_common_units(points.join(units, "series_key", "left"), "value", "formatted_value", "unit")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that are not in the common unit yet, with the power of ten to it."""
    return p3_points(spark, sf_dir).filter("exp10 != 0").select("series_key", "period", "exp10")


def p3_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in other than common units by what decided, the text or the unit, and whether signs alone or the index found its meaning."""
    return p3_points(spark, sf_dir).filter("exp10 != 0").groupBy("unit_evidence", F.col("unit_found_by").alias("found_by")).agg(F.count("*").alias("points"))


# --- 4: the macro reading known when asked


def _readings_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "observations").filter("value IS NOT NULL").select("observation_id", "series_key", "phenomenon_time", "result_time", "vintage"))
    for text in ("phenomenon_time", "result_time", "vintage"):
        o = parse_instant(o, F.col(text), F.lit("UTC"), f"{text}_sec")
    known = F.coalesce(F.when(F.col("result_time").isNotNull(), F.col("result_time_sec")), F.col("vintage_sec"))
    return o.withColumn("known_sec", known).filter("phenomenon_time_sec IS NOT NULL AND known_sec IS NOT NULL")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request with the reading of its series that was known when it was asked."""
    readings = _readings_known(spark, sf_dir).withColumn("change_sec", F.greatest("phenomenon_time_sec", "known_sec"))
    # both levels of the running best read the parsed readings
    readings = cut_lineage(readings.select("series_key", "observation_id", "change_sec", "phenomenon_time_sec", "known_sec", "vintage_sec"))
    intervals = validity_intervals(readings, "series_key", "change_sec", ["phenomenon_time_sec", "known_sec", "vintage_sec", "observation_id"])
    asked = table(spark, sf_dir, "context_requests").select("request_id", "series_key", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(requested_at AS TIMESTAMP_NTZ)) div 1000000").alias("asked_sec")).distinct()
    answered = as_of_join(asked, "series_key", "asked_sec", intervals)
    return answered.filter("best IS NOT NULL").select("request_id", F.col("best.observation_id").alias("observation_id")).distinct()


# --- 5: references that lead nowhere


def _micros(c: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({c} AS TIMESTAMP_NTZ))")


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "global_object_locator")
    return o.select(normal_key(F.col("object_id")).alias("key"), _micros("loaded_at").alias("at"), F.coalesce(F.lower(F.trim("quality_status")).isin(*REMOVED), F.lit(False)).alias("removed"))


EDGE_REFS = ("from_object_id", "to_object_id")


def _references(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per record and reference column, at the record's first delivery, with `extra` columns."""
    edges = table(spark, sf_dir, "global_edge_spine").select("edge_id", *EDGE_REFS, *extra, _micros("loaded_at").alias("at"))
    edges = edges.groupBy("edge_id").agg(F.min(F.struct("at", *EDGE_REFS, *extra)).alias("r"))
    named = F.array(*[F.struct(F.lit(c).alias("ref_column"), normal_key(F.col(f"r.{c}")).alias("key")) for c in EDGE_REFS])
    more = [F.col(f"r.{c}").alias(c) for c in extra]
    edges = edges.select(F.lit("global_edge_spine").alias("table_name"), F.col("edge_id").alias("record_key"), *more, F.col("r.at").alias("at"), F.inline(named))
    points = table(spark, sf_dir, "chart_series_points").select(F.concat_ws("@", "series_key", "period").alias("record_key"), "object_id", *extra, _micros("loaded_at").alias("at"))
    points = points.groupBy("record_key").agg(F.min(F.struct("at", "object_id", *extra)).alias("r"))
    points = points.select(F.lit("chart_series_points").alias("table_name"), "record_key", *more, F.col("r.at").alias("at"), F.lit("object_id").alias("ref_column"), normal_key(F.col("r.object_id")).alias("key"))
    return edges.unionByName(points).filter("key IS NOT NULL")


def _raw_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all deliveries, read without a shuffle."""
    edges = table(spark, sf_dir, "global_edge_spine").select(F.explode(F.array(*EDGE_REFS)).alias("key"))
    return edges.unionByName(table(spark, sf_dir, "chart_series_points").select(F.col("object_id").alias("key"))).select(normal_key(F.col("key")).alias("key"))


def p5_orphans(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return orphan_references(_references(spark, sf_dir, extra), _objects(spark, sf_dir), _raw_keys(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references with their kind; record, column and kind are unique already."""
    return p5_orphans(spark, sf_dir).select("table_name", "record_key", "ref_column", "kind")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references counted by table, period, column and kind."""
    return orphan_report(p5_orphans(spark, sf_dir, ("period",)))


#: Microseconds since 1970 up to which p5_current takes the counts as kept state: 2024-01-01. Any time gives the same report.
KEPT_UNTIL = 1704067200 * 10**6


def p5_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that records refer to and that do not exist after all deliveries, with their signed counts.

    The counts are maintained: those of all deltas up to KEPT_UNTIL are the state to which later deltas are added.
    """
    references = _references(spark, sf_dir).select("key", "at", F.lit(1).alias("delta"))
    existence = existence_deltas(_objects(spark, sf_dir))
    early = F.col("at") <= KEPT_UNTIL
    state = signed_counts(references.filter(early), existence.filter(early))
    return current_orphans(signed_counts(references.filter(~early), existence.filter(~early), state))


# --- 6: one UTC instant for every written time


#: Dates with slashes put the month first, unless the values of a source outweigh that.
CONVENTION = {"slash": 50.0}


def p6_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time of the four tables with its instant, format, posterior and ambiguity."""
    t = lambda name: table(spark, sf_dir, name)
    rows = [
        t("polygon_daily").select(F.lit("polygon_daily").alias("table_name"), F.col("record_id").cast("string").alias("record_id"), F.col("t").cast("string").alias("written"), F.lit("UTC").alias("zone")),
        t("fmp_price").select(F.lit("fmp_price").alias("table_name"), F.col("record_id").cast("string").alias("record_id"), F.col("date").alias("written"), F.col("exchange_tz").alias("zone")),
        t("fred_cpi").select(F.lit("fred_cpi").alias("table_name"), F.col("record_id").cast("string").alias("record_id"), F.col("realtime_start").alias("written"), F.lit("America/New_York").alias("zone")),
        t("observations").select(F.lit("observations").alias("table_name"), F.col("observation_id").alias("record_id"), F.col("phenomenon_time").alias("written"), F.lit("UTC").alias("zone")),
    ]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    return resolve_times(union, "table_name", "written", F.col("zone"), CONVENTION)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable times not already in their table's plain form, as UTC text."""
    r = p6_instants(spark, sf_dir).filter("utc_sec IS NOT NULL AND NOT time_ambiguous")
    plain = F.when(F.col("table_name") == "polygon_daily", F.col("time_format") == "epoch_ms").otherwise(F.col("written").rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}Z)?$"))
    return r.filter(~plain).select("table_name", "record_id", "utc_time").distinct()


def p6_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable times of distinct records by table and by what decided: one reading, or the mixture of several; and how many it left open."""
    r = p6_instants(spark, sf_dir).filter("time_readings > 0")
    decided = F.when(F.col("time_readings") > 1, "mixture").otherwise("single")
    r = r.select("table_name", "record_id", "written", decided.alias("decided_by"), "time_ambiguous").distinct()
    return r.groupBy("table_name", "decided_by").agg(F.count("*").alias("times"), F.count_if("time_ambiguous").alias("unresolved"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_grid": p2_grid, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_report": p5_report, "p5_current": p5_current, "p6_found": p6_found, "p1_evidence": p1_evidence, "p2_checks": p2_checks, "p3_evidence": p3_evidence, "p6_evidence": p6_evidence}
