"""Queries over the evidence and metric tables, each with its SQL counterpart.

Every query reads its whole tables. Constants such as search terms, prefixes or k are what a
caller would ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridant.functions.text_units import compact_number, period_sort_key, section_key, slug, valid_period
from veridant.functions.timeparse import parse_instant, utc_text
from veridant.operators import graph, lineage, links, ranking, relational, series, textsearch
from veridant.plans.data_quality_sql import _instants
from veridant.session import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
TERMS = ["revenue", "segment", "freight", "margin"]
_LIST = ", ".join(f"'{t}'" for t in TERMS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- series with vintages


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Distinct readings with the UTC instant they are of and the seconds from which they were known; unreadable times are left out.

    A reading is known from its result time, if that is null from its vintage. Spellings of one instant are one key.
    """
    o = spread(_t(spark, d, "observations").select("series_key", "observation_id", "phenomenon_time", "value", "result_time", "vintage"))
    for text in ("phenomenon_time", "result_time", "vintage"):
        o = parse_instant(o, F.col(text), F.lit("UTC"), f"{text}_sec")
    known = F.when(F.col("result_time").isNotNull(), F.col("result_time_sec")).otherwise(F.col("vintage_sec"))
    o = o.filter("phenomenon_time_sec IS NOT NULL").select("series_key", "observation_id", utc_text(F.col("phenomenon_time_sec")).alias("phenomenon_time"), "value", known.alias("known_sec"), "vintage_sec")
    return o.distinct()


_KNOWN = f"""{_instants("o", "SELECT series_key, observation_id, phenomenon_time t, 'UTC' z, value, result_time, regexp_replace(vintage, '^([0-9]{4})([0-9]{2})([0-9]{2})$', '\\1-\\2-\\3') v FROM observations")},
    kn AS (SELECT DISTINCT series_key, observation_id, strftime(u, '%Y-%m-%dT%H:%M:%SZ') phenomenon_time, value, CASE WHEN result_time IS NOT NULL THEN timezone('UTC', try_cast(CASE WHEN length(result_time) = 10 THEN result_time || ' 00:00:00+00' ELSE result_time END AS TIMESTAMPTZ)) ELSE try_cast(nullif(v, '') AS TIMESTAMP) END known, try_cast(nullif(v, '') AS TIMESTAMP) vt FROM o WHERE u IS NOT NULL)"""


@query(
    f"""WITH {_KNOWN} SELECT series_key, phenomenon_time, observation_id, value FROM (SELECT *, row_number() OVER (PARTITION BY series_key, phenomenon_time
    ORDER BY known DESC NULLS LAST, vt DESC NULLS LAST, observation_id DESC, value DESC NULLS LAST) rn FROM kn) WHERE rn = 1"""
)
def latest_vintage(spark, d):
    """Newest vintage of every reading; one row for each series and instant, however its time is spelled."""
    return series.latest_vintage(_known(spark, d), ["series_key", "phenomenon_time"], ["observation_id", "value"])


@query(
    f"""WITH {_KNOWN} SELECT series_key, phenomenon_time, superseded_id, superseding_id, old_value, new_value FROM (SELECT series_key, phenomenon_time, lag(observation_id) OVER w superseded_id, observation_id superseding_id,
    lag(value) OVER w old_value, value new_value FROM kn WINDOW w AS (PARTITION BY series_key, phenomenon_time ORDER BY known ASC NULLS FIRST, vt ASC NULLS FIRST, observation_id ASC, value ASC NULLS FIRST)) WHERE superseded_id IS NOT NULL"""
)
def revision_chain(spark, d):
    """Which vintage supersedes which."""
    return series.revision_chain(_known(spark, d), ["series_key", "phenomenon_time"])


@query(
    f"""WITH {_KNOWN}, r AS (SELECT kn.*, row_number() OVER (w ORDER BY known NULLS FIRST, vt NULLS FIRST, observation_id, value) up, row_number() OVER (w ORDER BY known DESC NULLS LAST, vt DESC NULLS LAST, observation_id DESC, value DESC) down
    FROM kn JOIN (SELECT DISTINCT series_key FROM series_catalog WHERE domain = 'macro') USING (series_key) WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series_key, phenomenon_time))
    SELECT series_key, phenomenon_time, max(value) FILTER (up = 1) first_value, max(value) FILTER (down = 1) latest_value, count(DISTINCT observation_id) - 1 revision_count, round(max(value) FILTER (down = 1) - max(value) FILTER (up = 1), 6) revision FROM r GROUP BY 1, 2"""
)
def release_events(spark, d):
    """First and newest value of each macro release."""
    macro = _t(spark, d, "series_catalog").filter("domain = 'macro'").select("series_key").distinct()
    return series.release_events(_known(spark, d).join(macro, "series_key"), ["series_key", "phenomenon_time"])


@query(
    f"""WITH {_KNOWN}, r AS (SELECT series_key, phenomenon_time, max(value) value, max(known) known FROM kn JOIN (SELECT DISTINCT series_key FROM series_catalog WHERE domain = 'macro') USING (series_key) WHERE value IS NOT NULL GROUP BY ALL)
    SELECT series_key, phenomenon_time, value FROM r ORDER BY known DESC NULLS LAST, phenomenon_time DESC, series_key LIMIT 50"""
)
def recent_releases(spark, d):
    """The 50 macro releases known last: by known time, then instant, newest first; unknown ones last."""
    macro = _t(spark, d, "series_catalog").filter("domain = 'macro'").select("series_key").distinct()
    r = _known(spark, d).filter("value IS NOT NULL").join(macro, "series_key").groupBy("series_key", "phenomenon_time").agg(F.max("value").alias("value"), F.max("known_sec").alias("known"))
    return r.orderBy(F.col("known").desc_nulls_last(), F.col("phenomenon_time").desc(), "series_key").limit(50).drop("known")


@query(
    f"""WITH {_instants("o", "SELECT series_key, phenomenon_time t, 'UTC' z, value FROM observations WHERE value IS NOT NULL")},
    c AS (SELECT series_key, max(lower(substr(trim(frequency), 1, 1))) = 'q' q FROM series_catalog GROUP BY 1),
    p AS (SELECT o.series_key, 'CY' || year(u) || CASE WHEN q THEN 'Q' || quarter(u) ELSE 'M' || lpad(month(u)::varchar, 2, '0') END AS period, u::date dy, value FROM o JOIN c USING (series_key) WHERE u IS NOT NULL)
    SELECT series_key, period, max(dy) last_day, max(struct_pack(dy := dy, v := value)).v AS value, count(*) readings FROM p GROUP BY 1, 2"""
)
def month_end_downsample(spark, d):
    """Last reading of each month or quarter by UTC day, however its time is written; unreadable times are left out."""
    o = spread(_t(spark, d, "observations").select("series_key", "phenomenon_time", "value").filter("value IS NOT NULL"))
    o = parse_instant(o, F.col("phenomenon_time"), F.lit("UTC"), "sec").withColumn("day", F.date_from_unix_date(F.floor(F.col("sec") / 86400).cast("int")))
    c = _t(spark, d, "series_catalog").groupBy("series_key").agg((F.max(F.lower(F.substring(F.trim("frequency"), 1, 1))) == "q").alias("q"))
    return series.downsample(o.join(c, "series_key"), "series_key", "day", "value", F.coalesce("q", F.lit(False)))


@query(
    """SELECT ticker, trade_date, max(struct_pack(i := observation_id, c := close, v := volume)).i AS observation_id, max(struct_pack(i := observation_id, c := close, v := volume)).c AS close,
    max(struct_pack(i := observation_id, c := close, v := volume)).v AS volume FROM (SELECT observation_id, ticker, trade_date, max(close) AS close, max(volume) AS volume FROM ohlcv_observations GROUP BY 1, 2, 3) GROUP BY 1, 2"""
)
def ohlc_current_view(spark, d):
    """One bar per ticker and day."""
    o = _t(spark, d, "ohlcv_observations").groupBy("observation_id", "ticker", "trade_date").agg(F.max("close").alias("close"), F.max("volume").alias("volume"))
    b = o.groupBy("ticker", "trade_date").agg(F.max(F.struct("observation_id", "close", "volume")).alias("b"))
    return b.select("ticker", "trade_date", "b.observation_id", "b.close", "b.volume")


# --- chart series


def _points(spark, d):
    """Distinct points with their series' attributes."""
    p = _t(spark, d, "chart_series_points").select("series_key", "period", "fiscal_year", "fiscal_quarter", "period_sort_key", "source_sort_key", "value", "object_id", "document_type").distinct()
    s = _t(spark, d, "chart_series").select("series_key", "ticker", "canonical_metric", "unit", "scope_kind", "scope_key", "period_type", "basis", "source_class").distinct()
    return p.join(s, "series_key")


_POINTS = """p AS (SELECT DISTINCT series_key, period, fiscal_year, fiscal_quarter, period_sort_key, source_sort_key, value, object_id, document_type FROM chart_series_points),
s AS (SELECT DISTINCT series_key, ticker, canonical_metric, unit, scope_kind, scope_key, period_type, basis, source_class FROM chart_series), ps AS (SELECT * FROM p JOIN s USING (series_key))"""
_METRIC = ["ticker", "canonical_metric", "unit", "scope_kind", "scope_key", "period_type"]
_M = ", ".join(_METRIC)


@query(
    f"""WITH {_POINTS}, v AS (SELECT {_M}, fiscal_year, fiscal_quarter, period, value, max(struct_pack(k := source_sort_key, o := object_id)) f FROM ps WHERE value IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY {_M} ORDER BY fiscal_year DESC NULLS LAST, fiscal_quarter DESC NULLS LAST, period DESC NULLS LAST) context_rank FROM v)
    SELECT {_M}, period, value, f.o AS object_id, context_rank, count(*) OVER (PARTITION BY {_M}, fiscal_year, fiscal_quarter, period) > 1 AS conflict FROM r WHERE context_rank <= 4"""
)
def latest_context_depth(spark, d):
    """Newest four periods of each metric series with conflict flags."""
    return series.latest_contexts(_points(spark, d), _METRIC, 4)


def _change_sql(gap: str) -> str:
    return f"""WITH {_POINTS}, a AS (SELECT {_M}, fiscal_year, fiscal_quarter, min(value) AS value, max(value) AS top FROM ps WHERE value IS NOT NULL AND fiscal_year IS NOT NULL GROUP BY ALL),
    v AS (SELECT *, CASE WHEN fiscal_quarter IS NULL THEN fiscal_year * 10 ELSE (fiscal_year * 4 + fiscal_quarter) * 10 + 1 END i FROM a WHERE value = top)
    SELECT {", ".join("n." + m for m in _METRIC)}, n.fiscal_year, n.fiscal_quarter, o.value previous_value, n.value, n.value - o.value absolute_change,
    CASE WHEN o.value > 0 AND n.value >= 0 THEN n.value / o.value - 1 END growth_rate
    FROM v n JOIN v o ON {" AND ".join(f"n.{m} = o.{m}" for m in _METRIC)} AND o.i = n.i - CASE WHEN n.fiscal_quarter IS NULL THEN 10 ELSE {gap} END"""


@query(_change_sql("10"))
def growth_adjacent(spark, d):
    """Change and growth from period to period."""
    return series.period_changes(_points(spark, d), _METRIC, "adjacent")


@query(_change_sql("40"))
def growth_year_over_year(spark, d):
    """Change and growth against the same period a year before."""
    return series.period_changes(_points(spark, d), _METRIC, "year")


@query(
    f"""WITH {_POINTS}, k AS (SELECT ticker, canonical_metric, unit, period, scope_kind, scope_key, value FROM ps WHERE unit IS NOT NULL),
    t AS (SELECT ticker, canonical_metric, unit, period, min(value) total FROM k WHERE scope_kind = 'company' AND value > 0 GROUP BY ALL HAVING min(value) = max(value))
    SELECT ticker, canonical_metric, unit, period, scope_key, max(value) AS value, any_value(total) total, round(max(value) / any_value(total), 6) share FROM k JOIN t USING (ticker, canonical_metric, unit, period)
    WHERE scope_kind <> 'company' AND value IS NOT NULL GROUP BY ALL"""
)
def share_of_total(spark, d):
    """Share of each segment in its company's total."""
    return series.share_of_total(_points(spark, d).filter("unit IS NOT NULL"), ["ticker", "canonical_metric", "unit", "period"])


@query(
    f"""WITH {_POINTS}, v AS (SELECT series_key, period, period_sort_key, max(value) AS value FROM ps GROUP BY ALL), l AS (SELECT *, lag(value) OVER (PARTITION BY series_key ORDER BY period_sort_key, period) previous_value FROM v)
    SELECT series_key, period, value, previous_value, CASE WHEN value > previous_value THEN 'up' WHEN value < previous_value THEN 'down' ELSE 'flat' END direction FROM l WHERE value IS NOT NULL AND previous_value IS NOT NULL"""
)
def trend_direction(spark, d):
    """Direction of each point of a chart series."""
    p = _points(spark, d).groupBy("series_key", "period", "period_sort_key").agg(F.max("value").alias("value"))
    return series.trend(p, ["series_key"], ["period_sort_key", "period"]).select("series_key", "period", "value", "previous_value", "direction")


@query(
    """WITH v AS (SELECT series_key, period, period_sort_key, max(value) AS value FROM chart_series_points GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY period_sort_key DESC, period DESC) rn FROM v)
    SELECT series_key, period, period_sort_key, value, row_number() OVER (PARTITION BY series_key ORDER BY period_sort_key, period) AS position FROM r WHERE rn <= 8"""
)
def latest_points(spark, d):
    """Newest eight points of each series, oldest first."""
    p = _t(spark, d, "chart_series_points").groupBy("series_key", "period", "period_sort_key").agg(F.max("value").alias("value"))
    return series.latest_points(p, "series_key", "period_sort_key", 8)


@query(
    """WITH p AS (SELECT series_key, count(DISTINCT period) n FROM chart_series_points GROUP BY 1), s AS (SELECT series_key, max(point_count) declared FROM chart_series GROUP BY 1)
    SELECT coalesce(s.series_key, p.series_key) series_key, declared, coalesce(n, 0) actual, CASE WHEN s.series_key IS NULL THEN 'orphan' WHEN p.series_key IS NULL THEN 'empty' ELSE 'count' END issue
    FROM s FULL JOIN p ON s.series_key = p.series_key WHERE declared IS DISTINCT FROM coalesce(n, 0)"""
)
def declared_point_counts(spark, d):
    """Series whose declared number of points is not the actual one."""
    p = _t(spark, d, "chart_series_points").groupBy("series_key").agg(F.countDistinct("period").alias("n"))
    s = _t(spark, d, "chart_series").groupBy("series_key").agg(F.max("point_count").alias("declared"), F.lit(True).alias("is_series"))
    j = s.join(p, "series_key", "full_outer")
    issue = F.when(F.col("is_series").isNull(), "orphan").when(F.col("n").isNull(), "empty").otherwise("count")
    return j.select("series_key", "declared", F.coalesce("n", F.lit(0)).alias("actual"), issue.alias("issue")).filter("NOT declared <=> actual")


@query(
    """SELECT DISTINCT period, CASE WHEN regexp_matches(period, '^CY[0-9]{4}Q[1-4]$') THEN (substr(period, 3, 4) || substr(period, 8, 1))::int WHEN regexp_matches(period, '^(FY|CY)[0-9]{4}$') THEN (substr(period, 3, 4) || '5')::int END sort_key,
    regexp_matches(period, '^(FY[0-9]{4}|CY[0-9]{4}(Q[1-4])?)$') AS valid FROM chart_series_points"""
)
def period_labels(spark, d):
    """Sort key and validity of every period label in use."""
    return _t(spark, d, "chart_series_points").select("period").distinct().select("period", period_sort_key(F.col("period")).alias("sort_key"), valid_period(F.col("period")).alias("valid"))


@query(
    """SELECT CASE WHEN grouping(document_type) = 1 THEN 'overall' ELSE document_type END stratum, count(*) n, count(DISTINCT ticker) tickers, sum(CASE WHEN trace_status = 'complete' THEN 1 ELSE 0 END) complete_n,
    round(avg(CASE WHEN trace_status = 'complete' THEN 1.0 ELSE 0.0 END), 6) complete_share FROM (SELECT DISTINCT series_key, period, ticker, document_type, trace_status FROM chart_series_points) GROUP BY GROUPING SETS ((), (document_type))"""
)
def overall_and_strata(spark, d):
    """Trace completeness overall and for each form, in one pass."""
    p = _t(spark, d, "chart_series_points").select("series_key", "period", "ticker", "document_type", "trace_status").distinct()
    done = (F.col("trace_status") == "complete").cast("int")
    g = p.rollup("document_type").agg(F.grouping("document_type").alias("g"), F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"), F.sum(F.coalesce(done, F.lit(0))).alias("complete_n"), F.round(F.avg(F.coalesce(done, F.lit(0)).cast("double")), 6).alias("complete_share"))
    return g.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("document_type")).alias("stratum"), "n", "tickers", "complete_n", "complete_share")


# --- objects and edges


@query("SELECT DISTINCT object_id, ticker, object_type FROM global_object_locator WHERE object_id >= 'metric:' AND object_id < 'metric;'")
def prefix_range_scan(spark, d):
    """Objects whose id begins with metric:, as a range the scan can skip by."""
    return relational.prefix_scan(_t(spark, d, "global_object_locator"), "object_id", "metric:").select("object_id", "ticker", "object_type").distinct()


@query("SELECT document_type, object_type, count(*) n FROM global_object_locator WHERE document_type IN ('10-K') AND (quality_status IS NULL OR quality_status <> 'fail') GROUP BY ALL")
def scoped_filter(spark, d):
    """Counts of annual objects that did not fail."""
    o = relational.scope_filter(_t(spark, d, "global_object_locator"), document_type=["10-K"], ticker=[])
    return o.filter("quality_status IS NULL OR quality_status != 'fail'").groupBy("document_type", "object_type").agg(F.count("*").alias("n"))


@query(
    """SELECT ticker, company_name, n AS support FROM (SELECT ticker, company_name, count(*) n, row_number() OVER (PARTITION BY ticker ORDER BY count(*) DESC, company_name) rn FROM global_object_locator WHERE company_name IS NOT NULL GROUP BY 1, 2) WHERE rn = 1"""
)
def modal_company_name(spark, d):
    """Most frequent name of each ticker."""
    return relational.modal_value(_t(spark, d, "global_object_locator"), "ticker", "company_name")


@query(
    """SELECT lower(coalesce(quality_status, 'none')) status, count(*) n, count(DISTINCT ticker) tickers, sum(CASE WHEN document_type = '10-K' THEN 1 ELSE 0 END) annual, sum(coalesce(occurrence_count, 0)) occurrences FROM global_object_locator GROUP BY 1"""
)
def quality_rollup(spark, d):
    """Objects by quality status with conditional sums."""
    o = _t(spark, d, "global_object_locator").groupBy(F.lower(F.coalesce("quality_status", F.lit("none"))).alias("status"))
    return o.agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"), F.count_if(F.col("document_type") == "10-K").alias("annual"), F.sum(F.coalesce("occurrence_count", F.lit(0))).alias("occurrences"))


@query(
    """SELECT object_id, min(struct_pack(a := coalesce(semantic_hash, ''), b := ticker, c := coalesce(period, ''))).a semantic_hash, min(struct_pack(a := coalesce(semantic_hash, ''), b := ticker, c := coalesce(period, ''))).b ticker,
    min(struct_pack(a := coalesce(semantic_hash, ''), b := ticker, c := coalesce(period, ''))).c AS period, count(*) occurrences FROM global_object_locator GROUP BY 1"""
)
def canonical_upsert(spark, d):
    """One canonical row per object, whatever the order of deliveries."""
    o = _t(spark, d, "global_object_locator").select("object_id", F.coalesce("semantic_hash", F.lit("")).alias("semantic_hash"), "ticker", F.coalesce("period", F.lit("")).alias("period"))
    return relational.canonical_upsert(o, ["object_id"], ["semantic_hash", "ticker", "period"])


@query(
    """WITH a AS (SELECT object_id, max(object_hash) old FROM global_object_locator WHERE loaded_at < TIMESTAMP '2024-09-01' GROUP BY 1), b AS (SELECT object_id, max(object_hash) new FROM global_object_locator WHERE loaded_at >= TIMESTAMP '2024-03-01' GROUP BY 1)
    SELECT coalesce(a.object_id, b.object_id) object_id, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END change FROM a FULL JOIN b ON a.object_id = b.object_id WHERE old IS NULL OR new IS NULL OR old <> new"""
)
def manifest_diff(spark, d):
    """Objects added, removed or changed between two manifests."""
    o = _t(spark, d, "global_object_locator")
    part = lambda c: o.filter(c).groupBy("object_id").agg(F.max("object_hash").alias("h"))
    return relational.manifest_diff(part("loaded_at < TIMESTAMP_NTZ '2024-09-01 00:00:00'"), part("loaded_at >= TIMESTAMP_NTZ '2024-03-01 00:00:00'"), "object_id", "h")


@query("SELECT to_object_id, count(DISTINCT ticker) tickers, count(DISTINCT document_id) documents, count(*) refs, round(1 / sqrt(greatest(count(DISTINCT ticker), 1)), 6) weight, count(DISTINCT ticker) >= 25 generic FROM global_edge_spine WHERE to_object_id IS NOT NULL GROUP BY 1")
def key_statistics(spark, d):
    """How widely each object is referred to, with the weight of links through it."""
    return relational.key_statistics(_t(spark, d, "global_edge_spine"), "to_object_id", "ticker", "document_id")


@query(
    """SELECT from_ticker, relation_type, count(*) "rows", max(confidence) max_confidence, max(materiality) max_materiality, arg_min(compact_reason, edge_id) FILTER (compact_reason <> '') compact_reason FROM (SELECT DISTINCT edge_id, from_ticker, relation_type, confidence, materiality, compact_reason FROM global_edge_spine) GROUP BY 1, 2"""
)
def merge_keep_best(spark, d):
    """Upsert of relations by ticker: maxima and the first reason given."""
    e = _t(spark, d, "global_edge_spine").select("edge_id", "from_ticker", "relation_type", "confidence", "materiality", "compact_reason").distinct()
    return relational.merge_keep_best(e, ["from_ticker", "relation_type"], ["confidence", "materiality"], "compact_reason", ["edge_id"])


@query(
    """WITH x AS (SELECT DISTINCT edge_id, 'from_object_id' AS "end", from_object_id id FROM global_edge_spine UNION SELECT edge_id, 'to_object_id', to_object_id FROM global_edge_spine)
    SELECT id, edge_id, "end" FROM x WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM global_object_locator l WHERE l.object_id = x.id)"""
)
def missing_endpoints(spark, d):
    """Edge ends that are no object, by exact id."""
    return relational.missing_endpoints(_t(spark, d, "global_edge_spine"), ["from_object_id", "to_object_id"], _t(spark, d, "global_object_locator"), "object_id")


@query(
    """SELECT DISTINCT edge_id, from_object_id, relation_type, to_object_id FROM global_edge_spine e WHERE EXISTS (SELECT 1 FROM global_object_locator l WHERE l.object_id = e.from_object_id) AND EXISTS (SELECT 1 FROM global_object_locator l WHERE l.object_id = e.to_object_id)"""
)
def edge_projection(spark, d):
    """Edges of which both ends exist."""
    o = _t(spark, d, "global_object_locator").select("object_id").distinct()
    e = _t(spark, d, "global_edge_spine").select("edge_id", "from_object_id", "relation_type", "to_object_id").distinct()
    return e.join(o.withColumnRenamed("object_id", "from_object_id"), "from_object_id", "left_semi").join(o.withColumnRenamed("object_id", "to_object_id"), "to_object_id", "left_semi")


@query("SELECT from_ticker FROM (SELECT from_ticker, count(DISTINCT relation_type) n FROM global_edge_spine WHERE relation_type IN ('supports', 'drives', 'similar_topic') GROUP BY 1) WHERE n = 3")
def facet_intersection(spark, d):
    """Tickers with all of three relations."""
    return relational.facet_intersection(_t(spark, d, "global_edge_spine"), "from_ticker", "relation_type", ["supports", "drives", "similar_topic"])


_STEP = "round(greatest(least(0.42 * coalesce(confidence, 0.5) + 0.28 * coalesce(CASE upper(evidence_grade) WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.8 WHEN 'C' THEN 0.6 WHEN 'D' THEN 0.4 END::double, 0.58) + 0.15 * coalesce(materiality, 0.5) + 0.15 * coalesce(recency_score, 0.5), 1.0), 0.05), 6)"


@query(
    f"""WITH e AS (SELECT from_object_id, to_object_id, relation_type, max({_STEP}) score FROM global_edge_spine WHERE from_object_id IS NOT NULL AND to_object_id IS NOT NULL GROUP BY ALL)
    SELECT from_object_id, to_object_id, relation_type, score, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY from_object_id ORDER BY score DESC, to_object_id, relation_type) rn FROM e) WHERE rn <= 5"""
)
def top_neighbours(spark, d):
    """Best five neighbours of each object by step score."""
    s = graph.step_score("confidence", "evidence_grade", "materiality", "recency_score")
    e = _t(spark, d, "global_edge_spine").filter("from_object_id IS NOT NULL AND to_object_id IS NOT NULL").groupBy("from_object_id", "to_object_id", "relation_type").agg(F.max(s).alias("score"))
    return relational.top_per_group(e, ["from_object_id"], [F.col("score").desc(), F.col("to_object_id"), F.col("relation_type")], 5)


@query(
    """WITH e AS (SELECT DISTINCT from_ticker s, to_ticker t FROM global_edge_spine WHERE edge_scope = 'cross_company' AND from_ticker IS NOT NULL AND to_ticker IS NOT NULL),
    h AS (SELECT s, t, 1 h FROM e UNION ALL SELECT a.s, b.t, 2 FROM e a JOIN e b ON a.t = b.s UNION ALL SELECT a.s, c.t, 3 FROM e a JOIN e b ON a.t = b.s JOIN e c ON b.t = c.s) SELECT s AS start, t AS "end", min(h) hops FROM h WHERE s <> t GROUP BY 1, 2"""
)
def company_hops(spark, d):
    """Companies within three cross-company steps of each other."""
    return graph.hop_pairs(_t(spark, d, "global_edge_spine").filter("edge_scope = 'cross_company'"), "from_ticker", "to_ticker", 3)


@query(
    """WITH RECURSIVE r0 AS (SELECT from_object_id root FROM global_edge_spine WHERE from_object_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), n AS (SELECT DISTINCT from_object_id s, to_object_id t, relation_type r FROM global_edge_spine WHERE from_object_id IS NOT NULL AND to_object_id IS NOT NULL),
    nn AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY s ORDER BY r, t) <= 20), p AS (SELECT [root] path, []::varchar[] rel, 0 depth FROM r0 UNION ALL SELECT list_append(path, t), list_append(rel, r), depth + 1 FROM p JOIN nn ON s = path[len(path)] WHERE depth < 3 AND NOT list_contains(path, t))
    SELECT array_to_string(path, ' > ') path, array_to_string(rel, ' > ') relations, depth FROM (SELECT * FROM p WHERE depth > 0 ORDER BY depth, path, rel LIMIT 40)"""
)
def evidence_paths(spark, d):
    """Paths of up to three steps from the most referred-to object."""
    e = _t(spark, d, "global_edge_spine")
    root = e.filter("from_object_id IS NOT NULL").groupBy("from_object_id").count().orderBy(F.col("count").desc(), "from_object_id").first()
    p = graph.paths_from(e, "from_object_id", "to_object_id", "relation_type", [root[0]] if root else [])
    return p.select(F.array_join("path", " > ").alias("path"), F.array_join("relations", " > ").alias("relations"), "depth")


@query(
    """WITH m AS (SELECT DISTINCT compact_label AS label, ticker FROM global_object_locator WHERE compact_label IS NOT NULL AND ticker IS NOT NULL), c AS (SELECT label, min(ticker) representative, count(*) members FROM m GROUP BY 1 HAVING count(*) > 1)
    SELECT m.label, ticker, representative, members FROM m JOIN c ON m.label = c.label"""
)
def exact_key_classes(spark, d):
    """Tickers that share a topic label, as classes."""
    return links.key_classes(_t(spark, d, "global_object_locator").withColumnRenamed("compact_label", "label"), "label", "ticker")


@query(
    """WITH l AS (SELECT DISTINCT compact_label l, list_distinct(regexp_extract_all(lower(compact_label), '[a-z0-9]+')) ts FROM global_object_locator WHERE compact_label IS NOT NULL),
    t AS (SELECT l, len(ts) n, unnest(ts) w FROM l), c AS (SELECT a.l label_a, b.l label_b, any_value(a.n) na, any_value(b.n) nb, count(*) k FROM t a JOIN t b ON a.w = b.w AND a.l < b.l GROUP BY 1, 2)
    SELECT label_a, label_b, round(k / (na + nb - k), 6) jaccard FROM c WHERE k / (na + nb - k) >= 0.6 - 1e-12"""
)
def jaccard_links(spark, d):
    """Topic labels with similar words."""
    return links.jaccard_links(_t(spark, d, "global_object_locator"), "compact_label", 0.6)


@query()
def capped_links(spark, d):
    """Cross-company edges under the caps of a pair and of a company."""
    s = graph.step_score("confidence", "evidence_grade", "materiality", "recency_score")
    e = _t(spark, d, "global_edge_spine").filter("edge_scope = 'cross_company' AND from_ticker IS NOT NULL AND to_ticker IS NOT NULL").groupBy("edge_id").agg(F.min("from_ticker").alias("a"), F.min("to_ticker").alias("b"), F.max(s).alias("weight"))
    return links.cap_links(e, "a", "b", "weight")


@query(
    """WITH k AS (SELECT DISTINCT object_id, object_type FROM global_object_locator), g AS (SELECT DISTINCT from_object_id s, to_object_id o FROM global_edge_spine WHERE relation_type = 'supports' AND to_object_id IS NOT NULL AND from_object_id IS NOT NULL),
    c AS (SELECT o, sum(CASE WHEN object_type = 'EvidenceQuote' THEN 1 ELSE 0 END) q, sum(CASE WHEN object_type = 'ResearchClaim' THEN 1 ELSE 0 END) cl, sum(CASE WHEN object_type = 'FinancialMetric' THEN 1 ELSE 0 END) m FROM g JOIN k ON s = k.object_id GROUP BY 1)
    SELECT object_id, object_type, coalesce(q, 0) quotes, coalesce(cl, 0) claims, coalesce(m, 0) metrics, CASE WHEN object_type = 'EvidenceQuote' THEN 'complete' WHEN object_type NOT IN ('ResearchClaim', 'FinancialMetric', 'FactorExposure', 'NamedEntity') THEN 'index_only'
    WHEN coalesce(q, 0) > 0 THEN 'complete' WHEN coalesce(cl, 0) + coalesce(m, 0) > 0 THEN 'partial' ELSE 'orphan' END trace_status, CASE WHEN coalesce(q, 0) > 0 THEN 1 WHEN coalesce(cl, 0) > 0 THEN 2 ELSE 0 END trace_depth FROM k LEFT JOIN c ON c.o = k.object_id"""
)
def trace_status(spark, d):
    """How far each object can be traced to a quote."""
    support = _t(spark, d, "global_edge_spine").filter("relation_type = 'supports' AND from_object_id IS NOT NULL AND to_object_id IS NOT NULL")
    return lineage.trace_status(_t(spark, d, "global_object_locator"), support)


@query("""WITH r AS (SELECT ticker, document_id, filing_date, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC NULLS LAST, document_id DESC NULLS LAST) rn FROM global_object_locator), c AS (SELECT ticker, count(DISTINCT document_id) documents, count(DISTINCT CASE WHEN document_type = '10-K' THEN document_id END) annual FROM global_object_locator GROUP BY 1)
    SELECT c.ticker, document_id latest_document, filing_date latest_filing, documents, annual FROM c JOIN r ON c.ticker IS NOT DISTINCT FROM r.ticker WHERE rn = 1""")
def document_anchors(spark, d):
    """Latest document and document counts of each company."""
    o = _t(spark, d, "global_object_locator").groupBy("ticker").agg(F.max(F.struct("filing_date", "document_id")).alias("b"), F.countDistinct("document_id").alias("documents"), F.countDistinct(F.when(F.col("document_type") == "10-K", F.col("document_id"))).alias("annual"))
    return o.select("ticker", F.col("b.document_id").alias("latest_document"), F.col("b.filing_date").alias("latest_filing"), "documents", "annual")


@query("SELECT ticker FROM global_object_locator WHERE ticker IS NOT NULL UNION SELECT ticker FROM chart_series WHERE ticker IS NOT NULL UNION SELECT ticker FROM documents WHERE ticker IS NOT NULL")
def available_tickers(spark, d):
    """Tickers present in any table."""
    t = lambda n: _t(spark, d, n).select("ticker").filter("ticker IS NOT NULL")
    return t("global_object_locator").union(t("chart_series")).union(t("documents")).distinct()


@query(
    """WITH f AS (SELECT from_ticker ticker, relation_type, edge_id, coalesce(materiality, 0) m FROM (SELECT DISTINCT edge_id, from_ticker, relation_type, materiality FROM global_edge_spine) WHERE from_ticker IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY m DESC, edge_id) rn FROM f) SELECT ticker, edge_id, m AS materiality, rn AS turn FROM r ORDER BY rn, ticker LIMIT 200"""
)
def round_robin_merge(spark, d):
    """The best edges of the companies in turn, 200 in all."""
    e = _t(spark, d, "global_edge_spine").select("edge_id", F.col("from_ticker").alias("ticker"), F.coalesce("materiality", F.lit(0.0)).alias("materiality")).filter("ticker IS NOT NULL").distinct()
    return ranking.round_robin(e, "ticker", [F.col("materiality").desc(), F.col("edge_id")], 200)


@query(
    """WITH u AS (SELECT from_ticker ticker, from_object_id unit, max(coalesce(materiality, 0)) score FROM global_edge_spine WHERE from_object_id IS NOT NULL AND from_ticker IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, unit) rn FROM u)
    SELECT ticker, round(sum(score * CASE rn WHEN 1 THEN 1.0::double WHEN 2 THEN 0.3::double ELSE 0.1::double END), 6) score, count(*) items FROM r WHERE rn <= 3 GROUP BY 1"""
)
def decayed_ticker_score(spark, d):
    """Score of a company from its three best objects."""
    u = _t(spark, d, "global_edge_spine").filter("from_object_id IS NOT NULL AND from_ticker IS NOT NULL").groupBy(F.col("from_ticker").alias("ticker"), F.col("from_object_id").alias("unit")).agg(F.max(F.coalesce("materiality", F.lit(0.0))).alias("score"))
    return ranking.decayed_sum(u, "ticker", "unit", "score")


@query(
    """WITH c AS (SELECT from_ticker ticker, relation_type channel, count(DISTINCT edge_id) n FROM global_edge_spine WHERE from_ticker IS NOT NULL AND relation_type IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, ticker) rk FROM c)
    SELECT ticker, round(sum(CASE channel WHEN 'supports' THEN 4.0 WHEN 'drives' THEN 1.0 WHEN 'similar_topic' THEN 0.2 ELSE 0.0 END::double / (60 + rk)), 9) fused, count(*) channels FROM r GROUP BY 1"""
)
def rank_fusion(spark, d):
    """Companies by reciprocal rank over the relations they have most of."""
    c = _t(spark, d, "global_edge_spine").filter("from_ticker IS NOT NULL AND relation_type IS NOT NULL").groupBy(F.col("from_ticker").alias("ticker"), F.col("relation_type").alias("channel")).agg(F.countDistinct("edge_id").alias("n"))
    return ranking.rank_fusion(c, "ticker", "channel", "n", {"supports": 4.0, "drives": 1.0, "similar_topic": 0.2})


@query(
    """WITH c AS (SELECT from_ticker ticker, relation_type clause, count(DISTINCT edge_id) n FROM global_edge_spine WHERE from_ticker IS NOT NULL AND relation_type IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY clause ORDER BY n DESC, ticker) rk FROM c)
    SELECT ticker, count(DISTINCT CASE WHEN clause = 'supports' THEN clause END) required_hits, round(sum(CASE WHEN clause = 'supports' THEN 2.0 ELSE 1.0 END::double / (60 + rk)), 9) score, count(DISTINCT clause) hits, min(rk) best_rank FROM r GROUP BY 1"""
)
def clause_routing(spark, d):
    """Companies for a plan of clauses, one of them required."""
    c = _t(spark, d, "global_edge_spine").filter("from_ticker IS NOT NULL AND relation_type IS NOT NULL").groupBy(F.col("from_ticker").alias("ticker"), F.col("relation_type").alias("clause")).agg(F.countDistinct("edge_id").alias("n"))
    r = c.withColumn("rk", F.row_number().over(Window.partitionBy("clause").orderBy(F.col("n").desc(), "ticker"))).withColumn("required", F.col("clause") == "supports")
    return ranking.clause_routing(r, "clause", "required", "ticker", "rk")


@query(
    """WITH e AS (SELECT DISTINCT edge_id, relation_type, coalesce(materiality, 0) m FROM global_edge_spine WHERE relation_type IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY relation_type ORDER BY m DESC, edge_id) <= 3 reserved FROM e)
    SELECT edge_id, relation_type, m AS materiality, reserved FROM r ORDER BY reserved DESC, m DESC, edge_id LIMIT 50"""
)
def reserved_top(spark, d):
    """Fifty edges with three places kept for each relation."""
    e = _t(spark, d, "global_edge_spine").filter("relation_type IS NOT NULL").select("edge_id", "relation_type", F.coalesce("materiality", F.lit(0.0)).alias("materiality")).distinct()
    return ranking.reserved_top(e, "relation_type", "materiality", "edge_id", 3, 50)


# --- texts


@query(
    """SELECT id, CASE WHEN text IS NULL OR text = '' THEN 'schema' WHEN start_char IS NULL OR end_char IS NULL OR end_char < start_char THEN 'offsets' WHEN char_count IS DISTINCT FROM length(text) THEN 'count' WHEN section_name IS NULL THEN 'section' END stage, count(*) n FROM mini_10k_spans GROUP BY ALL"""
)
def staged_rejects(spark, d):
    """First failing check of every span."""
    return lineage.staged_rejects(_t(spark, d, "mini_10k_spans")).groupBy("id", "stage").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT DISTINCT source_document_id, section_name, start_char FROM mini_10k_spans WHERE start_char IS NOT NULL) SELECT source_document_id, section_name, start_char, lead(start_char) OVER (PARTITION BY source_document_id ORDER BY start_char, section_name NULLS FIRST) next_start FROM s"""
)
def section_boundaries(spark, d):
    """Where each span ends by the start of the next one."""
    s = _t(spark, d, "mini_10k_spans").filter("start_char IS NOT NULL").select("source_document_id", "section_name", "start_char").distinct()
    return s.withColumn("next_start", F.lead("start_char").over(Window.partitionBy("source_document_id").orderBy("start_char", F.col("section_name").asc_nulls_first())))


@query(
    """WITH n AS (SELECT id, section_name, lower(trim(section_name)) n, regexp_replace(lower(trim(section_name)), '[^a-z0-9]+', '', 'g') g FROM mini_10k_spans) SELECT DISTINCT id, section_name, CASE g WHEN 'business' THEN 'item1' WHEN 'riskfactors' THEN 'item1a' WHEN 'mda' THEN 'item7' WHEN 'financialstatements' THEN 'item8' WHEN 'controls' THEN 'item9a' WHEN 'marketrisk' THEN 'item7a'
    ELSE 'item' || nullif(regexp_extract(n, '^item[ _.-]*([0-9]+[a-c]?)([^a-z]|$)', 1), '') END section_key FROM n"""
)
def canonical_sections(spark, d):
    """Sections under one key however they are spelled."""
    return _t(spark, d, "mini_10k_spans").select("id", "section_name").distinct().withColumn("section_key", section_key(F.col("section_name")))


_WORDS = "regexp_extract_all(strip_accents(replace(lower(coalesce({c}, '')), 'ß', 'ss')), '[\\p{{L}}\\p{{N}}]+')"
_TOK = _WORDS.format(c="text")


@query(f"WITH t AS (SELECT doc_id, unnest({_TOK}) term FROM documents) SELECT term, count(DISTINCT doc_id) df, count(*) cf FROM t GROUP BY 1")
def term_statistics(spark, d):
    """Documents and occurrences of every term."""
    return textsearch.term_statistics(textsearch.postings(_documents(spark, d), "doc_id", ["text"]), "doc_id")


def _bm25_sql(match: str, mode_filter: str = "") -> str:
    return f"""WITH h AS (SELECT doc_id, q, len(list_filter(ts, lambda x: {match})) f, len(ts) dl FROM (SELECT doc_id, {_TOK} ts FROM documents), (SELECT unnest([{_LIST}]) q)),
    s AS (SELECT q, count(*) n_all, sum(CASE WHEN f > 0 THEN 1 ELSE 0 END) n, avg(dl) avgdl FROM h GROUP BY 1)
    SELECT doc_id, round(sum(greatest(ln((n_all - n + 0.5::double) / (n + 0.5::double)), 1e-6) * f * 2.2::double / (f + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))), 6) score, count(DISTINCT q) matched FROM h JOIN s USING (q) WHERE f > 0 GROUP BY 1 {mode_filter}"""


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query(_bm25_sql("x = q"))
def bm25_or(spark, d):
    """BM25 scores of all documents with any of the terms."""
    return _rounded(textsearch.bm25(_documents(spark, d), "doc_id", {"text": 1.0}, TERMS))


@query(_bm25_sql("starts_with(x, q)", "HAVING count(DISTINCT q) = 4"))
def bm25_prefix_and(spark, d):
    """BM25 scores of documents with all terms, as prefixes."""
    return _rounded(textsearch.bm25(_documents(spark, d), "doc_id", {"text": 1.0}, TERMS, prefix=True, mode="and"))


@query(
    f"""WITH b AS ({_bm25_sql("x = q")}), p AS (SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 80), m AS (SELECT *, min(score) OVER () lo, max(score) OVER () hi FROM p), r AS (SELECT doc_id, matched, matched >= 3 AS strict, 0.65::double * matched / 4 + 0.35::double * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END x FROM m)
    SELECT doc_id, round(CASE WHEN strict THEN x ELSE x * 0.25::double END, 5) "primary", strict, matched FROM r"""
)
def coverage_rank(spark, d):
    """Candidates of a search reranked by how many terms they cover."""
    b = _rounded(textsearch.bm25(_documents(spark, d), "doc_id", {"text": 1.0}, TERMS))
    return textsearch.coverage_rank(b, "doc_id", len(TERMS), 20).withColumn("primary", F.round("primary", 5))


@query(
    f"""WITH a AS ({_bm25_sql("starts_with(x, q)", "HAVING count(DISTINCT q) = 4")}), o AS ({_bm25_sql("starts_with(x, q)")}) SELECT doc_id, CASE WHEN a.doc_id IS NOT NULL THEN 0 ELSE 1 END rung, o.score FROM o LEFT JOIN a USING (doc_id)"""
)
def relaxation_ladder(spark, d):
    """Strict matches first, then documents with any term; each at its first rung."""
    hits = _rounded(textsearch.bm25(_documents(spark, d), "doc_id", {"text": 1.0}, TERMS, prefix=True))
    return ranking.first_rung([hits.filter(F.col("matched") == len(TERMS)), hits], "doc_id", "score")


@query(
    f"""WITH t AS (SELECT doc_id, unnest(list_distinct({_TOK})) w FROM documents), h AS (SELECT * FROM t WHERE w IN ({_LIST})) SELECT a.w term_a, b.w term_b, count(*) docs FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.w < b.w GROUP BY 1, 2"""
)
def pair_coherence(spark, d):
    """How often two query terms meet in a document."""
    return textsearch.term_pairs(_documents(spark, d), "doc_id", "text", TERMS)


@query("""SELECT series_key, json_extract_string(provenance_json, '$.provider') provider, count(*) n, max(json_extract_string(provenance_json, '$.batch')::int) last_batch FROM observations GROUP BY 1, 2""")
def json_path_rollup(spark, d):
    """Readings by provider, from their provenance."""
    o = _t(spark, d, "observations").select("series_key", F.get_json_object("provenance_json", "$.provider").alias("provider"), F.get_json_object("provenance_json", "$.batch").cast("int").alias("b"))
    return o.groupBy("series_key", "provider").agg(F.count("*").alias("n"), F.max("b").alias("last_batch"))


@query("""SELECT flag, count(DISTINCT series_key) series FROM (SELECT series_key, unnest(from_json(quality_flags_json, '["VARCHAR"]')) flag FROM chart_series) GROUP BY 1""")
def json_array_unnest(spark, d):
    """Series by quality flag."""
    return _t(spark, d, "chart_series").select("series_key", F.explode(F.from_json("quality_flags_json", "array<string>")).alias("flag")).groupBy("flag").agg(F.countDistinct("series_key").alias("series"))


@query("""SELECT k AS key, count(*) n, count(DISTINCT user_id) users FROM (SELECT user_id, unnest(json_keys(props)) k FROM events) GROUP BY 1""")
def map_explode(spark, d):
    """Properties of events as rows."""
    return _t(spark, d, "events").select("user_id", F.explode(F.from_json("props", "map<string,string>"))).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT DISTINCT canonical_metric, trim(regexp_replace(lower(coalesce(metric_name, '')), '[^a-z0-9]+', '_', 'g'), '_') slug FROM chart_series")
def metric_slugs(spark, d):
    """Metric names as keys."""
    return _t(spark, d, "chart_series").select("canonical_metric", slug(F.coalesce("metric_name", F.lit(""))).alias("slug")).distinct()


# --- stars and streams


@query("""SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2""")
def tumbling_window(spark, d):
    """Events by hour and type."""
    e = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minute THEN 0 ELSE 1 END s FROM events), k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minute AS "end", count(*) n FROM k GROUP BY user_id, k"""
)
def session_windows(spark, d):
    """Sessions of a user, closed by 30 minutes of silence."""
    e = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@query(
    """SELECT n_name, year(o_orderdate) AS order_year, count(*) orders, round(sum(o_totalprice), 2) total, round(avg(o_totalprice), 6) mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""
)
def orders_by_nation(spark, d):
    """Orders of each nation by year."""
    j = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", F.year("o_orderdate").alias("order_year")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 6).alias("mean"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def customers_without_orders(spark, d):
    """Customers without an order in progress: an anti join."""
    return _t(spark, d, "customer").join(_t(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) sum_qty, round(sum(l_extendedprice), 2) sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) sum_disc_price, count(*) n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def pricing_summary(spark, d):
    """Filter and aggregate at the scan."""
    li = _t(spark, d, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count("*").alias("n"))


@query(
    f"""WITH {_POINTS} SELECT series_key, period, CASE WHEN upper(unit) = 'USD' THEN CASE WHEN abs(value) >= 1e9 THEN printf('$%.1fB', round(value / 1e9, 1)) WHEN abs(value) >= 1e6 THEN printf('$%.1fM', round(value / 1e6, 1)) WHEN abs(value) >= 1e3 THEN printf('$%.1fK', round(value / 1e3, 1)) ELSE printf('$%.0f', round(value, 0)) END
    WHEN lower(unit) IN ('percent', '%') THEN printf('%.1f%%', round(value, 1)) ELSE concat_ws(' ', CASE WHEN value IS NOT NULL THEN format('{{:,.2f}}', value) END, unit) END compact FROM ps"""
)
def formatted_points(spark, d):
    """Chart points in compact form."""
    return _points(spark, d).select("series_key", "period", compact_number(F.col("value"), F.col("unit")).alias("compact"))
