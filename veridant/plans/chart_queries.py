"""Queries on chart series: classification, best points, packs of series, labels and ids; each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridant.functions import chart_labels
from veridant.functions.lexical import normal_text, words
from veridant.functions.text_units import period_sort_key
from veridant.operators import spine
from veridant.plans.evidence import _WORDS, _t, query
from veridant.plans.metric_queries import MP, metric_points
from veridant.session import spread

_SLUG = "trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', '_', 'g'), '_')"
_HAY = f"{_SLUG.format(c='metric_name')} || ' ' || {_SLUG.format(c='label')} || ' ' || lower(coalesce(label, ''))"


def _classify_sql() -> str:
    any_of = lambda needles: "(" + " OR ".join(f"contains(hay, '{n}')" for n in needles) + ")"
    cases = " ".join(f"WHEN {any_of(ns)} THEN '{m}'" for m, ns in chart_labels.METRIC_ALIASES.items())
    return f"""CASE WHEN contains(hay, 'business_combination_and_other_related_cost') OR (contains(hay, 'business combination') AND contains(hay, 'related cost')) THEN 'ma_related_costs' WHEN {any_of(("business_combination", "business combinations", "acquisition", "m_and_a"))} AND {any_of(("cash", "net_of_cash", "purchase"))} THEN 'ma_cash_outflow'
    WHEN {any_of(("adjusted_free_cash_flow", "adjusted_fcf"))} THEN 'adjusted_free_cash_flow' {cases} END"""


_CLASSED = f"""h AS (SELECT *, {_HAY} hay FROM (SELECT DISTINCT series_key, metric_name, label, source_class, period_type, scope_label, scope_kind FROM chart_series)), c AS (SELECT *, {_classify_sql()} metric FROM h),
    b AS (SELECT *, CASE WHEN contains(lower(coalesce(metric, '') || ' ' || coalesce(label, '')), 'non-gaap') OR contains(lower(coalesce(metric, '') || ' ' || coalesce(label, '')), 'adjusted') THEN 'non_gaap_adjusted' WHEN source_class = 'xbrl' OR contains(lower(coalesce(label, '')), 'xbrl') THEN 'gaap_xbrl' WHEN metric IN ('gross_margin', 'operating_margin') THEN 'company_reported_ratio' ELSE 'company_reported' END basis FROM c)"""


@query(
    f"""WITH {_CLASSED} SELECT DISTINCT series_key, metric, basis, CASE WHEN metric IN ('cash_and_cash_equivalents', 'total_debt') OR lower(period_type) = 'instant' THEN 'point_in_time' WHEN contains(lower(coalesce(label, '')), 'ttm') THEN 'ttm' ELSE 'period' END duration,
    CASE WHEN basis = 'gaap_xbrl' THEN 'xbrl' WHEN contains(lower(coalesce(metric, '') || ' ' || coalesce(label, '')), 'cash flow') OR metric IN ('operating_cash_flow', 'free_cash_flow', 'capital_expenditures', 'share_repurchase') THEN 'cash_flow_statement' WHEN metric IN ('cash_and_cash_equivalents', 'total_debt') THEN 'balance_sheet' WHEN metric IN ('gross_margin', 'operating_margin') THEN 'ratio_metric' ELSE 'company_reported_metric' END source_class FROM b"""
)
def classified_series(spark, d):
    """Canonical metric, basis, duration and source class of each series, from its name and label."""
    s = _t(spark, d, "chart_series").select("series_key", "metric_name", "label", "source_class", "period_type", "scope_label", "scope_kind").distinct()
    s = s.withColumn("metric", chart_labels.classify_metric(F.col("metric_name"), F.col("label")))
    s = s.withColumn("basis", chart_labels.basis_of(F.col("metric"), F.col("label"), F.coalesce(F.col("source_class") == "xbrl", F.lit(False))))
    s = s.withColumn("duration", chart_labels.duration_of(F.col("metric"), F.col("label"), F.col("period_type")))
    return s.select("series_key", "metric", "basis", "duration", chart_labels.source_class_of(F.col("metric"), F.col("basis"), F.col("label")).alias("source_class")).distinct()


@query("SELECT DISTINCT series_key, CASE WHEN scope_kind = 'segment' AND trim(coalesce(scope_label, '')) <> '' THEN 'segment' ELSE 'company_total' END kind, CASE WHEN scope_kind = 'segment' AND trim(coalesce(scope_label, '')) <> '' THEN trim(regexp_replace(lower(scope_label), '[^a-z0-9]+', '_', 'g'), '_') ELSE 'company_total' END AS key FROM chart_series")
def series_scopes(spark, d):
    """Scope of each series: its segment, or the whole company."""
    segment = F.when(F.col("scope_kind") == "segment", F.col("scope_label"))
    none = F.lit(None).cast("string")
    s = _t(spark, d, "chart_series").select("series_key", chart_labels.scope_of(segment, none, none).alias("s")).distinct()
    return s.select("series_key", "s.kind", "s.key").distinct()


@query("SELECT DISTINCT series_key, period, 'CY' || fiscal_year || CASE WHEN fiscal_quarter IS NOT NULL THEN 'Q' || fiscal_quarter WHEN regexp_matches(period, 'Q[1-4]') THEN 'Q' || regexp_extract(period, 'Q([1-4])', 1) ELSE '' END AS calendar_period, regexp_replace(upper(trim(period)), '^(FY|CY)([0-9]{4})', '\\2') AS plain_period FROM chart_series_points WHERE fiscal_year IS NOT NULL")
def point_periods(spark, d):
    """Period labels of points from their fiscal year and quarter, and without the kind of year."""
    p = _t(spark, d, "chart_series_points").filter("fiscal_year IS NOT NULL")
    label = chart_labels.period_of(F.col("fiscal_year"), F.col("fiscal_quarter"), F.lit(None).cast("string"), F.col("period"))
    return p.select("series_key", "period", label.alias("calendar_period"), chart_labels.plain_period(F.col("period")).alias("plain_period")).distinct()


_SORT = "CASE WHEN regexp_matches(document_period, '^CY[0-9]{4}Q[1-4]$') THEN (substr(document_period, 3, 4) || substr(document_period, 8, 1))::int WHEN regexp_matches(document_period, '^(FY|CY)[0-9]{4}$') THEN (substr(document_period, 3, 4) || '5')::int END"
_QUALITY = f"(CASE WHEN metric_lineage_status = 'linked' THEN 20 ELSE 0 END + CASE WHEN trace_status = 'complete' THEN 10 ELSE 0 END)"


@query(
    f"""SELECT series_key, period, object_id, value FROM (SELECT *, row_number() OVER (PARTITION BY series_key, period ORDER BY coalesce(source_sort_key, 0) DESC, {_QUALITY} DESC, CASE WHEN document_type IN ('10-K', '10-Q') THEN 5 ELSE 0 END DESC, CASE WHEN {_SORT} = period_sort_key THEN 5 ELSE 0 END DESC, coalesce(object_id, '') DESC, value DESC NULLS LAST) rn FROM chart_series_points) WHERE rn = 1"""
)
def best_points(spark, d):
    """The copy of each point that counts: newest filing, traced, from a filing, of the exact period, greatest id."""
    quality = chart_labels.point_quality(F.col("source_sort_key"), F.col("metric_lineage_status"), F.col("trace_status"), F.col("document_type"), period_sort_key(F.col("document_period")), F.col("period_sort_key"), F.col("object_id"))
    b = _t(spark, d, "chart_series_points").groupBy("series_key", "period").agg(F.max(F.struct(quality.alias("q"), "value", "object_id")).alias("b"))
    return b.select("series_key", "period", "b.object_id", "b.value")


@query(
    f"""WITH {MP}, n AS (SELECT series_key, ticker, metric, scope_kind, scope_key, count(*) points, max(fiscal_year) newest FROM mp WHERE value IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY ticker, metric, scope_kind, scope_key ORDER BY points DESC, newest DESC NULLS LAST, series_key) first FROM n), o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY scope_kind = 'company' DESC, points DESC, newest DESC NULLS LAST, metric, scope_key, series_key) place FROM r WHERE first = 1)
    SELECT ticker, series_key, metric, place, points FROM o WHERE place <= 8"""
)
def series_pack(spark, d):
    """Eight series for each company: one for a metric and scope, totals first, then the longest and newest."""
    n = metric_points(spark, d).filter("value IS NOT NULL").groupBy("series_key", "ticker", "metric", "scope_kind", "scope_key").agg(F.count("*").alias("points"), F.max("fiscal_year").alias("newest"))
    best = Window.partitionBy("ticker", "metric", "scope_kind", "scope_key").orderBy(F.col("points").desc(), F.col("newest").desc_nulls_last(), "series_key")
    r = n.withColumn("first", F.row_number().over(best)).filter("first = 1")
    w = Window.partitionBy("ticker").orderBy((F.col("scope_kind") == "company").desc(), F.col("points").desc(), F.col("newest").desc_nulls_last(), "metric", "scope_key", "series_key")
    return r.withColumn("place", F.row_number().over(w)).filter("place <= 8").select("ticker", "series_key", "metric", "place", "points")


@query(
    f"""WITH {MP}, n AS (SELECT series_key, max(ticker) ticker, max(metric) metric, count(*) points FROM mp WHERE value IS NOT NULL GROUP BY 1), o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY points DESC, series_key) place FROM n),
    pt AS (SELECT series_key, period, value, row_number() OVER (PARTITION BY series_key ORDER BY fiscal_year DESC NULLS LAST, fiscal_quarter DESC NULLS LAST, period DESC) rn FROM mp WHERE value IS NOT NULL)
    SELECT ticker, o.series_key, metric, array_to_string(list(period || '=' || round(value, 2)::decimal(38, 2)::varchar ORDER BY rn DESC), ';') points FROM o JOIN pt USING (series_key) WHERE place <= 3 AND rn <= 4 GROUP BY ALL"""
)
def chart_pack(spark, d):
    """Three series for each company with their four newest points, oldest first, as one nested row."""
    p = metric_points(spark, d).filter("value IS NOT NULL")
    n = p.groupBy("series_key").agg(F.max("ticker").alias("ticker"), F.max("metric").alias("metric"), F.count("*").alias("points"))
    o = n.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("points").desc(), "series_key"))).filter("place <= 3")
    newest = Window.partitionBy("series_key").orderBy(F.col("fiscal_year").desc_nulls_last(), F.col("fiscal_quarter").desc_nulls_last(), F.col("period").desc())
    pt = p.select("series_key", "period", "value", F.row_number().over(newest).alias("rn")).filter("rn <= 4")
    text = F.concat("period", F.lit("="), F.round("value", 2).cast("decimal(38,2)").cast("string"))
    packed = pt.groupBy("series_key").agg(F.sort_array(F.collect_list(F.struct("rn", text.alias("t"))), asc=False).alias("ps"))
    return o.join(packed, "series_key").select("ticker", "series_key", "metric", F.array_join(F.transform("ps", lambda x: x.t), ";").alias("points"))


_DICTIONARY = {"revenue": ["revenue", "net sales", "turnover"], "net_income": ["net income", "net earnings", "profit"], "headcount": ["headcount", "employees"], "free_cash_flow": ["free cash flow"], "total_debt": ["total debt", "borrowings"], "gross_margin": ["gross margin"]}
_ALIASES = [(a, m) for m, names in _DICTIONARY.items() for a in names]
_ALIAS_SQL = ", ".join(f"('{a}', '{m}')" for a, m in _ALIASES)


@query(
    f"""WITH al(alias, metric) AS (VALUES {_ALIAS_SQL}), w AS (SELECT doc_id, ' ' || array_to_string({_WORDS.format(c="text")}, ' ') || ' ' t FROM documents WHERE text IS NOT NULL) SELECT metric, alias, count(DISTINCT doc_id) documents FROM w JOIN al ON contains(t, ' ' || alias || ' ') GROUP BY 1, 2"""
)
def metric_mentions(spark, d):
    """Documents that name a metric by any of its aliases, as whole words; the dictionary is small and given."""
    al = spark.createDataFrame(_ALIASES, "alias string, metric string")
    # one pass over the folded words with all aliases, the longest first
    pattern = r"(?<= )(" + "|".join(sorted((a for a, _ in _ALIASES), key=len, reverse=True)) + r")(?= )"
    text = F.concat(F.lit(" "), normal_text(F.col("text")), F.lit(" "))
    held = spread(_t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))).alias("alias"))
    return held.groupBy("alias").agg(F.countDistinct("doc_id").alias("documents")).join(F.broadcast(al), "alias").select("metric", "alias", "documents")


_PACKS = {"semiconductors": ["wafer", "foundry", "chip"], "software": ["software", "cloud", "subscription"], "logistics": ["freight", "warehouse", "brokerage"], "consumer": ["apparel", "grocery", "retail"]}


@query(
    f"""WITH w AS (SELECT ticker, list_distinct(flatten(list({_WORDS.format(c="compact_label")}))) ws FROM global_object_locator WHERE ticker IS NOT NULL GROUP BY 1), p AS (SELECT ticker, pack, ord, hits FROM w, LATERAL (SELECT unnest([{", ".join(f"struct_pack(pack := '{k}', ord := {i}, hits := len(list_filter({v}, lambda a: list_contains(ws, a))))" for i, (k, v) in enumerate(_PACKS.items()))}], recursive := true)))
    SELECT ticker, CASE WHEN max(hits) = 0 THEN 'generic' ELSE arg_max(pack, hits * 100 - ord) END pack, max(hits) hits FROM p GROUP BY 1"""
)
def sector_packs(spark, d):
    """The sector pack of each company by how many of its words the labels hold; the first of equals, generic without any."""
    w = _t(spark, d, "global_object_locator").filter("ticker IS NOT NULL").select("ticker", F.explode(words(F.col("compact_label"))).alias("w"))
    count = lambda ws: F.countDistinct(F.when(F.col("w").isin(ws), F.col("w")))
    g = w.groupBy("ticker").agg(*[count(ws).alias(k) for k, ws in _PACKS.items()])
    best = F.greatest(*[F.struct(F.col(k).alias("hits"), F.lit(-i).alias("o"), F.lit(k).alias("pack")) for i, k in enumerate(_PACKS)])
    every = _t(spark, d, "global_object_locator").filter("ticker IS NOT NULL").select("ticker").distinct()
    g = every.join(g.select("ticker", best.alias("b")), "ticker", "left")
    return g.select("ticker", F.when(F.coalesce(F.col("b.hits"), F.lit(0)) == 0, "generic").otherwise(F.col("b.pack")).alias("pack"), F.coalesce("b.hits", F.lit(0)).alias("hits"))


@query("SELECT DISTINCT edge_id, 'edge:' || ticker || ':' || period || ':' || left(sha1(concat_ws('|', from_object_id, relation_type, to_object_id)), 10) local_edge_id FROM global_edge_spine WHERE ticker IS NOT NULL AND period IS NOT NULL")
def edge_local_ids(spark, d):
    """Ids of edges from what they connect."""
    e = _t(spark, d, "global_edge_spine").filter("ticker IS NOT NULL AND period IS NOT NULL")
    made = F.concat_ws(":", F.lit("edge"), "ticker", "period", spine.local_digest(10, F.col("from_object_id"), F.col("relation_type"), F.col("to_object_id")))
    return e.select("edge_id", made.alias("local_edge_id")).distinct()


@query("SELECT DISTINCT series_key, period, left(sha256(concat_ws('|', series_key, period, coalesce(fiscal_year::varchar, ''), coalesce(fiscal_quarter::varchar, ''), coalesce(document_period, ''))), 24) context_key, CASE WHEN fiscal_quarter IS NOT NULL THEN 'quarter' ELSE 'annual' END duration FROM chart_series_points")
def observation_contexts(spark, d):
    """The context of each point: a key of its period's identity, and how long it covers."""
    p = _t(spark, d, "chart_series_points")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.left(F.sha2(F.concat_ws("|", "series_key", "period", text("fiscal_year"), text("fiscal_quarter"), text("document_period")), 256), F.lit(24))
    duration = chart_labels.duration_basis(F.when(F.col("fiscal_quarter").isNotNull(), "quarterly").otherwise("yearly"))
    return p.select("series_key", "period", key.alias("context_key"), duration.alias("duration")).distinct()


@query(
    f"""WITH {MP}, t AS (SELECT series_key, period, 120 * (metric = 'revenue')::int + 45 * (scope_kind = 'company')::int + 40 * (fiscal_year = 2022)::int + 30 * (unit = 'USD')::int + 18 * (source_class = 'xbrl')::int + 8 * (trace_status IS NOT DISTINCT FROM 'complete')::int score, object_id FROM mp WHERE value IS NOT NULL AND metric IS NOT NULL AND unit IS NOT NULL AND fiscal_year IS NOT NULL AND source_class IS NOT NULL AND scope_kind IS NOT NULL)
    SELECT series_key, period, score FROM t WHERE score >= 100 ORDER BY score DESC, series_key, period LIMIT 200"""
)
def metric_lookup(spark, d):
    """The 200 points that answer a metric question best, by added scores of what matches."""
    p = metric_points(spark, d).filter("value IS NOT NULL AND metric IS NOT NULL AND unit IS NOT NULL AND fiscal_year IS NOT NULL AND source_class IS NOT NULL AND scope_kind IS NOT NULL")
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = points(F.col("metric") == "revenue", 120) + points(F.col("scope_kind") == "company", 45) + points(F.col("fiscal_year") == 2022, 40) + points(F.col("unit") == "USD", 30) + points(F.col("source_class") == "xbrl", 18) + points(F.col("trace_status") == "complete", 8)
    return p.select("series_key", "period", score.alias("score")).filter("score >= 100").orderBy(F.col("score").desc(), "series_key", "period").limit(200)


@query(
    f"""WITH {MP}, s AS (SELECT series_key, period, scope_kind, value, row_number() OVER (PARTITION BY scope_kind = 'company' ORDER BY abs(value) DESC, series_key, period) rn FROM mp WHERE value IS NOT NULL AND metric = 'revenue' AND scope_kind IS NOT NULL)
    SELECT series_key, period, scope_kind <> 'company' target, value FROM s WHERE rn <= CASE WHEN scope_kind = 'company' THEN 10 ELSE 20 END"""
)
def denominator_split(spark, d):
    """For a question on shares: two thirds of 30 places to parts, one third to company totals."""
    p = metric_points(spark, d).filter("value IS NOT NULL AND metric = 'revenue' AND scope_kind IS NOT NULL").select("series_key", "period", "value", (F.col("scope_kind") != "company").alias("target"))
    order = [F.abs("value").desc(), F.col("series_key"), F.col("period")]
    parts, totals = p.filter("target").orderBy(*order).limit(20), p.filter("NOT target").orderBy(*order).limit(10)
    return parts.unionByName(totals)


@query(f"""WITH {MP} SELECT ticker, metric, CASE WHEN scope_kind = 'company' THEN '__total__' ELSE scope_kind END dimension, CASE WHEN scope_kind = 'company' THEN '__total__' ELSE scope_key END member, count(*) points, count(DISTINCT period) periods FROM mp WHERE value IS NOT NULL GROUP BY ALL""")
def metric_dimensions(spark, d):
    """Dimensions and members that each metric of a company is reported by; totals under a sentinel."""
    p = metric_points(spark, d).filter("value IS NOT NULL")
    total = F.col("scope_kind") == "company"
    p = p.withColumns({"dimension": F.when(total, "__total__").otherwise(F.col("scope_kind")), "member": F.when(total, "__total__").otherwise(F.col("scope_key"))})
    return p.groupBy("ticker", "metric", "dimension", "member").agg(F.count("*").alias("points"), F.countDistinct("period").alias("periods"))


@query(
    """WITH p AS (SELECT DISTINCT series_key, period, value FROM chart_series_points WHERE value IS NOT NULL), u AS (SELECT series_key, max(unit) unit FROM chart_series GROUP BY 1)
    SELECT series_key, period, value, CASE WHEN unit IN ('USD', 'usd') THEN CASE WHEN abs(value) >= 1e9 THEN 'B' WHEN abs(value) >= 1e6 THEN 'M' ELSE 'plain' END WHEN contains(lower(unit), 'percent') OR unit = '%' THEN 'percent' ELSE 'number' END AS style FROM p JOIN u USING (series_key)"""
)
def value_styles(spark, d):
    """How each value is written: billions, millions, plain dollars, percent or number."""
    u = _t(spark, d, "chart_series").groupBy("series_key").agg(F.max("unit").alias("unit"))
    p = _t(spark, d, "chart_series_points").filter("value IS NOT NULL").select("series_key", "period", "value").distinct().join(u, "series_key")
    text = chart_labels.format_value(F.col("value"), F.col("unit"))
    style = F.when(text.endswith("B"), "B").when(text.endswith("M"), "M").when(text.startswith("$"), "plain").when(text.endswith("%"), "percent").otherwise("number")
    return p.select("series_key", "period", "value", style.alias("style"))


@query(
    """WITH c AS (SELECT DISTINCT series_key, period, fiscal_year fy, fiscal_quarter fq, object_id FROM chart_series_points WHERE object_id IS NOT NULL), e AS (SELECT series_key, list(DISTINCT object_id) expected FROM c WHERE fq IS NULL GROUP BY 1), g AS (SELECT series_key, list(DISTINCT object_id) got FROM c WHERE fy >= 2020 GROUP BY 1)
    SELECT series_key, round(len(list_intersect(expected, coalesce(got, []))) / len(expected)::double, 6) recall, len(list_intersect(expected, coalesce(got, []))) = len(expected) passed FROM e LEFT JOIN g USING (series_key)"""
)
def graded_recall(spark, d):
    """Share of the expected objects of each case that were found, and whether all were."""
    c = _t(spark, d, "chart_series_points").filter("object_id IS NOT NULL").select("series_key", "object_id", "fiscal_year", "fiscal_quarter").distinct()
    expected = c.filter("fiscal_quarter IS NULL").select("series_key", "object_id").distinct()
    got = c.filter("fiscal_year >= 2020").select("series_key", "object_id", F.lit(True).alias("hit")).distinct()
    g = expected.join(got, ["series_key", "object_id"], "left").groupBy("series_key").agg(F.avg(F.coalesce(F.col("hit"), F.lit(False)).cast("double")).alias("r"))
    return g.select("series_key", F.round("r", 6).alias("recall"), (F.col("r") == 1).alias("passed"))
