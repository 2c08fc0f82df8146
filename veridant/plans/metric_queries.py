"""Queries on metric series: bundles, calculations, coverage, facts, lookups; each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridant.operators import metrics
from veridant.plans.evidence import _t, query

_ATTRIBUTES = ["ticker", "canonical_metric", "unit", "scope_kind", "scope_key", "period_type", "basis", "duration", "source_class", "metric_name", "label"]
_POINT = ["value", "object_id", "fiscal_year", "fiscal_quarter", "document_type", "document_period", "source_sort_key", "trace_status", "metric_lineage_status"]


def metric_points(spark, d):
    """The newest delivery of each point with the attributes of its series."""
    p = _t(spark, d, "chart_series_points").groupBy("series_key", "period").agg(F.max(F.struct("loaded_at", *_POINT)).alias("p")).select("series_key", "period", *[F.col(f"p.{c}").alias(c) for c in _POINT])
    s = _t(spark, d, "chart_series").groupBy("series_key").agg(*[F.max(c).alias(c) for c in _ATTRIBUTES])
    p = p.join(s, "series_key").withColumnRenamed("canonical_metric", "metric")
    return p.withColumns({"metric_scope": F.when(F.col("scope_kind") == "company", "company_total").otherwise("dimensioned"), "currency": F.lit("")})


MP = f"""lp AS (SELECT * FROM chart_series_points QUALIFY row_number() OVER (PARTITION BY series_key, period ORDER BY loaded_at DESC, {", ".join(f"{c} DESC NULLS LAST" for c in _POINT)}) = 1),
    sr AS (SELECT series_key, {", ".join(f"max({c}) {'metric' if c == 'canonical_metric' else c}" for c in _ATTRIBUTES)} FROM chart_series GROUP BY 1),
    mp AS (SELECT lp.series_key, period, {", ".join(_POINT)}, sr.* EXCLUDE (series_key), CASE WHEN scope_kind = 'company' THEN 'company_total' ELSE 'dimensioned' END metric_scope, '' currency FROM lp JOIN sr USING (series_key))"""
SERIES = ["ticker", "metric", "unit", "scope_kind", "scope_key", "period_type"]
_S = ", ".join(SERIES)
_INDEX = "CASE WHEN fiscal_quarter IS NULL THEN fiscal_year * 10 ELSE (fiscal_year * 4 + fiscal_quarter) * 10 + 1 END"
_GAP = "CASE WHEN fiscal_quarter IS NULL THEN 10 ELSE 40 END"


def _bundle_sql() -> str:
    same = " AND ".join(f"{{a}}.{c} IS NOT DISTINCT FROM {{b}}.{c}" for c in SERIES)
    on = same.format(a="a", b="b")
    return f"""{MP}, vv AS (SELECT {_S}, fiscal_year, fiscal_quarter, period, value, max(struct_pack(k := source_sort_key, o := object_id)).o AS object_id FROM mp WHERE value IS NOT NULL GROUP BY ALL),
    cx AS (SELECT {_S}, fiscal_year, fiscal_quarter, period, count(*) n, {_INDEX} i, {_INDEX} - {_GAP} bf FROM vv GROUP BY ALL),
    cf AS (SELECT * FROM cx WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY {_S} ORDER BY coalesce(fiscal_year, 0) DESC, coalesce(fiscal_quarter, 0) DESC, period DESC) = 1),
    pr AS (SELECT a.*, b.period prior FROM cx a JOIN cx b ON {on} AND b.i = a.bf QUALIFY row_number() OVER (PARTITION BY {", ".join("a." + c for c in SERIES)} ORDER BY coalesce(a.fiscal_year, 0) DESC, coalesce(a.fiscal_quarter, 0) DESC, a.period DESC) = 1),
    lt AS (SELECT *, row_number() OVER (PARTITION BY {_S} ORDER BY coalesce(fiscal_year, 0) DESC, coalesce(fiscal_quarter, 0) DESC, period DESC) rn FROM cx),
    ch AS (SELECT {_S}, period, 'conflict' bundle, 0 ord FROM cf UNION ALL SELECT {_S}, period, 'pair', 0 FROM pr a WHERE NOT EXISTS (SELECT 1 FROM cf b WHERE {on}) UNION ALL SELECT {_S}, prior, 'pair', 1 FROM pr a WHERE NOT EXISTS (SELECT 1 FROM cf b WHERE {on})
      UNION ALL SELECT {_S}, period, 'latest', rn FROM lt a WHERE rn <= 2 AND NOT EXISTS (SELECT 1 FROM cf b WHERE {on}) AND NOT EXISTS (SELECT 1 FROM pr b WHERE {on})),
    bu AS (SELECT {", ".join("a." + c for c in SERIES)}, bundle, row_number() OVER (PARTITION BY {", ".join("a." + c for c in SERIES)} ORDER BY ord, value) - 1 AS position, a.period, value, object_id FROM ch a JOIN vv b ON {on} AND a.period = b.period)"""


@query(f"WITH {_bundle_sql()} SELECT * FROM bu")
def metric_bundles(spark, d):
    """For each metric series its conflict set, else its newest year-over-year pair, else its two newest periods."""
    return metrics.metric_bundles(metric_points(spark, d), SERIES, "year_over_year")


@query(
    f"""WITH {_bundle_sql()}, fs AS (SELECT {_S}, bundle <> 'conflict' late, period newest FROM bu WHERE position = 0), sz AS (SELECT {_S}, count(*) n FROM bu GROUP BY ALL),
    st AS (SELECT fs.*, coalesce(sum(n) OVER (PARTITION BY fs.ticker, fs.metric ORDER BY late, newest DESC, {", ".join(f"fs.{c} ASC NULLS FIRST" for c in SERIES)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int start FROM fs JOIN sz USING ({_S}))
    SELECT bu.*, (start + position)::int turn FROM bu JOIN st USING ({_S}) WHERE start < 6"""
)
def planned_metric_rows(spark, d):
    """Bundles of every company and metric in turns, conflicts first, whole bundles until six rows."""
    b = metrics.metric_bundles(metric_points(spark, d), SERIES, "year_over_year")
    return metrics.interleave(b, ["ticker", "metric"], SERIES, 6)


_TOP = "SELECT ticker FROM mp WHERE ticker IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, ticker LIMIT 3"


def _top_tickers(spark, d) -> list[str]:
    """The three companies with the most points: what a caller would name."""
    return sorted(r.ticker for r in metric_points(spark, d).filter("ticker IS NOT NULL").groupBy("ticker").count().orderBy(F.col("count").desc(), "ticker").limit(3).collect())


_BASIS = "CASE WHEN regexp_matches(period, '^(FY|CY)?(19|20)[0-9]{2}(Q[1-4])?$') THEN CASE WHEN period LIKE 'FY%' THEN 'fiscal' WHEN period LIKE 'CY%' THEN 'calendar' ELSE 'unspecified' END || CASE WHEN regexp_matches(period, '[0-9]{4}Q') THEN '_quarterly' ELSE '_annual' END ELSE 'unknown' END"
_ID = "metric, unit, currency, scope_key, metric_scope, period_basis, duration_basis"
_VALUES = f"""{MP}, tt AS ({_TOP}), rc AS (SELECT ticker, {_ID}, period, fiscal_year, fiscal_quarter, min(value) v, {_INDEX} i FROM (SELECT *, {_BASIS} period_basis, coalesce(duration, 'unknown') duration_basis FROM mp WHERE value IS NOT NULL AND fiscal_year IS NOT NULL AND metric IS NOT NULL AND ticker IS NOT NULL AND unit IS NOT NULL)
      GROUP BY ALL HAVING min(value) = max(value)),
    pj AS (SELECT a.*, b.period from_period, b.v pv FROM rc a JOIN rc b ON a.ticker = b.ticker AND a.metric = b.metric AND a.unit = b.unit AND a.scope_key = b.scope_key AND a.metric_scope = b.metric_scope AND a.period_basis = b.period_basis AND a.duration_basis = b.duration_basis AND b.i = a.i - CASE WHEN a.fiscal_quarter IS NULL THEN 10 ELSE 40 END),
    cv AS (SELECT 'value' kind, {_ID}, NULL::varchar from_period, period, NULL::varchar calculation_window, ticker, NULL::varchar other_ticker, v AS value FROM rc
      UNION ALL SELECT 'absolute_change', {_ID}, from_period, period, 'year_over_year', ticker, NULL, v - pv FROM pj UNION ALL SELECT 'growth_rate', metric, 'ratio', currency, scope_key, metric_scope, period_basis, duration_basis, from_period, period, 'year_over_year', ticker, NULL, (v - pv) / pv FROM pj WHERE pv > 0 AND v >= 0
      UNION ALL SELECT 'value_difference', a.metric, a.unit, a.currency, a.scope_key, a.metric_scope, a.period_basis, a.duration_basis, NULL, a.period, NULL, a.ticker, b.ticker, a.v - b.v FROM rc a JOIN rc b ON a.metric = b.metric AND a.unit = b.unit AND a.scope_key = b.scope_key AND a.metric_scope = b.metric_scope AND a.period_basis = b.period_basis AND a.duration_basis = b.duration_basis AND a.period = b.period AND a.ticker < b.ticker WHERE a.ticker IN (FROM tt) AND b.ticker IN (FROM tt))"""


@query(f"WITH {_VALUES} SELECT * FROM cv")
def computed_values(spark, d):
    """Values, changes, growth and differences of companies that the points support, with the parts they must agree in."""
    return metrics.computed_values(metric_points(spark, d), list(metrics.AXES), "year_over_year", _top_tickers(spark, d))


@query(f"WITH {_VALUES} SELECT metric, unit, scope_key, period, ticker, other_ticker, value FROM cv WHERE kind = 'value_difference'")
def pairwise_difference(spark, d):
    """Differences between the three companies with the most points, where unit, scope, basis and period agree."""
    v = metrics.computed_values(metric_points(spark, d), ["value_difference"], "year_over_year", _top_tickers(spark, d))
    return v.select("metric", "unit", "scope_key", "period", "ticker", "other_ticker", "value")


@query(
    f"""WITH {_VALUES}, g AS (SELECT metric, unit, scope_key, from_period, period, duration_basis, ticker, value FROM cv WHERE kind = 'growth_rate' AND ticker IN (FROM tt))
    SELECT a.metric, a.scope_key, a.from_period, a.period, a.ticker, b.ticker other_ticker, a.value - b.value growth_difference FROM g a JOIN g b ON a.metric = b.metric AND a.scope_key = b.scope_key AND a.from_period = b.from_period AND a.period = b.period AND a.duration_basis = b.duration_basis AND a.ticker < b.ticker"""
)
def pairwise_growth(spark, d):
    """Differences of growth rates between the three companies with the most points, over the same two periods."""
    top = _top_tickers(spark, d)
    g = metrics.computed_values(metric_points(spark, d), ["growth_rate"], "year_over_year").filter(F.col("ticker").isin(top))
    keys = ["metric", "scope_key", "from_period", "period", "duration_basis"]
    g = g.select(*keys, "ticker", "value")
    other = g.select(*keys, F.col("ticker").alias("other_ticker"), F.col("value").alias("other"))
    return g.join(other, keys).filter("ticker < other_ticker").select("metric", "scope_key", "from_period", "period", "ticker", "other_ticker", (F.col("value") - F.col("other")).alias("growth_difference"))


_AXES_SQL = "(SELECT unnest(['value', 'absolute_change', 'growth_rate', 'value_difference']) axis)"


@query(
    f"""WITH {_VALUES}, ak AS (SELECT m AS metric, axis FROM (SELECT DISTINCT metric m FROM mp WHERE metric IS NOT NULL UNION SELECT 'not_a_metric') x, {_AXES_SQL}),
    gr AS (SELECT kind, metric, from_period, period, unit, currency, scope_key, metric_scope, period_basis, duration_basis, calculation_window, count(DISTINCT t) FILTER (t IN (FROM tt)) held, count(DISTINCT CASE WHEN ticker IN (FROM tt) AND other_ticker IN (FROM tt) THEN ticker || other_ticker END) pairs
      FROM (SELECT *, unnest([ticker, other_ticker]) t FROM cv) GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11),
    be AS (SELECT metric, kind axis, max(held) covered, bool_or(held = (SELECT count(*) FROM tt) AND (kind <> 'value_difference' OR (pairs >= (SELECT count(*) * (count(*) - 1) // 2 FROM tt) AND (SELECT count(*) FROM tt) > 1))) complete FROM gr GROUP BY 1, 2)
    SELECT metric, axis, CASE WHEN covered IS NULL THEN 'missing' WHEN complete THEN 'covered' ELSE 'partial' END status, coalesce(covered, 0) covered FROM ak LEFT JOIN be USING (metric, axis)"""
)
def calculation_coverage(spark, d):
    """Whether values, changes, growth and differences of each metric are there for all three companies asked for."""
    p, top = metric_points(spark, d), _top_tickers(spark, d)
    names = p.filter("metric IS NOT NULL").select("metric").distinct().unionByName(spark.sql("SELECT 'not_a_metric' metric"))
    asked = names.select("metric", F.explode(F.array(*[F.lit(a) for a in metrics.AXES])).alias("axis"))
    return metrics.calculation_coverage(metrics.computed_values(p, list(metrics.AXES), "year_over_year", top), asked, top)


@query(
    f"""WITH {MP} SELECT series_key, period, document_period, CASE WHEN document_period IN ('FY2021', 'FY2022') THEN 0 WHEN period IN ('FY2021', 'FY2022') THEN 1 ELSE 2 END bucket,
    row_number() OVER (PARTITION BY series_key ORDER BY CASE WHEN document_period IN ('FY2021', 'FY2022') THEN 0 WHEN period IN ('FY2021', 'FY2022') THEN 1 ELSE 2 END, period DESC) place FROM mp"""
)
def filing_bucket_order(spark, d):
    """Points of each series with those filed in the requested periods first, then those that only observe them."""
    p = metric_points(spark, d)
    bucket = metrics.filing_bucket_order(p, ["FY2021", "FY2022"], "document_period", "period")
    p = p.withColumn("bucket", bucket)
    return p.select("series_key", "period", "document_period", "bucket", F.row_number().over(Window.partitionBy("series_key").orderBy("bucket", F.col("period").desc())).alias("place"))


_RANKED = f"""{MP}, rk AS (SELECT series_key, period, row_number() OVER (ORDER BY abs(value) DESC, series_key, period) rank FROM mp WHERE value IS NOT NULL AND metric = 'revenue')"""


@query(
    f"""WITH {_RANKED}, q AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY rank) place, period IN ('FY2018', 'FY2019') asked FROM rk), en AS (SELECT count(DISTINCT period) >= 2 enough FROM q WHERE asked),
    pool AS (SELECT *, rank <= 20 base, rank > 20 AND enough AS isnew FROM q, en WHERE rank <= 20 OR (asked AND place <= 2)), dr AS (SELECT *, base AND NOT asked droppable FROM pool),
    nn AS (SELECT least(count(*) FILTER (isnew), greatest(20 - count(*) FILTER (base), 0) + count(*) FILTER (droppable)) acc, greatest(20 - count(*) FILTER (base), 0) free FROM dr),
    o AS (SELECT *, row_number() OVER (PARTITION BY isnew ORDER BY rank) no, row_number() OVER (PARTITION BY droppable ORDER BY rank DESC) fe FROM dr, nn)
    SELECT series_key, period, isnew AND no <= acc reserved FROM o WHERE (isnew AND no <= acc) OR (base AND NOT (droppable AND fe <= greatest(acc - free, 0)))"""
)
def period_reservation(spark, d):
    """The 20 best points of a metric, in which each of two requested periods keeps two places."""
    asked = ["FY2018", "FY2019"]
    p = metric_points(spark, d).filter("value IS NOT NULL AND metric = 'revenue'").select("series_key", "period", F.abs("value").alias("size"))
    order = [F.col("size").desc(), F.col("series_key"), F.col("period")]
    # what can be in the answer: the window, and the best of each requested period
    best = p.orderBy(*order).limit(20)
    reserve = p.filter(F.col("period").isin(asked)).withColumn("place", F.row_number().over(Window.partitionBy("period").orderBy(*order))).filter("place <= 2").drop("place")
    pool = best.unionByName(reserve).distinct()
    ranked = pool.select("series_key", "period", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("rank"))
    return metrics.reserve_periods(ranked, asked, "period", "rank", 20).drop("rank")


# --- facts and what is derived from them

TAGS = {"xbrl": 0, "derived": 1}
UNITS = {"USD": 0, "usd": 1, "EUR": 2}
_RATIOS = {"net_margin": ("net_income", "revenue"), "operating_margin": ("operating_income", "revenue"), "capital_intensity": ("capital_expenditure", "revenue")}
_DIFFERENCES = {"cash_after_investment": ("free_cash_flow", "capital_expenditure")}
_FACTS = f"""{MP}, bf AS (SELECT ticker, metric, fiscal_year, fiscal_quarter, period_type, value, unit, source_class tag, object_id FROM mp WHERE scope_kind = 'company' AND value IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY ticker, metric, fiscal_year, fiscal_quarter, period_type ORDER BY CASE source_class WHEN 'xbrl' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END, CASE unit WHEN 'USD' THEN 0 WHEN 'usd' THEN 1 WHEN 'EUR' THEN 2 ELSE 3 END, source_sort_key DESC NULLS LAST, object_id DESC NULLS LAST, value DESC, unit DESC NULLS LAST) = 1)"""
FACT_KEYS = ["ticker", "metric", "fiscal_year", "fiscal_quarter", "period_type"]


def _best(spark, d):
    return metrics.best_facts(metric_points(spark, d).withColumnRenamed("source_class", "tag"), FACT_KEYS, TAGS, UNITS)


@query(f"WITH {_FACTS} SELECT * FROM bf")
def best_facts(spark, d):
    """The fact that stands for each company, metric and period: undimensioned, by tag, unit, newest filing."""
    return _best(spark, d)


def _derived_sql() -> str:
    names = sorted({m for pair in [*_RATIOS.values(), *_DIFFERENCES.values()] for m in pair})
    wide = ", ".join(f"max(value) FILTER (metric = '{m}') v_{m}, max(object_id) FILTER (metric = '{m}') o_{m}" for m in names)
    keys = "ticker, fiscal_year, fiscal_quarter, period_type"
    parts = [f"SELECT {keys}, '{n}' metric, CASE WHEN v_{b} <> 0 THEN v_{a} / v_{b} END AS value, o_{a} first_input, o_{b} second_input FROM w" for n, (a, b) in _RATIOS.items()]
    parts += [f"SELECT {keys}, '{n}', v_{a} - v_{b}, o_{a}, o_{b} FROM w" for n, (a, b) in _DIFFERENCES.items()]
    return f"WITH {_FACTS}, w AS (SELECT {keys}, {wide} FROM bf GROUP BY ALL), z AS ({' UNION ALL '.join(parts)}) SELECT {keys}, metric, round(value, 6) AS value, first_input, second_input FROM z WHERE value IS NOT NULL"


@query(_derived_sql())
def derived_metrics(spark, d):
    """Ratios and differences of the best facts of a period, with the facts they come from."""
    keys = ["ticker", "fiscal_year", "fiscal_quarter", "period_type"]
    return metrics.derived_metrics(_best(spark, d), keys, _RATIOS, _DIFFERENCES).withColumn("value", F.round("value", 6))


@query(f"""WITH {_FACTS}, y AS (SELECT ticker, metric, fiscal_year, max(value) v FROM bf WHERE fiscal_quarter IS NULL AND fiscal_year IS NOT NULL GROUP BY ALL) SELECT a.ticker, a.metric, a.fiscal_year, round((a.v - b.v) / abs(b.v) * 100, 6) growth_percent FROM y a JOIN y b ON a.ticker = b.ticker AND a.metric = b.metric AND a.fiscal_year = b.fiscal_year + 1 WHERE b.v <> 0""")
def growth_support(spark, d):
    """Growth percentages that annual facts support: the year exactly before, its absolute value as the base."""
    g = metrics.yearly_growth(_best(spark, d).filter("fiscal_quarter IS NULL"), ["ticker", "metric"], single=False)
    return g.withColumn("growth_percent", F.round("growth_percent", 6))


@query(
    f"""WITH {MP}, y AS (SELECT ticker, metric, unit, scope_key, fiscal_year, max(value) v FROM mp WHERE fiscal_quarter IS NULL AND fiscal_year IS NOT NULL AND value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT value) = 1)
    SELECT a.ticker, a.metric, a.unit, a.scope_key, a.fiscal_year, round((a.v - b.v) / abs(b.v) * 100, 6) growth_percent FROM y a JOIN y b ON a.ticker = b.ticker AND a.metric = b.metric AND a.unit = b.unit AND a.scope_key = b.scope_key AND a.fiscal_year = b.fiscal_year + 1 WHERE b.v <> 0"""
)
def single_growth_support(spark, d):
    """Growth percentages from years that hold exactly one value of their group."""
    p = metric_points(spark, d).filter("fiscal_quarter IS NULL")
    return metrics.yearly_growth(p, ["ticker", "metric", "unit", "scope_key"], single=True).withColumn("growth_percent", F.round("growth_percent", 6))


# --- catalog rows and dedupe


@query(
    """SELECT ticker, canonical_metric, series_key, status, observation_count FROM series_catalog WHERE ticker IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, canonical_metric ORDER BY status IS NOT DISTINCT FROM 'available' DESC, observation_count DESC NULLS LAST, series_key, status) = 1"""
)
def market_series_choice(spark, d):
    """The catalog row that answers for a company's metric: available first, then most readings, then the key."""
    c = _t(spark, d, "series_catalog").filter("ticker IS NOT NULL")
    order = F.struct((~F.coalesce(F.col("status") == "available", F.lit(False))).alias("a"), (-F.coalesce(F.col("observation_count"), F.lit(-1))).alias("n"), "series_key", "status")
    b = c.groupBy("ticker", "canonical_metric").agg(F.min(F.struct(order.alias("o"), "observation_count")).alias("b"))
    return b.select("ticker", "canonical_metric", F.col("b.o.series_key").alias("series_key"), F.col("b.o.status").alias("status"), "b.observation_count")


@query(f"""WITH {MP}, k AS (SELECT *, coalesce(value::varchar, '') idt FROM mp) SELECT ticker, metric, unit, scope_key, period_type, period, value, min(series_key) series_key, count(*) copies FROM mp WHERE value IS NOT NULL GROUP BY ticker, metric, unit, scope_key, period_type, period, value""")
def natural_key_dedupe(spark, d):
    """Metric rows by their natural key; the first series stands for the copies."""
    return metric_points(spark, d).filter("value IS NOT NULL").groupBy("ticker", "metric", "unit", "scope_key", "period_type", "period", "value").agg(F.min("series_key").alias("series_key"), F.count("*").alias("copies"))


@query(
    """WITH dd AS (SELECT ticker, document_id, min(document_type) document_type, max(filing_date) filing_date, max(period) period FROM global_object_locator WHERE document_id IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY ticker, document_type ORDER BY filing_date DESC NULLS LAST, document_id) rn, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC NULLS LAST, document_id) al FROM dd)
    SELECT ticker, document_id, 'latest_annual' AS role FROM r WHERE document_type = '10-K' AND rn = 1 UNION ALL SELECT ticker, document_id, 'latest_quarter' FROM r WHERE document_type = '10-Q' AND rn = 1 UNION ALL SELECT ticker, document_id, 'current' FROM r WHERE al = 1"""
)
def filing_roles(spark, d):
    """Each company's newest annual filing, newest quarterly filing and newest filing of any form."""
    dd = _t(spark, d, "global_object_locator").filter("document_id IS NOT NULL").groupBy("ticker", "document_id").agg(F.min("document_type").alias("document_type"), F.max("filing_date").alias("filing_date"))
    newest = Window.partitionBy("ticker", "document_type").orderBy(F.col("filing_date").desc_nulls_last(), "document_id")
    overall = Window.partitionBy("ticker").orderBy(F.col("filing_date").desc_nulls_last(), "document_id")
    r = dd.withColumns({"rn": F.row_number().over(newest), "al": F.row_number().over(overall)})
    roles = F.array(F.when((F.col("document_type") == "10-K") & (F.col("rn") == 1), F.lit("latest_annual")), F.when((F.col("document_type") == "10-Q") & (F.col("rn") == 1), F.lit("latest_quarter")), F.when(F.col("al") == 1, F.lit("current")))
    return r.select("ticker", "document_id", F.explode(F.filter(roles, lambda x: x.isNotNull())).alias("role"))
