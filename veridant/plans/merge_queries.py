"""Queries on merges, dictionaries, lookups and selections; each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridant.functions.lexical import words
from veridant.operators import ranking
from veridant.plans.evidence import _WORDS, _t, query
from veridant.plans.metric_queries import MP, metric_points
from veridant.plans.search_queries import _TS, OBJECTS, WEIGHTS, _hits, object_index, objects
from veridant.plans.spine_queries import _EDGES, edges

_KEY = "trim(regexp_replace(lower(coalesce(label, '')), '[^a-z0-9]+', '_', 'g'), '_')"


def _slug():
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("label", F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


@query(
    f"""WITH {_hits(["freight", "brokerage"])}, sl AS (SELECT doc, row_number() OVER (ORDER BY round(score, 6) DESC, doc) r FROM b WHERE matched = 2 ORDER BY r LIMIT 30), {_hits(["freight", "demand"]).split("tl AS (SELECT *, len(t1) + len(t2) + len(t3) dl FROM tk), ", 1)[1].replace("h0 AS", "g0 AS").replace("FROM h0", "FROM g0").replace(" h AS", " g AS").replace("FROM h ", "FROM g ").replace("st AS (SELECT q", "gt AS (SELECT q").replace("al AS (", "ga AS (").replace("b AS (SELECT doc", "c AS (SELECT doc").replace("FROM h JOIN st USING (q), al", "FROM g JOIN gt USING (q), ga").replace("JOIN st USING (q), al", "JOIN gt USING (q), ga")},
    lo AS (SELECT doc, row_number() OVER (ORDER BY round(score, 6) DESC, doc) r FROM c ORDER BY r LIMIT 30), u AS (SELECT doc, 0 list, r FROM sl UNION ALL SELECT doc, 1, r FROM lo) SELECT doc, list, r FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc ORDER BY list, r) = 1) ORDER BY list, r LIMIT 40"""
)
def ordered_merge(spark, d):
    """Two ranked lists as one: the first list in order, then what only the second has; 40 in all."""
    index = object_index(spark, d)
    rank = Window.partitionBy(F.lit(1)).orderBy(F.col("s").desc(), "doc")
    best = lambda terms, mode, n: index.bm25(terms, WEIGHTS, mode).select("doc", F.round("score", 6).alias("s")).orderBy(F.col("s").desc(), "doc").limit(30).select("doc", F.lit(n).alias("list"), F.row_number().over(rank).alias("r"))
    u = best(["freight", "brokerage"], "and", 0).unionByName(best(["freight", "demand"], "or", 1))
    first = u.groupBy("doc").agg(F.min(F.struct("list", "r")).alias("b")).select("doc", "b.list", "b.r")
    return first.orderBy("list", "r").limit(40)


@query(
    f"""WITH {OBJECTS}, {_EDGES}, s AS (SELECT to_object_id object_id, from_object_id ev FROM ed WHERE relation_type = 'supports' AND from_object_id IS NOT NULL), m AS (SELECT ticker, {_KEY} key, object_id FROM ob WHERE object_type = 'FactorExposure' AND ticker IS NOT NULL AND {_KEY} <> '')
    SELECT ticker, key, count(DISTINCT m.object_id) merged, count(DISTINCT ev) supports, min(m.object_id) kept FROM m LEFT JOIN s USING (object_id) GROUP BY 1, 2"""
)
def merged_exposures(spark, d):
    """Exposures of one key as one, with the supports of all of them."""
    s = edges(spark, d).filter("relation_type = 'supports' AND from_object_id IS NOT NULL").select(F.col("to_object_id").alias("object_id"), F.col("from_object_id").alias("ev"))
    m = objects(spark, d).filter("object_type = 'FactorExposure' AND ticker IS NOT NULL").select("ticker", _slug().alias("key"), "object_id").filter("key != ''")
    return m.join(s, "object_id", "left").groupBy("ticker", "key").agg(F.countDistinct("object_id").alias("merged"), F.countDistinct("ev").alias("supports"), F.min("object_id").alias("kept"))


@query(f"""WITH {OBJECTS} SELECT {_KEY} topic, count(*) objects, count(DISTINCT ticker) companies, count(DISTINCT object_type) kinds, min(object_id) source_object FROM ob WHERE {_KEY} <> '' GROUP BY 1""")
def global_topics(spark, d):
    """Topics of all shards as one index, with the object that stands for each."""
    o = objects(spark, d).withColumn("topic", _slug()).filter("topic != ''")
    return o.groupBy("topic").agg(F.count("*").alias("objects"), F.countDistinct("ticker").alias("companies"), F.countDistinct("object_type").alias("kinds"), F.min("object_id").alias("source_object"))


FACTORS = {"freight_rates": ["freight", "brokerage"], "inventory": ["inventory", "obsolescence"], "capacity": ["capacity"], "pricing": ["pricing", "price"], "currency": ["currency", "exchange"]}
_FACTORS = "[" + ", ".join(f"struct_pack(f := '{k}', a := {v})" for k, v in FACTORS.items()) + "]"


@query(
    f"""WITH {OBJECTS}, w AS (SELECT object_id, list_distinct({_WORDS.format(c="label")}) ws FROM ob), x AS (SELECT object_id, unnest({_FACTORS}) f, ws FROM w) SELECT object_id, f.f factor, len(list_intersect(ws, f.a)) hits FROM x WHERE len(list_intersect(ws, f.a)) > 0"""
)
def factor_keys(spark, d):
    """All factors that a label names by any of their aliases."""
    w = objects(spark, d).select("object_id", F.inline(F.array(F.struct(F.array_distinct(words(F.col("label"))).alias("ws")))))
    each = F.array(*[F.struct(F.lit(k).alias("factor"), F.size(F.array_intersect("ws", F.array(*[F.lit(a) for a in v]))).alias("hits")) for k, v in FACTORS.items()])
    return w.select("object_id", F.inline(each)).filter("hits > 0")


TAGS = {"Revenues": "revenue", "NetIncomeLoss": "net_income", "OperatingIncomeLoss": "operating_income", "LongTermDebt": "total_debt"}
NAMES = {"revenue": "revenue", "net income": "net_income", "operating income": "operating_income", "total debt": "total_debt", "gross margin": "gross_margin", "headcount": "headcount", "free cash flow": "free_cash_flow"}
_NAME_ROWS = ", ".join(f"('{a}', '{m}')" for a, m in NAMES.items())


@query(f"""WITH al(a, m) AS (VALUES {_NAME_ROWS}), n AS (SELECT DISTINCT metric_name, array_to_string({_WORDS.format(c="metric_name")}, ' ') a FROM chart_series WHERE metric_name IS NOT NULL) SELECT metric_name, m AS canonical FROM n LEFT JOIN al USING (a)""")
def canonical_metrics(spark, d):
    """Metric names with the canonical metric of the dictionary, null for those it does not know."""
    al = spark.createDataFrame(list(NAMES.items()), "a string, canonical string")
    n = _t(spark, d, "chart_series").filter("metric_name IS NOT NULL").select("metric_name", F.array_join(words(F.col("metric_name")), " ").alias("a")).distinct()
    return n.join(F.broadcast(al), "a", "left").select("metric_name", "canonical")


@query(
    f"""WITH {MP} SELECT ticker, metric, fiscal_year, value, object_id FROM mp WHERE value IS NOT NULL AND fiscal_year IS NOT NULL AND scope_kind = 'company' QUALIFY row_number() OVER (PARTITION BY ticker, metric, fiscal_year ORDER BY CASE source_class WHEN 'xbrl' THEN 0 ELSE 1 END, CASE document_type WHEN '10-K' THEN 0 ELSE 1 END, fiscal_quarter IS NOT NULL, source_sort_key DESC NULLS LAST, period DESC, object_id DESC NULLS LAST, value DESC) = 1"""
)
def reference_facts(spark, d):
    """The fact a year is checked against: by kind of source, annual filing, whole year, newest filing."""
    p = metric_points(spark, d).filter("value IS NOT NULL AND fiscal_year IS NOT NULL AND scope_kind = 'company'")
    w = Window.partitionBy("ticker", "metric", "fiscal_year").orderBy(F.when(F.col("source_class") == "xbrl", 0).otherwise(1), F.when(F.col("document_type") == "10-K", 0).otherwise(1), F.col("fiscal_quarter").isNotNull(), F.col("source_sort_key").desc_nulls_last(), F.col("period").desc(), F.col("object_id").desc_nulls_last(), F.col("value").desc())
    return p.withColumn("r", F.row_number().over(w)).filter("r = 1").select("ticker", "metric", "fiscal_year", "value", "object_id")


@query(
    f"""WITH {OBJECTS}, {_EDGES}, s AS (SELECT DISTINCT from_object_id claim, to_object_id object_id FROM ed JOIN ob ON ob.object_id = from_object_id WHERE relation_type = 'supports' AND object_type = 'ResearchClaim' AND to_object_id IS NOT NULL), x AS (SELECT claim, s.object_id, object_type FROM s JOIN ob ON ob.object_id = s.object_id)
    SELECT claim, object_id, object_type FROM x WHERE object_type IN ('FactorExposure', 'FinancialMetric') QUALIFY count(*) FILTER (object_type = 'FactorExposure') OVER (PARTITION BY claim) > 0 AND count(*) FILTER (object_type = 'FinancialMetric') OVER (PARTITION BY claim) > 0"""
)
def exposure_edges(spark, d):
    """Exposures and metrics that rest on the same claim, as members of their claim; each exposure is linked to each metric of it.

    The claim stands for all pairs of its members, which a hub would have too many of.
    """
    o = objects(spark, d)
    claims = o.filter("object_type = 'ResearchClaim'").select(F.col("object_id").alias("claim"))
    s = edges(spark, d).filter("relation_type = 'supports' AND to_object_id IS NOT NULL").select(F.col("from_object_id").alias("claim"), F.col("to_object_id").alias("object_id")).join(claims, "claim").distinct()
    x = s.join(o.select("object_id", "object_type").filter(F.col("object_type").isin("FactorExposure", "FinancialMetric")), "object_id")
    both = x.groupBy("claim").agg(F.countDistinct("object_type").alias("kinds")).filter("kinds = 2")
    return x.join(both, "claim", "left_semi").select("claim", "object_id", "object_type")


@query(
    f"""WITH {_hits(["freight", "demand"])}, m AS (SELECT from_object_id object_id, max(materiality) mat FROM global_edge_spine WHERE from_object_id IS NOT NULL GROUP BY 1) SELECT ob.object_id, matched, coalesce(mat, 0) materiality FROM b JOIN ob ON ob.object_id = doc LEFT JOIN m ON m.object_id = doc
    ORDER BY matched DESC, status = 'pass' DESC NULLS LAST, coalesce(mat, 0) DESC, coalesce(period, '') DESC, object_type, coalesce(ticker, ''), ob.object_id LIMIT 60"""
)
def topic_search(spark, d):
    """Sixty topics of a question by seven keys: words, soundness, materiality, period, kind, company, id."""
    m = _t(spark, d, "global_edge_spine").filter("from_object_id IS NOT NULL").groupBy(F.col("from_object_id").alias("object_id")).agg(F.max("materiality").alias("mat"))
    b = object_index(spark, d).bm25(["freight", "demand"], WEIGHTS).select(F.col("doc").alias("object_id"), "matched")
    j = b.join(objects(spark, d), "object_id").join(m, "object_id", "left").withColumn("materiality", F.coalesce("mat", F.lit(0.0)))
    order = [F.col("matched").desc(), (F.col("status") == "pass").desc_nulls_last(), F.col("materiality").desc(), F.coalesce("period", F.lit("")).desc(), F.col("object_type"), F.coalesce("ticker", F.lit("")), F.col("object_id")]
    return j.orderBy(*order).limit(60).select("object_id", "matched", "materiality")


@query(
    f"""WITH {MP} SELECT ticker, metric, scope_key, unit, string_agg(period || '=' || round(value, 1)::decimal(38, 1)::varchar, ';' ORDER BY fiscal_year, fiscal_quarter NULLS FIRST, period, series_key) points, count(*) n FROM mp WHERE value IS NOT NULL AND metric = 'revenue' AND scope_key IS NOT NULL AND unit IS NOT NULL AND fiscal_year IS NOT NULL GROUP BY 1, 2, 3, 4"""
)
def metric_series_rows(spark, d):
    """Observations of a metric as one series for each company, scope and unit, in order of periods."""
    p = metric_points(spark, d).filter("value IS NOT NULL AND metric = 'revenue' AND scope_key IS NOT NULL AND unit IS NOT NULL AND fiscal_year IS NOT NULL")
    one = F.struct("fiscal_year", "fiscal_quarter", "period", "series_key", F.concat("period", F.lit("="), F.round("value", 1).cast("decimal(38,1)").cast("string")).alias("t"))
    g = p.groupBy("ticker", "metric", "scope_key", "unit").agg(F.sort_array(F.collect_list(one)).alias("ps"), F.count("*").alias("n"))
    return g.select("ticker", "metric", "scope_key", "unit", F.array_join(F.transform("ps", lambda x: x.t), ";").alias("points"), "n")


@query(
    f"""WITH {OBJECTS}, r AS (SELECT ticker, object_id, object_type IN ('EvidenceQuote', 'ResearchClaim') ev, row_number() OVER (PARTITION BY ticker, object_type IN ('EvidenceQuote', 'ResearchClaim') ORDER BY label NULLS LAST, object_id) n FROM ob WHERE ticker IS NOT NULL AND object_type IS NOT NULL)
    SELECT ticker, object_id, ((n - 1) // 2) * 3 + CASE WHEN ev THEN (n - 1) % 2 ELSE 2 END AS slot FROM r WHERE (ev AND n <= 10) OR (NOT ev AND n <= 5 AND n % 2 = 1)"""
)
def interleaved_evidence(spark, d):
    """Evidence and meaning in turns: two of the first kind, one of the second, for each company."""
    ev = F.col("object_type").isin("EvidenceQuote", "ResearchClaim")
    o = objects(spark, d).filter("ticker IS NOT NULL AND object_type IS NOT NULL").withColumn("ev", ev)
    r = o.withColumn("n", F.row_number().over(Window.partitionBy("ticker", "ev").orderBy(F.col("label").asc_nulls_last(), "object_id")))
    r = r.filter((F.col("ev") & (F.col("n") <= 10)) | (~F.col("ev") & (F.col("n") <= 5) & (F.col("n") % 2 == 1)))
    slot = F.floor((F.col("n") - 1) / 2) * 3 + F.when(F.col("ev"), (F.col("n") - 1) % 2).otherwise(2)
    return r.select("ticker", "object_id", slot.cast("long").alias("slot"))


@query(
    f"""WITH {OBJECTS}, m AS (SELECT from_object_id object_id, max(materiality) mat, max(recency_score) rec FROM global_edge_spine WHERE from_object_id IS NOT NULL GROUP BY 1), k AS (SELECT label, count(DISTINCT ticker) c FROM ob WHERE label IS NOT NULL GROUP BY 1),
    s AS (SELECT ob.object_id, ob.ticker, round(0.5 * coalesce(mat, 0) + 0.3 * coalesce(rec, 0) + 0.2 * least(c, 5) / 5.0 + 1e-10, 6) score FROM ob JOIN k USING (label) LEFT JOIN m USING (object_id) WHERE ob.ticker IS NOT NULL)
    SELECT ticker, object_id, score FROM s QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY score DESC, object_id) <= 5"""
)
def cross_company_signals(spark, d):
    """Five signals of each company by materiality, recency and how many companies share their topic."""
    m = _t(spark, d, "global_edge_spine").filter("from_object_id IS NOT NULL").groupBy(F.col("from_object_id").alias("object_id")).agg(F.max("materiality").alias("mat"), F.max("recency_score").alias("rec"))
    o = objects(spark, d)
    k = o.filter("label IS NOT NULL").groupBy("label").agg(F.countDistinct("ticker").alias("c"))
    zero = F.lit(0.0)
    score = 0.5 * F.coalesce("mat", zero) + 0.3 * F.coalesce("rec", zero) + 0.2 * F.least(F.col("c"), F.lit(5)) / 5.0
    s = o.filter("ticker IS NOT NULL").join(k, "label").join(m, "object_id", "left").select("object_id", "ticker", F.round(score + 1e-10, 6).alias("score"))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("score").desc(), "object_id"))).filter("r <= 5").select("ticker", "object_id", "score")


@query(
    """SELECT DISTINCT period, CASE WHEN regexp_matches(upper(period), '^(CY|FY)?(19|20)[0-9]{2}(Q[1-4])?$') THEN CASE WHEN regexp_matches(upper(period), 'Q[1-4]$') THEN 'CY' ELSE 'FY' END || regexp_extract(period, '[0-9]{4}') || regexp_extract(upper(period), 'Q[1-4]$') END normalized, regexp_matches(period, '^CY[0-9]{4}$') calendar_year FROM chart_series_points WHERE period IS NOT NULL"""
)
def normalized_periods(spark, d):
    """Period labels in one form: fiscal years, calendar quarters; null for other labels."""
    up = F.upper("period")
    quarter = F.regexp_extract(up, r"Q[1-4]$", 0)
    made = F.concat(F.when(quarter != "", "CY").otherwise("FY"), F.regexp_extract("period", r"[0-9]{4}", 0), quarter)
    p = _t(spark, d, "chart_series_points").filter("period IS NOT NULL").select("period").distinct()
    return p.select("period", F.when(up.rlike(r"^(CY|FY)?(19|20)\d{2}(Q[1-4])?$"), made).alias("normalized"), F.col("period").rlike(r"^CY[0-9]{4}$").alias("calendar_year"))


@query(
    f"""WITH {MP}, r AS (SELECT series_key, period, value, 'observation' kind FROM mp WHERE scope_kind = 'company' AND source_class = 'derived' AND value IS NOT NULL UNION ALL SELECT series_key, period, value, 'dimensioned_fact' FROM mp WHERE scope_kind <> 'company' AND source_class = 'xbrl' AND value IS NOT NULL)
    SELECT kind, series_key, period, value, left(sha256(kind || '|' || series_key || '|' || period), 24) lookup_key FROM r"""
)
def metric_lookup_rows(spark, d):
    """Rows of the metric lookup: derived observations of companies, and facts only where they carry dimensions."""
    p = metric_points(spark, d).filter("value IS NOT NULL")
    a = p.filter("scope_kind = 'company' AND source_class = 'derived'").select(F.lit("observation").alias("kind"), "series_key", "period", "value")
    b = p.filter("scope_kind != 'company' AND source_class = 'xbrl'").select(F.lit("dimensioned_fact").alias("kind"), "series_key", "period", "value")
    r = a.unionByName(b)
    return r.withColumn("lookup_key", F.left(F.sha2(F.concat_ws("|", "kind", "series_key", "period"), 256), F.lit(24)))


@query(
    f"""WITH {_TS}, cl AS (SELECT unnest(['freight', 'inventory', 'pricing']) c), u AS (SELECT c, doc, len(list_filter(list_concat(list_concat(t1, t2), t3), lambda w: w = c)) hits FROM tl, cl), v AS (SELECT c, doc, hits, status IS NOT DISTINCT FROM 'pass' sound, object_type IN ('EvidenceQuote', 'ResearchClaim') ev FROM u JOIN ob ON object_id = doc WHERE hits > 0 AND object_type IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY ev DESC, sound DESC, hits DESC, doc) rn FROM v) SELECT c clause, doc, rn = 1 AS reserved FROM r ORDER BY (rn = 1) DESC, ev DESC, sound DESC, hits DESC, doc, c LIMIT 20"""
)
def evidence_candidates(spark, d):
    """Twenty candidates: the best unit of every clause first, then by kind, soundness and words."""
    o = objects(spark, d).filter("object_type IS NOT NULL")
    w = o.select("object_id", F.coalesce(F.col("status") == "pass", F.lit(False)).alias("sound"), F.col("object_type").isin("EvidenceQuote", "ResearchClaim").alias("ev"), F.explode(F.concat(words(F.col("label")), words(F.col("company")), words(F.col("summary")))).alias("clause")).filter(F.col("clause").isin("freight", "inventory", "pricing"))
    v = w.groupBy("clause", F.col("object_id").alias("doc"), "sound", "ev").agg(F.count("*").alias("hits"))
    best = [F.col("ev").desc(), F.col("sound").desc(), F.col("hits").desc(), F.col("doc")]
    r = v.withColumn("reserved", F.row_number().over(Window.partitionBy("clause").orderBy(*best)) == 1)
    return r.orderBy(F.col("reserved").desc(), *best, "clause").limit(20).select("clause", "doc", "reserved")


@query(
    """WITH o AS (SELECT ticker, object_type, document_type, period, count(DISTINCT object_id) n FROM global_object_locator WHERE ticker IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT ticker, sum(n) FILTER (document_type = '10-K') annual, sum(n) FILTER (document_type = '10-Q') quarterly, count(DISTINCT period) periods, max(period) FILTER (document_type = '10-K') newest_annual FROM o GROUP BY 1"""
)
def company_contexts(spark, d):
    """What there is of each company: objects of annual and quarterly filings, periods, the newest year."""
    o = _t(spark, d, "global_object_locator").filter("ticker IS NOT NULL").groupBy("ticker", "object_type", "document_type", "period").agg(F.countDistinct("object_id").alias("n"))
    form = lambda f, c: F.when(F.col("document_type") == f, F.col(c))
    return o.groupBy("ticker").agg(F.sum(form("10-K", "n")).alias("annual"), F.sum(form("10-Q", "n")).alias("quarterly"), F.countDistinct("period").alias("periods"), F.max(form("10-K", "period")).alias("newest_annual"))


@query(
    f"""WITH {OBJECTS}, {_EDGES}, n AS (SELECT from_object_id unit, to_object_id neighbour, max(materiality) weight FROM ed WHERE from_object_id IS NOT NULL AND to_object_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY weight DESC NULLS LAST, neighbour) rank FROM n), p AS (SELECT neighbour unit, sum(1.0 / (60 + rank)) prior FROM r WHERE rank <= 5 GROUP BY 1)
    SELECT unit, round(prior + 1e-10, 6) prior FROM p"""
)
def graph_priors(spark, d):
    """How often and how high units are among the five best neighbours of others, by reciprocal ranks."""
    n = edges(spark, d).filter("from_object_id IS NOT NULL AND to_object_id IS NOT NULL").groupBy(F.col("from_object_id").alias("unit"), F.col("to_object_id").alias("neighbour")).agg(F.max("materiality").alias("weight"))
    r = n.withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy(F.col("weight").desc_nulls_last(), "neighbour"))).filter("rank <= 5")
    return r.groupBy(F.col("neighbour").alias("unit")).agg(F.round(F.sum(1.0 / (ranking.RRF_K + F.col("rank"))) + 1e-10, 6).alias("prior"))
