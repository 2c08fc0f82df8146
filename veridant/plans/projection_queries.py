"""Queries on projections of objects, portfolios, ledgers and catalogs; each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridant.functions.lexical import words
from veridant.functions.timeparse import parse_instant
from veridant.operators import projections
from veridant.plans.data_quality_sql import _instants
from veridant.plans.evidence import _WORDS, _t, query
from veridant.plans.metric_queries import MP, metric_points
from veridant.plans.search_queries import OBJECTS, objects
from veridant.plans.spine_queries import _EDGES, edges
from veridant.session import spread

_PAIRS = f"""{OBJECTS}, {_EDGES}, su AS (SELECT DISTINCT to_object_id object_id, from_object_id other FROM ed WHERE relation_type = 'supports' AND from_object_id IS NOT NULL AND to_object_id IS NOT NULL), re AS (SELECT DISTINCT from_object_id object_id, to_object_id other FROM ed WHERE relation_type <> 'supports' AND from_object_id IS NOT NULL AND to_object_id IS NOT NULL)"""


def _channel_sql(source: str, most: int, name: str) -> str:
    return f"{name}0 AS (SELECT object_id, other, row_number() OVER (PARTITION BY object_id ORDER BY other) r FROM {source} WHERE object_id <> other), {name} AS (SELECT c.object_id, string_agg(ob.label, ' | ' ORDER BY r) t FROM {name}0 c JOIN ob ON ob.object_id = other WHERE r <= {most} AND ob.label IS NOT NULL GROUP BY 1)"


_TEXTS = f"""{_PAIRS}, {_channel_sql("su", 12, "cs")}, {_channel_sql("re", 16, "cr")}, tx AS (SELECT ob.object_id, concat_ws(' ', nullif(label, ''), nullif(summary, '')) own, coalesce(cs.t, '') support, coalesce(cr.t, '') related, coalesce(company, '') entities FROM ob LEFT JOIN cs USING (object_id) LEFT JOIN cr ON cr.object_id = ob.object_id)"""


@query(f"WITH {_TEXTS} SELECT *, left(concat_ws(' ', nullif(own, ''), nullif(entities, ''), nullif(support, '')), 160) compact FROM tx")
def retrieval_texts(spark, d):
    """The texts an object is found by: its own, of what supports it, of what it relates to, its company; and a short one."""
    e = edges(spark, d).filter("from_object_id IS NOT NULL AND to_object_id IS NOT NULL")
    s = e.filter("relation_type = 'supports'").select(F.col("to_object_id").alias("object_id"), F.col("from_object_id").alias("other"))
    r = e.filter("relation_type != 'supports'").select(F.col("from_object_id").alias("object_id"), F.col("to_object_id").alias("other"))
    return projections.retrieval_texts(objects(spark, d), s, r)


_SORT = "CASE WHEN regexp_matches({p}, '(19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') THEN replace(regexp_extract({p}, '(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}'), '-', '')::int WHEN regexp_matches({p}, '(19|20)[0-9]{{2}}-[0-9]{{2}}') THEN replace(regexp_extract({p}, '(?:19|20)[0-9]{{2}}-[0-9]{{2}}'), '-', '')::int * 100 WHEN regexp_matches({p}, '(19|20)[0-9]{{2}}') THEN regexp_extract({p}, '((?:19|20)[0-9]{{2}})', 1)::int * 10000 END"


@query(
    f"""WITH {OBJECTS}, f AS (SELECT object_id, max(filing_date) filing_date FROM global_object_locator WHERE object_id IS NOT NULL GROUP BY 1) SELECT object_id, object_type kind, ticker, trim(regexp_replace(lower(coalesce(label, '')), '[^a-z0-9]+', '_', 'g'), '_') AS key, {_SORT.format(p="filing_date")} filed_key, {_SORT.format(p="period")} period_key FROM ob JOIN f USING (object_id) WHERE object_type IN ('FactorExposure', 'NamedEntity')"""
)
def typed_projections(spark, d):
    """Rows of factors and entities with a normalised key and dates that sort."""
    f = _t(spark, d, "global_object_locator").filter("object_id IS NOT NULL").groupBy("object_id").agg(F.max("filing_date").alias("filing_date"))
    o = objects(spark, d).filter(F.col("object_type").isin("FactorExposure", "NamedEntity")).join(f, "object_id")
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("label", F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return o.select("object_id", F.col("object_type").alias("kind"), "ticker", key.alias("key"), projections.date_sort_key(F.col("filing_date")).alias("filed_key"), projections.date_sort_key(F.col("period")).alias("period_key"))


_ASK = ["freight", "demand", "warehouse"]


@query(
    f"""WITH {OBJECTS}, s AS (SELECT object_id, object_type, ticker, len(list_intersect(list_distinct({_WORDS.format(c="label")}), {_ASK})) hits, CASE status WHEN 'pass' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS state, coalesce(period, '') period FROM ob WHERE object_type IN ('FactorExposure', 'NamedEntity'))
    SELECT object_id, hits, state FROM s WHERE hits > 0 ORDER BY hits DESC, state, period DESC, object_id LIMIT 100"""
)
def typed_projection_search(spark, d):
    """Factors and entities by how many words of a question they hold, sound ones first, the newest first; the best 100."""
    o = objects(spark, d).filter(F.col("object_type").isin("FactorExposure", "NamedEntity"))
    hits = F.size(F.array_intersect(F.array_distinct(words(F.col("label"))), F.array(*[F.lit(t) for t in _ASK])))
    state = F.when(F.col("status") == "pass", 0).when(F.col("status") == "warn", 1).otherwise(2)
    s = o.select("object_id", hits.alias("hits"), state.alias("state"), F.coalesce("period", F.lit("")).alias("period")).filter("hits > 0")
    return s.orderBy(F.col("hits").desc(), "state", F.col("period").desc(), "object_id").limit(100).drop("period")


@query(
    f"""WITH {OBJECTS}, m AS (SELECT from_object_id object_id, max(materiality) mat FROM global_edge_spine WHERE from_object_id IS NOT NULL GROUP BY 1) SELECT ticker, object_id, label FROM ob LEFT JOIN m USING (object_id) WHERE ticker IS NOT NULL AND (contains(lower(label), 'freight') OR contains(lower(label), 'demand'))
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY coalesce(mat, 0) DESC, label, object_id) <= 5"""
)
def topic_rows(spark, d):
    """Five topics of each company that hold a word of the question, the most material first."""
    m = _t(spark, d, "global_edge_spine").filter("from_object_id IS NOT NULL").groupBy(F.col("from_object_id").alias("object_id")).agg(F.max("materiality").alias("mat"))
    low = F.lower("label")
    o = objects(spark, d).filter(F.col("ticker").isNotNull() & (F.contains(low, F.lit("freight")) | F.contains(low, F.lit("demand")))).join(m, "object_id", "left")
    w = Window.partitionBy("ticker").orderBy(F.coalesce("mat", F.lit(0.0)).desc(), "label", "object_id")
    return o.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("ticker", "object_id", "label")


@query(
    f"""WITH {MP} SELECT series_key, period, value FROM mp a WHERE scope_kind <> 'company' AND EXISTS (SELECT 1 FROM mp b WHERE b.ticker = a.ticker AND b.scope_key = a.scope_key AND b.metric = 'revenue') AND EXISTS (SELECT 1 FROM mp c WHERE c.ticker = a.ticker AND c.period = a.period AND c.scope_kind = 'company')"""
)
def dimensioned_points(spark, d):
    """Points of parts whose part also reports revenue and whose period has a company total: a semi-join for each condition."""
    p = metric_points(spark, d)
    revenue = p.filter("metric = 'revenue'").select("ticker", "scope_key").distinct()
    total = p.filter("scope_kind = 'company'").select("ticker", "period").distinct()
    a = p.filter("scope_kind != 'company'").join(revenue, ["ticker", "scope_key"], "left_semi").join(total, ["ticker", "period"], "left_semi")
    return a.select("series_key", "period", "value")


@query(
    f"""WITH {OBJECTS}, {_EDGES}, c AS (SELECT ed.from_object_id object_id, ed.to_object_id context, b.period, b.object_type FROM ed JOIN ob a ON a.object_id = ed.from_object_id JOIN ob b ON b.object_id = ed.to_object_id AND a.ticker = b.ticker WHERE a.period IS DISTINCT FROM b.period AND ed.from_object_id <> ed.to_object_id)
    SELECT DISTINCT object_id, context FROM (SELECT * FROM (SELECT DISTINCT * FROM c) QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY period DESC NULLS LAST, object_type, context) <= 12)"""
)
def temporal_context(spark, d):
    """Neighbours of each object in its company's other periods, twelve, the newest first."""
    o = objects(spark, d)
    a = o.select(F.col("object_id").alias("from_object_id"), "ticker", F.col("period").alias("from_period"))
    b = o.select(F.col("object_id").alias("to_object_id"), "ticker", "period", "object_type")
    c = edges(spark, d).filter("from_object_id != to_object_id").select("from_object_id", "to_object_id").join(a, "from_object_id").join(b, ["to_object_id", "ticker"]).filter("NOT from_period <=> period")
    c = c.select(F.col("from_object_id").alias("object_id"), F.col("to_object_id").alias("context"), "period", "object_type").distinct()
    w = Window.partitionBy("object_id").orderBy(F.col("period").desc_nulls_last(), "object_type", "context")
    return c.withColumn("r", F.row_number().over(w)).filter("r <= 12").select("object_id", "context").distinct()


@query(
    """WITH s AS (SELECT DISTINCT series_key, ticker, scope_kind, scope_key, scope_label FROM chart_series WHERE scope_kind IS NOT NULL), c AS (SELECT ticker, scope_kind, scope_key, scope_label, count(*) n FROM s WHERE scope_label IS NOT NULL GROUP BY ALL),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY ticker, scope_kind, scope_key ORDER BY n DESC, length(scope_label) DESC, scope_label) = 1)
    SELECT b.ticker, b.scope_kind, b.scope_key, b.scope_label AS label, (SELECT count(DISTINCT series_key) FROM s WHERE s.ticker = b.ticker AND s.scope_kind = b.scope_kind AND s.scope_key IS NOT DISTINCT FROM b.scope_key) series FROM b"""
)
def dimension_catalog(spark, d):
    """Dimensions of each company with their commonest label, the longest of equals, and how many series they have."""
    s = _t(spark, d, "chart_series").filter("scope_kind IS NOT NULL").select("series_key", "ticker", "scope_kind", "scope_key", "scope_label").distinct()
    keys = ["ticker", "scope_kind", "scope_key"]
    n = s.groupBy(*keys).agg(F.countDistinct("series_key").alias("series"))
    b = projections.modal_label(s, keys, "scope_label").drop("n")
    same = b["ticker"].eqNullSafe(n["ticker"]) & b["scope_kind"].eqNullSafe(n["scope_kind"]) & b["scope_key"].eqNullSafe(n["scope_key"])
    return b.join(n, same).select(b["ticker"], b["scope_kind"], b["scope_key"], "label", "series")


@query(
    """WITH k AS (SELECT 'object' kind, compact_label AS key, ticker FROM global_object_locator UNION ALL SELECT 'metric', canonical_metric, ticker FROM chart_series UNION ALL SELECT 'relation', relation_type, ticker FROM global_edge_spine UNION ALL SELECT 'section', section_key, ticker FROM mini_10k_spans UNION ALL SELECT 'form', document_type, ticker FROM documents)
    SELECT kind, key, count(DISTINCT ticker) companies, count(*) AS refs, count(DISTINCT ticker) >= 25 AS generic FROM k WHERE key IS NOT NULL AND ticker IS NOT NULL GROUP BY 1, 2"""
)
def key_statistics_all(spark, d):
    """Keys of five tables with the companies that share them; keys of many companies are generic."""
    of = lambda t, kind, key: _t(spark, d, t).select(F.lit(kind).alias("kind"), F.col(key).alias("key"), "ticker")
    k = of("global_object_locator", "object", "compact_label").unionByName(of("chart_series", "metric", "canonical_metric")).unionByName(of("global_edge_spine", "relation", "relation_type")).unionByName(of("mini_10k_spans", "section", "section_key")).unionByName(of("documents", "form", "document_type"))
    g = k.filter("key IS NOT NULL AND ticker IS NOT NULL").groupBy("kind", "key").agg(F.countDistinct("ticker").alias("companies"), F.count("*").alias("refs"))
    return g.withColumn("generic", F.col("companies") >= 25)


@query(
    f"""WITH {OBJECTS}, m AS (SELECT from_object_id object_id, max(materiality) mat, max(evidence_grade) grade FROM global_edge_spine WHERE from_object_id IS NOT NULL GROUP BY 1), r AS (SELECT label key, ticker, object_id, coalesce(mat, 0.5) mat FROM ob LEFT JOIN m USING (object_id) WHERE label IS NOT NULL AND ticker IS NOT NULL)
    SELECT key, ticker, object_id FROM r QUALIFY row_number() OVER (PARTITION BY key, ticker ORDER BY mat DESC, object_id) = 1 AND count(*) OVER (PARTITION BY key) > 1"""
)
def best_references(spark, d):
    """The reference of each company that stands for a shared key: the most material, then the first."""
    m = _t(spark, d, "global_edge_spine").filter("from_object_id IS NOT NULL").groupBy(F.col("from_object_id").alias("object_id")).agg(F.max("materiality").alias("mat"))
    r = objects(spark, d).filter("label IS NOT NULL AND ticker IS NOT NULL").join(m, "object_id", "left").select(F.col("label").alias("key"), "ticker", "object_id", F.coalesce("mat", F.lit(0.5)).alias("mat"))
    b = r.groupBy("key", "ticker").agg(F.min(F.struct((-F.col("mat")).alias("m"), "object_id")).alias("b"), F.count("*").alias("n"))
    shared = b.groupBy("key").agg(F.sum("n").alias("all")).filter(F.col("all") > 1)
    return b.join(shared, "key", "left_semi").select("key", "ticker", F.col("b.object_id").alias("object_id"))


@query(
    f"""WITH {OBJECTS}, s AS (SELECT object_id, ticker author, object_type AS role, len(list_intersect(list_distinct({_WORDS.format(c="label")}), ['freight', 'demand', 'warehouse', 'inventory'])) score FROM ob WHERE ticker IS NOT NULL AND object_type IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY score DESC, author, object_id) a, row_number() OVER (PARTITION BY role ORDER BY score DESC, author, object_id) ro FROM s WHERE score > 0), t AS (SELECT *, CASE WHEN a = 1 THEN 0 WHEN ro = 1 AND role IN ('FactorExposure', 'ResearchClaim') THEN 1 ELSE 2 END step FROM r)
    SELECT object_id, author, role, score, step FROM t ORDER BY step, score DESC, author, object_id LIMIT 15"""
)
def lens_portfolio(spark, d):
    """Fifteen answers: the best of every company, then of the preferred kinds, then of the rest."""
    score = F.size(F.array_intersect(F.array_distinct(words(F.col("label"))), F.array(*[F.lit(t) for t in ("freight", "demand", "warehouse", "inventory")])))
    s = objects(spark, d).filter("ticker IS NOT NULL AND object_type IS NOT NULL").select("object_id", F.col("ticker").alias("author"), F.col("object_type").alias("role"), score.alias("score"))
    return projections.portfolio(s, "author", "role", "score", "object_id", ["FactorExposure", "ResearchClaim"], 15)


@query(
    f"""WITH {OBJECTS}, u AS (SELECT c clause_id, ticker, object_type IN ('EvidenceQuote', 'ResearchClaim') AND status = 'pass' eligible, object_type = 'EvidenceQuote' strong FROM ob, (SELECT unnest(['freight', 'hydrogen', 'zeppelin']) c) WHERE contains(lower(label), c) AND ticker IS NOT NULL AND object_type IS NOT NULL AND status IS NOT NULL),
    tk AS (SELECT list(t) ts FROM (SELECT DISTINCT ticker t FROM ob WHERE ticker IS NOT NULL ORDER BY 1 LIMIT 2)), g AS (SELECT clause_id, list(DISTINCT ticker) FILTER (eligible) have, list(DISTINCT ticker) FILTER (eligible AND strong) best, bool_or(eligible) anyone FROM u GROUP BY 1)
    SELECT c.c clause_id, c.c <> 'zeppelin' required, CASE WHEN g.clause_id IS NULL THEN 'missing' WHEN anyone AND len(list_filter(ts, lambda t: NOT list_contains(coalesce(have, []), t))) = 0 THEN 'covered' ELSE 'partial' END coverage, coalesce(anyone, false) AND len(list_filter(ts, lambda t: NOT list_contains(coalesce(best, []), t))) = 0 strong
    FROM (SELECT unnest(['freight', 'hydrogen', 'zeppelin']) c) c CROSS JOIN tk LEFT JOIN g ON g.clause_id = c.c"""
)
def clause_coverage(spark, d):
    """Whether each clause of a question is covered for the companies it needs, and by strong evidence."""
    o = objects(spark, d)
    needed = [r.ticker for r in o.filter("ticker IS NOT NULL").select("ticker").distinct().orderBy("ticker").limit(2).collect()]
    asked = ["freight", "hydrogen", "zeppelin"]
    held = F.filter(F.array(*[F.lit(c) for c in asked]), lambda c: F.contains(F.lower("label"), c))
    u = o.filter("ticker IS NOT NULL AND object_type IS NOT NULL AND status IS NOT NULL").select(F.explode(held).alias("clause_id"), "ticker", (F.col("object_type").isin("EvidenceQuote", "ResearchClaim") & (F.col("status") == "pass")).alias("eligible"), (F.col("object_type") == "EvidenceQuote").alias("strong"))
    clauses = spark.createDataFrame([(c, c != "zeppelin", needed) for c in asked], "clause_id string, required boolean, tickers array<string>")
    return projections.clause_coverage(u, clauses)


@query(
    """WITH s AS (SELECT DISTINCT id, source_document_id, text FROM mini_10k_spans WHERE id IS NOT NULL AND text IS NOT NULL), n AS (SELECT id, source_document_id, unnest(regexp_extract_all(text, '[$]([0-9][0-9,]*(?:[.][0-9]+)?)', 1)) raw FROM s), q AS (SELECT 'span' source, source_document_id document, 'amount' kind, replace(raw, ',', '')::double AS value, id evidence FROM n),
    f AS (SELECT 'fact', source_document_id, 'amount', value, object_id FROM chart_series_points WHERE value IS NOT NULL AND object_id IS NOT NULL) SELECT source, document, kind, value, min(evidence) evidence FROM (SELECT * FROM q UNION ALL SELECT * FROM f) GROUP BY 1, 2, 3, 4"""
)
def numeric_ledger(spark, d):
    """Amounts that texts and facts state, once for each source, document and value, with the first that states it."""
    s = _t(spark, d, "mini_10k_spans").filter("id IS NOT NULL AND text IS NOT NULL").select("id", "source_document_id", "text").distinct()
    n = s.select("id", "source_document_id", F.explode(F.regexp_extract_all("text", F.lit(r"\$([0-9][0-9,]*(?:\.[0-9]+)?)"), 1)).alias("raw"))
    q = n.select(F.lit("span").alias("source"), F.col("source_document_id").alias("document"), F.lit("amount").alias("kind"), F.replace("raw", F.lit(","), F.lit("")).cast("double").alias("value"), F.col("id").alias("evidence"))
    f = _t(spark, d, "chart_series_points").filter("value IS NOT NULL AND object_id IS NOT NULL").select(F.lit("fact").alias("source"), F.col("source_document_id").alias("document"), F.lit("amount").alias("kind"), "value", F.col("object_id").alias("evidence"))
    return q.unionByName(f).groupBy("source", "document", "kind", "value").agg(F.min("evidence").alias("evidence"))


@query(
    """WITH a AS (SELECT DISTINCT ticker FROM global_object_locator WHERE ticker IS NOT NULL), b AS (SELECT DISTINCT ticker FROM chart_series WHERE ticker IS NOT NULL), c AS (SELECT DISTINCT ticker FROM documents WHERE ticker IS NOT NULL)
    SELECT 'everywhere' AS place, ticker FROM (FROM a INTERSECT FROM b INTERSECT FROM c) UNION ALL SELECT 'objects_only', ticker FROM (FROM a EXCEPT FROM b EXCEPT FROM c) UNION ALL SELECT 'documents_only', ticker FROM (FROM c EXCEPT FROM a)"""
)
def company_sets(spark, d):
    """Companies that all tables know, and those that one table knows alone."""
    t = lambda n: _t(spark, d, n).filter("ticker IS NOT NULL").select("ticker")
    a, b, c = t("global_object_locator"), t("chart_series"), t("documents")
    tag = lambda df, name: df.select(F.lit(name).alias("place"), "ticker")
    return tag(a.intersect(b).intersect(c), "everywhere").unionByName(tag(a.distinct().subtract(b).subtract(c), "objects_only")).unionByName(tag(c.distinct().subtract(a), "documents_only"))


@query(
    """WITH p AS (SELECT DISTINCT series_key, period, value FROM chart_series_points WHERE value > 0), s AS (SELECT series_key, max(ticker) ticker, max(canonical_metric) metric FROM chart_series GROUP BY 1), j AS (SELECT * FROM p JOIN s USING (series_key))
    SELECT a.series_key, b.series_key other_series, a.period, count(*) AS matches FROM j a JOIN j b ON a.ticker = b.ticker AND a.period = b.period AND a.metric = b.metric AND a.series_key < b.series_key AND abs(a.value - b.value) <= 0.005 * a.value GROUP BY 1, 2, 3"""
)
def tolerance_matches(spark, d):
    """Points of two series of a company and metric that agree within half a percent in a period: an equi-join with a bound inside."""
    s = _t(spark, d, "chart_series").groupBy("series_key").agg(F.max("ticker").alias("ticker"), F.max("canonical_metric").alias("metric"))
    j = _t(spark, d, "chart_series_points").filter("value > 0").select("series_key", "period", "value").distinct().join(s, "series_key")
    b = j.select("ticker", "metric", "period", F.col("series_key").alias("other_series"), F.col("value").alias("other"))
    m = j.join(b, ["ticker", "metric", "period"]).filter((F.col("series_key") < F.col("other_series")) & (F.abs(F.col("value") - F.col("other")) <= 0.005 * F.col("value")))
    return m.groupBy("series_key", "other_series", "period").agg(F.count("*").alias("matches"))


@query(
    f"""WITH {OBJECTS}, w AS (SELECT ticker, unnest(list_distinct({_WORDS.format(c="label")})) w FROM ob WHERE ticker IS NOT NULL AND object_type = 'FactorExposure'), c AS (SELECT ticker, w, count(*) n FROM w WHERE length(w) > 3 GROUP BY 1, 2)
    SELECT ticker, string_agg(w, ',' ORDER BY n DESC, w) factors FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, w) <= 5) GROUP BY 1"""
)
def company_profiles(spark, d):
    """The five commonest words of each company's exposures."""
    w = objects(spark, d).filter("ticker IS NOT NULL AND object_type = 'FactorExposure'").select("ticker", F.explode(F.array_distinct(words(F.col("label")))).alias("w")).filter(F.length("w") > 3)
    c = w.groupBy("ticker", "w").agg(F.count("*").alias("n"))
    top = c.withColumn("r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("n").desc(), "w"))).filter("r <= 5")
    return top.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x.w), ",").alias("factors"))


@query(
    """WITH o AS (SELECT ticker, document_type, count(DISTINCT document_id) n, max(period) newest FROM global_object_locator WHERE ticker IS NOT NULL AND document_type IS NOT NULL GROUP BY 1, 2) SELECT ticker, string_agg(document_type || '=' || n || '@' || newest, ';' ORDER BY document_type) coverage, sum(n) documents FROM o GROUP BY 1"""
)
def web_catalog(spark, d):
    """A nested catalog of each company: forms with their documents and newest period."""
    o = _t(spark, d, "global_object_locator").filter("ticker IS NOT NULL AND document_type IS NOT NULL").groupBy("ticker", "document_type").agg(F.countDistinct("document_id").alias("n"), F.max("period").alias("newest"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("document_type", "n", "newest"))), lambda x: F.concat(x.document_type, F.lit("="), x.n.cast("string"), F.lit("@"), x.newest))
    return o.groupBy("ticker").agg(F.array_join(text, ";").alias("coverage"), F.sum("n").alias("documents"))


@query(
    f"""WITH {_instants("o", "SELECT ticker, trade_date t, 'UTC' z, close FROM ohlcv_observations WHERE close IS NOT NULL")}, b AS (SELECT ticker, u::date dy, max(close) AS close FROM o WHERE u IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dy DESC) r FROM b)
    SELECT ticker, dy AS trade_day, close, row_number() OVER (PARTITION BY ticker ORDER BY dy) position FROM n WHERE r <= 20"""
)
def market_series(spark, d):
    """The newest twenty closes of each company, oldest first, however their days are written."""
    o = parse_instant(spread(_t(spark, d, "ohlcv_observations").select("ticker", "trade_date", "close").filter("close IS NOT NULL")), F.col("trade_date"), F.lit("UTC"), "sec")
    b = o.filter("sec IS NOT NULL").groupBy("ticker", F.date_from_unix_date(F.floor(F.col("sec") / 86400).cast("int")).alias("trade_day")).agg(F.max("close").alias("close"))
    n = b.withColumn("r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("trade_day").desc()))).filter("r <= 20")
    return n.select("ticker", "trade_day", "close", F.row_number().over(Window.partitionBy("ticker").orderBy("trade_day")).alias("position"))


@query(
    f"""WITH {OBJECTS}, {_EDGES}, g AS (SELECT object_id, label, object_type, ticker, row_number() OVER (PARTITION BY ticker, object_type, trim(regexp_replace(lower(coalesce(label, '')), '[^a-z0-9]+', '_', 'g'), '_') ORDER BY object_id) rn, EXISTS (SELECT 1 FROM ed WHERE to_object_id = ob.object_id AND relation_type = 'supports') sup FROM ob)
    SELECT object_id, CASE WHEN coalesce(label, '') = '' THEN 'no_label' WHEN length(label) < 12 THEN 'short_label' WHEN NOT sup THEN 'unsupported' WHEN rn > 1 THEN 'duplicate' ELSE 'accepted' END verdict FROM g"""
)
def curated_objects(spark, d):
    """Objects accepted or rejected with the first reason; of a company's equal labels the first object wins."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("label", F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    sup = edges(spark, d).filter("relation_type = 'supports' AND to_object_id IS NOT NULL").select(F.col("to_object_id").alias("object_id"), F.lit(True).alias("sup")).distinct()
    o = objects(spark, d).withColumn("key", key).join(sup, "object_id", "left")
    rn = F.row_number().over(Window.partitionBy("ticker", "object_type", "key").orderBy("object_id"))
    verdict = F.when(F.coalesce("label", F.lit("")) == "", "no_label").when(F.length("label") < 12, "short_label").when(F.col("sup").isNull(), "unsupported").when(F.col("rn") > 1, "duplicate").otherwise("accepted")
    return o.withColumn("rn", rn).select("object_id", verdict.alias("verdict"))


@query(
    f"""WITH {OBJECTS}, {_EDGES}, h AS (SELECT object_id, row_number() OVER (PARTITION BY ticker ORDER BY label, object_id) rank, ticker, object_type FROM ob WHERE contains(lower(label), 'freight') AND ticker IS NOT NULL), top AS (SELECT * FROM h WHERE rank <= 10), n AS (SELECT ticker, to_object_id object_id, max(1000 - rank + 180) s FROM top JOIN ed ON from_object_id = top.object_id GROUP BY 1, 2),
    a AS (SELECT ticker, object_id, 1000.0 - rank s FROM top UNION ALL SELECT ticker, object_id, s FROM n), b AS (SELECT ticker, object_id, max(s) s FROM a GROUP BY 1, 2)
    SELECT b.ticker, b.object_id, (b.s + CASE ob.object_type WHEN 'EvidenceQuote' THEN 15 WHEN 'ResearchClaim' THEN 10 ELSE 0 END)::double score FROM b JOIN ob ON ob.object_id = b.object_id QUALIFY row_number() OVER (PARTITION BY b.ticker ORDER BY score DESC, b.object_id) <= 10"""
)
def graph_lift(spark, d):
    """Hits and their neighbours by rank, promotion and kind; ten of each company."""
    o = objects(spark, d)
    h = o.filter(F.contains(F.lower("label"), F.lit("freight")) & F.col("ticker").isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy("ticker").orderBy("label", "object_id"))).filter("rank <= 10").select("ticker", "object_id", "rank")
    e = edges(spark, d).select(F.col("from_object_id").alias("object_id"), "to_object_id")
    n = h.join(e, "object_id").select("ticker", F.col("to_object_id").alias("object_id"), (F.lit(1180.0) - F.col("rank")).alias("s"))
    b = h.select("ticker", "object_id", (F.lit(1000.0) - F.col("rank")).alias("s")).unionByName(n).groupBy("ticker", "object_id").agg(F.max("s").alias("s"))
    b = b.join(o.select("object_id", "object_type"), "object_id").withColumn("score", F.col("s") + F.when(F.col("object_type") == "EvidenceQuote", 15).when(F.col("object_type") == "ResearchClaim", 10).otherwise(0))
    w = Window.partitionBy("ticker").orderBy(F.col("score").desc(), "object_id")
    return b.withColumn("r", F.row_number().over(w)).filter("r <= 10").select("ticker", "object_id", "score")
