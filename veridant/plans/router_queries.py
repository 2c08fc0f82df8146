"""Queries on routing and directness, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridant.functions.lexical import words
from veridant.operators import routing
from veridant.plans.evidence import _WORDS, _t, query
from veridant.plans.search_queries import _TS, OBJECTS, WEIGHTS, _hits, object_index, objects

_KEY = "trim(regexp_replace(lower(coalesce(label, '')), '[^a-z0-9]+', '_', 'g'), '_')"
TERMS = ["demand", "freight", "brokerage"]


@query(
    f"""WITH {OBJECTS} SELECT ticker, split_part({_KEY}, '_of_', 1) family, count(*) objects, count(DISTINCT object_type) kinds, min(object_id) first_object, count(DISTINCT period) periods FROM ob WHERE ticker IS NOT NULL AND {_KEY} <> '' GROUP BY 1, 2"""
)
def routing_units(spark, d):
    """Units that a question can be routed to: one for each company and family of topics, with what it holds."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("label", F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    o = objects(spark, d).filter("ticker IS NOT NULL").withColumn("key", key).filter("key != ''").withColumn("family", F.substring_index("key", "_of_", 1))
    return o.groupBy("ticker", "family").agg(F.count("*").alias("objects"), F.countDistinct("object_type").alias("kinds"), F.min("object_id").alias("first_object"), F.countDistinct("period").alias("periods"))


@query(
    f"""WITH {OBJECTS}, n AS (SELECT ticker, company, count(*) c FROM ob WHERE ticker IS NOT NULL AND company IS NOT NULL GROUP BY 1, 2), m AS (SELECT ticker, company FROM n QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY c DESC, company) = 1)
    SELECT o.ticker, coalesce(m.company, o.ticker) company_name, o.objects, o.documents FROM (SELECT ticker, count(*) objects, count(DISTINCT document_type) documents FROM ob WHERE ticker IS NOT NULL GROUP BY 1) o LEFT JOIN m ON m.ticker = o.ticker"""
)
def ticker_profiles(spark, d):
    """Companies with their commonest name, or the ticker without one, and how much there is of them."""
    o = objects(spark, d).filter("ticker IS NOT NULL")
    n = o.filter("company IS NOT NULL").groupBy("ticker", "company").agg(F.count("*").alias("c"))
    m = n.groupBy("ticker").agg(F.min(F.struct((-F.col("c")).alias("c"), "company")).alias("b")).select("ticker", F.col("b.company").alias("company"))
    p = o.groupBy("ticker").agg(F.count("*").alias("objects"), F.countDistinct("document_type").alias("documents"))
    return p.join(m, "ticker", "left").select("ticker", F.coalesce("company", "ticker").alias("company_name"), "objects", "documents")


@query(
    f"""WITH {OBJECTS}, a AS (SELECT DISTINCT array_to_string({_WORDS.format(c="company")}, ' ') alias, ticker, 2 priority FROM ob WHERE company IS NOT NULL AND ticker IS NOT NULL UNION SELECT DISTINCT lower(ticker), ticker, 3 FROM ob WHERE ticker IS NOT NULL)
    SELECT alias, count(DISTINCT ticker) companies, max(priority) priority, arg_min(ticker, struct_pack(p := -priority, t := ticker)) best FROM a WHERE alias <> '' GROUP BY 1"""
)
def alias_lookup(spark, d):
    """Aliases with the companies they name; the best by priority, a ticker over a name."""
    o = objects(spark, d).filter("ticker IS NOT NULL")
    names = o.filter("company IS NOT NULL").select(F.array_join(words(F.col("company")), " ").alias("alias"), "ticker", F.lit(2).alias("priority"))
    a = names.unionByName(o.select(F.lower("ticker").alias("alias"), "ticker", F.lit(3).alias("priority"))).filter("alias != ''").distinct()
    return a.groupBy("alias").agg(F.countDistinct("ticker").alias("companies"), F.max("priority").alias("priority"), F.min(F.struct((-F.col("priority")).alias("p"), "ticker")).alias("b")).select("alias", "companies", "priority", F.col("b.ticker").alias("best"))


_FACET = "(object_type = 'FactorExposure')::int + (document_type = '10-K')::int + (period = 'FY2022')::int"


@query(f"""WITH {OBJECTS} SELECT object_id unit, coalesce({_FACET}, 0) hits FROM ob WHERE object_type IS NOT NULL AND document_type IS NOT NULL AND period IS NOT NULL AND {_FACET} >= 2""")
def facet_candidates(spark, d):
    """Units by how many facets of a question they meet, two at least."""
    o = objects(spark, d).filter("object_type IS NOT NULL AND document_type IS NOT NULL AND period IS NOT NULL")
    one = lambda c: F.when(c, 1).otherwise(0)
    hits = one(F.col("object_type") == "FactorExposure") + one(F.col("document_type") == "10-K") + one(F.col("period") == "FY2022")
    return o.select(F.col("object_id").alias("unit"), hits.alias("hits")).filter("hits >= 2")


@query(
    """WITH m AS (SELECT from_object_id unit, from_ticker ticker, max(materiality) materiality FROM global_edge_spine WHERE from_ticker IS NOT NULL AND from_object_id IS NOT NULL GROUP BY 1, 2) SELECT ticker, unit, materiality FROM m QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY coalesce(materiality, 0) DESC, unit) <= 5"""
)
def units_by_materiality(spark, d):
    """The five most material units of each company, for when nothing else routes."""
    m = _t(spark, d, "global_edge_spine").filter("from_ticker IS NOT NULL AND from_object_id IS NOT NULL").groupBy(F.col("from_object_id").alias("unit"), F.col("from_ticker").alias("ticker")).agg(F.max("materiality").alias("materiality"))
    w = Window.partitionBy("ticker").orderBy(F.coalesce("materiality", F.lit(0.0)).desc(), "unit")
    return m.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("ticker", "unit", "materiality")


_COARSE = f"""{_hits(TERMS)}, fc AS (SELECT object_id unit, coalesce({_FACET}, 0) hits FROM ob WHERE object_type IS NOT NULL AND document_type IS NOT NULL AND period IS NOT NULL AND {_FACET} >= 2), fr AS (SELECT unit, row_number() OVER (ORDER BY hits DESC, unit) r FROM fc ORDER BY r LIMIT 80),
    fp AS (SELECT doc unit, matched / 3.0::double "primary" FROM b), fu AS (SELECT unit, sum(p) score FROM (SELECT unit, "primary" / 61 p FROM fp UNION ALL SELECT unit, 0.1 / (60 + r) FROM fr) GROUP BY 1),
    tu AS (SELECT ob.ticker, unit, score, row_number() OVER (PARTITION BY ob.ticker ORDER BY round(score, 9) DESC, unit) r FROM fu JOIN ob ON ob.object_id = unit WHERE ob.ticker IS NOT NULL), ts AS (SELECT ticker, sum(score * CASE r WHEN 1 THEN 1.0 WHEN 2 THEN 0.3 ELSE 0.1 END) score FROM tu WHERE r <= 3 GROUP BY 1)"""


def _coarse(spark, d):
    """Companies by the fielded and facet channels, fused."""
    fielded = object_index(spark, d).bm25(TERMS, WEIGHTS).select(F.col("doc").alias("unit"), (F.col("matched") / F.lit(3.0)).alias("primary"))
    best = facet_candidates(spark, d).orderBy(F.col("hits").desc(), "unit").limit(80)
    facets = best.select("unit", F.lit("facet").alias("channel"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("hits").desc(), "unit")).alias("rank"))
    fused = routing.fused_units(fielded, facets).withColumn("score", F.round("score", 9))
    return routing.ticker_scores(fused.join(objects(spark, d).filter("ticker IS NOT NULL").select(F.col("object_id").alias("unit"), "ticker"), "unit"))


@query(f"WITH {_COARSE} SELECT ticker, round(score, 6) score FROM ts")
def routed_tickers(spark, d):
    """Companies that a question is routed to: search by fields and facets, fused by rank, three best units each."""
    return _coarse(spark, d).select("ticker", F.round("score", 6).alias("score"))


_INFO = {"demand": 2.0, "freight": 3.0, "brokerage": 4.0, "inventory": 2.5}


def _coherence_sql() -> str:
    pairs = routing.term_pairs(_INFO)
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    info = ", ".join(f"('{t}', {i})" for t, i in _INFO.items())
    return f"""{_TS}, pr(a, b) AS (VALUES {values}), nf(term, info) AS (VALUES {info}), hh AS (SELECT DISTINCT doc, unnest(list_concat(t1, t2, t3)) term FROM tl), pp AS (SELECT x.doc, pr.a, pr.b FROM pr JOIN hh x ON x.term = pr.a JOIN hh y ON y.term = pr.b AND y.doc = x.doc),
    fw AS (SELECT a, b FROM pp GROUP BY 1, 2 HAVING count(*) <= 4096), kt AS (SELECT DISTINCT doc, unnest([a, b]) term FROM pp JOIN fw USING (a, b)), cs AS (SELECT doc, round(0.55 * count(*) / 4 + 0.45 * sum(info) / 11.5, 9) s FROM kt JOIN nf USING (term) GROUP BY 1),
    co AS (SELECT ob.ticker, doc unit, s coherence FROM cs JOIN ob ON ob.object_id = doc WHERE ob.ticker IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ob.ticker ORDER BY s DESC, doc) = 1)"""


def _coherent(spark, d):
    o = objects(spark, d)
    hits = o.select(F.col("object_id").alias("unit"), F.explode(F.array_distinct(F.concat(words(F.col("label")), words(F.col("company")), words(F.col("summary"))))).alias("term"))
    return routing.coherence(hits, o.filter("ticker IS NOT NULL").select(F.col("object_id").alias("unit"), "ticker"), _INFO)


@query(f"WITH {_coherence_sql()} SELECT ticker, unit, round(coherence, 6) coherence FROM co")
def coherence_scores(spark, d):
    """The unit of each company that holds most of a question together."""
    return _coherent(spark, d).withColumn("coherence", F.round("coherence", 6))


@query(
    f"""WITH {_COARSE}, {_coherence_sql().split("tl AS (SELECT *, len(t1) + len(t2) + len(t3) dl FROM tk), ", 1)[1]}, rk AS (SELECT ticker, row_number() OVER (ORDER BY round(score, 6) DESC, ticker) rank FROM ts)
    SELECT coalesce(rk.ticker, co.ticker) ticker, round(0.8 * coalesce(coherence, 0) + 0.2 * coalesce(1 / log2(rank + 1), 0), 6) final FROM rk FULL JOIN co ON rk.ticker = co.ticker"""
)
def router_search(spark, d):
    """Routing end to end: fielded search and facets, fusion, decay, then coherence with the coarse rank."""
    c = _coarse(spark, d).withColumn("score", F.round("score", 6))
    coarse = c.select("ticker", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("score").desc(), "ticker")).alias("rank"))
    return routing.reranked(coarse, _coherent(spark, d)).withColumn("final", F.round("final", 6))


@query(
    f"""WITH {_COARSE}, mi AS (SELECT ticker, count(*)::double score FROM tu GROUP BY 1), j AS (SELECT ts.ticker, ts.score c, mi.score m FROM ts LEFT JOIN mi USING (ticker))
    SELECT ticker, round(0.35 * CASE WHEN max(c) OVER () = min(c) OVER () THEN 1 ELSE (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) END + 0.65 * coalesce(CASE WHEN max(m) OVER () = min(m) OVER () THEN 1 ELSE (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) END, 0), 5) final FROM j"""
)
def micro_rerank(spark, d):
    """The optional second stage: scaled coarse and fine scores; no company is added or dropped."""
    coarse = _coarse(spark, d)
    fielded = object_index(spark, d).bm25(TERMS, WEIGHTS).select(F.col("doc").alias("unit"))
    best = facet_candidates(spark, d).orderBy(F.col("hits").desc(), "unit").limit(80).select("unit")
    fine = fielded.unionByName(best).distinct().join(objects(spark, d).filter("ticker IS NOT NULL").select(F.col("object_id").alias("unit"), "ticker"), "unit").groupBy("ticker").agg(F.count("*").cast("double").alias("score"))
    return routing.micro_reranked(coarse.select("ticker", "score"), fine).withColumn("final", F.round("final", 5))


_ASKED = {"core": ["freight", "brokerage", "warehouse"], "mechanism": ["demand", "pricing"], "sector": ["logistics"], "channel": ["costs", "margin"], "predicate": ["exposure", "rising"], "generic": ["growth", "risk", "capacity"]}
_REQUIRED = ["freight"]


def _directness_sql() -> str:
    n = lambda ts: f"len(list_intersect(ws, {ts}))"
    cols = ", ".join(f"{n(v)} {k}" for k, v in _ASKED.items())
    return f"""{OBJECTS}, w AS (SELECT object_id, list_distinct({_WORDS.format(c="label")}) ws, object_type IN ('EvidenceQuote', 'ResearchClaim') ev FROM ob), f AS (SELECT object_id, ev, {cols}, {n(_REQUIRED)} must FROM w),
    g AS (SELECT *, (core > 0 OR mechanism > 0 OR sector > 0 OR must > 0) spec FROM f), h AS (SELECT *, NOT spec AND generic > 0 AS gen, greatest(0, least(1, 0.45 + 0.12 * (core + mechanism + sector) - 0.05 * generic)) sp FROM g),
    k AS (SELECT *, greatest(0, least(1, 0.35 * must + 0.2 * predicate / 2 + 0.15 * channel / 2 + 0.2 * coalesce(ev, false)::int + 0.1 * sp - gen::int * 0.25 - CASE WHEN must = 0 THEN 0.35 ELSE 0 END)) d FROM h)"""


@query(
    f"""WITH {_directness_sql()} SELECT object_id, CASE WHEN must > 0 AND ev AND NOT gen AND (spec OR channel > 0 OR predicate > 0) AND d >= 0.45 THEN 'direct' WHEN spec THEN 'strong_related' WHEN channel > 0 THEN 'related' WHEN generic > 0 THEN 'indirect' ELSE 'insufficient' END tier, round(d, 6) directness,
    (4.0 * least(core, 3) + 2.0 * least(mechanism, 2) + 1.5 * least(sector, 2) + least(channel, 3) - gen::int)::double score FROM k"""
)
def topic_directness(spark, d):
    """How directly each object answers a question, in five tiers, with its score."""
    o = objects(spark, d).select("object_id", "object_type", F.inline(F.array(F.struct(F.array_distinct(words(F.col("label"))).alias("ws")))))
    found = routing.facet_counts(F.col("ws"), _ASKED)
    o = o.withColumns({f"n_{k}": c for k, c in found.items()})
    found = {k: F.col(f"n_{k}") for k in _ASKED}
    evidence = F.coalesce(F.col("object_type").isin("EvidenceQuote", "ResearchClaim"), F.lit(False))
    specificity = routing.specificity_score(found["core"] + found["mechanism"] + found["sector"], found["generic"])
    r = o.withColumn("r", routing.directness(found, _ASKED, _REQUIRED, F.col("ws"), evidence, specificity))
    return r.select("object_id", "r.tier", F.round("r.directness", 6).alias("directness"), F.col("r.score").alias("score"))


@query(
    f"""WITH {_directness_sql()}, t AS (SELECT k.object_id, ob.ticker, CASE WHEN must > 0 AND ev AND NOT gen AND (spec OR channel > 0 OR predicate > 0) AND d >= 0.45 THEN 0 WHEN spec THEN 1 WHEN channel > 0 THEN 2 WHEN generic > 0 THEN 3 ELSE 4 END tier, round(d, 6) d FROM k JOIN ob USING (object_id) WHERE ob.ticker IS NOT NULL)
    SELECT ticker, object_id, tier, row_number() OVER (PARTITION BY ticker ORDER BY tier, d DESC, object_id) place FROM t WHERE tier < 4 QUALIFY place <= 5"""
)
def discovered_topics(spark, d):
    """The five objects of each company that answer most directly; insufficient ones are left out."""
    t = topic_directness(spark, d).join(objects(spark, d).filter("ticker IS NOT NULL").select("object_id", "ticker"), "object_id")
    order = F.create_map(*[F.lit(x) for kv in {"direct": 0, "strong_related": 1, "related": 2, "indirect": 3, "insufficient": 4}.items() for x in kv])
    t = t.withColumn("tier", F.element_at(order, F.col("tier"))).filter("tier < 4")
    return t.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy("tier", F.col("directness").desc(), "object_id"))).filter("place <= 5").select("ticker", "object_id", "tier", "place")


@query(
    f"""WITH {_hits(TERMS)}, r AS (SELECT ticker, doc, row_number() OVER (PARTITION BY ticker ORDER BY round(score, 6) DESC, doc) turn FROM b JOIN ob ON object_id = doc WHERE ticker IS NOT NULL) SELECT ticker, doc, turn FROM r WHERE turn <= 4"""
)
def fanout_query(spark, d):
    """The same question put to every company: four answers each, in order."""
    b = object_index(spark, d).bm25(TERMS, WEIGHTS).withColumn("score", F.round("score", 6)).join(objects(spark, d).filter("ticker IS NOT NULL").select(F.col("object_id").alias("doc"), "ticker"), "doc")
    return b.withColumn("turn", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("score").desc(), "doc"))).filter("turn <= 4").select("ticker", "doc", "turn")
