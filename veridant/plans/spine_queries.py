"""Queries on objects and edges across shards: scores, lineage, replicas, collisions, quality; each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridant.operators import spine
from veridant.plans.evidence import _t, query
from veridant.plans.search_queries import OBJECTS, objects

_YEAR = "nullif(regexp_extract({p}, '((?:19|20)[0-9]{{2}})', 1), '')::int"
_GAP = f"abs({_YEAR.format(p='a.period')} - {_YEAR.format(p='b.period')})"
_ALIGN = f"CASE WHEN a.period <> '' AND a.period = b.period THEN 1.0 WHEN {_GAP} IS NULL THEN 0.8 WHEN {_GAP} <= 1 THEN 0.9 WHEN {_GAP} <= 3 THEN 0.72 ELSE 0.55 END"
_EDGES = """ed AS (SELECT edge_id, from_object_id, to_object_id, relation_type, confidence, evidence_grade, materiality, recency_score FROM global_edge_spine WHERE edge_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at DESC, from_object_id DESC NULLS LAST, to_object_id DESC NULLS LAST, relation_type DESC NULLS LAST, confidence DESC NULLS LAST, evidence_grade DESC NULLS LAST, materiality DESC NULLS LAST, recency_score DESC NULLS LAST) = 1)"""


def edges(spark, d):
    """One row per edge: its newest delivery."""
    c = ["from_object_id", "to_object_id", "relation_type", "confidence", "evidence_grade", "materiality", "recency_score"]
    e = _t(spark, d, "global_edge_spine").filter("edge_id IS NOT NULL").groupBy("edge_id").agg(F.max(F.struct("loaded_at", *c)).alias("e"))
    return e.select("edge_id", *[F.col(f"e.{x}").alias(x) for x in c])


def _scored(spark, d):
    e, o = edges(spark, d), objects(spark, d)
    e = e.join(o.select(F.col("object_id").alias("from_object_id"), F.col("period").alias("from_period")), "from_object_id").join(o.select(F.col("object_id").alias("to_object_id"), F.col("period").alias("to_period"), "status"), "to_object_id")
    status, worth = spine.period_alignment(F.col("from_period"), F.col("to_period"))
    e = e.withColumns({"alignment": status, "worth": worth})
    return e.withColumn("score", spine.edge_score(F.col("confidence"), F.col("evidence_grade"), F.col("materiality"), F.col("recency_score"), F.col("worth")))


_B = "CASE WHEN {v} IS NOT NULL THEN greatest(0, least({v}, 1)) END"
_SCORED = f"""{OBJECTS}, {_EDGES}, sc AS (SELECT ed.*, a.period from_period, b.period to_period, b.status, {_ALIGN} worth FROM ed JOIN ob a ON a.object_id = from_object_id JOIN ob b ON b.object_id = to_object_id),
    se AS (SELECT *, round(greatest(0.05, least((0.42 * coalesce({_B.format(v="confidence")}, 0.6) + 0.28 * CASE lower(trim(evidence_grade)) WHEN 'direct' THEN 1.0 WHEN 'high' THEN 0.9 ELSE 0.58 END + 0.15 * coalesce({_B.format(v="materiality")}, 0.5) + 0.15 * coalesce({_B.format(v="recency_score")}, worth)) * (0.9 + 0.1 * worth), 1)) + 1e-10, 6) score FROM sc)"""


@query(f"WITH {_SCORED} SELECT edge_id, score, CASE worth WHEN 1.0 THEN 'same_period' WHEN 0.8 THEN 'unknown' WHEN 0.9 THEN 'near_period' WHEN 0.72 THEN 'distant_period' ELSE 'stale_period_gap' END alignment FROM se")
def edge_step_scores(spark, d):
    """Worth of a step along each edge with how its two periods agree."""
    return _scored(spark, d).select("edge_id", "score", "alignment")


@query(
    f"""WITH {_SCORED}, n AS (SELECT from_object_id object_id, to_object_id neighbour, relation_type, 'out' direction, edge_id, score FROM se UNION ALL SELECT to_object_id, from_object_id, relation_type, 'in', edge_id, score FROM se)
    SELECT object_id, neighbour, relation_type, direction, edge_id FROM n QUALIFY row_number() OVER (PARTITION BY object_id, direction ORDER BY relation_type, neighbour, edge_id) <= 20"""
)
def chain_neighbours(spark, d):
    """Neighbours of each object in both directions, by relation, object and edge, 20 a direction."""
    s = _scored(spark, d)
    n = s.select(F.col("from_object_id").alias("object_id"), F.col("to_object_id").alias("neighbour"), "relation_type", F.lit("out").alias("direction"), "edge_id").unionByName(s.select(F.col("to_object_id").alias("object_id"), F.col("from_object_id").alias("neighbour"), "relation_type", F.lit("in").alias("direction"), "edge_id"))
    w = Window.partitionBy("object_id", "direction").orderBy("relation_type", "neighbour", "edge_id")
    return n.withColumn("r", F.row_number().over(w)).filter("r <= 20").drop("r")


@query(
    f"""WITH {_SCORED}, n AS (SELECT from_object_id object_id, to_object_id neighbour, score FROM se UNION ALL SELECT to_object_id, from_object_id, score FROM se), g AS (SELECT object_id, neighbour, max(score) score FROM n WHERE object_id <> neighbour GROUP BY 1, 2)
    SELECT object_id, neighbour, score FROM g QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY score DESC, neighbour) <= 10"""
)
def graph_neighbours(spark, d):
    """The ten best distinct neighbours of each object, by the best step to them."""
    s = _scored(spark, d)
    n = s.select(F.col("from_object_id").alias("object_id"), F.col("to_object_id").alias("neighbour"), "score").unionByName(s.select(F.col("to_object_id").alias("object_id"), F.col("from_object_id").alias("neighbour"), "score"))
    g = n.filter("object_id != neighbour").groupBy("object_id", "neighbour").agg(F.max("score").alias("score"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("object_id").orderBy(F.col("score").desc(), "neighbour"))).filter("r <= 10").drop("r")


_SUPPORT = f"""{OBJECTS}, sp AS (SELECT DISTINCT from_object_id ev, o.object_type ek, to_object_id object_id FROM global_edge_spine JOIN ob o ON o.object_id = from_object_id WHERE relation_type = 'supports' AND to_object_id IS NOT NULL),
    qd AS (SELECT object_id, ev q FROM sp WHERE ek = 'EvidenceQuote'), cl AS (SELECT object_id, ev c FROM sp WHERE ek = 'ResearchClaim')"""


def _support(spark, d):
    return spine.support_pairs(_t(spark, d, "global_edge_spine"), objects(spark, d))


@query(
    f"""WITH {_SUPPORT}, aq AS (SELECT object_id, q, min(t) t FROM (SELECT object_id, q, 0 t FROM qd UNION ALL SELECT cl.object_id, qd.q, 1 FROM cl JOIN qd ON qd.object_id = cl.c) GROUP BY 1, 2)
    SELECT ob.object_id, object_type, coalesce(cn, 0) claims, coalesce(qn, 0) quotes, coalesce(tn, 0) quotes_by_claims FROM ob LEFT JOIN (SELECT object_id, count(*) cn FROM cl GROUP BY 1) USING (object_id) LEFT JOIN (SELECT object_id, count(*) qn, count(*) FILTER (t = 1) tn FROM aq GROUP BY 1) USING (object_id)"""
)
def evidence_lineage(spark, d):
    """Claims and quotes behind every object, directly and through its claims."""
    return spine.evidence_lineage(objects(spark, d), _support(spark, d))


@query(
    f"""WITH {_SUPPORT}, od AS (SELECT object_id, max_by(document_id, loaded_at) document_id FROM global_object_locator WHERE object_id IS NOT NULL GROUP BY 1), s AS (SELECT c, document_id, object_id FROM cl JOIN od USING (object_id) WHERE document_id IS NOT NULL)
    SELECT object_id, other FROM (SELECT DISTINCT a.object_id, b.object_id other FROM s a JOIN s b ON a.c = b.c AND a.document_id = b.document_id AND a.object_id <> b.object_id) QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY other) <= 12"""
)
def objects_sharing_claims(spark, d):
    """Other objects of the same document that rest on the same claim, twelve for each."""
    doc = _t(spark, d, "global_object_locator").filter("object_id IS NOT NULL").groupBy("object_id").agg(F.max_by("document_id", "loaded_at").alias("document_id"))
    return spine.sharing_evidence(doc, _support(spark, d))


@query(
    f"""WITH {_SUPPORT}, mi AS (SELECT object_id, ev FROM sp WHERE ek = 'FinancialMetric'), od AS (SELECT object_id, max_by(document_id, loaded_at) document_id FROM global_object_locator WHERE object_id IS NOT NULL GROUP BY 1)
    SELECT o.object_id, count(DISTINCT ev) inputs, count(DISTINCT document_id) documents, min(ev) first_input FROM ob o JOIN mi USING (object_id) LEFT JOIN od ON od.object_id = ev WHERE object_type = 'FinancialMetric' GROUP BY 1"""
)
def metric_lineage(spark, d):
    """Input metrics of each metric and the documents they come from."""
    inputs = _support(spark, d).filter("evidence_type = 'FinancialMetric'").select("object_id", "evidence")
    doc = _t(spark, d, "global_object_locator").filter("object_id IS NOT NULL").groupBy("object_id").agg(F.max_by("document_id", "loaded_at").alias("document_id")).withColumnRenamed("object_id", "evidence")
    m = objects(spark, d).filter("object_type = 'FinancialMetric'").select("object_id")
    return m.join(inputs, "object_id").join(doc, "evidence", "left").groupBy("object_id").agg(F.countDistinct("evidence").alias("inputs"), F.countDistinct("document_id").alias("documents"), F.min("evidence").alias("first_input"))


@query(f"""WITH {_SUPPORT}, tk AS (SELECT a.object_id, a.ticker, count(DISTINCT ev) steps, count(DISTINCT b.ticker) FILTER (b.ticker <> a.ticker) foreign_companies FROM ob a JOIN sp USING (object_id) JOIN ob b ON b.object_id = ev GROUP BY 1, 2) SELECT * FROM tk""")
def support_reach(spark, d):
    """How many supporting objects each object has, and of how many other companies."""
    o = objects(spark, d).select("object_id", "ticker")
    j = _support(spark, d).join(o, "object_id").join(o.select(F.col("object_id").alias("evidence"), F.col("ticker").alias("other")), "evidence")
    return j.groupBy("object_id", "ticker").agg(F.countDistinct("evidence").alias("steps"), F.countDistinct(F.when(F.col("other") != F.col("ticker"), F.col("other"))).alias("foreign_companies"))


@query(
    f"""WITH {_SUPPORT}, q AS (SELECT qd.q, c.object_id claim FROM qd JOIN ob c ON c.object_id = qd.object_id WHERE c.object_type = 'ResearchClaim') SELECT q quote_id, count(DISTINCT claim) claims, min(claim) first_claim FROM q GROUP BY 1"""
)
def claims_of_quotes(spark, d):
    """The claims that each quotation supports."""
    claims = objects(spark, d).filter("object_type = 'ResearchClaim'").select("object_id")
    q = _support(spark, d).filter("evidence_type = 'EvidenceQuote'").join(claims, "object_id")
    return q.groupBy(F.col("evidence").alias("quote_id")).agg(F.countDistinct("object_id").alias("claims"), F.min("object_id").alias("first_claim"))


# --- replicas, identity, collisions


@query("SELECT object_id, max(occurrence_count) declared, count(DISTINCT coalesce(shard_id, '') || chr(1) || coalesce(local_object_key, '')) AS found FROM global_object_locator WHERE object_id IS NOT NULL GROUP BY 1 HAVING max(occurrence_count) IS DISTINCT FROM count(DISTINCT coalesce(shard_id, '') || chr(1) || coalesce(local_object_key, ''))")
def replica_mismatches(spark, d):
    """Objects whose declared occurrences differ from the places they are in."""
    return spine.replica_mismatches(_t(spark, d, "global_object_locator").filter("object_id IS NOT NULL"), "object_id", "occurrence_count", ["shard_id", "local_object_key"])


_SEMANTIC = ["ticker", "document_id", "period", "object_type", "semantic_hash", "compact_label", "compact_summary", "quality_status"]


def _collision_sql() -> str:
    differ = ", ".join(f"CASE WHEN count(DISTINCT {c}) + max(({c} IS NULL)::int) > 1 THEN '{c}' END" for c in _SEMANTIC)
    return f"SELECT object_id, count(DISTINCT [{', '.join(f'coalesce({c}, chr(1))' for c in _SEMANTIC)}]) versions, array_to_string(list_filter([{differ}], lambda x: x IS NOT NULL), ',') columns FROM global_object_locator WHERE object_id IS NOT NULL GROUP BY 1 HAVING versions > 1"


@query(_collision_sql())
def semantic_collisions(spark, d):
    """Objects delivered with different contents, and which columns differ."""
    return spine.collisions(_t(spark, d, "global_object_locator").filter("object_id IS NOT NULL"), ["object_id"], _SEMANTIC)


@query("SELECT object_id, count(DISTINCT shard_id) shards, CASE WHEN count(DISTINCT semantic_hash) + max((semantic_hash IS NULL)::int) > 1 THEN 'conflict' WHEN count(DISTINCT shard_id) > 1 THEN 'equal' ELSE 'single' END verdict FROM global_object_locator WHERE object_id IS NOT NULL GROUP BY 1")
def identity_claims(spark, d):
    """Which shards claim each object, and whether they agree."""
    return spine.identity_claims(_t(spark, d, "global_object_locator").filter("object_id IS NOT NULL"), ["object_id"], "shard_id", "semantic_hash")


@query("SELECT DISTINCT object_id, ticker, CASE WHEN contains(object_id, ':' || ticker || ':') THEN object_id ELSE 'scoped:' || ticker || ':' || object_id END scoped_id FROM global_object_locator WHERE object_id IS NOT NULL AND ticker IS NOT NULL")
def scoped_ids(spark, d):
    """Ids that name their company, others with its scope put before."""
    o = _t(spark, d, "global_object_locator").filter("object_id IS NOT NULL AND ticker IS NOT NULL").select("object_id", "ticker").distinct()
    return o.withColumn("scoped_id", spine.scoped_local_id(F.col("ticker"), F.col("object_id")))


@query("SELECT object_id, shard_id, local_object_key, min(loaded_at) loaded_at, arg_min(semantic_hash, struct_pack(a := loaded_at, b := semantic_hash)) semantic_hash FROM global_object_locator WHERE object_id IS NOT NULL GROUP BY 1, 2, 3")
def replica_inserts(spark, d):
    """The first delivery of each object in each place; later ones are ignored."""
    return spine.first_inserted(_t(spark, d, "global_object_locator").filter("object_id IS NOT NULL"), ["object_id", "shard_id", "local_object_key"], ["loaded_at"], ["semantic_hash"])


@query(
    """WITH l AS (SELECT DISTINCT shard_id, document_id FROM global_object_locator WHERE document_id IS NOT NULL AND shard_id IS NOT NULL), e AS (SELECT DISTINCT shard_id, document_id FROM global_edge_spine WHERE document_id IS NOT NULL AND shard_id IS NOT NULL)
    SELECT coalesce(l.shard_id, e.shard_id) shard_id, count(*) FILTER (e.document_id IS NULL) without_edges, count(*) FILTER (l.document_id IS NULL) without_objects, count(*) FILTER (l.document_id IS NOT NULL AND e.document_id IS NOT NULL) complete FROM l FULL JOIN e ON l.shard_id = e.shard_id AND l.document_id = e.document_id GROUP BY 1"""
)
def shard_completeness(spark, d):
    """Documents of each shard that objects or edges know alone, and those that both know."""
    l = _t(spark, d, "global_object_locator").filter("document_id IS NOT NULL AND shard_id IS NOT NULL").select("shard_id", "document_id", F.lit(1).alias("l")).distinct()  # noqa: E741
    e = _t(spark, d, "global_edge_spine").filter("document_id IS NOT NULL AND shard_id IS NOT NULL").select("shard_id", "document_id", F.lit(1).alias("e")).distinct()
    j = l.join(e, ["shard_id", "document_id"], "full")
    return j.groupBy("shard_id").agg(F.count_if(F.col("e").isNull()).alias("without_edges"), F.count_if(F.col("l").isNull()).alias("without_objects"), F.count_if(F.col("l").isNotNull() & F.col("e").isNotNull()).alias("complete"))


@query("SELECT ticker, count(DISTINCT object_id) objects, count(DISTINCT document_id) documents, count(DISTINCT object_id) FILTER (object_type = 'EvidenceQuote') quotes, count(DISTINCT object_id) FILTER (object_type = 'ResearchClaim') claims, count(DISTINCT object_id) FILTER (object_type = 'FinancialMetric') metrics FROM global_object_locator GROUP BY 1")
def expected_shard_counts(spark, d):
    """What a shard of each company must hold."""
    of = lambda k: F.countDistinct(F.when(F.col("object_type") == k, F.col("object_id")))
    return _t(spark, d, "global_object_locator").groupBy("ticker").agg(F.countDistinct("object_id").alias("objects"), F.countDistinct("document_id").alias("documents"), of("EvidenceQuote").alias("quotes"), of("ResearchClaim").alias("claims"), of("FinancialMetric").alias("metrics"))


@query("SELECT object_id, ticker, shard_id, document_id FROM (SELECT DISTINCT object_id, ticker, shard_id, document_id FROM global_object_locator WHERE object_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY contains(object_id, ':' || ticker || ':') IS TRUE DESC, shard_id NULLS FIRST, ticker NULLS FIRST, document_id NULLS FIRST) = 1")
def preferred_replica(spark, d):
    """The replica that answers for an object: its own company's first, then by shard."""
    o = _t(spark, d, "global_object_locator").filter("object_id IS NOT NULL").select("object_id", "ticker", "shard_id", "document_id").distinct()
    own = F.coalesce(F.contains("object_id", F.concat(F.lit(":"), F.col("ticker"), F.lit(":"))), F.lit(False))
    b = o.groupBy("object_id").agg(F.min(F.struct((~own).alias("foreign"), "shard_id", "ticker", "document_id")).alias("b"))
    return b.select("object_id", "b.ticker", "b.shard_id", "b.document_id")


@query(
    """WITH k AS (SELECT DISTINCT object_id AS key, object_id, ticker FROM global_object_locator WHERE object_id IS NOT NULL UNION SELECT DISTINCT local_object_key, object_id, ticker FROM global_object_locator WHERE local_object_key IS NOT NULL AND object_id IS NOT NULL)
    SELECT DISTINCT key, object_id FROM k WHERE (key >= 'claim:E' AND key < 'claim:F') OR (key >= 'k001' AND key < 'k002')"""
)
def find_by_prefix(spark, d):
    """Objects by a prefix of their canonical id or of their key in a shard, as ranges that reach the scan."""
    o = _t(spark, d, "global_object_locator").filter("object_id IS NOT NULL")
    inside = lambda c: ((F.col(c) >= "claim:E") & (F.col(c) < "claim:F")) | ((F.col(c) >= "k001") & (F.col(c) < "k002"))
    a = o.filter(inside("object_id")).select(F.col("object_id").alias("key"), "object_id")
    b = o.filter(inside("local_object_key")).select(F.col("local_object_key").alias("key"), "object_id")
    return a.unionByName(b).distinct()


@query(f"""WITH {OBJECTS}, dl AS (SELECT document_id, min(ticker) ticker, min(document_type) document_type, min(period) period, max(filing_date) filing_date, count(DISTINCT object_id) objects, count(DISTINCT shard_id) shards FROM global_object_locator WHERE document_id IS NOT NULL GROUP BY 1) SELECT * FROM dl""")
def document_catalog(spark, d):
    """Documents with their company, form, period, filing date, objects and shards."""
    return _t(spark, d, "global_object_locator").filter("document_id IS NOT NULL").groupBy("document_id").agg(F.min("ticker").alias("ticker"), F.min("document_type").alias("document_type"), F.min("period").alias("period"), F.max("filing_date").alias("filing_date"), F.countDistinct("object_id").alias("objects"), F.countDistinct("shard_id").alias("shards"))


_KEY = "trim(regexp_replace(lower(coalesce(label, '')), '[^a-z0-9]+', '_', 'g'), '_')"


@query(f"""WITH {OBJECTS} SELECT object_type kind, {_KEY} AS key, count(*) objects, count(DISTINCT ticker) companies, min(object_id) first_object FROM ob WHERE object_type IN ('FactorExposure', 'NamedEntity', 'FinancialMetric') AND {_KEY} <> '' GROUP BY 1, 2""")
def typed_spine(spark, d):
    """Factors, entities and metrics by their normalised key: objects, companies, and the first object."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("label", F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    o = objects(spark, d).filter(F.col("object_type").isin(*spine.INTERPRETED)).withColumn("key", key).filter("key != ''")
    return o.groupBy(F.col("object_type").alias("kind"), "key").agg(F.count("*").alias("objects"), F.countDistinct("ticker").alias("companies"), F.min("object_id").alias("first_object"))


@query(
    """WITH l AS (SELECT DISTINCT object_id FROM global_object_locator WHERE object_id IS NOT NULL), r AS (SELECT edge_id record, from_object_id, relation_type relation, to_object_id FROM global_edge_spine UNION ALL SELECT series_key, object_id, 'observed_in', source_document_id FROM chart_series_points),
    dd AS (SELECT DISTINCT document_id object_id FROM global_object_locator WHERE document_id IS NOT NULL), a AS (FROM l UNION FROM dd)
    SELECT from_object_id, relation, to_object_id, min(record) record, count(*) copies FROM r WHERE from_object_id IN (FROM a) AND to_object_id IN (FROM a) GROUP BY 1, 2, 3"""
)
def reference_edges(spark, d):
    """Edges from all reference fields, where both ends exist, once for each pair and relation."""
    o = _t(spark, d, "global_object_locator")
    ends = o.select("object_id").unionByName(o.select(F.col("document_id").alias("object_id"))).filter("object_id IS NOT NULL").distinct()
    e = _t(spark, d, "global_edge_spine").select(F.col("edge_id").alias("record"), "from_object_id", F.col("relation_type").alias("relation"), "to_object_id")
    p = _t(spark, d, "chart_series_points").select(F.col("series_key").alias("record"), F.col("object_id").alias("from_object_id"), F.lit("observed_in").alias("relation"), F.col("source_document_id").alias("to_object_id"))
    r = e.unionByName(p).groupBy("from_object_id", "relation", "to_object_id").agg(F.min("record").alias("record"), F.count("*").alias("copies"))
    # the relation is grouped before the ends are looked up, so copies are not shuffled twice
    return r.join(ends.withColumnRenamed("object_id", "from_object_id"), "from_object_id", "left_semi").join(ends.withColumnRenamed("object_id", "to_object_id"), "to_object_id", "left_semi")


# --- quality

_REASON = "CASE WHEN compact_summary IS NULL THEN 'no_summary' WHEN lower(compact_summary) LIKE '%table%' THEN 'table' WHEN lower(compact_summary) LIKE '%extract%' THEN 'extract' ELSE 'other' END"
_EVENTS = f"ev AS (SELECT DISTINCT object_id, ticker, document_id, period, object_type, lower(trim(quality_status)) status, {_REASON} reason FROM global_object_locator WHERE lower(trim(quality_status)) IN ('warn', 'fail'))"


def quality_events(spark, d):
    """Distinct warnings and failures of objects with a reason bucket."""
    o = _t(spark, d, "global_object_locator").withColumn("status", F.lower(F.trim("quality_status"))).filter(F.col("status").isin("warn", "fail"))
    text = F.lower("compact_summary")
    reason = F.when(F.col("compact_summary").isNull(), "no_summary").when(text.contains("table"), "table").when(text.contains("extract"), "extract").otherwise("other")
    return o.select("object_id", "ticker", "document_id", "period", "object_type", "status", reason.alias("reason")).distinct()


@query(f"WITH {_EVENTS} SELECT status severity, object_type category, count(*) AS events, count(DISTINCT ticker) companies FROM ev GROUP BY 1, 2")
def quality_by_severity(spark, d):
    """Warnings and failures by kind of object."""
    return quality_events(spark, d).groupBy(F.col("status").alias("severity"), F.col("object_type").alias("category")).agg(F.count("*").alias("events"), F.countDistinct("ticker").alias("companies"))


@query(f"WITH {_EVENTS}, a AS (SELECT ticker, count(DISTINCT object_id) objects FROM global_object_locator GROUP BY 1), b AS (SELECT ticker, count(*) FILTER (status = 'fail') failures, count(*) FILTER (status = 'warn') warnings FROM ev GROUP BY 1) SELECT a.ticker, objects, coalesce(failures, 0) failures, coalesce(warnings, 0) warnings, round(coalesce(failures, 0) / objects::double, 6) failure_rate FROM a LEFT JOIN b ON a.ticker = b.ticker")
def ticker_quality(spark, d):
    """Objects, failures and warnings of each company, from two aggregates."""
    a = _t(spark, d, "global_object_locator").groupBy("ticker").agg(F.countDistinct("object_id").alias("objects"))
    b = quality_events(spark, d).groupBy("ticker").agg(F.count_if(F.col("status") == "fail").alias("failures"), F.count_if(F.col("status") == "warn").alias("warnings"))
    return a.join(b, "ticker", "left").na.fill(0, ["failures", "warnings"]).withColumn("failure_rate", F.round(F.col("failures") / F.col("objects"), 6))


@query(f"WITH {_EVENTS} SELECT reason, count(*) AS events, count(DISTINCT document_id) documents FROM ev WHERE status = 'fail' GROUP BY 1 ORDER BY events DESC, reason LIMIT 20")
def rejected_reasons(spark, d):
    """Reasons of failures, the commonest first; the 20 best."""
    r = quality_events(spark, d).filter("status = 'fail'").groupBy("reason").agg(F.count("*").alias("events"), F.countDistinct("document_id").alias("documents"))
    return r.orderBy(F.col("events").desc(), "reason").limit(20)


@query(f"WITH {_EVENTS} SELECT ticker, document_id, period, object_type stage, count(*) failures, min(object_id) first_object FROM ev WHERE status = 'fail' GROUP BY 1, 2, 3, 4")
def repair_jobs(spark, d):
    """One job for each company, document, period and stage with failures."""
    return quality_events(spark, d).filter("status = 'fail'").groupBy("ticker", "document_id", "period", F.col("object_type").alias("stage")).agg(F.count("*").alias("failures"), F.min("object_id").alias("first_object"))


@query(
    """WITH x AS (SELECT DISTINCT ticker FROM chart_series WHERE ticker IS NOT NULL), m AS (SELECT unnest(['revenue', 'net_income', 'total_debt', 'gross_margin']) metric), h AS (SELECT s.ticker, canonical_metric metric, count(DISTINCT p.period) periods FROM (SELECT DISTINCT series_key, ticker, canonical_metric, scope_kind FROM chart_series) s LEFT JOIN (SELECT DISTINCT series_key, period FROM chart_series_points WHERE value IS NOT NULL) p USING (series_key) WHERE scope_kind = 'company' GROUP BY 1, 2)
    SELECT x.ticker, m.metric, CASE WHEN periods > 0 THEN 'present' WHEN EXISTS (SELECT 1 FROM chart_series s WHERE s.ticker = x.ticker AND s.canonical_metric = m.metric) THEN 'eligible' ELSE 'blocked' END state FROM x CROSS JOIN m LEFT JOIN h ON h.ticker = x.ticker AND h.metric = m.metric"""
)
def metric_gaps(spark, d):
    """Whether each expected metric of a company is present as a total, eligible from parts, or blocked."""
    expected = F.array(*[F.lit(m) for m in ("revenue", "net_income", "total_debt", "gross_margin")])
    s = _t(spark, d, "chart_series").filter("ticker IS NOT NULL").select("series_key", "ticker", F.col("canonical_metric").alias("metric"), "scope_kind").distinct()
    p = _t(spark, d, "chart_series_points").filter("value IS NOT NULL").select("series_key").distinct().withColumn("has", F.lit(True))
    state = s.join(p, "series_key", "left").groupBy("ticker", "metric").agg(F.coalesce(F.bool_or((F.col("scope_kind") == "company") & F.col("has")), F.lit(False)).alias("present"))
    wanted = s.select("ticker").distinct().withColumn("metric", F.explode(expected))
    return wanted.join(state, ["ticker", "metric"], "left").select("ticker", "metric", F.when(F.col("present"), "present").when(F.col("present").isNotNull(), "eligible").otherwise("blocked").alias("state"))
