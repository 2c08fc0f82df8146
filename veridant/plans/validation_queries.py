"""Queries on validation: quotations, relations, supports, numbers, evidence grades, sections; each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridant.functions.document_nodes import document_nodes
from veridant.operators import spine
from veridant.plans.evidence import _t, query
from veridant.plans.search_queries import OBJECTS, objects
from veridant.plans.spine_queries import _EDGES, edges
from veridant.session import spread

_SPANS = "sp AS (SELECT DISTINCT id, text, ticker, section_key, span_index FROM mini_10k_spans WHERE id IS NOT NULL AND text IS NOT NULL)"
_SQUEEZE = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _quotes(spark, d):
    """A quotation of each span: as written, with other white space, or of the span after it in its section."""
    s = _t(spark, d, "mini_10k_spans").filter("id IS NOT NULL AND text IS NOT NULL").select("id", "text", "ticker", "section_key", "span_index").distinct()
    following = F.lead("text").over(Window.partitionBy("ticker", "section_key").orderBy("span_index", "id", "text"))
    s = s.withColumns({"following": following, "kind": F.pmod(F.length("text"), F.lit(3))})
    quote = F.when(F.col("kind") == 0, F.substring("text", 21, 120)).when(F.col("kind") == 1, F.regexp_replace(F.substring("text", 21, 120), " ", "\n\n")).otherwise(F.substring("following", 21, 120))
    return s.select("id", "text", quote.alias("quote"))


@query(
    f"""WITH {_SPANS}, q AS (SELECT id, text, CASE length(text) % 3 WHEN 0 THEN substr(text, 21, 120) WHEN 1 THEN replace(substr(text, 21, 120), ' ', chr(10) || chr(10)) ELSE substr(lead(text) OVER (PARTITION BY ticker, section_key ORDER BY span_index NULLS FIRST, id, text), 21, 120) END quote FROM sp)
    SELECT id, CASE WHEN coalesce(quote, '') = '' THEN 'empty' WHEN contains(text, quote) THEN 'exact' WHEN contains({_SQUEEZE.format(c="text")}, {_SQUEEZE.format(c="quote")}) THEN 'normalized' ELSE 'failed' END match, count(*) quotes FROM q GROUP BY 1, 2"""
)
def exact_quote_match(spark, d):
    """Whether quotations are in their source as written, with other white space, or not at all."""
    q = _quotes(spark, d)
    return q.select("id", spine.quote_match(F.col("quote"), F.col("text")).alias("match")).groupBy("id", "match").agg(F.count("*").alias("quotes"))


_ALLOWED = [("supports", "EvidenceQuote", "ResearchClaim"), ("supports", "ResearchClaim", "FinancialMetric"), ("supports", "EvidenceQuote", "FinancialMetric"), ("supports", "ResearchClaim", "FactorExposure"), ("exposed_to", "ResearchClaim", "FactorExposure"), ("drives", "FinancialMetric", "FinancialMetric")]
_ALLOWED_SQL = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _ALLOWED)
_CHECKED = f"""{OBJECTS}, {_EDGES}, al(r, f, t) AS (VALUES {_ALLOWED_SQL}), ck AS (SELECT edge_id, relation_type, from_object_id, to_object_id, CASE WHEN a.object_id IS NULL OR a.object_type IS NULL THEN 'missing_from' WHEN b.object_id IS NULL OR b.object_type IS NULL THEN 'missing_to' WHEN al.r IS NULL THEN 'not_allowed' ELSE 'accepted' END verdict
    FROM ed LEFT JOIN ob a ON a.object_id = from_object_id LEFT JOIN ob b ON b.object_id = to_object_id LEFT JOIN al ON al.r = relation_type AND al.f = a.object_type AND al.t = b.object_type)"""


def _checked(spark, d):
    allowed = spark.createDataFrame(_ALLOWED, "relation_type string, source_type string, target_type string")
    return spine.relation_checks(edges(spark, d), objects(spark, d), allowed)


@query(f"WITH {_CHECKED} SELECT relation_type, verdict, count(*) AS edges FROM ck GROUP BY 1, 2")
def relation_verdicts(spark, d):
    """Edges by relation and by what the list of allowed relations says."""
    return _checked(spark, d).groupBy("relation_type", "verdict").agg(F.count("*").alias("edges"))


@query(
    f"""WITH {_CHECKED}, c AS (SELECT to_object_id claim, list(DISTINCT from_object_id) ids FROM ed WHERE relation_type = 'supports' AND from_object_id IS NOT NULL AND to_object_id IS NOT NULL GROUP BY 1), u AS (SELECT claim, unnest(ids) id FROM c), ok AS (SELECT object_id FROM ob WHERE status IS DISTINCT FROM 'fail')
    SELECT claim, count(ok.object_id) kept, count(*) - count(ok.object_id) dropped FROM u LEFT JOIN ok ON ok.object_id = id GROUP BY 1"""
)
def pruned_supports(spark, d):
    """Supports of each object that are accepted, and how many are not."""
    e = edges(spark, d).filter("relation_type = 'supports' AND from_object_id IS NOT NULL AND to_object_id IS NOT NULL").select(F.col("to_object_id").alias("claim"), F.array("from_object_id").alias("ids")).distinct()
    ok = objects(spark, d).filter("NOT status <=> 'fail'").select("object_id")
    return spine.pruned_supports(e, ok, "claim", "ids").select("claim", F.size("kept").cast("long").alias("kept"), "dropped")


@query(
    f"""WITH {OBJECTS}, {_EDGES}, s AS (SELECT to_object_id object_id, count(DISTINCT from_object_id) n FROM ed JOIN ob ON ob.object_id = from_object_id WHERE relation_type = 'supports' AND ob.object_type IN ('EvidenceQuote', 'ResearchClaim') GROUP BY 1)
    SELECT ob.object_id, CASE WHEN object_type IS NULL OR ticker IS NULL OR document_type IS NULL THEN 'schema' WHEN coalesce(label, '') = '' THEN 'text' WHEN period IS NULL OR NOT regexp_matches(period, '^(FY[0-9]{{4}}|CY[0-9]{{4}}(Q[1-4])?)$') THEN 'period' WHEN status IN ('fail', 'deleted', 'tombstoned', 'removed') THEN 'status'
      WHEN object_type IN ('FactorExposure', 'NamedEntity', 'FinancialMetric') AND coalesce(n, 0) = 0 THEN 'support' END stage FROM ob LEFT JOIN s ON s.object_id = ob.object_id"""
)
def object_validation(spark, d):
    """The first stage at which each object fails: schema, text, period, status, support; null if it is accepted."""
    o = objects(spark, d)
    evidence = o.filter(F.col("object_type").isin("EvidenceQuote", "ResearchClaim")).select(F.col("object_id").alias("from_object_id"))
    s = edges(spark, d).filter("relation_type = 'supports'").join(evidence, "from_object_id").groupBy(F.col("to_object_id").alias("object_id")).agg(F.countDistinct("from_object_id").alias("n"))
    o = o.join(s, "object_id", "left")
    stage = spine.first_failure(
        [
            ("schema", F.col("object_type").isNotNull() & F.col("ticker").isNotNull() & F.col("document_type").isNotNull()),
            ("text", F.col("label") != ""),
            ("period", F.col("period").rlike(r"^(FY\d{4}|CY\d{4}(Q[1-4])?)$")),
            ("status", F.col("status").isNull() | ~F.col("status").isin("fail", "deleted", "tombstoned", "removed")),
            ("support", ~F.col("object_type").isin(*spine.INTERPRETED) | (F.coalesce("n", F.lit(0)) > 0)),
        ]
    )
    return o.select("object_id", stage.alias("stage"))


_NUMBERS = """nu AS (SELECT id, list_distinct(list_transform(regexp_extract_all(text, '[$]([0-9][0-9,]*(?:[.][0-9]+)?)', 1), lambda x: replace(x, ',', '')::double)) amounts, list_distinct(list_transform(regexp_extract_all(text, '([0-9]+(?:[.][0-9]+)?)%', 1), lambda x: x::double)) percents FROM (SELECT DISTINCT id, text FROM mini_10k_spans WHERE id IS NOT NULL AND text IS NOT NULL))"""


def _numbers(spark, d):
    s = _t(spark, d, "mini_10k_spans").filter("id IS NOT NULL AND text IS NOT NULL").select("id", "text").distinct()
    amounts = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\$([0-9][0-9,]*(?:\.[0-9]+)?)"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double")))
    percents = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?)%"), 1), lambda x: x.cast("double")))
    # behind a Generate, so that the numbers are read once
    return s.select("id", F.inline(F.array(F.struct(amounts.alias("amounts"), percents.alias("percents")))))


@query(
    f"""WITH {_NUMBERS}, p AS (SELECT row_number() OVER () k, id, unnest(percents) p, list_filter(amounts, lambda a: a <> 0) am FROM nu WHERE len(amounts) <= 80), x AS (SELECT k, unnest(am) a FROM p), v AS (SELECT x.k, unnest([(x.a - y.a) / abs(y.a) * 100, x.a / y.a * 100]) v FROM x JOIN x y ON x.k = y.k AND x.a <> y.a),
    w AS (SELECT k, v FROM v WHERE abs(v) <= 1000 AND v <> 0), h AS (SELECT DISTINCT id, p FROM p JOIN w USING (k) WHERE least(abs(v - p), abs(round_even(v, 1) - p), abs(round_even(v, 0) - p), abs(sign(v) * floor(abs(v)) - p), abs(sign(v) * ceil(abs(v)) - p)) < 1e-9), a AS (SELECT DISTINCT id, unnest(percents) p FROM nu)
    SELECT a.id, count(*) percentages, count(h.p) supported FROM a LEFT JOIN h ON h.id = a.id AND h.p = a.p GROUP BY 1"""
)
def percent_support(spark, d):
    """Percentages of each span, and how many are the growth or ratio of two of its amounts, rounded in a usual way."""
    n = _numbers(spark, d).select("id", "percents", F.inline(F.array(F.struct(spine.derived_percentages(F.col("amounts")).alias("derived")))))
    each = n.select("id", F.explode("percents").alias("p"), "derived").select("id", "p", spine.percent_supported(F.col("p"), F.col("derived")).alias("ok")).groupBy("id", "p").agg(F.max("ok").alias("ok"))
    return each.groupBy("id").agg(F.count("*").alias("percentages"), F.count_if("ok").alias("supported"))


@query(
    f"""WITH {_NUMBERS}, a AS (SELECT row_number() OVER () k, id, amounts FROM nu WHERE len(amounts) > 0), x AS (SELECT k, id, unnest(amounts) a FROM a WHERE len(amounts) <= 80), s AS (SELECT DISTINCT t.id, t.a FROM x t JOIN x l ON l.k = t.k AND l.a <> t.a JOIN x r ON r.k = t.k AND r.a <> t.a AND r.a <> l.a WHERE abs(l.a + r.a - t.a) < 1e-6 OR abs(abs(l.a - r.a) - t.a) < 1e-6)
    SELECT b.id, count(*) AS amounts, count(s.a) supported FROM (SELECT DISTINCT id, unnest(amounts) a FROM a) b LEFT JOIN s ON s.id = b.id AND s.a = b.a GROUP BY 1"""
)
def amount_support(spark, d):
    """Amounts of each span, and how many are the sum or difference of two others."""
    n = _numbers(spark, d).filter(F.size("amounts") > 0)
    each = n.select("id", "amounts", F.explode("amounts").alias("a"))
    others = F.filter("amounts", lambda x: x != F.col("a"))
    each = each.select("id", "a", (spine.amount_supported(F.col("a"), others) & (F.size("amounts") <= 80)).alias("ok")).groupBy("id", "a").agg(F.max("ok").alias("ok"))
    return each.groupBy("id").agg(F.count("*").alias("amounts"), F.count_if("ok").alias("supported"))


@query(
    f"""WITH {OBJECTS}, {_EDGES}, k AS (SELECT to_object_id object_id, max((b.object_type = 'EvidenceQuote' AND contains(lower(coalesce(b.label, '')), split_part(lower(a.label), ' ', 1)))::int) dq, max((b.object_type = 'ResearchClaim' AND contains(lower(coalesce(b.label, '')), split_part(lower(a.label), ' ', 1)))::int) dc, count(b.object_id) n
      FROM ed JOIN ob a ON a.object_id = to_object_id JOIN ob b ON b.object_id = from_object_id WHERE relation_type = 'supports' AND a.object_type = 'FactorExposure' AND a.label <> '' AND b.object_type IN ('EvidenceQuote', 'ResearchClaim') GROUP BY 1)
    SELECT ob.object_id, CASE WHEN k.object_id IS NULL THEN 'unsupported' WHEN dq = 1 THEN 'direct' WHEN dc = 1 THEN 'indirect' ELSE 'derived' END grade FROM ob LEFT JOIN k USING (object_id) WHERE object_type = 'FactorExposure' AND label <> ''"""
)
def evidence_grades(spark, d):
    """Grade of each exposure: direct if a quotation names its factor, indirect if only a claim does, derived with other support."""
    o = objects(spark, d)
    e = o.filter("object_type = 'FactorExposure' AND label != ''").select("object_id", F.substring_index(F.lower("label"), " ", 1).alias("factor"))
    s = o.filter(F.col("object_type").isin("EvidenceQuote", "ResearchClaim")).select(F.col("object_id").alias("from_object_id"), F.col("object_type").alias("kind"), F.lower(F.coalesce("label", F.lit(""))).alias("said"))
    j = edges(spark, d).filter("relation_type = 'supports'").select(F.col("to_object_id").alias("object_id"), "from_object_id").join(e, "object_id").join(s, "from_object_id")
    named = F.contains("said", F.col("factor"))
    k = j.groupBy("object_id").agg(F.max(named & (F.col("kind") == "EvidenceQuote")).alias("dq"), F.max(named & (F.col("kind") == "ResearchClaim")).alias("dc"))
    grade = F.when(F.col("dq").isNull(), "unsupported").when(F.col("dq"), "direct").when(F.col("dc"), "indirect").otherwise("derived")
    return e.join(k, "object_id", "left").select("object_id", grade.alias("grade"))


@query(
    f"""WITH n AS (SELECT DISTINCT ticker, id, section_key, span_index, start_char, lower(left(coalesce(text, ''), 400)) head FROM mini_10k_spans WHERE id IS NOT NULL AND ticker IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY start_char NULLS FIRST, id, section_key NULLS FIRST, span_index NULLS FIRST, head) pos FROM n)
    SELECT a.ticker, a.pos, max(a.section_key) section_key, count(DISTINCT b.section_key) sections, count(DISTINCT b.section_key) >= 4 AND (a.pos <= 30 OR bool_or(contains(b.head, 'contents'))) dense FROM r a JOIN r b ON a.ticker = b.ticker AND b.pos BETWEEN a.pos - 12 AND a.pos + 12 GROUP BY 1, 2"""
)
def contents_density(spark, d):
    """Distinct sections within twelve nodes on each side of each node, and whether that is a table of contents."""
    n = _t(spark, d, "mini_10k_spans").filter("id IS NOT NULL AND ticker IS NOT NULL").select("ticker", "id", "section_key", "span_index", "start_char", F.lower(F.left(F.coalesce("text", F.lit("")), F.lit(400))).alias("head")).distinct()
    order = Window.partitionBy("ticker").orderBy(F.col("start_char").asc_nulls_first(), "id", F.col("section_key").asc_nulls_first(), F.col("span_index").asc_nulls_first(), "head")
    near = order.rowsBetween(-12, 12)
    n = n.withColumns({"pos": F.row_number().over(order), "sections": F.size(F.collect_set("section_key").over(near)).cast("long"), "said": F.max(F.contains("head", F.lit("contents"))).over(near)})
    return n.select("ticker", "pos", "section_key", "sections", ((F.col("sections") >= 4) & ((F.col("pos") <= 30) | F.col("said"))).alias("dense"))


@query(
    """WITH s AS (SELECT DISTINCT ticker, source_document_id, section_key, id, start_char, 10 * (section_detection_method IS NOT DISTINCT FROM 'regex')::int + 5 * (length(coalesce(text, '')) > 500)::int + 3 * (section_number IS NOT NULL)::int - 8 * (section_detection_method IS NOT DISTINCT FROM 'toc')::int score FROM mini_10k_spans WHERE section_key IS NOT NULL AND source_document_id IS NOT NULL AND start_char IS NOT NULL),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source_document_id, section_key ORDER BY score DESC, start_char, id) = 1) SELECT source_document_id, section_key, id, score, row_number() OVER (PARTITION BY source_document_id ORDER BY start_char, section_key) place FROM b"""
)
def section_path(spark, d):
    """The best candidate of each section of a document by added scores, in order of the source."""
    one = lambda c, n: F.when(c, n).otherwise(0)
    s = _t(spark, d, "mini_10k_spans").filter("section_key IS NOT NULL AND source_document_id IS NOT NULL AND start_char IS NOT NULL")
    score = one(F.col("section_detection_method") == "regex", 10) + one(F.length("text") > 500, 5) + one(F.col("section_number").isNotNull(), 3) - one(F.col("section_detection_method") == "toc", 8)
    b = s.groupBy("source_document_id", "section_key").agg(F.min(F.struct((-score).alias("s"), "start_char", "id")).alias("b"))
    b = b.select("source_document_id", "section_key", F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"), F.col("b.start_char").alias("at"))
    return b.withColumn("place", F.row_number().over(Window.partitionBy("source_document_id").orderBy("at", "section_key"))).drop("at")


@query("SELECT id, sha256(regexp_replace(regexp_replace(text, chr(13) || chr(10), chr(10), 'g'), chr(13), chr(10), 'g')) digest, count(*) copies FROM mini_10k_spans WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2")
def text_digests(spark, d):
    """Digests of texts with all line ends alike, and how often each is delivered."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    return _t(spark, d, "mini_10k_spans").filter("id IS NOT NULL AND text IS NOT NULL").select("id", F.sha2(text, 256).alias("digest")).groupBy("id", "digest").agg(F.count("*").alias("copies"))


@query(
    """WITH q AS (SELECT DISTINCT section_name, id, CASE WHEN lower(coalesce(section_name, '')) LIKE '%1a%' THEN 0 WHEN lower(coalesce(section_name, '')) LIKE '%7%' THEN 1 ELSE 2 END pri, (contains(lower(coalesce(text, '')), 'demand') OR contains(lower(coalesce(text, '')), 'margin')) key, span_index FROM mini_10k_spans WHERE id IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY pri ORDER BY key DESC, span_index NULLS FIRST, id, section_name NULLS FIRST) rn FROM q) SELECT id, section_name, pri, rn FROM r WHERE rn <= CASE pri WHEN 0 THEN 20 WHEN 1 THEN 20 ELSE 10 END"""
)
def pilot_spans(spark, d):
    """Spans for a pilot: a quota for each kind of section, those with key words first, then in order."""
    name, text = F.lower(F.coalesce("section_name", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    pri = F.when(F.contains(name, F.lit("1a")), 0).when(F.contains(name, F.lit("7")), 1).otherwise(2)
    key = F.contains(text, F.lit("demand")) | F.contains(text, F.lit("margin"))
    q = _t(spark, d, "mini_10k_spans").filter("id IS NOT NULL").select("section_name", "id", pri.alias("pri"), key.alias("key"), "span_index").distinct()
    w = Window.partitionBy("pri").orderBy(F.col("key").desc(), F.col("span_index").asc_nulls_first(), "id", F.col("section_name").asc_nulls_first())
    return q.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= F.when(F.col("pri") == 2, 10).otherwise(20)).select("id", "section_name", "pri", "rn")


_KINDS = """ln AS (SELECT doc_id, row_number() OVER () g, unnest(list_transform(string_split(text, chr(10)), lambda l: trim(l))) line FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
    nd AS (SELECT doc_id, CASE WHEN line LIKE '#%' OR regexp_matches(line, '(?i)^\\W*item\\s+(\\d{1,2}[a-c]?)\\b') OR regexp_matches(line, '(?i)^\\W*part\\s+(iv|iii|ii|i)\\b') THEN 'heading' WHEN line LIKE '|%' THEN 'table' WHEN regexp_matches(line, '^([-*•]|\\d+[.)]) ') THEN 'list' WHEN length(line) <= 80 AND regexp_matches(line, '\\p{Lu}') AND line = upper(line) AND regexp_matches(line, '\\p{L}{3}') THEN 'heading' ELSE 'paragraph' END kind FROM ln WHERE line <> '')"""


@query(f"WITH {_KINDS} SELECT kind, count(*) nodes, count(DISTINCT doc_id) documents FROM nd GROUP BY 1")
def document_node_kinds(spark, d):
    """Lines of texts by kind of node."""
    n = document_nodes(spread(_t(spark, d, "documents").select("doc_id", "text")).distinct(), "doc_id", "text")
    return n.groupBy("kind").agg(F.count("*").alias("nodes"), F.countDistinct("doc").alias("documents"))


@query("SELECT count(DISTINCT ticker) companies, count(DISTINCT document_id) documents, count(DISTINCT object_id) objects, count(DISTINCT object_type) kinds, min(period) first_period, max(period) last_period FROM global_object_locator")
def export_totals(spark, d):
    """Grand totals of an export."""
    o = _t(spark, d, "global_object_locator")
    return o.agg(F.countDistinct("ticker").alias("companies"), F.countDistinct("document_id").alias("documents"), F.countDistinct("object_id").alias("objects"), F.countDistinct("object_type").alias("kinds"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


@query("SELECT DISTINCT object_id FROM global_object_locator l WHERE object_id >= 'claim:' AND object_id < 'claim;' AND EXISTS (SELECT 1 FROM global_object_locator r WHERE r.object_id = l.object_id AND r.document_type = '10-Q')")
def scoped_prefix_hits(spark, d):
    """Objects of a prefix that have a replica in scope: a range and a semi-join."""
    o = _t(spark, d, "global_object_locator")
    hits = o.filter((F.col("object_id") >= "claim:") & (F.col("object_id") < "claim;")).select("object_id").distinct()
    return hits.join(o.filter("document_type = '10-Q'").select("object_id"), "object_id", "left_semi")
