"""Queries over the search index, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridant.functions.lexical import character_pairs, fold, prefix_terms, scope_tokens, word_runs, words
from veridant.operators.search_index import SearchIndex
from veridant.plans.evidence import _WORDS, _t, query
from veridant.session import cut_lineage

#: Weights of the fields of an object.
WEIGHTS = {"label": 4.0, "company": 2.0, "summary": 1.0}
QUESTION = "demand for freight brokerage"
SYNONYMS = {"demand": ["order"], "freight": ["shipping", "cargo"]}


def objects(spark, d):
    """One row per object: its newest delivery."""
    o = _t(spark, d, "global_object_locator").filter("object_id IS NOT NULL")
    newest = F.max(F.struct("loaded_at", "ticker", "document_type", "period", "object_type", "company_name", "compact_label", "compact_summary", "quality_status")).alias("o")
    o = o.groupBy("object_id").agg(newest)
    return o.select("object_id", F.col("o.ticker").alias("ticker"), F.col("o.document_type").alias("document_type"), F.col("o.period").alias("period"), F.col("o.object_type").alias("object_type"), F.col("o.compact_label").alias("label"), F.col("o.company_name").alias("company"), F.col("o.compact_summary").alias("summary"), F.lower(F.trim("o.quality_status")).alias("status"))


OBJECTS = """ob AS (SELECT object_id, ticker, document_type, period, object_type, compact_label AS label, company_name company, compact_summary summary, lower(trim(quality_status)) status FROM global_object_locator WHERE object_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY loaded_at DESC, ticker DESC NULLS LAST, document_type DESC NULLS LAST, period DESC NULLS LAST, object_type DESC NULLS LAST, company_name DESC NULLS LAST, compact_label DESC NULLS LAST, compact_summary DESC NULLS LAST, quality_status DESC NULLS LAST) = 1)"""
_TS = f"""{OBJECTS}, tk AS (SELECT object_id doc, ticker, document_type, {_WORDS.format(c="label")} t1, {_WORDS.format(c="company")} t2, {_WORDS.format(c="summary")} t3 FROM ob), tl AS (SELECT *, len(t1) + len(t2) + len(t3) dl FROM tk)"""


def _hits(terms: list[str], scope: str = "true") -> str:
    """CTEs h (doc, q, f, dl) and b (doc, score, matched) of terms as prefixes."""
    tf = "len(list_filter({c}, lambda x: starts_with(x, q)))"
    return f"""{_TS}, h0 AS (SELECT doc, q, dl, {scope} inside, 4.0 * {tf.format(c="t1")} + 2.0 * {tf.format(c="t2")} + {tf.format(c="t3")} f FROM tl, (SELECT unnest({terms}) q)), h AS (SELECT * FROM h0 WHERE f > 0),
    st AS (SELECT q, count(*) n FROM h GROUP BY 1), al AS (SELECT count(*) nn, avg(dl) al FROM tl),
    b AS (SELECT doc, sum(greatest(ln((nn - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / al))) score, count(DISTINCT q) matched, list(DISTINCT q) qs FROM h JOIN st USING (q), al WHERE inside GROUP BY 1)"""


def object_index(spark, d) -> SearchIndex:
    return SearchIndex.build(objects(spark, d), "object_id", ["label", "company", "summary"], {"ticker": "ticker", "doctype": "document_type", "otype": "object_type"})


@query(f"""WITH {_hits(prefix_terms(QUESTION))} SELECT doc, round(score, 6) score, matched FROM b""")
def bm25_fielded(spark, d):
    """Objects by BM25 with weights for label, company and summary; terms are prefixes."""
    return object_index(spark, d).bm25(prefix_terms(QUESTION), WEIGHTS).withColumn("score", F.round("score", 6))


@query(f"""WITH {_hits(prefix_terms(QUESTION), "ticker = 'ECMZ' AND document_type = '10-K'")} SELECT doc, round(score, 6) score, matched FROM b""")
def bm25_scoped(spark, d):
    """The same search within one company's annual filings, scoped by tokens of the index."""
    return object_index(spark, d).bm25(prefix_terms(QUESTION), WEIGHTS, scope=scope_tokens(ticker="ECMZ", doctype="10-K")).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_hits(["demand", "order", "freight", "shipping", "cargo", "brokerage"])}, r AS (SELECT doc, score, CASE WHEN list_contains(qs, 'demand') AND list_contains(qs, 'freight') AND list_contains(qs, 'brokerage') THEN 0
    WHEN list_has_any(qs, ['demand', 'order']) AND list_has_any(qs, ['freight', 'shipping', 'cargo']) AND list_contains(qs, 'brokerage') THEN 1 WHEN (list_contains(qs, 'demand') AND list_contains(qs, 'freight')) OR (list_contains(qs, 'freight') AND list_contains(qs, 'brokerage')) THEN 2
    WHEN list_has_any(qs, ['demand', 'freight', 'brokerage']) THEN 3 END rung FROM b) SELECT doc, rung, round(score, 6) score FROM r WHERE rung IS NOT NULL ORDER BY rung, score DESC, doc LIMIT 200"""
)
def ladder_full(spark, d):
    """All rungs of the relaxation ladder: strict, with synonyms, smaller questions, any term; the best 200."""
    return object_index(spark, d).ladder(QUESTION, 200, SYNONYMS, WEIGHTS).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_TS}, p AS (SELECT DISTINCT doc, ticker, unnest(list_concat(t1, t2, t3)) term FROM tl) SELECT term, count(DISTINCT doc) unit_df, count(DISTINCT ticker) ticker_df,
    round(greatest(ln(((SELECT count(*) FROM tl) + 1.0) / (count(DISTINCT doc) + 1)) + ln(((SELECT count(DISTINCT ticker) FROM tl) + 1.0) / (count(DISTINCT ticker) + 1)), 0), 6) information FROM p GROUP BY 1"""
)
def term_information(spark, d):
    """Units and companies of each term and how much it tells: both inverse frequencies, at least zero."""
    o = objects(spark, d)
    each = o.select("object_id", "ticker", F.explode(F.array_distinct(F.concat(words(F.col("label")), words(F.col("company")), words(F.col("summary"))))).alias("term"))
    t = each.groupBy("term").agg(F.countDistinct("object_id").alias("unit_df"), F.countDistinct("ticker").alias("ticker_df"))
    units, tickers = o.agg(F.count("*")).scalar(), o.agg(F.countDistinct("ticker")).scalar()
    info = F.log((units + 1.0) / (F.col("unit_df") + 1)) + F.log((tickers + 1.0) / (F.col("ticker_df") + 1))
    return t.withColumn("information", F.round(F.greatest(info, F.lit(0.0)), 6))


@query(
    f"""WITH {_hits(["demand", "freight", "brokerage"])}, df AS (SELECT q, count(*) n, count(DISTINCT ticker) tn FROM h JOIN (SELECT doc, ticker FROM tl) USING (doc) GROUP BY 1),
    i AS (SELECT q, greatest(ln(((SELECT count(*) FROM tl) + 1.0) / (n + 1)) + ln(((SELECT count(DISTINCT ticker) FROM tl) + 1.0) / (tn + 1)), 0) info FROM df), top AS (SELECT * FROM b ORDER BY score DESC, doc LIMIT 80),
    mm AS (SELECT min(score) lo, max(score) hi FROM top), c AS (SELECT doc, matched, score, (SELECT sum(info) FROM i WHERE list_contains(qs, i.q)) / (SELECT sum(info) FROM i) ic, matched / (SELECT count(*) FROM i)::double cov, matched >= ceil(0.6 * (SELECT count(*) FROM i)) strict FROM top)
    SELECT doc, round((0.45 * cov + 0.35 * ic + 0.2 * CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END) * CASE WHEN strict THEN 1 ELSE 0.25 END, 5) "primary", strict, matched FROM c, mm"""
)
def information_coverage(spark, d):
    """Rerank of the best 80 units: 0.45 coverage, 0.35 coverage of information, 0.20 scaled score; under 60 % of the terms a quarter."""
    index, terms = object_index(spark, d), ["demand", "freight", "brokerage"]
    tickers = objects(spark, d).select(F.col("object_id").alias("doc"), "ticker")
    hits = cut_lineage(index.hits(terms, WEIGHTS))
    df = hits.join(tickers, "doc").groupBy("q").agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tn"))
    all_units, all_tickers = tickers.agg(F.count("*")).scalar(), tickers.agg(F.countDistinct("ticker")).scalar()
    info = df.select("q", F.greatest(F.log((all_units + 1.0) / (F.col("n") + 1)) + F.log((all_tickers + 1.0) / (F.col("tn") + 1)), F.lit(0.0)).alias("info"))
    top = cut_lineage(index.bm25(terms, WEIGHTS, hits=hits).orderBy(F.col("score").desc(), "doc").limit(80))
    info = cut_lineage(info)
    held = hits.join(F.broadcast(top.select("doc")), "doc", "left_semi").join(F.broadcast(info), "q").groupBy("doc").agg(F.sum("info").alias("held"))
    n, total = info.agg(F.count("*")).scalar(), info.agg(F.sum("info")).scalar()
    t = top.join(held, "doc").withColumns({"n": n, "total": total})
    # 80 rows
    w = Window.partitionBy(F.lit(1))
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low))
    strict = F.col("matched") >= F.ceil(0.6 * F.col("n"))
    score = 0.45 * F.col("matched") / F.col("n") + 0.35 * F.col("held") / F.col("total") + 0.2 * scaled
    return t.select("doc", F.round(score * F.when(strict, 1.0).otherwise(0.25), 5).alias("primary"), strict.alias("strict"), "matched")


_SHORT = ["fre", "bro"]


@query(
    f"""WITH {_TS}, w AS (SELECT DISTINCT doc, unnest(list_concat(t1, t2, t3)) w FROM tl), g AS (SELECT doc, w, unnest(list_distinct(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)))) p FROM w WHERE length(w) >= 2)
    SELECT p pair, count(DISTINCT w) terms, count(DISTINCT doc) units FROM g GROUP BY 1"""
)
def pair_postings(spark, d):
    """Postings of character pairs: how many words and units hold each; the index of short and unsegmented words."""
    o = objects(spark, d)
    w = o.select("object_id", F.explode(F.array_distinct(F.concat(words(F.col("label")), words(F.col("company")), words(F.col("summary"))))).alias("w"))
    pairs = w.select("w").distinct().select("w", F.explode(character_pairs(F.col("w"))).alias("pair"))
    return w.join(pairs, "w").groupBy("pair").agg(F.countDistinct("w").alias("terms"), F.countDistinct("object_id").alias("units"))


@query(
    f"""WITH {_TS}, q AS (SELECT unnest(['fr', 're', 'ei', 'ig', 'gh', 'ht']) p), w AS (SELECT doc, f, unnest(ws) w FROM (SELECT doc, 4.0 f, t1 ws FROM tl UNION ALL SELECT doc, 2.0, t2 FROM tl UNION ALL SELECT doc, 1.0, t3 FROM tl)),
    g AS (SELECT doc, f, unnest(list_distinct(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)))) p FROM w), c AS (SELECT doc, f, p, count(*) tf FROM g JOIN q USING (p) GROUP BY ALL)
    SELECT doc, round(sum(f * ln(1 + tf)), 6) score, round(count(DISTINCT p) / 6.0::double, 6) coverage FROM c GROUP BY 1 HAVING count(DISTINCT p) / 6.0 >= 0.75"""
)
def short_token_rescue(spark, d):
    """Units by the character pairs of a term, in any field: weighted logarithms of counts, three quarters of the pairs at least."""
    want = ["fr", "re", "ei", "ig", "gh", "ht"]
    o = objects(spark, d)
    fields = F.array(*[F.struct(F.lit(v).alias("weight"), words(F.col(k)).alias("ws")) for k, v in WEIGHTS.items()])
    each = o.select("object_id", F.inline(fields)).select("object_id", "weight", F.explode("ws").alias("w"))
    held = each.select("object_id", "weight", F.explode(F.array_intersect(character_pairs(F.col("w")), F.array(*[F.lit(p) for p in want]))).alias("pair"))
    c = held.groupBy("object_id", "weight", "pair").agg(F.count("*").alias("tf"))
    s = c.groupBy(F.col("object_id").alias("doc")).agg(F.round(F.sum(F.col("weight") * F.log1p(F.col("tf").cast("double"))), 6).alias("score"), F.round(F.countDistinct("pair") / F.lit(float(len(want))), 6).alias("coverage"))
    return s.filter("coverage >= 0.75")


@query(
    f"""WITH al AS (SELECT DISTINCT array_to_string({_WORDS.format(c="company_name")}, ' ') alias, ticker FROM global_object_locator WHERE company_name IS NOT NULL), x AS (SELECT DISTINCT object_id, compact_label, {_WORDS.format(c="compact_label")} ws FROM global_object_locator WHERE compact_label IS NOT NULL AND object_id IS NOT NULL),
    g AS (SELECT DISTINCT unnest(list_concat(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), list_concat(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')), list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))))) run, object_id FROM x)
    SELECT run, count(DISTINCT object_id) objects, count(DISTINCT ticker) companies FROM g LEFT JOIN al ON al.alias = run GROUP BY 1"""
)
def label_runs(spark, d):
    """Runs of up to four words of labels, how many objects hold each, and the companies it is a name of."""
    names = _t(spark, d, "global_object_locator").filter("company_name IS NOT NULL").select(F.array_join(words(F.col("company_name")), " ").alias("run"), "ticker").distinct()
    x = _t(spark, d, "global_object_locator").filter("compact_label IS NOT NULL AND object_id IS NOT NULL").select("object_id", F.inline(F.array(F.struct(words(F.col("compact_label")).alias("ws"))))).select("object_id", F.explode(word_runs(F.col("ws"), 4)).alias("run")).distinct()
    return x.groupBy("run").agg(F.count("*").alias("objects")).join(names.groupBy("run").agg(F.countDistinct("ticker").alias("companies")), "run", "left").na.fill(0, ["companies"])


@query(f"""WITH {_TS} SELECT doc, len(t1) + len(t2) + len(t3) AS words, strip_accents(replace(lower(coalesce((SELECT label FROM ob WHERE object_id = doc), '')), 'ß', 'ss')) folded FROM tl""")
def folded_labels(spark, d):
    """Labels without case and diacritics, and how many words the index holds of each object."""
    o = objects(spark, d)
    return o.select(F.col("object_id").alias("doc"), (F.size(words(F.col("label"))) + F.size(words(F.col("company"))) + F.size(words(F.col("summary")))).alias("words"), fold(F.col("label")).alias("folded"))


@query(f"""WITH {OBJECTS}, p AS (SELECT unnest(['demand', 'freight', 'brokerage', 'warehouse', 'hydrogen']) term) SELECT term, EXISTS (SELECT 1 FROM ob WHERE status IS DISTINCT FROM 'removed' AND contains(lower(coalesce(label, '') || ' ' || coalesce(summary, '')), term)) present FROM p""")
def present_terms(spark, d):
    """Which of the terms of a question occur at all in scope; one pass."""
    terms = ["demand", "freight", "brokerage", "warehouse", "hydrogen"]
    text = F.lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("summary", F.lit(""))))
    o = objects(spark, d).filter("NOT status <=> 'removed'")
    found = o.agg(*[F.coalesce(F.max(text.contains(t)), F.lit(False)).alias(t) for t in terms])
    return found.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("present")) for t in terms])))
