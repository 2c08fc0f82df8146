"""More queries over the evidence tables: coverage, verdicts, rankings, links over time."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridant.functions import screening
from veridant.functions.numbers import extract_numbers
from veridant.functions.spans import sentence_candidates, span_windows
from veridant.functions.text_units import section_key
from veridant.operators import relational, textsearch
from veridant.plans.evidence import _t, _WORDS
from veridant.session import small_side, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """WITH p AS (SELECT DISTINCT p.ticker, canonical_metric, unit, scope_kind, scope_key, p.period, value FROM chart_series_points p JOIN (SELECT DISTINCT series_key, canonical_metric, unit, scope_kind, scope_key FROM chart_series) s USING (series_key))
    SELECT ticker, canonical_metric, unit, scope_kind, scope_key, period, count(DISTINCT value) AS "values", min(value) lowest, max(value) highest FROM p WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT value) > 1"""
)
def metric_conflicts(spark, d):
    """Periods of a metric with more than one value."""
    keys = ["ticker", "canonical_metric", "unit", "scope_kind", "scope_key", "period"]
    s = _t(spark, d, "chart_series").select("series_key", "canonical_metric", "unit", "scope_kind", "scope_key").distinct()
    p = _t(spark, d, "chart_series_points").filter("value IS NOT NULL").join(s, "series_key")
    return p.groupBy(*keys).agg(F.countDistinct("value").alias("values"), F.min("value").alias("lowest"), F.max("value").alias("highest")).filter(F.col("values") > 1)


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY series_key, period ORDER BY source_sort_key DESC NULLS LAST, loaded_at DESC, object_id DESC NULLS LAST, value DESC NULLS LAST) rn FROM chart_series_points) SELECT series_key, period, source_document_id, value, object_id FROM r WHERE rn = 1"""
)
def prefer_newest_filing(spark, d):
    """One point per series and period, from the newest filing."""
    order = F.struct("source_sort_key", "loaded_at", "object_id", "value", "source_document_id")
    p = _t(spark, d, "chart_series_points").groupBy("series_key", "period").agg(F.max(order).alias("b"))
    return p.select("series_key", "period", "b.source_document_id", "b.value", "b.object_id")


@query(
    """WITH o AS (SELECT observation_id, max(value) price FROM observations WHERE value IS NOT NULL GROUP BY 1), h AS (SELECT observation_id, max(close) AS close FROM ohlcv_observations WHERE close IS NOT NULL GROUP BY 1)
    SELECT CASE WHEN close = price THEN 'match' WHEN price = 0 THEN 'mismatch' WHEN abs(close - price) / abs(price) <= 0.001::double THEN 'match' WHEN abs(close - price) / abs(price) <= 0.01::double THEN 'tolerance' ELSE 'mismatch' END verdict, count(*) n FROM h JOIN o USING (observation_id) GROUP BY 1"""
)
def copy_verdicts(spark, d):
    """How far the closes agree with the price rows they copy."""
    o = _t(spark, d, "observations").filter("value IS NOT NULL").groupBy("observation_id").agg(F.max("value").alias("price"))
    h = _t(spark, d, "ohlcv_observations").filter("close IS NOT NULL").groupBy("observation_id").agg(F.max("close").alias("close"))
    off = F.abs(F.col("close") - F.col("price")) / F.nullif(F.abs("price"), F.lit(0.0))
    verdict = F.when((F.col("close") == F.col("price")) | (off <= 0.001), "match").when(off <= 0.01, "tolerance").otherwise("mismatch")
    return h.join(o, "observation_id").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(
    """WITH x AS (SELECT ticker, object_type, split_part(lower(compact_label), ' of ', 1) topic, period, min(object_id) object_id FROM global_object_locator WHERE compact_label IS NOT NULL AND object_id IS NOT NULL AND period IS NOT NULL AND ticker IS NOT NULL GROUP BY 1, 2, 3, 4),
    l AS (SELECT object_id, period, lead(object_id) OVER w next_id, lead(period) OVER w next_period FROM x WINDOW w AS (PARTITION BY ticker, object_type, topic ORDER BY regexp_extract(period, '[0-9]{4}'), period)) SELECT object_id, period, next_id, next_period FROM l WHERE next_id IS NOT NULL"""
)
def temporal_links(spark, d):
    """The first object of each topic of a company in a period, with that of the next period in which the topic comes."""
    o = _t(spark, d, "global_object_locator").filter("compact_label IS NOT NULL AND object_id IS NOT NULL AND period IS NOT NULL AND ticker IS NOT NULL")
    x = o.groupBy("ticker", "object_type", F.substring_index(F.lower("compact_label"), " of ", 1).alias("topic"), "period").agg(F.min("object_id").alias("object_id"))
    w = Window.partitionBy("ticker", "object_type", "topic").orderBy(F.regexp_extract("period", r"[0-9]{4}", 0), "period")
    return x.select("object_id", "period", F.lead("object_id").over(w).alias("next_id"), F.lead("period").over(w).alias("next_period")).filter("next_id IS NOT NULL")


@query(
    """WITH t AS (SELECT DISTINCT ticker, object_id, unnest(regexp_extract_all(lower(compact_label), '[a-z]{4,}')) term FROM global_object_locator), c AS (SELECT ticker, term, count(DISTINCT object_id) objects FROM t GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY objects DESC, term) AS rank FROM c) SELECT * FROM r WHERE rank <= 10"""
)
def topic_map(spark, d):
    """Ten most frequent topic words of each company."""
    t = _t(spark, d, "global_object_locator").select("ticker", "object_id", F.explode(F.regexp_extract_all(F.lower("compact_label"), F.lit("[a-z]{4,}"), 0)).alias("term"))
    c = t.groupBy("ticker", "term").agg(F.countDistinct("object_id").alias("objects"))
    return relational.top_per_group(c, ["ticker"], [F.col("objects").desc(), F.col("term")], 10)


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(
    f"""WITH x AS (SELECT DISTINCT id, text, section_key FROM mini_10k_spans WHERE id IS NOT NULL), a AS (SELECT *, split_part(coalesce(section_key, ''), '#', 1) sec, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) p, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l)), lambda l: l <> '') ls FROM x),
    b AS (SELECT *, lower(p) low, len(list_filter(ls, lambda l: regexp_matches(l, '(?i)^(item\\s+\\d{{1,2}}[a-z]?|part\\s+[ivx]+)\\b.+\\s+\\d{{1,4}}$'))) n, string_split(regexp_replace(p, '([.!?])\\s+([A-Z0-9"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) ss FROM a),
    c AS (SELECT *, len(list_filter(ss, lambda s: length(s) BETWEEN 60 AND 1200 AND (list_contains({_list(screening.TARGET_SECTIONS)}, sec) OR len(list_filter({_list(screening.QUOTE_WORDS)}, lambda k: contains(lower(s), k))) > 0))) cand FROM b)
    SELECT id, CASE WHEN p = '' THEN 'empty_span' WHEN length(regexp_replace(p, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 12 THEN 'layout_fragment' WHEN (n >= 3 AND n * 2 >= len(ls)) OR (starts_with(low, 'table of contents') AND n >= 2) THEN 'toc_like' WHEN list_contains({_list(screening.STRUCTURAL_LABELS)}, regexp_replace(low, '^[ .:-]+|[ .:-]+$', '', 'g')) THEN 'structural_label'
      WHEN sec = 'cover' THEN 'cover_metadata' WHEN contains(low, '/s/') OR contains(low, 'pursuant to the requirements of section') THEN 'signature_or_certification_boilerplate' WHEN list_contains({_list(screening.EXHIBIT_SECTIONS)}, sec) THEN 'exhibit_index_or_list' WHEN cand = 0 THEN 'no_quote_candidates' WHEN list_contains({_list(screening.TARGET_SECTIONS)}, sec) THEN 'core_section' ELSE 'has_quote_candidates' END reason, count(*) versions FROM c GROUP BY 1, 2"""
)
def span_eligibility(spark, d):
    """Each span with the first rule that keeps or skips it."""
    s = _t(spark, d, "mini_10k_spans").filter("id IS NOT NULL").select("id", "text", "section_key").distinct()
    section = F.substring_index(F.coalesce("section_key", F.lit("")), "#", 1)
    return s.select("id", screening.eligibility(F.col("text"), section).alias("reason")).groupBy("id", "reason").agg(F.count("*").alias("versions"))


@query(
    """SELECT coalesce(section_name, 'none') section, count(*) spans, round(avg(CASE WHEN char_count IS DISTINCT FROM length(text) THEN 1.0 ELSE 0.0 END), 6) wrong_count_share, round(avg(CASE WHEN end_char IS NULL OR end_char - start_char <> length(text) THEN 1.0 ELSE 0.0 END), 6) wrong_end_share FROM mini_10k_spans GROUP BY 1"""
)
def section_quality(spark, d):
    """Shares of wrong counts and offsets by section spelling."""
    s = _t(spark, d, "mini_10k_spans").groupBy(F.coalesce("section_name", F.lit("none")).alias("section"))
    wrong = ~F.col("char_count").eqNullSafe(F.length("text"))
    end = F.col("end_char").isNull() | F.coalesce(F.col("end_char") - F.col("start_char") != F.length("text"), F.lit(False))
    return s.agg(F.count("*").alias("spans"), F.round(F.avg(wrong.cast("double")), 6).alias("wrong_count_share"), F.round(F.avg(end.cast("double")), 6).alias("wrong_end_share"))


@query(
    """WITH t AS (SELECT from_ticker ticker, list_sort(list(DISTINCT relation_type)) has FROM global_edge_spine WHERE from_ticker IS NOT NULL AND relation_type IS NOT NULL GROUP BY 1)
    SELECT ticker, len(has) relations, CASE WHEN list_has_all(has, ['supports', 'drives', 'mentions']) THEN 'covered' WHEN list_has_any(has, ['supports', 'drives', 'mentions']) THEN 'partial' ELSE 'missing' END coverage FROM t"""
)
def relation_coverage(spark, d):
    """Whether each company has all, some or none of the required relations."""
    need = F.array(F.lit("supports"), F.lit("drives"), F.lit("mentions"))
    t = _t(spark, d, "global_edge_spine").filter("from_ticker IS NOT NULL AND relation_type IS NOT NULL").groupBy(F.col("from_ticker").alias("ticker")).agg(F.collect_set("relation_type").alias("has"))
    state = F.when(F.size(F.array_except(need, "has")) == 0, "covered").when(F.arrays_overlap("has", need), "partial").otherwise("missing")
    return t.select("ticker", F.size("has").alias("relations"), state.alias("coverage"))


@query(
    """WITH g AS (SELECT DISTINCT from_object_id q, to_object_id o FROM global_edge_spine WHERE relation_type = 'supports' AND from_object_id IS NOT NULL AND to_object_id IS NOT NULL), s AS (SELECT from_object_id q, to_object_id o, max(coalesce(materiality, 0)) m FROM global_edge_spine WHERE from_object_id IS NOT NULL AND to_object_id IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY m DESC, o) rk FROM s), h AS (SELECT r.q, rk FROM r JOIN g ON r.q = g.q AND r.o = g.o), n AS (SELECT q, count(*) gold FROM g GROUP BY 1), a AS (SELECT q, min(rk) first, sum(CASE WHEN rk <= 3 THEN 1 ELSE 0 END) hit, sum(CASE WHEN rk <= 3 THEN 1 / log2(rk + 1) ELSE 0 END) dcg FROM h GROUP BY 1)
    SELECT count(*) queries, round(avg(1.0::double / first), 6) mrr, round(avg(hit::double / gold), 6) recall_at_3, round(avg(dcg / (1 + CASE WHEN gold > 1 THEN 1 / log2(3) ELSE 0 END + CASE WHEN gold > 2 THEN 0.5 ELSE 0 END)), 6) ndcg_at_3 FROM n JOIN a USING (q)"""
)
def ranking_metrics(spark, d):
    """MRR, recall and nDCG at 3 of a ranking by materiality, supports being the gold."""
    e = _t(spark, d, "global_edge_spine").filter("from_object_id IS NOT NULL AND to_object_id IS NOT NULL")
    s = e.groupBy(F.col("from_object_id").alias("q"), F.col("to_object_id").alias("o")).agg(F.max(F.coalesce("materiality", F.lit(0.0))).alias("m"), F.max((F.coalesce("relation_type", F.lit("")) == "supports").cast("int")).alias("gold"))
    r = s.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy(F.col("m").desc(), "o")))
    g = F.col("gold") == 1
    top = g & (F.col("rk") <= 3)
    a = r.groupBy("q").agg(F.sum("gold").alias("n"), F.min(F.when(g, F.col("rk"))).alias("first"), F.count_if(top).alias("hit"), F.sum(F.when(top, 1 / F.log2(F.col("rk") + 1)).otherwise(0.0)).alias("dcg")).filter("n > 0")
    ideal = 1 + F.when(F.col("n") > 1, 1 / F.log2(F.lit(3.0))).otherwise(0.0) + F.when(F.col("n") > 2, 0.5).otherwise(0.0)
    return a.agg(F.count("*").alias("queries"), F.round(F.avg(1 / F.col("first")), 6).alias("mrr"), F.round(F.avg(F.col("hit") / F.col("n")), 6).alias("recall_at_3"), F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg_at_3"))


@query(
    """WITH c AS (SELECT ticker, document_type, count(DISTINCT document_id) n FROM global_object_locator WHERE document_type IS NOT NULL GROUP BY 1, 2) SELECT ticker, string_agg(document_type || ':' || n, ',' ORDER BY document_type) forms, sum(n) documents FROM c GROUP BY 1"""
)
def company_catalog(spark, d):
    """Documents by form for each company."""
    c = _t(spark, d, "global_object_locator").filter("document_type IS NOT NULL").groupBy("ticker", "document_type").agg(F.countDistinct("document_id").alias("n"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("document_type", "n"))), lambda x: F.concat(x["document_type"], F.lit(":"), x["n"].cast("string"))), ",")
    return c.groupBy("ticker").agg(listed.alias("forms"), F.sum("n").alias("documents"))


_KIND = " ".join(f"WHEN len(list_filter({_list(ws)}, lambda k: contains(low, k))) > 0 THEN '{k}'" for k, ws in screening.EVENT_KINDS.items())
_EVENTS = f"""w AS (SELECT doc_id, ticker, period, text, lower(text) low FROM documents WHERE text IS NOT NULL), ev AS (SELECT DISTINCT doc_id, ticker, coalesce(period, 'ALL') period, CASE {_KIND} ELSE 'business_update' END event_type, nullif(regexp_extract(text, '\\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\\s+\\d{{4}})\\b', 1), '') event_date FROM w WHERE len(list_filter({_list(screening.EVENT_WORDS)}, lambda k: contains(low, k))) > 0)"""


def _change_events(spark, d):
    e = spread(_t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "ticker", "period", "text"))
    day = F.nullif(F.regexp_extract("text", screening.MONTH_YEAR, 1), F.lit(""))
    e = e.select("doc_id", "ticker", F.coalesce("period", F.lit("ALL")).alias("period"), screening.event_kind(F.col("text")).alias("event_type"), day.alias("event_date"))
    return e.filter("event_type IS NOT NULL").distinct()


@query(f"WITH {_EVENTS} SELECT doc_id, ticker, period, event_type, event_date FROM ev")
def change_events(spark, d):
    """Texts that tell of an event, with its kind and the first month and year they name."""
    return _change_events(spark, d)


@query(
    f"""WITH {_EVENTS} SELECT ticker, period, doc_id, event_type FROM ev QUALIFY row_number() OVER (PARTITION BY ticker, period ORDER BY CASE event_type WHEN 'approval_update' THEN 0 WHEN 'project_execution_update' THEN 1 WHEN 'contract_update' THEN 2 ELSE 3 END, doc_id, event_date NULLS FIRST) <= 3"""
)
def selected_events(spark, d):
    """Three events of each company and period, approvals before progress before contracts before others."""
    rank = F.create_map(*[F.lit(x) for kv in {"approval_update": 0, "project_execution_update": 1, "contract_update": 2, "business_update": 3}.items() for x in kv])
    w = Window.partitionBy("ticker", "period").orderBy(F.element_at(rank, F.col("event_type")), "doc_id", F.col("event_date").asc_nulls_first())
    return _change_events(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("ticker", "period", "doc_id", "event_type")


def _run(n: int, i):
    """The n words of `ts` from place i."""
    return F.array_join(F.slice("ts", i, F.lit(n)), " ")


@query(
    f"""WITH a AS (SELECT DISTINCT lower(company_name) alias, ticker, {_WORDS.format(c="company_name")} ns FROM global_object_locator WHERE company_name IS NOT NULL), w AS (SELECT doc_id, ' ' || array_to_string({_WORDS.format(c="text")}, ' ') || ' ' ts FROM documents),
    g AS (SELECT DISTINCT ns, array_to_string(ns, ' ') n FROM a WHERE len(ns) > 0), h AS (SELECT n, doc_id FROM g JOIN w ON contains(ts, ' ' || n || ' ')) SELECT a.ticker, a.alias, count(DISTINCT doc_id) documents FROM h JOIN a ON array_to_string(a.ns, ' ') = n GROUP BY 1, 2"""
)
def company_mentions(spark, d):
    """Documents that name a company, by runs of as many words as a name has; case and what stands between words are ignored."""
    a = _t(spark, d, "global_object_locator").filter("company_name IS NOT NULL").select(F.lower("company_name").alias("alias"), "ticker").distinct()
    a = a.withColumn("ws", textsearch.tokens(F.col("alias"))).select("alias", "ticker", F.array_join("ws", " ").alias("name"), F.size("ws").alias("n")).filter("n > 0")
    lengths = {r.n: r.rows for r in a.groupBy("n").agg(F.count("*").alias("rows")).collect()}
    names = small_side(a.drop("n"), sum(lengths.values()), 100)
    ts = textsearch.tokens(F.col("text"))
    runs = [F.when(F.size("ts") >= n, F.transform(F.sequence(F.lit(1), F.size("ts") - n + 1), partial(_run, n))).otherwise(F.array().cast("array<string>")) for n in sorted(lengths)]
    g = _t(spark, d, "documents").select("doc_id", ts.alias("ts")).select("doc_id", F.explode(F.array_distinct(F.concat(*runs) if runs else F.array().cast("array<string>"))).alias("name"))
    return g.join(names, "name").groupBy("ticker", "alias").agg(F.countDistinct("doc_id").alias("documents"))


@query(
    """SELECT 'edge_from' check_name, count(*) broken FROM global_edge_spine e WHERE from_object_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM global_object_locator l WHERE l.object_id = e.from_object_id) UNION ALL
    SELECT 'edge_to', count(*) FROM global_edge_spine e WHERE to_object_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM global_object_locator l WHERE l.object_id = e.to_object_id) UNION ALL
    SELECT 'point_object', count(*) FROM chart_series_points p WHERE object_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM global_object_locator l WHERE l.object_id = p.object_id) UNION ALL
    SELECT 'point_series', count(*) FROM chart_series_points p WHERE NOT EXISTS (SELECT 1 FROM chart_series s WHERE s.series_key = p.series_key) UNION ALL
    SELECT 'observation_series', count(*) FROM observations o WHERE NOT EXISTS (SELECT 1 FROM series_catalog c WHERE c.series_key = o.series_key) UNION ALL
    SELECT 'bar_observation', count(*) FROM ohlcv_observations h WHERE observation_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM observations o WHERE o.observation_id = h.observation_id)"""
)
def referential_checks(spark, d):
    """Rows that refer to nothing, for each reference of the tables."""
    checks = [("edge_from", "global_edge_spine", "from_object_id", "global_object_locator", "object_id"), ("edge_to", "global_edge_spine", "to_object_id", "global_object_locator", "object_id"), ("point_object", "chart_series_points", "object_id", "global_object_locator", "object_id"), ("point_series", "chart_series_points", "series_key", "chart_series", "series_key"), ("observation_series", "observations", "series_key", "series_catalog", "series_key"), ("bar_observation", "ohlcv_observations", "observation_id", "observations", "observation_id")]
    out = None
    for name, left, a, right, b in checks:
        keys = _t(spark, d, right).select(F.col(b).alias("k")).distinct()
        one = _t(spark, d, left).select(F.col(a).alias("k")).filter("k IS NOT NULL").join(keys, "k", "left_anti").agg(F.count("*").alias("broken")).select(F.lit(name).alias("check_name"), "broken")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH o AS (SELECT ticker, substr(trade_date, 1, 7) AS month, trade_date, max(open) AS open, max(high) AS high, min(low) AS low, max(close) AS close, max(volume) AS volume FROM ohlcv_observations GROUP BY ALL)
    SELECT ticker, month, arg_min(open, trade_date) FILTER (open IS NOT NULL) AS open, max(high) AS high, min(low) AS low, arg_max(close, trade_date) FILTER (close IS NOT NULL) AS close, count(*) AS days FROM o GROUP BY 1, 2"""
)
def monthly_bars(spark, d):
    """Daily bars rolled up to months."""
    o = _t(spark, d, "ohlcv_observations").groupBy("ticker", F.substring("trade_date", 1, 7).alias("month"), "trade_date").agg(F.max("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("close").alias("close"))
    first, last = F.min(F.when(F.col("open").isNotNull(), F.struct("trade_date", "open"))), F.max(F.when(F.col("close").isNotNull(), F.struct("trade_date", "close")))
    m = o.groupBy("ticker", "month").agg(first.alias("a"), F.max("high").alias("high"), F.min("low").alias("low"), last.alias("z"), F.count("*").alias("days"))
    return m.select("ticker", "month", F.col("a.open").alias("open"), "high", "low", F.col("z.close").alias("close"), "days")


@query(
    """WITH s AS (SELECT time_bucket(INTERVAL 15 minute, ts) - to_minutes(15 * k) AS start, value FROM events, (SELECT unnest(range(4)) k)) SELECT start, start + INTERVAL 1 hour AS "end", count(*) n, round(sum(value), 4) total FROM s GROUP BY 1"""
)
def sliding_window(spark, d):
    """Events of the last hour, every quarter of an hour."""
    e = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return e.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


@query(
    """WITH x AS (SELECT DISTINCT id, ticker, lower(trim(section_name)) n, regexp_replace(lower(trim(section_name)), '[^a-z0-9]+', '', 'g') g, length(text) chars FROM mini_10k_spans), y AS (SELECT ticker, CASE g WHEN 'business' THEN 'item1' WHEN 'riskfactors' THEN 'item1a' WHEN 'mda' THEN 'item7' WHEN 'financialstatements' THEN 'item8' WHEN 'controls' THEN 'item9a' WHEN 'marketrisk' THEN 'item7a' ELSE 'item' || nullif(regexp_extract(n, '^item[ _.-]*([0-9]+[a-c]?)([^a-z]|$)', 1), '') END s, chars FROM x)
    SELECT ticker, CASE WHEN grouping(s) = 1 THEN 'all' ELSE coalesce(s, 'unknown') END section, count(*) spans, sum(chars) chars FROM y GROUP BY ticker, ROLLUP (s)"""
)
def section_sizes(spark, d):
    """Characters by company and section, and over all sections."""
    s = _t(spark, d, "mini_10k_spans").select("id", "ticker", section_key(F.col("section_name")).alias("s"), F.length("text").alias("n"), F.col("section_name").alias("spelled")).distinct()
    g = s.groupingSets([["ticker", "s"], ["ticker"]], "ticker", "s").agg(F.grouping("s").alias("g"), F.count("*").alias("spans"), F.sum("n").alias("chars"))
    return g.select("ticker", F.when(F.col("g") == 1, "all").otherwise(F.coalesce("s", F.lit("unknown"))).alias("section"), "spans", "chars")


@query()
def span_chunks(spark, d):
    """Section texts in fixed windows that end at sentences."""
    return span_windows(_t(spark, d, "mini_10k_spans"), "id", "text").distinct()


@query("SELECT DISTINCT id, length(text) AS characters, true covered, true within_limit, true overlapping FROM mini_10k_spans WHERE text <> ''")
def span_chunk_checks(spark, d):
    """What the windows of each text must hold: the whole text covered, at most 1,500 characters, each begins within the one before."""
    t = _t(spark, d, "mini_10k_spans").filter("text != ''").select("id", "text").distinct()
    # versions of a span are told apart, as windows are of one text
    c = span_windows(t.withColumn("version", F.to_json(F.struct("id", F.xxhash64("text").alias("h")))), "version", "text")
    w = Window.partitionBy("version").orderBy("position")
    c = c.withColumn("before", F.lag("stop").over(w))
    sound = F.when(F.col("position") == 0, F.col("start") == 0).otherwise((F.col("start") < F.col("before")) & (F.col("start") >= F.col("before") - 150))
    g = c.groupBy("version").agg(F.max("stop").alias("characters"), F.min("start").alias("first"), F.bool_and(F.length("part") == F.col("stop") - F.col("start")).alias("parts"), F.bool_and(F.col("stop") - F.col("start") <= 1500).alias("within_limit"), F.bool_and(sound).alias("overlapping"))
    return g.select(F.get_json_object("version", "$.id").alias("id"), "characters", ((F.col("first") == 0) & F.col("parts")).alias("covered"), "within_limit", "overlapping").distinct()


@query()
def quote_candidates(spark, d):
    """Sentences of sections, with offsets."""
    return sentence_candidates(_t(spark, d, "mini_10k_spans"), "id", "text").distinct()


@query()
def numeric_tokens(spark, d):
    """Numbers in documents: amounts, percentages and plain numbers."""
    return extract_numbers(_t(spark, d, "documents").select("doc_id", "text").distinct(), "doc_id", "text")
