"""Control files, artifacts, planner and endpoints."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from veridant.functions import document_nodes, lexical, text_units
from veridant.operators import links, metrics, routing, search_index, spine
from veridant.operators.search_index import SearchIndex
from veridant.plans.planner import Retriever, RulePlanner, answerability
from veridant.plans.search_plan import Clause, Engine, SearchPlan
from veridant.sources import artifacts, files, readers


def test_atomic_and_bounded(tmp_path):
    p = str(tmp_path / "a" / "x.json")
    files.atomic_write_json(p, {"ä": 1})
    assert json.load(open(p)) == {"ä": 1} and "ä" in open(p).read()
    assert os.listdir(tmp_path / "a") == ["x.json"]
    assert files.read_bounded(io.BytesIO(b"abc"), 3) == b"abc"
    with pytest.raises(ValueError):
        files.read_bounded(io.BytesIO(b"abcd"), 3)


def test_structured_output():
    assert files.parse_structured('{"a": 1}') == {"a": 1}
    assert files.parse_structured('Here:\n```json\n[1, 2]\n```\nthat is all') == [1, 2]
    assert files.parse_structured('so it is {"a": {"b": 2}} indeed') == {"a": {"b": 2}}
    with pytest.raises(ValueError):
        files.parse_structured("nothing here {")


def test_checkpoint_goes_on_and_survives_a_broken_file(tmp_path):
    p = str(tmp_path / "c.json")
    ran = []
    c = files.StageCheckpoint(p)
    with pytest.raises(RuntimeError):
        c.run([("one", lambda: ran.append(1)), ("two", lambda: (_ for _ in ()).throw(RuntimeError()))])
    assert files.StageCheckpoint(p).run([("one", lambda: ran.append(1)), ("two", lambda: {"rows": 2})]) == ["two"] and ran == [1]
    open(p, "w").write("{")
    assert not files.StageCheckpoint(p).is_complete("one")


def test_queue_claims_retries_and_recovers(tmp_path):
    q = files.JobQueue(str(tmp_path), max_attempts=2)
    assert q.put(files.Job("b")) and q.put(files.Job("a")) and not q.put(files.Job("a"))
    job = q.claim()
    assert job.job_id == "a" and q.jobs("running")[0].job_id == "a"
    q.finish(job, "broken")
    job = q.claim()
    assert job.job_id == "a" and job.attempts == 2
    q.finish(job, "broken again")
    assert [j.job_id for j in q.jobs("failed")] == ["a"]
    job = q.claim()
    assert q.recover(-1) == 1 and q.claim().job_id == "b" and q.claim() is None
    q.finish(q.jobs("running")[0])
    assert [j.job_id for j in q.jobs("done")] == ["b"]


def test_batches_are_kept_and_in_order(tmp_path):
    calls = []
    work = lambda b: calls.append(b) or [x * 2 for x in b]
    assert files.run_batches(work, range(5), 2, 3, str(tmp_path)) == [[0, 2], [4, 6], [8]]
    assert files.run_batches(work, range(5), 2, 3, str(tmp_path)) == [[0, 2], [4, 6], [8]] and len(calls) == 3
    names = set(os.listdir(tmp_path))
    keep = sorted(names)[0]
    assert files.collect_garbage(str(tmp_path), {keep}, dry_run=True) == sorted(names - {keep}) and len(os.listdir(tmp_path)) == 3
    files.collect_garbage(str(tmp_path), {keep})
    assert os.listdir(tmp_path) == [keep]
    s = files.seal(str(tmp_path / keep))
    assert files.seal_holds(str(tmp_path / keep), s)
    (tmp_path / keep).write_text("changed")
    assert not files.seal_holds(str(tmp_path / keep), s)
    r = files.RecentResults(2)
    assert [r.get(k, lambda k=k: k) for k in "aba"] == ["a", "b", "a"] and r.get("c", lambda: "c") == "c" and list(r.held) == ["a", "c"]


def test_artifacts(spark):
    o = spark.createDataFrame(
        [("c1", "ResearchClaim", None, "said", ["q1", "gone", "q1"], None), ("q1", "EvidenceQuote", "rejected", None, None, None), (None, "x", None, None, None, None), ("f1", "FactorExposure", None, "", ["q1"], ["c1"])],
        "id string, type string, review_status string, text string, supported_by_quotes array<string>, supported_by_claims array<string>",
    ).withColumns({"claim_text": F.lit(None).cast("string"), "quote_text": F.when(F.col("id") == "q1", "a quote"), "description": F.lit(" "), "source_fact_ids": F.lit(None).cast("array<string>"), "source_metric_ids": F.lit(None).cast("array<string>")})
    rows = {r.id: (r.searchable, r.rejected) for r in artifacts.object_rows(o).collect()}
    assert rows == {"c1": ("said", False), "q1": ("a quote", True), "f1": ("", False)}
    assert sorted(map(tuple, artifacts.support_links(o).collect())) == [("c1", "q1", "quote"), ("f1", "c1", "claim"), ("f1", "q1", "quote")]
    a = spark.createDataFrame([("k", 1), ("l", 1)], "key string, v int")
    b = spark.createDataFrame([("k", 0)], "key string, v int")
    assert sorted(map(tuple, artifacts.merged_fragments([a, b], ["key"]).collect())) == [("k", 0), ("l", 1)]


def test_filings_and_tickers(spark):
    f = spark.createDataFrame([("1", "10-Q", "a", "2024-06-30", "2024-08-01", "u"), ("1", "10-Q", "b", None, "2024-11-02", "u"), ("1", "10-K", "c", "", "bad", "u")], artifacts.FILING_SCHEMA)
    assert {r.accession: r.period for r in artifacts.filings_of(f, "1", []).collect()} == {"a": "CY2024Q2", "b": "CY2024Q4", "c": "CYunknown"}
    assert artifacts.chosen_filing(f, "10-Q").first().accession == "b" and artifacts.chosen_filing(f, "10-Q", "CY2024Q2").first().accession == "a"
    d = spark.createDataFrame([("abc", 12), ("ABC", 12)], "ticker string, cik int")
    got = {r.ticker: r.cik for r in artifacts.resolve_tickers(spark.createDataFrame([(" abc",), ("zz",), (None,)], "ticker string"), d).collect()}
    assert got == {" abc": "0000000012", "zz": None, None: None}
    with pytest.raises(ValueError):
        artifacts.series_dimension(spark, [{"series_key": "a", "frequency": "hourly"}])
    assert artifacts.series_dimension(spark, [{"series_key": "a", "frequency": "daily"}]).count() == 1
    now = spark.createDataFrame([("t", "x", "1"), ("t", "y", "2"), ("u", "z", "3")], "ticker string, path string, digest string")
    then = spark.createDataFrame([("t", "x", "0"), ("t", "w", "9"), ("u", "z", "3")], "ticker string, path string, digest string")
    assert [tuple(r) for r in artifacts.stale_items(now, then, "ticker", "digest").collect()] == [("t", 1, 1, 1)]


def test_planner_and_endpoints(spark, data_dir):
    plan = RulePlanner().plan("Compare the latest revenue of ECMZ versus Harwyn Foods in FY2022 10-K filings", {"ECMZ": "Drafenlum Industries", "HUBQ": "Harwyn Foods", "ZZZZ": None})
    assert (plan.intent, plan.tickers, plan.metric, plan.periods, plan.document_types, plan.period_policy) == ("compare", ("ECMZ", "HUBQ"), "revenue", ("FY2022",), ("10-K",), "latest")
    engine = Engine(spark, data_dir)
    r = Retriever(engine)
    some = sorted(r.companies())[0]
    p, rows = r.retrieve(f"revenue of {some}")
    assert p.metric == "revenue" and rows.count() >= 0 and {x.ticker for x in rows.select("ticker").distinct().collect()} <= {some}
    p, rows = r.retrieve("capacity constraints of freight")
    assert p.intent == "search" and rows.count() > 0
    oid = engine._t("global_edge_spine").filter("relation_type = 'supports' AND to_object_id LIKE 'metric:%'").first().to_object_id
    assert engine.chain(oid).count() > 0 and engine.topic_map(some).count() > 0 and engine.list_documents([some]).count() > 0
    assert engine.bundle(oid).count() <= 1
    q = spark.createDataFrame([("nope", "x")], "span_id string, quote string")
    assert engine.verify_evidence(q).first().match == "no_source"
    c = lambda *rows: answerability(spark.createDataFrame(list(rows), "required boolean, coverage string")).first().answer
    assert c((True, "covered"), (False, "missing")) == "answerable" and c((True, "partial"), (True, "missing")) == "partial" and c((True, "missing"),) == "not_answerable"


def test_index_is_written_by_bucket_and_pruned(spark, tmp_path):
    o = spark.createDataFrame([("a", "Café freight demand", "X"), ("b", "cafe", "Y"), ("c", None, "X"), (None, "freight", "X"), ("d", "", None)], "id string, label string, ticker string")
    index = SearchIndex.build(o, "id", ["label"], {"ticker": "ticker"})
    index.write(str(tmp_path))
    read = SearchIndex.open(spark, str(tmp_path))
    assert {r.doc for r in read.bm25(["cafe"]).collect()} == {"a", "b"}
    assert {r.doc for r in read.bm25(["cafe"], scope=lexical.scope_tokens(ticker="X")).collect()} == {"a"}
    assert {r.doc for r in read.bm25(["caf", "frei"], mode="and").collect()} == {"a"}
    assert read.bm25([]).count() == 0
    assert read.totals.first().objects == 4
    plan = read.hits(["cafe"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    got = [(r.doc, r.rung) for r in read.ladder("freight demand cost", 10).orderBy("rung", "doc").collect()]
    assert got == [("a", 2)]


def test_buckets_of_terms_are_those_of_the_engine(spark, monkeypatch):
    terms = ["", "a", "ab", "freight", "éclair", "東京都", "10", "zz9"]
    ours = [search_index._literal_bucket(spark, t) for t in terms]
    monkeypatch.setattr(search_index, "xxhash", None)
    assert ours == [search_index._literal_bucket(spark, t) for t in terms]


def test_words_of_questions():
    assert lexical.python_words("Straße, CAFÉ 10-K") == ["strasse", "cafe", "10", "k"]
    assert lexical.prefix_terms("the rising costs of buses and sales series") == ["rising", "cost", "buse", "sales", "series"]
    assert lexical.split_queries("gross_margin of retail stores", 4) == [["gross", "margin"], ["margin", "retail"], ["retail", "stores"], ["gross"]]


def test_folding_matches_python(spark):
    texts = ["Straße ÀÉÎõü Ñandú", "ﬁne", "Ｆｕｌｌ", "naïve Œuvre", None, "東京 tower", "éclair"]
    got = [r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select(lexical.words(F.col("t")).alias("w")).collect()]
    assert got[0] == ["strasse", "aeiou", "nandu"] and got[2] == ["full"] and got[4] == [] and got[5] == ["東京", "tower"] and got[6] == ["eclair"]


def test_bundles_coverage_and_reservation(spark):
    p = spark.createDataFrame(
        [("A", 2021, None, "FY2021", 1.0, 1, "x"), ("A", 2022, None, "FY2022", 2.0, 1, "y"), ("A", 2020, None, "FY2020", 5.0, 1, "v"), ("B", 2022, None, "FY2022", 1.0, 1, "p"), ("B", 2022, None, "FY2022", 3.0, 2, "q"), ("C", 2020, None, "FY2020", 1.0, 1, "r"), ("C", 2022, None, "FY2022", None, 1, "s"), ("C", 2022, None, "FY2022", 4.0, 1, "t")],
        "s string, fiscal_year int, fiscal_quarter int, period string, value double, source_sort_key int, object_id string",
    )
    got = sorted((r.s, r.bundle, r.position, r.period, r.value) for r in metrics.metric_bundles(p, ["s"], "year_over_year").collect())
    assert got == [("A", "pair", 0, "FY2022", 2.0), ("A", "pair", 1, "FY2021", 1.0), ("B", "conflict", 0, "FY2022", 1.0), ("B", "conflict", 1, "FY2022", 3.0), ("C", "latest", 0, "FY2022", 4.0), ("C", "latest", 1, "FY2020", 1.0)]
    assert metrics.metric_bundles(p.limit(0), ["s"]).count() == 0
    rows = spark.createDataFrame([(i, "P" if i in (1, 8, 9) else "Q" if i == 7 else "Z") for i in range(1, 10)], "rank int, period string")
    kept = metrics.reserve_periods(rows, ["P", "Q"], "period", "rank", 4).collect()
    assert sorted((r.rank, r.reserved) for r in kept) == [(1, False), (2, False), (7, True), (8, True)]
    assert sorted(r.rank for r in metrics.reserve_periods(rows.filter("period != 'Q'"), ["P", "Q"], "period", "rank", 4).collect()) == [1, 2, 3, 4]


def test_link_caps_equal_greedy_selection(spark):
    import random

    rng = random.Random(5)
    rows = [(f"n{rng.randrange(6)}", f"m{rng.randrange(8)}", round(rng.random(), 2)) for _ in range(300)]
    want, used, pairs = [], {}, {}
    for a, b, w in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        pairs[a, b] = pairs.get((a, b), 0) + 1
        if pairs[a, b] <= 3 and used.get(a, 0) < 9 and used.get(b, 0) < 9:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            want.append((a, b, w))
    got = links.cap_links(spark.createDataFrame(rows, "a string, b string, w double"), "a", "b", "w", per_pair=3, per_node=9)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_scores_matches_and_hashes(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first().v
    assert v(spine.grade_score(F.lit(None).cast("string"))) == 0.58 and v(spine.grade_score(F.lit(" Direct"))) == 1.0
    status, worth = spine.period_alignment(F.lit("FY2020"), F.lit("CY2024Q1"))
    assert (v(status), v(worth)) == ("stale_period_gap", 0.55)
    n = F.lit(None).cast("double")
    assert v(spine.association_score(n, n, F.lit(None).cast("string"), n, F.lit(1.0))) == pytest.approx(round((0.25 * 0.55 + 0.2 * 0.58) * 0.88, 6))
    assert v(spine.quote_match(F.lit("a  b"), F.lit("x a b"))) == "normalized" and v(spine.quote_match(F.lit(""), F.lit("x"))) == "empty"
    assert v(spine.scoped_local_id(F.lit("T"), F.lit("q:T:1"))) == "q:T:1" and v(spine.scoped_local_id(F.lit("T"), F.lit("q"))) == "scoped:T:q"
    assert v(spine.semantic_hash(F.lit("a"), F.lit(None).cast("string"))) != v(spine.semantic_hash(F.lit(None).cast("string"), F.lit("a")))
    made = spine.derived_percentages(F.array(F.lit(100.0), F.lit(110.0), F.lit(0.0)))
    assert v(spine.percent_supported(F.lit(10.0), made)) and v(spine.percent_supported(F.lit(90.9), made)) and not v(spine.percent_supported(F.lit(55.0), made))
    assert v(spine.amount_supported(F.lit(30.0), F.array(F.lit(10.0), F.lit(20.0)))) and not v(spine.amount_supported(F.lit(20.0), F.array(F.lit(10.0))))
    assert routing.term_pairs({"a": 2.0, "b": 3.0, "c": 1.0}) == [("a", "b")]


def test_nodes_and_heading_candidates(spark):
    text = "# Report\n\nPART I\nItem 1. Business\nWe make things.\n| a | b |\n- one\nItem 7A. Market risk 45\nPART II\nItem 8. Statements"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "plain")], "id int, text string")
    n = document_nodes.document_nodes(df, "id", "text")
    got = {(r.doc, r.node): r.kind for r in n.collect()}
    assert [got[1, i] for i in (0, 2, 3, 4, 5, 6, 7, 8, 9)] == ["heading", "heading", "heading", "paragraph", "table", "list", "heading", "heading", "heading"] and got[4, 0] == "paragraph" and len(got) == 10
    c = {r.item: (r.part, r.score) for r in document_nodes.heading_candidates(n).filter("item IS NOT NULL").collect()}
    assert c == {"1": ("i", 75), "7a": ("i", 50), "8": ("ii", 75)}


def test_research_state_and_scope(spark, data_dir):
    engine = Engine(spark, data_dir)
    plan = SearchPlan((Clause("a", ("revenue",)), Clause("b", ("zzzz",))), limit=5)
    state = engine.research_state(plan)
    assert state["answer"].first().answer == "partial" and state["candidates"].count() <= 5
    assert engine.has_scope() and not engine.has_scope(ticker=["nobody"])
    assert engine.quality_events(status="fail").filter("status != 'fail'").count() == 0


def test_contexts_dimensions_and_ratios(spark):
    c = spark.createDataFrame([("2023-01-01", "2023-12-31", None), ("2022-07-01", "2023-06-30", None), ("2023-01-01", "2023-03-31", None), (None, None, "2023-12-31"), (None, "bad", None)], "a string, b string, i string")
    got = [(r.p.period_type, r.p.days, r.p.fiscal_year, r.d) for r in c.select(text_units.context_period(F.col("a"), F.col("b"), F.col("i")).alias("p"), text_units.derived_period(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [("annual", 365, 2023, "CY2023"), ("annual", 365, 2023, "FY2023"), ("quarter", 90, 2023, "FY2023"), ("instant", 1, 2023, None), (None, None, None, None)]
    j = spark.createDataFrame([('{"us-gaap:SegmentAxis": "x:EuropeMember", "b": null}',), ("{}",), (None,), ("no json",)], "j string")
    assert [r.m for r in j.select(text_units.dimension_map(F.col("j")).alias("m")).collect()] == [{"Segment": "Europe"}, None, None, None]
    t = spark.createDataFrame([("Revenue in the Europe North segment rose",), ("nothing",), (None,)], "t string")
    assert [r.d for r in t.select(text_units.dimension_from_text(F.col("t")).alias("d")).collect()] == ["Europe North", None, None]
    assert lexical.metric_question("What was the revenues growth of FY2023 in Europe stores 2024?") == "revenue growth europe store" and lexical.dimension_anchors("revenue of European stores in 2024") == ["european", "store"]
    p = spark.createDataFrame([("A", [("2024-03-31", "Q1", {"pe": 2.0, "pb": None, "x": float("nan")})])], readers.RATIOS_PAYLOAD)
    assert [(r.canonical_metric, r.value) for r in readers.quarterly_ratios(p).collect()] == [("pe", 2.0)] and readers.quarterly_ratios(p, ["pb"]).count() == 0
    f = spark.createDataFrame([("f", "a.htm", "<p>"), ("f", "b.htm", "<ix:nonFraction><ix:nonNumeric>"), ("f", "c.htm", "<ix:nonfraction>"), ("g", "d.htm", None)], "filing string, path string, content string")
    assert [tuple(r) for r in readers.inline_sources(f, "filing", "path", "content").collect()] == [("f", "b.htm", 2)]
