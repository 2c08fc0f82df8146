import json

import pytest
from pyspark.sql import functions as F

from veridant.functions.numbers import extract_numbers, numeric_tokens, unsupported_numbers
from veridant.functions.spans import windows
from veridant.functions.text_units import compact_number, period_sort_key, section_key, valid_period
from veridant.operators import graph, links, ranking, relational
from veridant.plans.search_plan import Clause, Engine, SearchPlan
from veridant.sources import markup, readers
from veridant.streaming import pipelines


def test_jsonl_round_trip_and_missing_file(spark, tmp_path):
    schema = "id string, n int, tags array<string>"
    assert readers.read_jsonl(spark, str(tmp_path / "none"), schema).count() == 0
    df = spark.createDataFrame([("ä", 1, ["x"]), ("b", None, [])], schema)
    readers.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(map(str, readers.read_jsonl(spark, str(tmp_path / "out"), schema).collect())) == sorted(map(str, df.collect()))
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed|bad record"):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema).collect()


def test_provider_payloads(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"observations": [{"date": "2024-01-01", "value": "1.5", "vintage": "2024-02-01"}, {"date": "2024-02-01", "value": "."}, {"date": "2024-03-01", "value": "2"}]}))
    m = spark.read.schema(readers.MACRO_PAYLOAD).json(str(tmp_path / "m.json")).withColumn("k", F.lit("cpi"))
    assert [(r.phenomenon_time, r.value) for r in readers.macro_observations(m, "k", end="2024-02-15").collect()] == [("2024-01-01", 1.5)]
    (tmp_path / "a.json").write_text(json.dumps({"ticker": "T", "results": [{"t": 1704153600000, "c": 2.0}]}))
    a = spark.read.schema(readers.AGGREGATES_PAYLOAD).json(str(tmp_path / "a.json"))
    assert str(readers.aggregate_bars(a).first().trade_date) == "2024-01-02"
    (tmp_path / "b.json").write_text(json.dumps({"symbol": "S", "historical": [{"date": "2024-01-02", "close": 3.0, "changePercent": 1.0}]}))
    assert readers.daily_bars(spark.read.schema(readers.BARS_PAYLOAD).json(str(tmp_path / "b.json"))).first().changepercent == 1.0
    v = spark.createDataFrame([("1.5",), (".",), ("NaN",), (None,), ("x",)], "v string").select(readers.safe_number(F.col("v")).alias("n"))
    assert [r.n for r in v.collect()] == [1.5, None, None, None, None]


def test_html_and_inline_facts(spark):
    html = """<html><head><style>x{}</style></head><body><nav>skip</nav><h1>Item 1. Business</h1><p>We sell <b>pumps</b>.<a href="/x">more</a></p><table><tr><th>Item</th><th>2024</th></tr><tr><td>Sales</td><td>5</td></tr></table>
    <xbrli:context id="c1"><startDate>2024-01-01</startDate><endDate>2024-12-31</endDate><xbrldi:explicitMember dimension="seg">pumps</xbrldi:explicitMember></xbrli:context>
    <ix:nonFraction name="us-gaap:Revenues" contextRef="c1" unitRef="usd" scale="6">(1,250.5)</ix:nonFraction></body></html>"""
    pages = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    got = {r.id: r for r in markup.clean_pages(pages, "id", "html").collect()}
    assert got[1].markdown.startswith("# Item 1. Business\n\nWe sell pumps.more") and "| Sales | 5 |" in got[1].markdown and got[1].links == ["/x"] and "skip" not in got[1].markdown
    assert got[2].markdown == ""
    f = markup.xbrl_facts(pages, "id", "html").collect()
    assert [(r.tag, r.value, r.duration_days, r.dimensions) for r in f] == [("us-gaap:Revenues", -1250.5e6, 366, ["seg=pumps"])]


def test_numbers_and_their_support(spark):
    assert [(k, v) for k, v, _ in numeric_tokens("In fiscal 2024 revenue rose 12.5% to $1.2 billion, a loss of (3,400) units, per Item 7.")] == [("percent", 12.5), ("amount", 1.2e9), ("number", -3400.0)]
    need = extract_numbers(spark.createDataFrame([(1, "Sales were $5.0 million, up 10%.")], "id int, t string"), "id", "t")
    have = spark.createDataFrame([(1, "amount", 5.02e6), (1, "percent", 12.0)], "id int, kind string, value double")
    assert [(r.kind, r.value) for r in unsupported_numbers(need, have, ["id"]).collect()] == [("percent", 10.0)]


def test_windows_cover_the_text():
    text = "A sentence of some length here. " * 120
    w = windows(text)
    assert w[0][0] == 0 and w[-1][1] == len(text) and all(b - a <= 1500 for a, b in w)
    assert all(y[0] <= x[1] for x, y in zip(w, w[1:], strict=False))
    assert windows("") == [] and windows("short") == [(0, 5)]


def test_labels(spark):
    df = spark.createDataFrame([("FY2024",), ("CY2024Q3",), ("CY2024M03",), ("CY2024Q5",), (None,)], "p string")
    assert [(r.k, r.v) for r in df.select(period_sort_key(F.col("p")).alias("k"), valid_period(F.col("p")).alias("v")).collect()] == [(20245, True), (20243, True), (202403, True), (None, False), (None, False)]
    names = spark.createDataFrame([("Item 1A",), ("ITEM 1A.",), ("item_7a",), ("Risk Factors",), ("MD&A",), ("Item 1. Business",), ("nothing",), (None,)], "s string")
    assert [r.k for r in names.select(section_key(F.col("s")).alias("k")).collect()] == ["item1a", "item1a", "item7a", "item1a", "item7", "item1", None, None]
    n = spark.createDataFrame([(1.25e9, "USD"), (12.0, "percent"), (5.0, "shares")], "v double, u string")
    assert [r.c for r in n.select(compact_number(F.col("v"), F.col("u")).alias("c")).collect()] == ["$1.3B", "12.0%", "5.00 shares"]


def test_prefix_bounds_and_empty_scope(spark):
    df = spark.createDataFrame([("metric:a",), ("metrid",), ("metric",)], "k string")
    assert [r.k for r in relational.prefix_scan(df, "k", "metric:").collect()] == ["metric:a"]
    assert relational.scope_filter(df, k=[]).count() == 3
    assert [r.k for r in relational.ordered_lookup(df, "k", ["metrid", "metric:a"]).orderBy("position").collect()] == ["metrid", "metric:a"]


def test_best_first_and_paths(spark):
    e = spark.createDataFrame([("a", "b", 0.9, "r"), ("b", "c", 0.9, "r"), ("a", "c", 0.5, "r"), ("c", "a", 1.0, "r"), ("c", "d", 0.1, "s")], "s string, t string, w double, rel string")
    found = graph.best_first(e, "s", "t", "w", "a")
    assert [p for _, p in found] == [["a", "b"], ["a", "b", "c"], ["a", "c"], ["a", "b", "c", "d"], ["a", "c", "d"]]
    assert [r.path for r in graph.paths_from(e, "s", "t", "rel", ["a"], 2).collect()] == [["a", "b"], ["a", "c"], ["a", "b", "c"], ["a", "c", "d"]]


def test_link_caps(spark):
    rows = [("a", "b", 1.0 - i / 100) for i in range(12)] + [("a", f"x{i}", 0.5 - i / 1000) for i in range(10)]
    got = links.cap_links(spark.createDataFrame(rows, "p string, q string, w double"), "p", "q", "w", per_pair=8, per_node=10).collect()
    assert len(got) == 10 and sum(r.q == "b" for r in got) == 8 and sorted(r.q for r in got if r.q != "b") == ["x0", "x1"]


def test_round_robin_and_ladder(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 2.0), ("b", 3, 1.0)], "g string, i int, s double")
    assert [r.i for r in ranking.round_robin(df, "g", [F.col("s").desc()], 2).collect()] == [1, 3]
    rungs = ranking.first_rung([df.filter("i = 1"), df], "i", "s").orderBy("i").collect()
    assert [(r.i, r.rung) for r in rungs] == [(1, 0), (2, 1), (3, 1)]


def test_search_plan(spark, data_dir):
    engine = Engine(spark, data_dir)
    plan = SearchPlan((Clause("c1", ("revenue", "segment")), Clause("c2", ("zzzz",))), limit=5)
    got = engine.execute(plan).collect()
    assert 0 < len(got) <= 5 and {r.clause_id for r in got} == {"c1"}
    assert {r.clause_id: r.coverage for r in engine.coverage(plan).collect()}["c2"] == "missing"
    assert engine.catalog().count() > 0 and engine.quality().count() > 0 and engine.query(["revenue"]).count() > 0 and engine.index_context().count() > 0


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "2024-01-01 00:00:10", "a", 1.0), (2, "2024-01-01 00:10:00", "a", 2.0), (2, "2024-01-01 00:10:00", "a", 2.0), (3, "2024-01-01 02:00:00", "b", 3.0)]
    schema = "id int, t string, k string, value double"
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("t").cast("timestamp")).drop("t").write.parquet(src)
    stream = pipelines.read_landing(spark, src, "id int, k string, value double, ts timestamp")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    w = run(pipelines.windowed_counts(stream, "ts", "k", "1 hour", "10 minutes"), "w1", "complete")
    assert sorted((r.k, r.n) for r in w.collect()) == [("a", 3), ("b", 1)]
    s = run(pipelines.sessions(stream, "ts", "k", "30 minutes", "10 minutes"), "s1", "append")
    assert sorted((r.k, r.n) for r in s.collect()) == [("a", 3)]
    assert run(pipelines.first_deliveries(stream, "ts", "id", "3 hours"), "d1", "append").count() == 3


def test_upsert_is_repeatable(spark, tmp_path):
    target = str(tmp_path / "t")
    merge = pipelines.upsert_latest(target, ["k"], ["seq"])
    one = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, seq int, v string")
    two = spark.createDataFrame([("a", 2, "z"), ("b", 0, "old")], "k string, seq int, v string")
    merge(one, 0)
    merge(two, 1)
    merge(two, 1)
    assert sorted(map(tuple, spark.read.parquet(f"{target}/1").collect())) == [("a", 2, "z"), ("b", 1, "y")]
