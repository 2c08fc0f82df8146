import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veridant.functions.periods import frequency_code, period_day
from veridant.operators import regular_grid
from veridant.operators.regular_grid import regularize, smooth
from veridant.operators.spikes import flag_readings, is_placeholder, judge_source
from veridant.operators.units import AliasIndex, to_common_units, weighted_distance


def walk(n, seed=1, step=0.5, start=100.0):
    return start + np.cumsum(np.random.default_rng(seed).normal(0, step, n))


def test_placeholders():
    v = np.array([-999, -99999, 9999999, 999999.99, 999, 9999, -1, 99.9, 123456])
    assert is_placeholder(v).tolist() == [True, True, True, True, False, False, False, False, False]


def test_spikes_but_not_level_shifts():
    v = walk(200)
    v[50] *= 3
    v[80:82] *= 2
    v[120:] *= 2  # a lasting jump
    reason = judge_source(np.arange(200), v, "price")
    assert np.flatnonzero(reason != "").tolist() == [50, 80, 81]


def test_stuck_runs_count_periods_and_spare_the_first():
    v = walk(100)
    v[30:38] = v[30]
    v[60:65] = v[60]  # only five
    p = np.repeat(np.arange(100), 1)
    reason = judge_source(p, v, "level")
    assert np.flatnonzero(reason == "stuck").tolist() == list(range(31, 38))
    assert not (judge_source(p, v, "rate_steps") == "stuck").any()
    # revisions of one period do not lengthen a run
    p2, v2 = np.concatenate([p, [64, 64]]), np.concatenate([v, [v[60] + 0.01, v[60] + 0.02]])
    order = np.argsort(p2, kind="stable")
    assert not (judge_source(p2[order], v2[order], "level")[60:68] == "stuck").any()


def test_impossible_by_kind():
    v = walk(60)
    v[20] = -5.0
    for kind, bad in (("price", "impossible"), ("count", "impossible"), ("volume", "impossible")):
        assert judge_source(np.arange(60), v, kind)[20] == bad
    assert judge_source(np.arange(1), np.array([-1.0]), "price").tolist() == ["impossible"]


def test_flag_readings_edges(spark):
    schema = "s string, p long, v double, kind string, reason string"
    assert flag_readings(spark.createDataFrame([], schema), ["s"], "p", "v", F.col("kind")).count() == 0
    v = walk(50).tolist()
    v[25] = 1e4
    rows = [("a", i, x, "price", "clash") for i, x in enumerate(v)] + [("a", 25, 1e4, "price", "clash"), ("a", None, 1e4, "price", None), ("a", 26, None, "price", None), ("a", 27, math.nan, "price", None), (None, 1, 5.0, "price", None), ("b", 1, 5.0, None, None)]
    got = flag_readings(spark.createDataFrame(rows, schema), ["s"], "p", "v", F.col("kind")).collect()
    assert [(r.s, r.p, r.reason) for r in got] == [("a", 25, "spike")] * 2


def test_smoother_recovers_a_line_and_widens_in_gaps():
    t = np.arange(60.0)
    y = 5 + 0.5 * t
    y[20:30] = np.nan
    mean, error = smooth(t, y)
    assert np.abs(mean[20:30] - (5 + 0.5 * t[20:30])).max() < 0.3
    z = walk(60)
    z[20:30] = np.nan
    error = smooth(t, z)[1]
    assert error[25] > 1.5 * error[10]
    assert smooth(np.array([0.0, 1.0, 2.0]), np.array([np.nan, 3.0, np.nan]))[0].tolist() == pytest.approx([3.0, 3.0, 3.0])


def test_grid_marks_missing_periods(spark):
    day = lambda s: int(dt.datetime.fromisoformat(s).replace(tzinfo=dt.UTC).timestamp())
    rows = [("d", day("2024-01-05"), 1.0, "D", "1"), ("d", day("2024-01-06"), 9.0, "D", "2"), ("d", day("2024-01-10"), 2.0, "D", None), ("m", day("2024-01-31"), 1.0, "M", None), ("m", day("2024-04-02"), 2.0, "M", None), ("x", day("2024-01-01"), None, "M", None), ("one", day("2024-01-01"), 1.0, "Q", None), (None, 1, 1.0, "D", None), ("n", 1, math.nan, "D", None)]
    df = spark.createDataFrame(rows, "s string, sec long, v double, code string, known string")
    got = regularize(df, "s", "sec", "v", "code", "known").collect()
    missing = sorted((r.s, str(r.period_start)) for r in got if r.missing)
    assert missing == [("d", "2024-01-08"), ("d", "2024-01-09"), ("m", "2024-02-01"), ("m", "2024-03-01")]
    # the weekend reading belongs to its Friday and came later
    assert next(r.reading for r in got if r.s == "d" and str(r.period_start) == "2024-01-05") == 9.0
    assert all(r.filled is not None and r.std_error >= 0 for r in got)
    assert regularize(df.limit(0), "s", "sec", "v", "code", "known").count() == 0


def test_frequencies_and_periods(spark):
    words = {"daily": "D", "business daily": "D", "DAILY": "D", "wk": "W", "W": "W", "month": "M", "M": "M", "qtr": "Q", "Quarterly": "Q", "annual": None, None: None, "": None}
    df = spark.createDataFrame([(w,) for w in words], "f string")
    assert {r.f: r.c for r in df.select("f", frequency_code(F.col("f")).alias("c")).collect()} == words
    sec = spark.createDataFrame([(1704585600,)], "s long")  # Sunday 2024-01-07
    got = sec.select(*[period_day(F.col("s"), F.lit(c)).cast("string").alias(c) for c in "DWMQ"]).first()
    assert tuple(got) == ("2024-01-05", "2024-01-01", "2024-01-01", "2024-01-01")


def test_alias_index_meanings():
    ix = AliasIndex()
    want = {"US$ thousands": ("usd", 3), "$ in billions": ("usd", 9), "INR crore": ("inr", 7), "mn shs": ("shares", 6), "employees (k)": ("employees", 3), "USD (000s)": ("usd", 3), "fraction": ("percent", 2), "basis points": ("percent", -2), "kWh": ("energy", -3), "EUR milions": ("eur", 6), "thosand shares": ("shares", 3), "Perecnt": ("percent", 0)}
    assert {k: ix.meaning(k)[:2] for k in want} == want
    assert ix.meaning("") == (None, None, False, None)
    assert ix.meaning("zorkmids")[2] is False
    assert weighted_distance("million", "milion") < weighted_distance("million", "billion")


def test_common_units(spark):
    rows = [(1, 12.5, "$12,500k", "USD"), (2, 12.5, None, "USD mm"), (3, 0.4, "4000 bps", "percent"), (4, 12.5, "12.5", "EUR thousand"), (5, 5.0, None, None), (6, None, "$5M", "USD"), (7, 0.0, "$0.00B", "USD mm"), (8, 1500.0, "USD 1,500", "USD mm"), (9, 2.0, "", ""), (2, 12.5, None, "USD mm")]
    df = spark.createDataFrame(rows, "id int, value double, formatted string, unit string").withColumn("exp10", F.lit("clash"))
    got = sorted(((r.id, r.exp10, r.unit_evidence) for r in to_common_units(df, "value", "formatted", "unit").collect()), key=repr)
    assert got == sorted([(1, 6, "text"), (2, 6, "unit"), (2, 6, "unit"), (3, 2, "text"), (4, 3, "unit"), (5, None, "none"), (6, None, "none"), (7, 6, "unit"), (8, 0, "text"), (9, None, "none")], key=repr)
    assert to_common_units(df.limit(0), "value", "formatted", "unit").count() == 0


def test_long_sources_come_in_pieces_with_the_same_grid(monkeypatch):
    rng = np.random.default_rng(3)
    days = np.sort(rng.choice(np.arange(18000, 19500), 900, replace=False))
    sec = np.repeat(days, 2) * 86400.0 + np.tile([3600.0, 40000.0], 900)
    value = 100 + 10 * np.sin(sec / 5e6) + rng.normal(size=1800) * 0.05
    day = pd.to_datetime(np.repeat(days, 2), unit="D").date
    long = pd.DataFrame({"source": "a", "code": "D", "day": day, "sec": sec, "prefer": None, "value": value})
    # a reading of a weekend belongs to its Friday
    long["day"] = [d - dt.timedelta(days=max(d.weekday() - 4, 0)) for d in long["day"]]
    short = long.iloc[:7].assign(source="b")
    rows = pd.concat([long, short], ignore_index=True)
    whole = regular_grid.fill_sources(rows.assign(low=None, high=None))
    monkeypatch.setattr(regular_grid, "LONG_SOURCE", 500)
    monkeypatch.setattr(regular_grid, "OVERLAP", 120)
    pieces = list(regular_grid._whole_sources(rows.iloc[i : i + 100] for i in range(0, len(rows), 100)))
    assert len(pieces) > 4 and max(map(len, pieces)) < 700
    got = pd.concat([regular_grid.fill_sources(p) for p in pieces], ignore_index=True)
    assert got[["source", "period_start", "missing"]].equals(whole[["source", "period_start", "missing"]])
    assert np.array_equal(got["reading"], whole["reading"], equal_nan=True)
    # pieces choose their split of the variance apart, so fills differ by little, far less than the series moves
    assert np.abs(got["smoothed"] - whole["smoothed"]).max() < 0.5
