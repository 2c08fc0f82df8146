import pandas as pd
import pytest
from pyspark.sql import functions as F

from veridant.functions.timeparse import parse_instant, utc_text
from veridant.operators.timestamps import fit_format_mixture, resolve_times

CASES = {
    "2024-01-02": "2024-01-02T00:00:00Z",
    "2024-01-02T03:04:05Z": "2024-01-02T03:04:05Z",
    "2024-01-02T03:49": "2024-01-02T08:49:00Z",
    "20220108T000000Z": "2022-01-08T00:00:00Z",
    "01/08/2023": "2023-01-08T00:00:00Z",
    "02/08/2024 4:00:00 PM": "2024-02-08T21:00:00Z",
    "01/23/2025 12:43:44 AM": "2025-01-23T05:43:44Z",
    "16 May 2022 16:00:00": "2022-05-16T20:00:00Z",
    "Wed, 31 Aug 2022 00:00:00 GMT": "2022-08-31T00:00:00Z",
    "2022-04-22T16:58:14.000000001Z": "2022-04-22T16:58:14Z",
    "2022-01-19 17:18:22 EST": "2022-01-19T22:18:22Z",
    "2022-02-24 16:09:14 Europe/Berlin": "2022-02-24T15:09:14Z",
    "2016-02-10 19:00:00 America/New_York": "2016-02-11T00:00:00Z",
    "2022-01-31T00:40:05-0500": "2022-01-31T05:40:05Z",
    "2023-11-28T18:34:48-05:30": "2023-11-29T00:04:48Z",
    "1641829420000": "2022-01-10T15:43:40Z",
    "1647033196": "2022-03-11T21:13:16Z",
    "Apr 14, 2025": "2025-04-14T00:00:00Z",
    "31.12.2023": "2023-12-31T00:00:00Z",
    "2024-03-10 02:30:00": "2024-03-10T07:30:00Z",  # skipped hour
    "2024-11-03 01:30:00": "2024-11-03T05:30:00Z",  # doubled hour
    "20240414": "2024-04-14T00:00:00Z",
    **dict.fromkeys(["2024-13-45", "9999-12-31", "0", "-1", "", "n/a", "2024-02-30", "2024-01-02 24:00:00", "13/13/2023", "2024-01-02 10:00:00 Foo/Bar", "x" * 100000]),
}


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_written_forms_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(k,) for k in [*CASES, None]], "x string")
        got = {r.x: r.u for r in parse_instant(df, F.col("x"), F.lit("America/New_York"), "s").select("x", utc_text(F.col("s")).alias("u")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {**CASES, None: None}


def test_mixture_picks_units_by_their_source():
    counts = pd.DataFrame({"source": "a", "signature": ["epoch_ms@2022|epoch_us@1970", "epoch_ms@1970|epoch_s@2022"], "n": [90, 10]})
    chosen = dict(fit_format_mixture(counts)[["signature", "chosen"]].values)
    assert chosen == {"epoch_ms@2022|epoch_us@1970": "epoch_ms", "epoch_ms@1970|epoch_s@2022": "epoch_s"}


def test_slash_dates_follow_their_source_or_stay_ambiguous(spark):
    rows = [("eu", f"{d}/01/2024") for d in range(13, 29)] + [("eu", "02/03/2024")] + [("us", f"01/{d}/2024") for d in range(13, 29)] + [("us", "02/03/2024")] + [("mixed", "13/01/2024"), ("mixed", "01/13/2024"), ("mixed", "02/03/2024")]
    got = {(r.source, r.t): (r.utc_time, r.time_ambiguous) for r in resolve_times(spark.createDataFrame(rows, "source string, t string"), "source", "t").collect()}
    assert got[("eu", "02/03/2024")] == ("2024-03-02T00:00:00Z", False)
    assert got[("us", "02/03/2024")] == ("2024-02-03T00:00:00Z", False)
    assert got[("mixed", "02/03/2024")][1] is True
    assert got[("eu", "13/01/2024")][0] == "2024-01-13T00:00:00Z"


def test_empty_null_repeated_and_clashing_columns(spark):
    schema = "source string, t string, utc_time string, extra int"
    assert resolve_times(spark.createDataFrame([], schema), "source", "t").count() == 0
    df = spark.createDataFrame([("a", "2024-01-02", "old", 1), ("a", "2024-01-02", "old", 1), (None, None, "old", 2)], schema)
    got = sorted((r.utc_time or "", r.extra) for r in resolve_times(df, "source", "t").collect())
    assert got == [("", 2), ("2024-01-02T00:00:00Z", 1), ("2024-01-02T00:00:00Z", 1)]
