from veridant.plans import registry


def test_month_ends_take_every_readable_spelling(spark, tmp_path):
    times = ["2024-01-02", "2024-01-31T23:30:00-05:00", "20240115", "15.02.2024", "2024-02-29 10:00:00 Europe/Berlin", "1711843200", "9999-12-31", "n/a", None]
    rows = [(f"o{i}", "m", t, float(i)) for i, t in enumerate(times)] + [("q0", "q", "2024-05-01T00:00:00Z", 7.0), ("q1", "q", "2024-06-30", None)]
    spark.createDataFrame(rows, "observation_id string, series_key string, phenomenon_time string, value double").write.parquet(f"{tmp_path}/observations.parquet")
    spark.createDataFrame([("m", "monthly"), ("q", " Quarterly")], "series_key string, frequency string").write.parquet(f"{tmp_path}/series_catalog.parquet")
    got = sorted((r.series_key, r.period, str(r.last_day), r.value, r.readings) for r in registry.queries()["month_end_downsample"](spark, str(tmp_path)).collect())
    assert got == [("m", "CY2024M01", "2024-01-15", 2.0, 2), ("m", "CY2024M02", "2024-02-29", 4.0, 3), ("m", "CY2024M03", "2024-03-31", 5.0, 1), ("q", "CY2024Q2", "2024-05-01", 7.0, 1)]
