import random

from veridant.operators.asof import as_of_join, validity_intervals
from veridant.operators.orphans import current_orphans, orphan_references, signed_counts


def brute(changes, entity, at):
    known = [(r, i) for e, a, r, i in changes if e == entity and a is not None and a <= at]
    return max(known)[1] if known else None


def test_as_of_against_brute_force(spark):
    rng = random.Random(3)
    changes = [(rng.choice("abc"), rng.randrange(0, 2000), rng.randrange(50), i) for i in range(300)] + [("a", None, 1, 999), ("hot", 5, 1, 1000), ("hot", 5, 2, 1001)]
    events = [(i, rng.choice(["a", "b", "c", "hot", "none", None]), rng.choice([rng.randrange(-50, 2500), None])) for i in range(300)] * 2
    c = spark.createDataFrame(changes, "entity string, at long, r int, i int")
    e = spark.createDataFrame(events, "id int, entity string, t long")
    iv = validity_intervals(c, "entity", "at", ["r", "i"], 100)
    got = [(r.id, r.best.i if r.best else None) for r in as_of_join(e, "entity", "t", iv, 100).collect()]
    want = [(i, brute(changes, s, t) if s is not None and t is not None else None) for i, s, t in events]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # intervals are half-open and do not overlap
    spans = sorted((r.entity, r.valid_from, r.valid_to) for r in iv.filter("valid_to IS NOT NULL").collect())
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False) if a[0] == b[0])


def test_as_of_on_empty_tables(spark):
    c = spark.createDataFrame([], "entity string, at long, r int")
    e = spark.createDataFrame([], "id int, entity string, t long")
    assert as_of_join(e, "entity", "t", validity_intervals(c, "entity", "at", ["r"])).count() == 0
    e = spark.createDataFrame([(1, "a", 5)], "id int, entity string, t long")
    assert as_of_join(e, "entity", "t", validity_intervals(c, "entity", "at", ["r"])).first().best is None


def judge(objects, key, at):
    mine = [(t, gone) for k, t, gone in objects if k == key]
    if not mine:
        return "missing"
    if min(t for t, _ in mine) > at:
        return "late"
    newest = max(t for t, _ in mine if t <= at)
    return "deleted" if all(g for t, g in mine if t == newest) else None


def test_orphans_against_brute_force_with_hot_and_heavy_keys(spark):
    rng = random.Random(5)
    objects = [(f"k{rng.randrange(20)}", rng.randrange(100), rng.random() < 0.4) for _ in range(60)] + [("heavy", t, t % 3 == 0) for t in range(0, 100, 2)]
    refs = [(i, rng.choice(["hot", "heavy", *[f"k{j}" for j in range(25)], None]) if i % 3 else "k1", rng.randrange(100)) for i in range(400)]
    o = spark.createDataFrame(objects + objects[:5], "key string, at long, removed boolean")
    r = spark.createDataFrame(refs, "id int, key string, at long")
    want = sorted((i, k, t, j) for i, k, t in refs if k is not None and (j := judge(objects, k, t)))
    for heavy in (64, 10):
        got = sorted(tuple(x) for x in orphan_references(r, o, heavy_changes=heavy).select("id", "key", "at", "kind").collect())
        assert got == want


def test_orphans_on_empty_tables(spark):
    o = spark.createDataFrame([], "key string, at long, removed boolean")
    r = spark.createDataFrame([], "id int, key string, at long")
    assert orphan_references(r, o).count() == 0
    r = spark.createDataFrame([(1, "a", 1), (1, "a", 1)], "id int, key string, at long")
    assert [x.kind for x in orphan_references(r, o).collect()] == ["missing", "missing"]


def test_signed_counts_continue(spark):
    refs = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), (None, 1)], "key string, delta int")
    exists = spark.createDataFrame([("b", 1), ("c", 1)], "key string, delta int")
    state = signed_counts(refs, exists)
    assert [r.key for r in current_orphans(state).collect()] == ["a"]
    later = signed_counts(spark.createDataFrame([("a", -2)], "key string, delta int"), spark.createDataFrame([("b", -1)], "key string, delta int"), state)
    assert [r.key for r in current_orphans(later).collect()] == ["b"]


def test_current_orphans_of_the_tables(spark, data_dir):
    from tests.compare import assert_same, connect
    from veridant.plans import registry

    key = "nullif(lower(regexp_replace({}, '^[ \\t]+|[ \\t]+$', '', 'g')), '')"
    sql = f"""WITH e AS (SELECT * FROM global_edge_spine QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at) = 1),
    p AS (SELECT * FROM chart_series_points QUALIFY row_number() OVER (PARTITION BY series_key, period ORDER BY loaded_at) = 1),
    r AS (SELECT {key.format("o")} AS "key" FROM (SELECT from_object_id o FROM e UNION ALL SELECT to_object_id FROM e UNION ALL SELECT object_id FROM p)),
    l AS (SELECT {key.format("object_id")} AS "key", max_by(coalesce(lower(trim(quality_status)) IN ('deleted', 'tombstoned', 'removed'), false), loaded_at) gone FROM global_object_locator GROUP BY 1)
    SELECT "key", count(*) reference_count, 0 existence_count FROM r LEFT JOIN l USING ("key") WHERE "key" IS NOT NULL AND coalesce(gone, true) GROUP BY 1"""
    df = registry.queries()["p5_current"](spark, data_dir)
    assert df.count() > 0
    assert_same(df, connect(data_dir), sql)
