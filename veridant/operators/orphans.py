"""References to records that do not exist, from signed counts of change deltas.

A key has two counts: references (+1 for each reference delta) and existence (+1 when its
object appears, -1 when it is removed). `signed_counts` keeps both for any mix of deltas
and can be continued with later ones; keys with positive references and zero existence are
the current orphan report. `orphan_references` judges each reference at its own time, by
the existence count summed up to then.

Scale: the existence side is condensed to one row per key. A key with more than
`heavy_changes` state changes never becomes one row; its references take the interval join of operators.asof, which spreads a key over time
buckets. Reference keys that hold more than 1 in HOT_SHARE rows are salted. A frequent-items
sketch finds them in one pass without a shuffle; there can be at most HOT_SHARE of them,
which bounds their broadcast, and which keys it finds changes the work only, not the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridant.operators.asof import as_of_join, validity_intervals

SALTS = 32
#: Microseconds of a time bucket of the interval join.
HEAVY_BUCKET = 28 * 86400 * 10**6
HOT_SHARE = 200


def normal_key(c: Column) -> Column:
    """Key without blanks and tabs at both ends and without letter case; empty gives null."""
    return F.nullif(F.lower(F.regexp_replace(c, r"^[ \t]+|[ \t]+$", "")), F.lit(""))


def signed_counts(references: DataFrame, existence: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(key, reference_count, existence_count) after all deltas, added to `state` if given.

    references, existence: columns key, delta. Null keys are left out. Keys whose counts are
    both zero again are kept, so the result can serve as the next state.
    """
    parts = references.select("key", F.col("delta").alias("r"), F.lit(0).alias("e")).unionByName(existence.select("key", F.lit(0).alias("r"), F.col("delta").alias("e")))
    if state is not None:
        parts = parts.unionByName(state.select("key", F.col("reference_count").alias("r"), F.col("existence_count").alias("e")))
    return parts.filter("key IS NOT NULL").groupBy("key").agg(F.sum("r").alias("reference_count"), F.sum("e").alias("existence_count"))


def existence_deltas(objects: DataFrame) -> DataFrame:
    """(key, at, delta): +1 where an object appears, -1 where it is removed, in order of time; deliveries that change nothing give none.

    objects: key, at, removed. Of deliveries at one time any that is present counts. Null keys and times are left out.
    """
    states = objects.filter("key IS NOT NULL AND at IS NOT NULL").groupBy("key", "at").agg(F.max((~F.col("removed")).cast("int")).alias("present"))
    before = F.coalesce(F.lag("present").over(Window.partitionBy("key").orderBy("at")), F.lit(0))
    return states.select("key", "at", (F.col("present") - before).alias("delta")).filter("delta != 0")


def current_orphans(counts: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist now."""
    return counts.filter("reference_count > 0 AND existence_count = 0")


def hot_keys(keys: DataFrame) -> DataFrame:
    """Keys in more than 1 of HOT_SHARE rows, by a frequent-items sketch: at most HOT_SHARE rows."""
    top = keys.agg(F.expr(f"approx_top_k(key, {HOT_SHARE}, {50 * HOT_SHARE})").alias("top"), F.count("*").alias("total"))
    return top.select("total", F.inline("top")).filter(F.col("count") * HOT_SHARE > F.col("total")).select(F.col("item").alias("key"), F.lit(True).alias("__hot"))


def orphan_references(references: DataFrame, objects: DataFrame, sketch_from: DataFrame | None = None, heavy_changes: int = 64, salts: int = SALTS) -> DataFrame:
    """References that name no object known to exist at their time, with `kind`.

    references: key, at and any further columns, one row per reference; objects: key, at,
    removed. Times are epoch microseconds. kind is `missing` if the key never has an object,
    `late` if its first object comes after the reference, `deleted` if the existence count
    up to the reference's time is zero again. References with null key or time are no
    cases; sound references do not come out. Equal rows stay as they are. Columns of references
    named kind, first_at or deltas are replaced.

    sketch_from: a cheaper relation with the keys of `references` (such as the raw rows), to
    find hot keys in. Whether any key is heavy is asked of the object side first, in a job
    of its own; only if there is one, its references take the interval join.
    """
    refs = references.drop("kind", "first_at", "deltas").filter("key IS NOT NULL AND at IS NOT NULL")
    hot = F.broadcast(hot_keys((refs if sketch_from is None else sketch_from).select("key").filter("key IS NOT NULL")))
    states = objects.filter("key IS NOT NULL AND at IS NOT NULL").groupBy("key", "at").agg(F.max((~F.col("removed")).cast("int")).alias("present"))
    heavy = states.groupBy("key").agg(F.count("*").alias("__n")).filter(F.col("__n") > heavy_changes).select("key")
    columns = refs.columns
    if heavy.isEmpty():
        return _judge_light(refs, states, hot, salts)
    light = _judge_light(refs.join(heavy, "key", "left_anti"), states.join(heavy, "key", "left_anti"), hot, salts)
    changes = states.join(heavy, "key").withColumn("changed", F.col("at"))
    intervals = validity_intervals(changes, "key", "at", ["changed", "present"], HEAVY_BUCKET)
    judged = as_of_join(refs.join(heavy, "key", "left_semi"), "key", "at", intervals, HEAVY_BUCKET)
    kind = F.when(F.col("best").isNull(), "late").when(F.col("best.present") == 0, "deleted")
    return light.unionByName(judged.withColumn("kind", kind).filter("kind IS NOT NULL").select(*columns, "kind"))


def _judge_light(refs: DataFrame, states: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """References against keys of few changes, one row of existence deltas per key."""
    side = states.groupBy("key").agg(F.min("at").alias("first_at"), F.array_sort(F.collect_list(F.struct("at", "present"))).alias("s"))
    deltas = "transform(s, (x, i) -> struct(x.at AS at, x.present - IF(i = 0, 0, s[i - 1].present) AS delta))"
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    side = side.select("key", "first_at", F.expr(deltas).alias("deltas")).join(hot, "key", "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    spread = F.when(F.col("__hot"), F.pmod(F.xxhash64(*[F.col(c) for c in refs.columns if c != "key"]), F.lit(salts))).otherwise(F.lit(0))
    salted = refs.join(hot, "key", "left").withColumn("__salt", spread.cast("int")).drop("__hot")
    existence = F.expr("aggregate(deltas, 0, (n, x) -> n + IF(x.at <= at, x.delta, 0))")
    kind = F.when(F.col("first_at").isNull(), "missing").when(F.col("first_at") > F.col("at"), "late").when(existence == 0, "deleted")
    return salted.join(side, ["key", "__salt"], "left").withColumn("kind", kind).filter("kind IS NOT NULL").select(*refs.columns, "kind")


def orphan_report(orphans: DataFrame, table: str = "table_name", period: str = "period") -> DataFrame:
    """Counts of orphan references by table, period and kind."""
    return orphans.groupBy(table, period, "ref_column", "kind").agg(F.count("*").alias("references"), F.countDistinct("key").alias("keys"))
