"""Links between entities that share keys or similar topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridant.session import cut_lineage


def key_classes(refs: DataFrame, key: str, member: str) -> DataFrame:
    """Members of each key shared by two or more: key, member, representative (the smallest), class size.

    Stands for all pairs within a key without writing them out.
    """
    m = refs.filter(F.col(key).isNotNull() & F.col(member).isNotNull()).select(key, member).distinct()
    c = m.groupBy(key).agg(F.min(member).alias("representative"), F.count("*").alias("members")).filter("members > 1")
    return m.join(c, key)


def jaccard_links(labels: DataFrame, label: str, threshold: float) -> DataFrame:
    """(label_a, label_b, jaccard) of distinct labels whose token sets overlap enough, a < b.

    Prefix filter: with tokens in order of rarity, two sets of Jaccard t share a token among the
    first n - ceil(t n) + 1 of each, so only those are joined on, and sizes must fit. Exact:
    every pair at or over the threshold comes out, no token is left out for being frequent.
    """
    sets = labels.filter(F.col(label).isNotNull()).select(F.col(label).alias("l")).distinct().withColumn("ts", F.array_distinct(F.regexp_extract_all(F.lower("l"), F.lit("[a-z0-9]+"), 0))).filter("size(ts) > 0")
    rarity = sets.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    ordered = sets.select("l", F.explode("ts").alias("t")).join(rarity, "t").groupBy("l").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("o"))
    keep = F.expr(f"size(o) - cast(ceil({threshold} * size(o) - 1e-9) AS INT) + 1")
    p = ordered.select("l", F.transform("o", lambda x: x["t"]).alias("ts"), F.explode(F.slice(F.transform("o", lambda x: x["t"]), F.lit(1), keep)).alias("t"))
    a, b = p.select("t", F.col("l").alias("label_a"), F.col("ts").alias("ta")), p.select("t", F.col("l").alias("label_b"), F.col("ts").alias("tb"))
    fits = (F.size("ta") >= threshold * F.size("tb") - 1e-9) & (F.size("tb") >= threshold * F.size("ta") - 1e-9)
    pairs = a.join(b, "t").filter((F.col("label_a") < F.col("label_b")) & fits).select("label_a", "label_b", "ta", "tb").distinct()
    both = F.size(F.array_intersect("ta", "tb"))
    j = both / (F.size("ta") + F.size("tb") - both)
    return pairs.select("label_a", "label_b", j.alias("j")).filter(F.col("j") >= threshold - 1e-12).select("label_a", "label_b", F.round("j", 6).alias("jaccard"))


def cap_links(links: DataFrame, a: str, b: str, weight: str, per_pair: int = 8, per_node: int = 500, max_rounds: int = 64) -> DataFrame:
    """Greedy selection by weight: at most `per_pair` links of a pair and `per_node` of a node; ties by the ends.

    The pair cap is a window. The node cap goes in rounds: a link that is within the places left at both its ends, among the
    links not settled yet, is one that greedy selection takes, as fewer better links than places can come before it; links of
    full nodes are dropped. The best link left is always taken, and in practice a few rounds settle all. Each round is two
    windows by node, written to the checkpoint folder; more than `max_rounds` rounds raise.
    """
    w = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(F.col(weight).desc(), a, b)
    columns = links.columns
    d = links.withColumn("__p", F.row_number().over(w)).filter(F.col("__p") <= per_pair)
    d = cut_lineage(d.withColumns({"__id": F.struct((-F.col(weight)).alias("w"), F.col(a).alias("a"), F.col(b).alias("b"), "__p"), "__taken": F.lit(False)}))
    for _ in range(max_rounds):
        used = d.filter("__taken").select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("__u"))
        at = lambda end: used.select(F.col("node").alias(end), F.col("__u").alias(f"__u_{end}"))
        r = d.join(at(a), a, "left").join(at(b), b, "left").na.fill(0, [f"__u_{a}", f"__u_{b}"])
        r = r.filter(F.col("__taken") | ((F.col(f"__u_{a}") < per_node) & (F.col(f"__u_{b}") < per_node)))
        # a node's rank counts the open links at either of its ends
        open_ends = r.filter("NOT __taken").select("__id", F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(f"__u_{a}").alias("u")), F.struct(F.col(b).alias("node"), F.col(f"__u_{b}").alias("u")))).alias("e"))
        ranked = open_ends.select("__id", "e.node", "e.u", F.row_number().over(Window.partitionBy("e.node").orderBy("__id")).alias("rank"))
        sure = ranked.groupBy("__id").agg(F.min(F.col("rank") <= per_node - F.col("u")).alias("__sure"))
        d = cut_lineage(r.drop(f"__u_{a}", f"__u_{b}").join(sure, "__id", "left").withColumn("__taken", F.col("__taken") | F.coalesce("__sure", F.lit(False))).drop("__sure"))
        if d.filter("NOT __taken").isEmpty():
            return d.select(*columns)
    raise RuntimeError(f"links not settled in {max_rounds} rounds")
