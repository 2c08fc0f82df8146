"""Routing a question to companies: units, channels, fusion, coherence; and how directly an object answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridant.operators.ranking import RRF_K

#: Weights of the channels beside the search by fields, and what a channel's first rank counts.
CHANNELS = {"exact_alias": 4.0, "facet": 0.1, "short_token": 0.2}
DECAY = (1.0, 0.3, 0.1)
#: Least information of a term that takes part in pairs, most pairs, and most units of a pair.
PAIR_INFORMATION, MOST_PAIRS, MOST_UNITS = 1.5, 12, 4096


def fused_units(fielded: DataFrame, others: DataFrame) -> DataFrame:
    """(unit, score): fielded results count their score at the first rank, other channels their weight at their own rank.

    fielded: unit, primary; others: unit, channel, rank.
    """
    weight = F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv])
    a = fielded.select("unit", (F.col("primary") / (RRF_K + 1)).alias("part"))
    b = others.select("unit", (F.coalesce(F.try_element_at(weight, F.col("channel")), F.lit(0.0)) / (RRF_K + F.col("rank"))).alias("part"))
    return a.unionByName(b).groupBy("unit").agg(F.sum("part").alias("score"))


def ticker_scores(units: DataFrame) -> DataFrame:
    """(ticker, score, units): the best three units of each company, decayed; units: ticker, unit, score."""
    w = Window.partitionBy("ticker").orderBy(F.col("score").desc(), "unit")
    d = F.array(*[F.lit(x) for x in DECAY])
    top = units.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= len(DECAY))
    return top.groupBy("ticker").agg(F.sum(F.col("score") * F.element_at(d, F.col("__r"))).alias("score"), F.count("*").alias("units"))


def term_pairs(information: dict[str, float]) -> list[tuple[str, str]]:
    """The pairs of telling terms that tell most together, at most MOST_PAIRS; on the driver, over the terms of a question."""
    telling = sorted(t for t, i in information.items() if i >= PAIR_INFORMATION)
    pairs = [(a, b) for n, a in enumerate(telling) for b in telling[n + 1 :]]
    return sorted(pairs, key=lambda p: (-(information[p[0]] + information[p[1]]), p))[:MOST_PAIRS]


def coherence(hits: DataFrame, tickers: DataFrame, information: dict[str, float]) -> DataFrame:
    """(ticker, unit, coherence): how much of a question one unit of a company holds together, the best unit of each.

    hits: unit, term. A unit takes part if it holds a pair of terms that at most MOST_UNITS units hold. Of all terms in such
    pairs: 0.55 of the share a unit holds, 0.45 of the share of their information.
    """
    pairs = term_pairs(information)
    terms = sorted({t for p in pairs for t in p})
    if not pairs:
        return tickers.select("ticker", "unit", F.lit(0.0).alias("coherence")).limit(0)
    held = hits.filter(F.col("term").isin(terms)).groupBy("unit").agg(F.collect_set("term").alias("ts"))
    both = F.array(*[F.when(F.array_contains("ts", a) & F.array_contains("ts", b), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in pairs])
    each = held.select("unit", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("p")).select("unit", "p.a", "p.b")
    few = each.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") <= MOST_UNITS).select("a", "b")
    kept = each.join(F.broadcast(few), ["a", "b"]).groupBy("unit").agg(F.array_distinct(F.flatten(F.collect_set(F.array("a", "b")))).alias("ts"))
    info = F.create_map(*[F.lit(x) for t in terms for x in (t, float(information[t]))])
    told = F.aggregate(F.transform("ts", lambda t: F.element_at(info, t)), F.lit(0.0), lambda s, x: s + x)
    score = 0.55 * F.size("ts") / len(terms) + 0.45 * told / sum(information[t] for t in terms)
    b = kept.select("unit", score.alias("s")).join(tickers, "unit").groupBy("ticker").agg(F.max(F.struct(F.round("s", 9).alias("s"), F.col("unit").alias("u"))).alias("top"), F.min(F.struct((-F.round("s", 9)).alias("s"), F.col("unit").alias("u"))).alias("b"))
    return b.select("ticker", F.col("b.u").alias("unit"), (-F.col("b.s")).alias("coherence"))


def reranked(coarse: DataFrame, coherent: DataFrame) -> DataFrame:
    """(ticker, final): 0.8 coherence and 0.2 of the reciprocal logarithm of the coarse rank; companies of either side.

    coarse: ticker, rank. A company without a coarse rank has coherence only.
    """
    j = coarse.join(coherent.select("ticker", "coherence"), "ticker", "full")
    return j.select("ticker", (0.8 * F.coalesce("coherence", F.lit(0.0)) + 0.2 * F.coalesce(1 / F.log2(F.col("rank") + 1.0), F.lit(0.0))).alias("final"))


def micro_reranked(coarse: DataFrame, micro: DataFrame) -> DataFrame:
    """(ticker, final): 0.35 of the scaled coarse score and 0.65 of the scaled fine one; never adds or drops a company.

    coarse, micro: ticker, score. Both are small: one row for each company of a shortlist.
    """
    everything = Window.partitionBy(F.lit(1))
    scaled = lambda c: F.when(F.max(c).over(everything) == F.min(c).over(everything), 1.0).otherwise((F.col(c) - F.min(c).over(everything)) / (F.max(c).over(everything) - F.min(c).over(everything)))
    m = micro.select("ticker", F.col("score").alias("__m"))
    j = coarse.select("ticker", F.col("score").alias("__c")).join(m, "ticker", "left")
    return j.select("ticker", (0.35 * scaled("__c") + 0.65 * F.coalesce(scaled("__m"), F.lit(0.0))).alias("final"))


def required_first(routed: DataFrame, clause_best: DataFrame) -> DataFrame:
    """Routed companies with `place`: the best company of each required clause comes first, then the others as they were.

    routed: ticker, rank; clause_best: clause, ticker, clause_rank of the required clauses. Small: one row a company.
    """
    first = clause_best.join(routed, "ticker").groupBy("clause").agg(F.min(F.struct("clause_rank", "rank", "ticker")).alias("b")).select(F.col("b.ticker").alias("ticker")).distinct().withColumn("__first", F.lit(0))
    r = routed.join(first, "ticker", "left").na.fill(1, ["__first"])
    return r.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("__first", "rank", "ticker"))).drop("__first")


# --- how directly an object answers

#: Kinds of terms that a question and an object can share.
FACETS = ("core", "mechanism", "sector", "channel", "predicate", "generic")


def facet_counts(ws: Column, asked: dict[str, list[str]]) -> dict[str, Column]:
    """How many terms of each facet of a question are among the words of an object."""
    return {k: F.size(F.array_intersect(ws, F.array(*[F.lit(t) for t in ts]).cast("array<string>"))) for k, ts in asked.items()}


def directness(found: dict[str, Column], asked: dict[str, list[str]], required: list[str], ws: Column, evidence: Column, specificity: Column) -> Column:
    """Struct (tier, directness, score): direct, strong_related, related, indirect or insufficient, after the facets found."""
    must = F.size(F.array_intersect(ws, F.array(*[F.lit(t) for t in required]).cast("array<string>"))) if required else F.lit(0)
    share = lambda n, of, otherwise: n / len(of) if of else F.lit(otherwise)
    anchor = share(must, required, 1.0)
    specific = reduce(lambda a, b: a | b, [found[k] > 0 for k in ("core", "mechanism", "sector")]) | (must > 0)
    generic_only = ~specific & (found["generic"] > 0)
    missing = F.lit(len(required)) - must
    penalty = F.when(generic_only, 0.25).otherwise(0.0) + (F.when(anchor == 0, 0.35).otherwise(F.least(F.lit(0.25), 0.05 * missing)) if required else F.lit(0.0))
    raw = 0.35 * anchor + 0.2 * share(found["predicate"], asked["predicate"], 0.0) + 0.15 * share(found["channel"], asked["channel"], 0.0) + 0.2 * F.when(evidence, 1.0).otherwise(0.0) + 0.1 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), specificity)) - penalty
    d = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    met = (anchor > 0) if required else F.lit(True)
    signal = specific | (found["channel"] > 0) | (found["predicate"] > 0)
    tier = F.when(met & evidence & ~generic_only & signal & (d >= 0.45), "direct").when(specific, "strong_related").when(found["channel"] > 0, "related").when(found["generic"] > 0, "indirect").otherwise("insufficient")
    score = 4.0 * F.least(found["core"], F.lit(3)) + 2.0 * F.least(found["mechanism"], F.lit(2)) + 1.5 * F.least(found["sector"], F.lit(2)) + F.least(found["channel"], F.lit(3)) - F.when(generic_only, 1.0).otherwise(0.0)
    return F.struct(tier.alias("tier"), d.alias("directness"), score.alias("score"))


def specificity_score(specific: Column, generic: Column) -> Column:
    """0.45 and 0.12 for each specific term, less 0.05 for each generic one, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.45 + 0.12 * specific - 0.05 * generic))
