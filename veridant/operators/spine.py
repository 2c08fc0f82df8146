"""Objects and edges across shards: scores, lineage, replicas, collisions, completeness, validation stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Worth of each evidence grade, and of any other.
GRADES = {"direct": 1.0, "primary": 1.0, "verified": 0.95, "explicit": 0.95, "high": 0.9, "medium": 0.72, "inferred": 0.62, "derived": 0.55, "low": 0.4, "unsupported": 0.15, "accepted": 0.6}
OTHER_GRADE = 0.58
#: Added before scores are rounded, so that ties do not hang on the last bit of a sum.
TIE = 1e-10
#: Types of objects that need evidence of their own, and the types that are evidence.
INTERPRETED = ("FactorExposure", "NamedEntity", "FinancialMetric")


def grade_score(grade: Column) -> Column:
    """Worth of an evidence grade; unknown and null ones are neutral."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv]), F.lower(F.trim(grade))), F.lit(OTHER_GRADE))


def period_alignment(left: Column, right: Column) -> tuple[Column, Column]:
    """(status, score) of two periods: the same, at most one, at most three, more years apart, or unknown."""
    year = lambda p: F.nullif(F.regexp_extract(p, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")
    gap = F.abs(year(left) - year(right))
    status = F.when((left != "") & (left == right), "same_period").when(gap.isNull(), "unknown").when(gap <= 1, "near_period").when(gap <= 3, "distant_period").otherwise("stale_period_gap")
    # Worth of each status.
    worth = F.create_map(*[F.lit(x) for kv in {"same_period": 1.0, "unknown": 0.8, "near_period": 0.9, "distant_period": 0.72, "stale_period_gap": 0.55}.items() for x in kv])
    return status, F.element_at(worth, status)


def bounded(value: Column, otherwise: Column) -> Column:
    """The value within 0 and 1, `otherwise` if it is null; least and greatest alone would pass over a null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(value, F.lit(1.0)))).otherwise(otherwise)


def edge_score(confidence: Column, grade: Column, materiality: Column, recency: Column, alignment: Column) -> Column:
    """Worth of a step along an edge, between 0.05 and 1."""
    s = 0.42 * bounded(confidence, F.lit(0.6)) + 0.28 * grade_score(grade) + 0.15 * bounded(materiality, F.lit(0.5)) + 0.15 * bounded(recency, alignment)
    return F.round(F.greatest(F.lit(0.05), F.least(s * (0.9 + 0.1 * alignment), F.lit(1.0))) + TIE, 6)


def association_score(weight: Column, confidence: Column, grade: Column, penalty: Column, alignment: Column) -> Column:
    """Worth of a step along a link between companies, between 0.03 and 0.88, under an edge of the same strength."""
    w = F.least(bounded(weight, F.lit(0.0)) / 0.75, F.lit(1.0))
    s = (0.55 * w + 0.25 * bounded(confidence, F.lit(0.55)) + 0.2 * grade_score(grade)) * (1 - 0.5 * bounded(penalty, F.lit(0.0))) * alignment * 0.88
    return F.round(F.greatest(F.lit(0.03), F.least(s, F.lit(0.88))) + TIE, 6)


# --- lineage


def support_pairs(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(evidence, evidence_type, object_id): distinct supports edges whose evidence exists; both ends are trimmed of nothing."""
    s = edges.filter("relation_type = 'supports' AND from_object_id IS NOT NULL AND to_object_id IS NOT NULL").select(F.col("from_object_id").alias("evidence"), F.col("to_object_id").alias("object_id")).distinct()
    kinds = objects.select(F.col("object_id").alias("evidence"), F.col("object_type").alias("evidence_type"))
    return s.join(kinds, "evidence")


def evidence_lineage(objects: DataFrame, support: DataFrame) -> DataFrame:
    """(object_id, object_type, claims, quotes, quotes_by_claims): evidence of each object over one and two steps.

    Quotes stand for themselves. A quote of a claim of the object is evidence too. Counts are of distinct objects.
    """
    claims = support.filter("evidence_type = 'ResearchClaim'").select("object_id", F.col("evidence").alias("claim"))
    quotes = support.filter("evidence_type = 'EvidenceQuote'").select("object_id", F.col("evidence").alias("quote"))
    through = claims.join(quotes.withColumnRenamed("object_id", "claim"), "claim").select("object_id", "quote", F.lit(True).alias("through"))
    all_quotes = quotes.withColumn("through", F.lit(False)).unionByName(through).groupBy("object_id", "quote").agg(F.min("through").alias("through"))
    q = all_quotes.groupBy("object_id").agg(F.count("*").alias("quotes"), F.count_if("through").alias("quotes_by_claims"))
    c = claims.groupBy("object_id").agg(F.count("*").alias("claims"))
    o = objects.select("object_id", "object_type")
    return o.join(c, "object_id", "left").join(q, "object_id", "left").na.fill(0, ["claims", "quotes", "quotes_by_claims"]).select("object_id", "object_type", "claims", "quotes", "quotes_by_claims")


def sharing_evidence(objects: DataFrame, support: DataFrame, most: int = 12) -> DataFrame:
    """(object_id, other): other objects of the same document that share a claim, the first `most` by id.

    The first partners of any object of a claim are among the claim's first `most` + 1 objects, so each claim gives its
    objects at most that many, however many it supports.
    """
    s = support.filter("evidence_type = 'ResearchClaim'").join(objects.select("object_id", "document_id").filter("document_id IS NOT NULL"), "object_id").select("evidence", "document_id", "object_id")
    w = Window.partitionBy("evidence", "document_id").orderBy("object_id")
    first = s.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most + 1).select("evidence", "document_id", F.col("object_id").alias("other"))
    pairs = s.join(first, ["evidence", "document_id"]).filter("object_id != other").select("object_id", "other").distinct()
    return pairs.withColumn("__r", F.row_number().over(Window.partitionBy("object_id").orderBy("other"))).filter(F.col("__r") <= most).drop("__r")


# --- replicas and collisions


def replica_mismatches(replicas: DataFrame, key: str, declared: str, place: list[str]) -> DataFrame:
    """(key, declared, found): keys whose declared number of occurrences differs from the distinct places they are in."""
    g = replicas.groupBy(key).agg(F.max(declared).alias("declared"), F.countDistinct(*[F.coalesce(F.col(p), F.lit("")) for p in place]).alias("found"))
    return g.filter("NOT declared <=> cast(found AS int)")


def collisions(rows: DataFrame, key: list[str], semantic: list[str]) -> DataFrame:
    """(key, versions, columns): keys that come with different contents, null-safe, and the columns that differ, in order."""
    present = F.array(*[F.when((F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))) > 1, F.lit(c)) for c in semantic])
    contents = F.countDistinct(F.struct(*[F.struct(F.col(c)) for c in semantic])).alias("versions")
    return rows.groupBy(*key).agg(contents, F.array_join(F.filter(present, lambda x: x.isNotNull()), ",").alias("columns")).filter("versions > 1")


def identity_claims(rows: DataFrame, key: list[str], shard: str, semantic: str) -> DataFrame:
    """(key, shards, verdict): single if one shard claims the key, equal if several agree, conflict if they do not."""
    g = rows.groupBy(*key).agg(F.countDistinct(shard).alias("shards"), (F.countDistinct(semantic) + F.max(F.col(semantic).isNull().cast("int"))).alias("__v"))
    verdict = F.when(F.col("__v") > 1, "conflict").when(F.col("shards") > 1, "equal").otherwise("single")
    return g.select(*key, "shards", verdict.alias("verdict"))


def first_inserted(rows: DataFrame, key: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """The row of each composite key that would be inserted first; later ones are ignored."""
    b = rows.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in payload if c not in order])).alias("b"))
    return b.select(*key, *[F.col(f"b.{c}").alias(c) for c in [*order, *[p for p in payload if p not in order]]])


def scoped_local_id(ticker: Column, object_id: Column) -> Column:
    """scoped:T:id, unless the id names the company between colons already."""
    return F.when(F.contains(object_id, F.concat(F.lit(":"), ticker, F.lit(":"))), object_id).otherwise(F.concat(F.lit("scoped:"), ticker, F.lit(":"), object_id))


def semantic_hash(*parts: Column) -> Column:
    """Digest of the contents that make an object what it is; null and empty parts differ from each other's places."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def local_digest(size: int, *parts: Column) -> Column:
    """The first `size` hexadecimal digits of the SHA-1 of the parts, joined by bars."""
    return F.left(F.sha1(F.concat_ws("|", *parts)), F.lit(size))


# --- validation


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that does not hold, null if all do; a null check does not hold."""
    return reduce(lambda c, nc: c.when(~F.coalesce(nc[1], F.lit(False)), nc[0]), checks[1:], F.when(~F.coalesce(checks[0][1], F.lit(False)), checks[0][0]))


def quote_match(quote: Column, text: Column) -> Column:
    """exact, normalized (white space taken as one blank), empty, or failed, of a quotation against its source."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.coalesce(quote, F.lit("")) == "", "empty").when(F.contains(text, quote), "exact").when(F.contains(squeeze(text), squeeze(quote)), "normalized").otherwise("failed")


def relation_checks(edges: DataFrame, objects: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges with `verdict`: missing_from, missing_to, not_allowed or accepted.

    allowed: relation_type, source_type, target_type; a small relation, joined as it is.
    """
    kind = lambda end, name: objects.select(F.col("object_id").alias(end), F.col("object_type").alias(name))
    e = edges.join(kind("from_object_id", "__from"), "from_object_id", "left").join(kind("to_object_id", "__to"), "to_object_id", "left")
    ok = allowed.select("relation_type", F.col("source_type").alias("__from"), F.col("target_type").alias("__to"), F.lit(True).alias("__ok")).distinct()
    e = e.join(ok, ["relation_type", "__from", "__to"], "left")
    verdict = F.when(F.col("__from").isNull(), "missing_from").when(F.col("__to").isNull(), "missing_to").when(F.col("__ok").isNull(), "not_allowed").otherwise("accepted")
    return e.withColumn("verdict", verdict).drop("__from", "__to", "__ok")


def pruned_supports(claims: DataFrame, accepted: DataFrame, key: str, supports: str) -> DataFrame:
    """(key, kept, dropped): the ids of an array column that are accepted, in order, and how many are not.

    The ids are exploded and joined, so an array of any length is not compared with the whole set in one task.
    """
    e = claims.select(key, F.posexplode(supports).alias("at", "id"))
    j = e.join(accepted.select(F.col("object_id").alias("id"), F.lit(True).alias("__ok")).distinct(), "id", "left")
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("__ok"), F.struct("at", "id")))), lambda x: x.id)
    return j.groupBy(key).agg(kept.alias("kept"), F.count_if(F.col("__ok").isNull()).alias("dropped"))


def derived_percentages(amounts: Column) -> Column:
    """Growth and ratio, in percent, of all ordered pairs of up to 80 amounts; more amounts give none."""
    usable = F.array_distinct(F.filter(amounts, lambda x: x != 0))
    growth = lambda a, b: (a - b) / F.abs(b) * 100
    of = lambda a: F.flatten(F.transform(F.filter(usable, lambda b: b != a), lambda b: F.array(growth(a, b), a / b * 100)))
    made = F.filter(F.flatten(F.transform(usable, of)), lambda x: (F.abs(x) <= 1000) & (x != 0))
    return F.when(F.size(usable) <= 80, made).otherwise(F.array().cast("array<double>"))


def percent_supported(percent: Column, derived: Column) -> Column:
    """Whether a percentage is one of the derived ones, as it is or rounded to one place or none, down or up."""
    forms = lambda x: F.array(x, F.bround(x, 1), F.bround(x, 0), F.signum(x) * F.floor(F.abs(x)), F.signum(x) * F.ceil(F.abs(x)))
    return F.exists(derived, lambda x: F.exists(forms(x), lambda f: F.abs(f - percent) < 1e-9))


def amount_supported(amount: Column, amounts: Column) -> Column:
    """Whether an amount is the sum or the difference of two of up to 80 others."""
    usable = F.array_distinct(amounts)
    pair = F.exists(usable, lambda a: F.exists(F.filter(usable, lambda b: b != a), lambda b: (F.abs(a + b - amount) < 1e-6) | (F.abs(F.abs(a - b) - amount) < 1e-6)))
    return (F.size(usable) <= 80) & pair
