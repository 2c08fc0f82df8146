"""What is read of objects for search and ranking: text channels, typed projections, ledgers, portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most supporting and related texts of an object, and characters of its compact text.
MOST_SUPPORT, MOST_RELATED, COMPACT = 12, 16, 160


def retrieval_texts(objects: DataFrame, support: DataFrame, related: DataFrame) -> DataFrame:
    """(object_id, own, support, related, entities, compact): the text channels of each object.

    objects: object_id, object_type, label, company, summary; support, related: object_id, other. Supporting texts are those of
    the first MOST_SUPPORT objects by id, related ones of the first MOST_RELATED; texts are joined in that order. The first
    objects are chosen before their texts are joined, so a hub brings no more than that.
    """
    own = F.concat_ws(" ", F.nullif("label", F.lit("")), F.nullif("summary", F.lit("")))
    texts = objects.select(F.col("object_id").alias("other"), F.col("label").alias("said"))

    def channel(pairs: DataFrame, most: int, name: str) -> DataFrame:
        w = Window.partitionBy("object_id").orderBy("other")
        first = pairs.filter("object_id != other").select("object_id", "other").distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
        j = first.join(texts.filter("said IS NOT NULL"), "other")
        return j.groupBy("object_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "said"))), lambda x: x.said), " | ").alias(name))

    o = objects.select("object_id", own.alias("own"), F.coalesce("company", F.lit("")).alias("entities"))
    o = o.join(channel(support, MOST_SUPPORT, "support"), "object_id", "left").join(channel(related, MOST_RELATED, "related"), "object_id", "left").na.fill("", ["support", "related"])
    return o.withColumn("compact", F.left(F.concat_ws(" ", F.nullif("own", F.lit("")), F.nullif("entities", F.lit("")), F.nullif("support", F.lit(""))), F.lit(COMPACT)))


def date_sort_key(text: Column) -> Column:
    """A whole number by which written dates sort: yyyyMMdd, yyyyMM00 or yyyy0000 by how much is known; null without a year."""
    full = F.regexp_extract(text, r"((?:19|20)\d{2})-(\d{2})-(\d{2})", 0)
    month = F.regexp_extract(text, r"((?:19|20)\d{2})-(\d{2})", 0)
    year = F.regexp_extract(text, r"((?:19|20)\d{2})", 1)
    return F.when(full != "", F.regexp_replace(full, "-", "").cast("int")).when(month != "", F.regexp_replace(month, "-", "").cast("int") * 100).when(year != "", year.cast("int") * 10000)


def modal_label(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, label, n): the commonest label of each key; of equals the longest, then the first."""
    c = rows.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"))
    b = c.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.length(label)).alias("l"), F.col(label).alias("label"))).alias("b"))
    return b.select(*keys, F.col("b.label").alias("label"), (-F.col("b.n")).alias("n"))


def portfolio(rows: DataFrame, author: str, role: str, score: str, item: str, preferred: list[str], limit: int) -> DataFrame:
    """At most `limit` items, unique: the best of each author, then the best of each preferred role, then the best of the rest.

    Rows without a positive score are left out. Ties go to the smaller author, then item.
    """
    best = [F.col(score).desc(), F.col(author), F.col(item)]
    r = rows.filter(F.col(score) > 0)
    r = r.withColumns({"__a": F.row_number().over(Window.partitionBy(author).orderBy(*best)), "__r": F.row_number().over(Window.partitionBy(role).orderBy(*best))})
    step = F.when(F.col("__a") == 1, 0).when((F.col("__r") == 1) & F.col(role).isin(preferred), 1).otherwise(2)
    return r.withColumn("step", step).orderBy("step", *best).limit(limit).drop("__a", "__r")


def clause_coverage(units: DataFrame, clauses: DataFrame) -> DataFrame:
    """(clause_id, required, coverage, strong): covered, partial or missing, and whether strong claims are allowed.

    units: clause_id, ticker, eligible, strong; clauses: clause_id, required, tickers. A clause is covered by an eligible unit of
    every company it needs, partial with any unit; strong if every needed company has a strong eligible one.
    """
    of = lambda c: F.collect_set(F.when(c, F.col("ticker")))
    u = units.groupBy("clause_id").agg(of(F.col("eligible")).alias("have"), of(F.col("eligible") & F.col("strong")).alias("best"), F.count("*").alias("n"), F.max("eligible").alias("any"))
    j = clauses.join(u, "clause_id", "left")
    complete = lambda c: F.size(F.array_except("tickers", F.coalesce(c, F.array().cast("array<string>")))) == 0
    state = F.when(F.col("n").isNull(), "missing").when(F.col("any") & complete(F.col("have")), "covered").otherwise("partial")
    return j.select("clause_id", "required", state.alias("coverage"), (F.coalesce(F.col("any"), F.lit(False)) & complete(F.col("best"))).alias("strong"))
