"""An inverted index over fielded objects, written by term, and searches that read only the terms they ask for.

Postings are one row per term and object with the term's count in each field and the object's length. They are
written in buckets of the first two characters of the term, sorted by term, so a search reads the buckets of its words and,
inside them, the row groups of its prefixes. Scope (company, form, period, type) is indexed as tokens of its own, which scope a
search by a semi-join and count for no length.

Scale: one shuffle by term builds the index; a search shuffles only the postings that it hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridant.functions import lexical
from veridant.functions.lexical import words
from veridant.operators.textsearch import B, K1
from veridant.session import cut_lineage

try:
    import xxhash
except ImportError:
    xxhash = None

#: Buckets that postings are written in.
BUCKETS = 64
LONGEST_PREFIX = "\U0010ffff"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.left(term, F.lit(2))), F.lit(BUCKETS)).cast("int")


class SearchIndex:
    """Postings (bucket, term, doc, length, one count for each field) and the totals of the objects."""

    def __init__(self, postings: DataFrame, totals: DataFrame, fields: list[str]) -> None:
        self.postings, self.totals, self.fields = postings, totals, fields

    @classmethod
    def build(cls, objects: DataFrame, doc: str, fields: list[str], scope: dict[str, str] | None = None) -> SearchIndex:
        """Index of distinct objects; scope: prefix of the token to column. Null fields hold no words, null ids are left out."""
        made = [F.struct(F.lit(f).alias("field"), words(F.col(f)).alias("ws")) for f in fields]
        o = objects.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), *[F.col(c) for c in (scope or {}).values()], F.array(*made).alias("fs"))
        o = o.withColumn("length", F.aggregate("fs", F.lit(0), lambda n, f: n + F.size(f.ws)))
        each = o.select("doc", "length", F.inline("fs")).select("doc", "length", "field", F.explode("ws").alias("term"))
        counts = [F.count_if(F.col("field") == f).cast("int").alias(f"tf_{f}") for f in fields]
        lexical_part = each.groupBy("term", "doc", "length").agg(*counts)
        tokens = [F.when(F.col(c).isNotNull(), F.concat(F.lit(k + "_"), F.replace(lexical.normal_text(F.col(c)), F.lit(" "), F.lit("")))) for k, c in (scope or {}).items()]
        scoped = o.select("doc", "length", F.explode(F.filter(F.array(*tokens), lambda t: t.isNotNull())).alias("term")).select("term", "doc", "length", *[F.lit(0).alias(f"tf_{f}") for f in fields]) if tokens else None
        postings = lexical_part if scoped is None else lexical_part.unionByName(scoped.distinct())
        totals = o.agg(F.count("*").alias("objects"), F.avg("length").alias("mean_length"))
        return cls(postings.withColumn("bucket", _bucket(F.col("term"))), totals, fields)

    def write(self, path: str) -> None:
        """Write the index below `path`, replacing what is there."""
        self.postings.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SearchIndex:
        postings = spark.read.parquet(f"{path}/postings")
        return cls(postings, spark.read.parquet(f"{path}/totals"), [c[3:] for c in postings.columns if c.startswith("tf_")])

    def _rows(self, terms: list[str], prefix: bool) -> DataFrame:
        """The postings of the terms, with q, the term asked for."""
        if not terms:
            return self.postings.withColumn("q", F.lit("")).limit(0)
        one_or_more = [t for t in terms if len(t) >= 2]
        if len(one_or_more) == len(terms):
            # the hash of a literal is taken by the optimizer before files are chosen
            buckets = self.postings.filter(F.col("bucket").isin([_literal_bucket(self.postings.sparkSession, t) for t in terms]))
        else:
            buckets = self.postings
        match = lambda t: (F.col("term") >= t) & (F.col("term") < t + LONGEST_PREFIX) if prefix else F.col("term") == t
        found = buckets.filter(reduce(lambda a, b: a | b, [match(t) for t in terms]))
        asked = F.array(*[F.when(match(t), F.lit(t)) for t in terms])
        return found.withColumn("q", F.explode(F.filter(asked, lambda x: x.isNotNull())))

    def scoped(self, scope: list[str] | None) -> DataFrame | None:
        """Objects that hold all tokens of a scope; None without a scope."""
        if not scope:
            return None
        return self._rows(scope, False).groupBy("doc").agg(F.countDistinct("q").alias("n")).filter(F.col("n") == len(set(scope))).select("doc")

    def hits(self, terms: list[str], weights: dict[str, float] | None = None, prefix: bool = True, scope: list[str] | None = None) -> DataFrame:
        """(doc, q, f, length): weighted count of each term asked for in each object that has it."""
        weighted = reduce(lambda a, b: a + b, [F.col(f"tf_{f}") * F.lit((weights or {}).get(f, 1.0)) for f in self.fields])
        rows = self._rows(terms, prefix).groupBy("doc", "q").agg(F.sum(weighted).alias("f"), F.max("length").alias("length")).filter("f > 0")
        inside = self.scoped(scope)
        return rows if inside is None else rows.join(inside, "doc", "left_semi")

    def bm25(self, terms: list[str], weights: dict[str, float] | None = None, mode: str = "or", prefix: bool = True, scope: list[str] | None = None, hits: DataFrame | None = None) -> DataFrame:
        """(doc, score, matched) by BM25 with field weights; statistics are of all objects, whatever the scope.

        hits: the hits of the terms everywhere, if they are at hand.
        """
        everywhere = self.hits(terms, weights, prefix) if hits is None else hits
        n = everywhere.groupBy("q").agg(F.count("*").alias("n"))
        rows = everywhere if not scope else everywhere.join(self.scoped(scope), "doc", "left_semi")
        size, mean = self.totals.select("objects").scalar(), self.totals.select("mean_length").scalar()
        # one row for each term asked for
        s = rows.join(F.broadcast(n), "q").withColumns({"__size": size, "__mean": mean})
        idf = F.greatest(F.log((F.col("__size") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
        part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("__mean")))
        out = s.groupBy("doc").agg(F.sum(part).alias("score"), F.countDistinct("q").alias("matched"))
        return out.filter(F.col("matched") == len(set(terms))) if mode == "and" else out

    def ladder(self, question: str, limit: int, synonyms: dict[str, list[str]] | None = None, weights: dict[str, float] | None = None, scope: list[str] | None = None, split_limit: int = 12, or_limit: int = 8) -> DataFrame:
        """(doc, rung, score): the relaxation ladder, best `limit` objects.

        Rungs: 0 all terms as prefixes; 1 all terms with synonyms; 2 any of the smaller questions in full; 3 any term. Further
        rungs are tried only if synonyms changed the question or it has three terms or more. An object is found at its first rung.
        """
        strict = lexical.prefix_terms(question)
        expanded = lexical.expand_terms(strict, synonyms or {})
        # what is hit is read once and used for scores and rungs
        hits = cut_lineage(self.hits(expanded, weights))
        scored = self.bm25(expanded, weights, "or", True, scope, hits).select("doc", "score")
        held = hits.groupBy("doc").agg(F.collect_set("q").alias("qs"))
        has = lambda terms: F.size(F.array_intersect("qs", F.array(*[F.lit(t) for t in terms]))) == len(set(terms))
        rung = F.when(has(strict), 0)
        if expanded != strict:
            groups = [[t, *(synonyms or {}).get(t, [])] for t in strict]
            rung = rung.when(reduce(lambda a, b: a & b, [F.arrays_overlap("qs", F.array(*[F.lit(t) for t in g])) for g in groups]), 1)
        if expanded != strict or len(strict) >= 3:
            parts = [[lexical.singular(w) for w in p] for p in lexical.split_queries(question, split_limit) if len(p) > 1]
            if parts:
                rung = rung.when(reduce(lambda a, b: a | b, [has(p) for p in parts]), 2)
            rung = rung.when(F.arrays_overlap("qs", F.array(*[F.lit(t) for t in [lexical.singular(w) for w in lexical.or_terms(question, or_limit)]])), 3)
        found = held.select("doc", rung.cast("int").alias("rung")).filter("rung IS NOT NULL").join(scored, "doc")
        return found.orderBy("rung", F.col("score").desc(), "doc").limit(limit)


def _literal_bucket(spark: SparkSession, term: str) -> int:
    """The bucket of a term, by the engine's hash; without the xxhash library the engine is asked in a small job."""
    if xxhash is None:
        return spark.range(1).select(_bucket(F.lit(term))).first()[0]
    unsigned = xxhash.xxh64(term[:2].encode(), seed=42).intdigest()
    return (unsigned - (1 << 64) if unsigned >= 1 << 63 else unsigned) % BUCKETS
