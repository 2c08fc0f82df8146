"""Full-text search on postings: tokens, prefix AND/OR, fielded BM25, coverage, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridant.functions.lexical import words

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits of any script; null gives an empty array."""
    return words(text)


def postings(documents: DataFrame, doc: str, fields: list[str]) -> DataFrame:
    """(doc, field, term, tf): one row per term of a field of a document."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("ts")) for f in fields])
    t = documents.select(doc, F.inline(each)).select(doc, "field", F.explode("ts").alias("term"))
    return t.groupBy(doc, "field", "term").agg(F.count("*").alias("tf"))


def term_statistics(posts: DataFrame, doc: str) -> DataFrame:
    """Documents and occurrences of each term."""
    return posts.groupBy("term").agg(F.countDistinct(doc).alias("df"), F.sum("tf").alias("cf"))


def query_hits(documents: DataFrame, doc: str, fields: dict[str, float], terms: list[str], prefix: bool = False) -> DataFrame:
    """(doc, q, f, dl): weighted frequency of each query term in each document, and the document's length.

    No posting is shuffled: a document is matched where it is read, by higher-order functions.
    With `prefix`, all terms that begin with a query term count for it.
    """
    # behind a Generate, so that the tokens are made once and not at each use
    made = F.inline(F.array(F.struct(*[tokens(F.col(f)).alias(f"__t{i}") for i, f in enumerate(fields)])))
    documents = documents.select(doc, made)
    parts = [(F.col(f"__t{i}"), w) for i, w in enumerate(fields.values())]
    total = F.lit(0)
    for ts, _ in parts:
        total = total + F.size(ts)
    match = lambda q: (lambda x: x.startswith(q)) if prefix else (lambda x: x == q)
    rows = []
    for q in terms:
        weighted = F.lit(0.0)
        for ts, w in parts:
            weighted = weighted + w * F.size(F.filter(ts, match(q)))
        rows.append(F.struct(F.lit(q).alias("q"), weighted.alias("f")))
    return documents.select(doc, total.alias("dl"), F.inline(F.array(*rows)))


def bm25(documents: DataFrame, doc: str, fields: dict[str, float], terms: list[str], prefix: bool = False, mode: str = "or") -> DataFrame:
    """(doc, score, matched) by fielded BM25; k1 1.2, b 0.75, idf ln((N-n+0.5)/(n+0.5)) of at least 1e-6.

    Column weights multiply frequencies, the length is the whole row's. mode `and` keeps documents
    that match every term. Statistics are over all documents; a repeated document counts
    as often as it comes.
    """
    hits = query_hits(documents, doc, fields, terms, prefix)
    stats = hits.groupBy("q").agg(F.count("*").alias("n_all"), F.count_if(F.col("f") > 0).alias("n"), F.avg("dl").alias("avgdl"))
    # one row per query term: bounded by the query
    s = hits.filter("f > 0").join(F.broadcast(stats), "q")
    idf = F.greatest(F.log((F.col("n_all") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = s.groupBy(doc).agg(F.sum(part).alias("score"), F.countDistinct("q").alias("matched"))
    return out.filter(F.col("matched") == len(set(terms))) if mode == "and" else out


def coverage_rank(scored: DataFrame, doc: str, n_terms: int, limit: int) -> DataFrame:
    """Rerank of the best 4 x limit: 0.65 coverage + 0.35 min-max score; under 60 % of the terms x 0.25."""
    pool = scored.orderBy(F.col("score").desc(), F.col(doc)).limit(4 * limit)
    w = Window.partitionBy(F.lit(1))
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low))
    primary = 0.65 * F.col("matched") / n_terms + 0.35 * scaled
    strict = F.col("matched") >= -(-6 * n_terms // 10)
    return pool.withColumns({"primary": F.when(strict, primary).otherwise(primary * 0.25), "strict": strict}).select(doc, "primary", "strict", "matched")


def term_pairs(documents: DataFrame, doc: str, text: str, terms: list[str]) -> DataFrame:
    """(term_a, term_b, docs): documents in which two of the given terms meet."""
    ts = F.array_sort(F.array_intersect(F.array_distinct(tokens(F.col(text))), F.array(*[F.lit(t) for t in terms])))
    pairs = F.flatten(F.transform(F.col("h"), lambda a: F.transform(F.filter("h", lambda b: b > a), lambda b: F.struct(a.alias("term_a"), b.alias("term_b")))))
    return documents.select(doc, ts.alias("h")).filter(F.size("h") > 1).select(F.inline(pairs)).groupBy("term_a", "term_b").agg(F.count("*").alias("docs"))
