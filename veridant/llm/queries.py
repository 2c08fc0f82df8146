"""Queries p7 to p10 over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridant.llm.leakage import find_leaks
from veridant.llm.packing import count_tokens, pack_containers, packing_summary
from veridant.llm.queries_sql import ORACLE_SQL  # noqa: F401
from veridant.llm.splitting import split_texts
from veridant.llm.truncation import judge_endings, truncation_rates
from veridant.session import spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


# --- 7: oversized sections


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections in pieces of at most 2,000 characters, overlapping by 200; repeated rows count once."""
    spans = table(spark, sf_dir, "mini_10k_spans").select("id", "text", "section_name", "start_char").distinct()
    return split_texts(spans, "id", "text", "section_name", "start_char")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized sections with the coarsest boundary at which they can be cut."""
    spans = spread(table(spark, sf_dir, "mini_10k_spans").select("id", "text", "section_name", "start_char").filter(F.length("text") > 2000))
    pieces = split_texts(spans, "id", "text", "section_name", "start_char")
    return pieces.filter("piece_index = 0").select("span_id", "coarsest_boundary").distinct()


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each oversized section what its pieces must hold: within the limit, overlaps of 200, the whole text covered, cut at the coarsest places."""
    p = p7_pieces(spark, sf_dir).filter("piece_count > 1")
    w = Window.partitionBy("span_id", "piece_count", "document_start_of").orderBy("piece_index")
    p = p.withColumn("document_start_of", F.coalesce(F.col("document_start") - F.col("piece_start"), F.lit(-1)))
    p = p.withColumn("before", F.lag("piece_end").over(w))
    g = p.groupBy("span_id", "section_name", "document_start_of", "piece_count").agg(
        F.bool_and((F.length("piece_text") <= 2000) & (F.length("piece_text") == F.col("piece_end") - F.col("piece_start"))).alias("within_limit"),
        F.bool_and(F.when(F.col("piece_index") == 0, F.col("piece_start") == 0).otherwise(F.col("before") - F.col("piece_start") == 200)).alias("overlapping"),
        F.max("piece_end").alias("characters"),
        F.bool_and(~F.col("boundary").isin("none") | (F.col("coarsest_boundary") == "none")).alias("natural"),
    )
    return g.select("span_id", "characters", "within_limit", "overlapping", "natural").distinct()


# --- 8: containers of 2,048 tokens


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in a container of 2,048 tokens; a document delivered again counts once."""
    documents = _documents(spark, sf_dir)
    sizes = count_tokens(documents, "doc_id", "text").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    return pack_containers(sizes, "doc_id", "n_tokens", about=table(spark, sf_dir, "documents").count())


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, by size."""
    return packing_summary(p8_containers(spark, sf_dir))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers must hold: every document with text once, none over its capacity, none split that fits, little room unused; no row without documents."""
    p = p8_containers(spark, sf_dir)
    c = p.groupBy("container_id", "capacity").agg(F.sum("part_size").alias("held"))
    d = p.groupBy("doc_id").agg(F.sum("part_size").alias("size"), F.count("*").alias("parts"), F.count_if(F.col("part") == 0).alias("firsts"))
    over, filled = c.agg(F.count_if(F.col("held") > F.col("capacity"))).scalar(), c.agg(F.sum("held") / F.sum("capacity") >= 0.97).scalar()
    totals = d.agg(F.count("*").alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("size") <= 2048)).alias("split_needlessly"), F.count_if(F.col("firsts") != 1).alias("placed_twice"))
    return totals.filter("documents > 0").withColumns({"over_capacity": over, "well_filled": filled})


# --- 9: evaluation items in training texts


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items by document, with the passages and the greatest overlap."""
    return find_leaks(_documents(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of an evaluation item."""
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with what they must hold: a run of twelve words or more, passages, and overlaps that are shares."""
    share = lambda c: F.col(c).isNull() | F.col(c).between(0, 1)
    sound = (F.col("longest_run") >= 12) & (F.col("passages") >= 1) & share("question_overlap") & share("answer_overlap") & (F.greatest(F.col("question_overlap"), F.coalesce("answer_overlap", F.lit(0.0))) > 0)
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id", sound.alias("sound"))


# --- 10: cut texts


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_endings(_documents(spark, sf_dir), ["doc_id", "source"], "text", "source")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text stops before its author ended it."""
    return _judged(spark, sf_dir).filter("truncated").select("doc_id", "source").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates; a document delivered again counts once."""
    # deliveries are taken once after they are judged, as narrow rows
    return truncation_rates(_judged(spark, sf_dir).distinct(), "source")


def p10_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut documents by what shows it: a significant length, or the shape of the ending alone."""
    found = _judged(spark, sf_dir).filter("truncated").groupBy("doc_id", "source").agg(F.max("evidence").alias("evidence"))
    return found.groupBy("evidence").agg(F.count("*").alias("documents"))


QUERIES = {"p7_found": p7_found, "p7_pieces": p7_pieces, "p7_checks": p7_checks, "p8_containers": p8_containers, "p8_usage": p8_usage, "p8_checks": p8_checks, "p9_found": p9_found, "p9_leaks": p9_leaks, "p9_checks": p9_checks, "p10_found": p10_found, "p10_rates": p10_rates, "p10_evidence": p10_evidence}
