"""Nodes of documents, candidates of section headings and the part they are in, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = r"(?i)^\W*item\s+(\d{1,2}[a-c]?)\b"
PART = r"(?i)^\W*part\s+(iv|iii|ii|i)\b"


def document_nodes(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, node, kind, line): the lines of each text that are not blank, in order, as heading, table, list or paragraph.

    A heading is marked as one, names an item or part, or is a short line in capitals. Null texts have no nodes.
    """
    lines = documents.filter(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("node", "line")).withColumn("line", F.trim("line")).filter("line != ''")
    line = F.col("line")
    capitals = (F.length(line) <= 80) & line.rlike(r"\p{Lu}") & (line == F.upper(line)) & line.rlike(r"\p{L}{3}")
    kind = F.when(line.startswith("#") | line.rlike(ITEM) | line.rlike(PART), "heading").when(line.startswith("|"), "table").when(line.rlike(r"^([-*•]|\d+[.)]) "), "list").when(capitals, "heading").otherwise("paragraph")
    return lines.select("doc", "node", kind.alias("kind"), "line")


def heading_candidates(nodes: DataFrame) -> DataFrame:
    """Headings with the part of the document they are in, the item they name, and an added score.

    The part is that of the last heading of a part before or at the node; nodes of a document are one window.
    """
    named = F.nullif(F.lower(F.regexp_extract("line", PART, 1)), F.lit(""))
    w = Window.partitionBy("doc").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    n = nodes.withColumn("part", F.last(named, ignorenulls=True).over(w)).filter("kind = 'heading'")
    item = F.nullif(F.lower(F.regexp_extract("line", ITEM, 1)), F.lit(""))
    return n.withColumn("item", item).withColumn("score", candidate_score(F.col("line"), F.col("item"), F.col("part")))


def candidate_score(line: Column, item: Column, part: Column) -> Column:
    """Points of a heading: an item named, a part known, short, no page number at its end, no full stop."""
    one = lambda c, n: F.when(c, n).otherwise(0)
    return one(item.isNotNull(), 50) + one(part.isNotNull(), 10) + one(F.length(line) <= 120, 15) - one(line.rlike(r"\s\d{1,4}$"), 25) - one(line.endswith("."), 10)
