"""Search plans: clauses with required concepts, compiled to one DataFrame and ranked once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridant.operators import lineage, ranking, relational, series, spine, textsearch
from veridant.session import table


@dataclass(frozen=True)
class Clause:
    """One part of a question: the words to look for and whether an answer needs it."""

    clause_id: str
    terms: tuple[str, ...]
    required: bool = True


@dataclass(frozen=True)
class SearchPlan:
    """A bounded question: clauses, the scope (empty: everything) and how many rows to return."""

    clauses: tuple[Clause, ...]
    tickers: tuple[str, ...] = ()
    document_types: tuple[str, ...] = ()
    limit: int = 20
    reserve: int = 1
    extra: dict = field(default_factory=dict)


class Engine:
    """The endpoints over the tables of one folder; every method returns a DataFrame."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def catalog(self) -> DataFrame:
        """Companies with their documents and objects."""
        return self._t("global_object_locator").groupBy("ticker").agg(F.countDistinct("document_id").alias("documents"), F.countDistinct("object_id").alias("objects"), F.max("filing_date").alias("latest_filing"))

    def index_context(self) -> DataFrame:
        return self._t("global_object_locator").groupBy("document_type", "object_type").agg(F.countDistinct("object_id").alias("objects"))

    def company_context(self, ticker: str) -> DataFrame:
        return self._t("global_object_locator").filter(F.col("ticker") == ticker).groupBy("document_type", "period", "object_type").agg(F.countDistinct("object_id").alias("objects"))

    def query(self, terms: list[str], **scope: list) -> DataFrame:
        """Relaxation ladder over the documents in scope: all terms as prefixes, then any."""
        docs = relational.scope_filter(self._t("documents"), **scope)
        hits = textsearch.bm25(docs, "doc_id", {"text": 1.0}, terms, prefix=True)
        return ranking.first_rung([hits.filter(F.col("matched") == len(set(terms))), hits], "doc_id", "score")

    def execute(self, plan: SearchPlan) -> DataFrame:
        """Rows (clause_id, required, doc_id, ticker, score, matched, reserved) of a plan.

        All clauses are matched in one pass over the documents. Each required clause keeps `reserve` places.
        """
        docs = relational.scope_filter(self._t("documents"), ticker=list(plan.tickers), document_type=list(plan.document_types))
        found = None
        for c in plan.clauses:
            hit = textsearch.bm25(docs, "doc_id", {"text": 1.0}, list(c.terms), prefix=True).select(F.lit(c.clause_id).alias("clause_id"), F.lit(c.required).alias("required"), "doc_id", "score", (F.col("matched") / len(set(c.terms))).alias("matched"))
            found = hit if found is None else found.unionByName(hit)
        found = found.join(docs.select("doc_id", "ticker").distinct(), "doc_id")
        return ranking.reserved_top(found.withColumn("item", F.concat_ws(":", "clause_id", "doc_id")), "clause_id", "score", "item", plan.reserve, plan.limit).drop("item")

    def coverage(self, plan: SearchPlan) -> DataFrame:
        """covered, partial or missing for each clause of the plan."""
        rows = self.execute(plan).groupBy("clause_id").agg(F.max("matched").alias("best"))
        asked = self.spark.createDataFrame([(c.clause_id, c.required) for c in plan.clauses], "clause_id string, required boolean")
        state = F.when(F.col("best") == 1.0, "covered").when(F.col("best").isNotNull(), "partial").otherwise("missing")
        return asked.join(rows, "clause_id", "left").select("clause_id", "required", state.alias("coverage"))

    def trace(self, object_id: str) -> DataFrame:
        """What supports an object."""
        e = self._t("global_edge_spine").filter((F.col("to_object_id") == object_id) & (F.col("relation_type") == "supports"))
        o = self._t("global_object_locator").select(F.col("object_id").alias("from_object_id"), "object_type", "document_id").distinct()
        return e.select("edge_id", "from_object_id", "evidence_grade").distinct().join(o, "from_object_id", "left")

    def quality(self) -> DataFrame:
        support = self._t("global_edge_spine").filter("relation_type = 'supports' AND from_object_id IS NOT NULL AND to_object_id IS NOT NULL")
        return lineage.trace_status(self._t("global_object_locator"), support).groupBy("object_type", "trace_status").agg(F.count("*").alias("objects"))

    def compare(self, tickers: list[str], metric: str) -> DataFrame:
        """Newest contexts of one metric for the companies asked for."""
        p = self._t("chart_series_points").drop("ticker").join(self._t("chart_series").select("series_key", "ticker", "canonical_metric", "unit", "scope_kind", "scope_key", "period_type").distinct(), "series_key")
        p = relational.scope_filter(p, ticker=tickers, canonical_metric=[metric])
        return series.latest_contexts(p, ["ticker", "canonical_metric", "unit", "scope_kind", "scope_key", "period_type"], 2)

    def topic_map(self, ticker: str) -> DataFrame:
        """Labels of a company by kind of object, the commonest first."""
        o = self._t("global_object_locator").filter((F.col("ticker") == ticker) & F.col("compact_label").isNotNull())
        return o.groupBy("object_type", "compact_label").agg(F.countDistinct("object_id").alias("objects")).orderBy(F.col("objects").desc(), "object_type", "compact_label")

    def get_object(self, object_id: str) -> DataFrame:
        """The newest delivery of one object."""
        return self._t("global_object_locator").filter(F.col("object_id") == object_id).orderBy(F.col("loaded_at").desc(), "shard_id").limit(1)

    def list_documents(self, tickers: list[str] | None = None, document_types: list[str] | None = None) -> DataFrame:
        """Documents in scope by company, form and period."""
        o = relational.scope_filter(self._t("global_object_locator").filter("document_id IS NOT NULL"), ticker=tickers or [], document_type=document_types or [])
        return o.groupBy("document_id").agg(F.min("ticker").alias("ticker"), F.min("document_type").alias("document_type"), F.min("period").alias("period"), F.countDistinct("object_id").alias("objects")).orderBy("ticker", "document_type", "period", "document_id")

    def bundle(self, object_id: str) -> DataFrame:
        """An object with its claims and quotes, over one and two steps."""
        newest = self.get_object(object_id)
        support = spine.support_pairs(self._t("global_edge_spine"), self._t("global_object_locator").select("object_id", "object_type").distinct())
        return newest.join(spine.evidence_lineage(newest.select("object_id", "object_type"), support).drop("object_type"), "object_id")

    def chain(self, object_id: str, depth: int = 2, per_step: int = 20) -> DataFrame:
        """(depth, from_object_id, to_object_id, relation_type): the edges around an object, breadth first, `per_step` from a node.

        The nodes of a depth are as few as depth and `per_step` allow, so each step is a semi-join with a small side.
        """
        e = self._t("global_edge_spine").filter("from_object_id IS NOT NULL AND to_object_id IS NOT NULL").select("from_object_id", "to_object_id", "relation_type").distinct()
        both = e.unionByName(e.select(F.col("to_object_id").alias("from_object_id"), F.col("from_object_id").alias("to_object_id"), "relation_type"))
        seen = self.spark.createDataFrame([(object_id,)], "from_object_id string")
        out = None
        for d in range(1, depth + 1):
            w = Window.partitionBy("from_object_id").orderBy("relation_type", "to_object_id")
            step = both.join(seen, "from_object_id", "left_semi").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_step).select(F.lit(d).alias("depth"), "from_object_id", "to_object_id", "relation_type")
            out = step if out is None else out.unionByName(step)
            seen = step.select(F.col("to_object_id").alias("from_object_id")).distinct()
        return out

    def verify_evidence(self, quotes: DataFrame) -> DataFrame:
        """quotes (span_id, quote) with `match`: exact, normalized, empty, failed, or no_source."""
        s = self._t("mini_10k_spans").filter("id IS NOT NULL").groupBy(F.col("id").alias("span_id")).agg(F.max("text").alias("text"))
        m = quotes.join(s, "span_id", "left")
        return m.withColumn("match", F.when(F.col("text").isNull(), "no_source").otherwise(spine.quote_match(F.col("quote"), F.col("text")))).drop("text")

    def has_scope(self, **scope: list) -> bool:
        """Whether any object is in scope; reads until the first."""
        return not relational.scope_filter(self._t("global_object_locator"), **scope).isEmpty()

    def quality_events(self, ticker: str | None = None, status: str | None = None) -> DataFrame:
        """Warnings and failures of objects, by company, document and object."""
        o = self._t("global_object_locator").withColumn("status", F.lower(F.trim("quality_status"))).filter(F.col("status").isin("warn", "fail"))
        o = o.filter(F.col("ticker") == ticker) if ticker else o
        o = o.filter(F.col("status") == status) if status else o
        return o.select("ticker", "document_id", "object_id", "object_type", "status").distinct().orderBy("ticker", "document_id", "object_id", "status")

    def research_state(self, plan: SearchPlan) -> dict[str, DataFrame]:
        """The bounded evidence of a plan: candidates, coverage of its clauses, and whether it can be answered."""
        coverage = self.coverage(plan)
        return {"candidates": self.execute(plan), "coverage": coverage, "answer": answerability(coverage)}


def answerability(coverage: DataFrame) -> DataFrame:
    """One row (answer): answerable if all required clauses are covered, partial if any is covered or partly so, else not.

    coverage: required, coverage; one row for each clause of a plan.
    """
    needed = F.col("required")
    c = coverage.agg(F.count_if(needed).alias("n"), F.count_if(needed & (F.col("coverage") == "covered")).alias("full"), F.count_if(needed & (F.col("coverage") != "missing")).alias("any"))
    return c.select(F.when(F.col("full") == F.col("n"), "answerable").when(F.col("any") > 0, "partial").otherwise("not_answerable").alias("answer"))
