"""From a question in words to a search plan, by rules; planners and rerankers are pluggable."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridant.functions.lexical import query_terms
from veridant.plans.search_plan import Clause, Engine, SearchPlan, answerability  # noqa: F401

# Words of a question and the form, kind of object or metric that they ask for.
FORMS = {"annual": "10-K", "10-k": "10-K", "quarterly": "10-Q", "10-q": "10-Q"}
KINDS = {"risk": "FactorExposure", "exposure": "FactorExposure", "quote": "EvidenceQuote", "claim": "ResearchClaim", "metric": "FinancialMetric", "entity": "NamedEntity"}
METRICS = {"revenue": "revenue", "sales": "revenue", "net income": "net_income", "profit": "net_income", "debt": "total_debt", "headcount": "headcount", "free cash flow": "free_cash_flow", "gross margin": "gross_margin"}
COMPARISONS = ("compare", "versus", " vs ", "against", "difference between")
LATEST = ("latest", "newest", "current", "most recent")
_PERIOD = re.compile(r"\b(?:FY|CY)\d{4}(?:Q[1-4])?\b", re.IGNORECASE)


@dataclass(frozen=True)
class QueryPlan:
    """What a question asks for: scope, kind, metric and words."""

    question: str
    intent: str
    tickers: tuple[str, ...] = ()
    document_types: tuple[str, ...] = ()
    periods: tuple[str, ...] = ()
    period_policy: str = "all"
    object_types: tuple[str, ...] = ()
    metric: str | None = None
    terms: tuple[str, ...] = ()
    limit: int = 20
    extra: dict = field(default_factory=dict)


class QueryPlanner(Protocol):
    """Makes a plan of a question, given the companies there are: ticker to name."""

    def plan(self, question: str, companies: dict[str, str]) -> QueryPlan: ...


class Reranker(Protocol):
    """Orders the rows of an answer; the rows are as few as the plan's limit."""

    def rerank(self, question: str, rows: DataFrame) -> DataFrame: ...


class RulePlanner:
    """Plans by words: companies named by ticker or name, forms, periods, kinds of objects, a metric."""

    def plan(self, question: str, companies: dict[str, str]) -> QueryPlan:
        low = f" {question.lower()} "
        tickers = tuple(t for t, name in sorted(companies.items()) if re.search(rf"\b{re.escape(t)}\b", question) or (name and name.lower() in low))
        metric = next((m for words, m in sorted(METRICS.items(), key=lambda x: -len(x[0])) if words in low), None)
        kinds = tuple(dict.fromkeys(k for w, k in KINDS.items() if w in low))
        forms = tuple(dict.fromkeys(f for w, f in FORMS.items() if w in low))
        intent = "compare" if len(tickers) > 1 or any(w in low for w in COMPARISONS) else "metric" if metric else "search"
        named = {w for t in tickers for w in query_terms(f"{t} {companies[t] or ''}")}
        terms = tuple(w for w in query_terms(_PERIOD.sub(" ", question)) if w not in named)
        periods = tuple(dict.fromkeys(p.upper() for p in _PERIOD.findall(question)))
        return QueryPlan(question, intent, tickers, forms, periods, "latest" if any(w in low for w in LATEST) else "all", kinds, metric, terms)


class Retriever:
    """Plans a question, runs it on an engine and orders the answer."""

    def __init__(self, engine: Engine, planner: QueryPlanner | None = None, reranker: Reranker | None = None) -> None:
        self.engine, self.planner, self.reranker = engine, planner or RulePlanner(), reranker

    def companies(self) -> dict[str, str]:
        """Tickers and names; one row a company."""
        rows = self.engine._t("global_object_locator").filter("ticker IS NOT NULL").groupBy("ticker").agg(F.max("company_name").alias("n")).collect()
        return {r.ticker: r.n for r in rows}

    def retrieve(self, question: str) -> tuple[QueryPlan, DataFrame]:
        """The plan and its rows: metric contexts for a metric of named companies, else texts by words."""
        plan = self.planner.plan(question, self.companies())
        if plan.metric and plan.tickers:
            rows = self.engine.compare(list(plan.tickers), plan.metric)
        else:
            clause = Clause("question", plan.terms or ("",))
            rows = self.engine.execute(SearchPlan((clause,), plan.tickers, plan.document_types, plan.limit))
        return plan, self.reranker.rerank(question, rows) if self.reranker else rows
