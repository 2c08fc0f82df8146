"""What a metric series is: canonical metric, scope, basis, duration, source class, period, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a metric's name and the canonical metric that they mean, first match wins.
METRIC_ALIASES: dict[str, tuple[str, ...]] = {
    "research_and_development": ("research_and_development", "r_d", "research_development"),
    "stock_based_compensation": ("stock_based_compensation", "share_based_compensation", "sbc"),
    "share_repurchase": ("share_repurchase", "stock_repurchase", "repurchase", "buyback"),
    "capital_expenditures": ("capital_expenditure", "capital_expenditures", "capex"),
    "operating_cash_flow": ("operating_cash_flow", "net_cash_provided_by_operating"),
    "free_cash_flow": ("free_cash_flow", "fcf"),
    "cash_and_cash_equivalents": ("cash_and_cash_equivalents", "cash_and_equivalents"),
    "total_debt": ("total_debt", "long_term_debt", "short_term_debt"),
    "operating_income": ("operating_income", "income_from_operations"),
    "net_income": ("net_income", "net_earnings"),
    "gross_margin": ("gross_margin",),
    "operating_margin": ("operating_margin",),
    "eps": ("eps", "earnings_per_share"),
    "revenue": ("revenue",),
    "net_sales": ("net_sales", "sales"),
}
# Metrics of a point in time, and metrics of the cash flow statement.
POINT_IN_TIME = ("cash_and_cash_equivalents", "total_debt")
CASH_FLOW = ("operating_cash_flow", "free_cash_flow", "capital_expenditures", "share_repurchase")
# Spellings of how long a value covers.
DURATIONS = {"annual": "annual", "year": "annual", "yearly": "annual", "quarter": "quarter", "quarterly": "quarter", "three_month": "quarter", "three_months": "quarter", "year_to_date": "year_to_date", "ytd": "year_to_date", "instant": "instant"}


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def classify_metric(name: Column, label: Column) -> Column:
    """The canonical metric that a name and its text mean; null if none."""
    hay = F.concat_ws(" ", slug(name), slug(label), F.lower(F.coalesce(label, F.lit(""))))
    costs = _any(hay, ("business_combination_and_other_related_cost",)) | (_any(hay, ("business combination",)) & _any(hay, ("related cost",)))
    bought = _any(hay, ("business_combination", "business combinations", "acquisition", "m_and_a")) & _any(hay, ("cash", "net_of_cash", "purchase"))
    c = F.when(costs, "ma_related_costs").when(bought, "ma_cash_outflow").when(_any(hay, ("adjusted_free_cash_flow", "adjusted_fcf")), "adjusted_free_cash_flow")
    for metric, needles in METRIC_ALIASES.items():
        c = c.when(_any(hay, needles), metric)
    return c


def scope_of(segment: Column, product: Column, geography: Column) -> Column:
    """Struct (kind, key, label): segment, then product, then geography, else the whole company."""
    named = [(k, F.trim(F.coalesce(c, F.lit("")))) for k, c in (("segment", segment), ("product", product), ("geography", geography))]
    key = lambda c: F.when(slug(c) != "", slug(c)).otherwise(F.left(F.sha1(c), F.lit(12)))
    total = F.struct(F.lit("company_total").alias("kind"), F.lit("company_total").alias("key"), F.lit("Company total").alias("label"))
    made = [(c, F.struct(F.lit(k).alias("kind"), key(c).alias("key"), c.alias("label"))) for k, c in named]
    return reduce(lambda w, m: w.when(m[0] != "", m[1]), made[1:], F.when(made[0][0] != "", made[0][1])).otherwise(total)


def basis_of(metric: Column, text: Column, from_facts: Column) -> Column:
    t = F.lower(F.concat_ws(" ", metric, text))
    return F.when(_any(t, ("non-gaap", "non gaap", "adjusted")), "non_gaap_adjusted").when(from_facts | _any(t, ("xbrl",)), "gaap_xbrl").when(metric.isin("gross_margin", "operating_margin"), "company_reported_ratio").otherwise("company_reported")


def duration_of(metric: Column, text: Column, period_type: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(_any(t, ("ttm", "trailing twelve")), "ttm").when(_any(t, ("ytd", "year to date")), "ytd").when((F.lower(period_type) == "instant") | metric.isin(*POINT_IN_TIME), "point_in_time").otherwise("period")


def source_class_of(metric: Column, basis: Column, text: Column) -> Column:
    t = F.lower(F.concat_ws(" ", metric, text))
    return (
        F.when(metric == "ma_related_costs", "fcf_reconciliation")
        .when(metric == "ma_cash_outflow", "cash_flow_statement")
        .when(metric == "adjusted_free_cash_flow", "company_non_gaap_metric")
        .when(basis == "gaap_xbrl", "xbrl")
        .when(_any(t, ("cash flow",)) | metric.isin(*CASH_FLOW), "cash_flow_statement")
        .when(metric.isin(*POINT_IN_TIME), "balance_sheet")
        .when(metric.isin("gross_margin", "operating_margin"), "ratio_metric")
        .otherwise("company_reported_metric")
    )


def duration_basis(period_type: Column) -> Column:
    """annual, quarter, year_to_date or instant of a spelling; unknown otherwise."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DURATIONS.items() for x in kv]), slug(period_type)), F.lit("unknown"))


def period_of(fiscal_year: Column, fiscal_quarter: Column, period_end: Column, label: Column) -> Column:
    """CYyyyy or CYyyyyQq: the fiscal year given, else that of the end date, else that of the label; null without a year."""
    year = F.coalesce(fiscal_year, F.year(F.try_to_date(period_end)), F.nullif(F.regexp_extract(label, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int"))
    quarter = F.coalesce(fiscal_quarter, F.nullif(F.regexp_extract(label, r"Q([1-4])", 1), F.lit("")).cast("int"))
    return F.when(quarter.isNotNull(), F.concat(F.lit("CY"), year.cast("string"), F.lit("Q"), quarter.cast("string"))).otherwise(F.concat(F.lit("CY"), year.cast("string")))


def plain_period(label: Column) -> Column:
    """The label with fiscal and calendar years taken as the same: 2024 or 2024Q3; other labels as they are."""
    return F.regexp_replace(F.upper(F.trim(label)), r"^(?:FY|CY)(?=\d{4})", "")


def format_value(value: Column, unit: Column) -> Column:
    """$1.2B, $3.4M, $567, 7.8%, or the number in its shortest form."""
    a = F.abs(value)
    usd = F.when(a >= 1e9, F.format_string("$%.1fB", value / 1e9)).when(a >= 1e6, F.format_string("$%.1fM", value / 1e6)).otherwise(F.concat(F.lit("$"), F.format_number(value, 0)))
    return F.when(unit.isin("USD", "usd"), usd).when(F.contains(F.lower(unit), F.lit("percent")) | (unit == "%"), F.format_string("%.1f%%", value)).otherwise(F.regexp_replace(F.format_string("%.6g", value), r"(\.\d*?)0+$|\.0*$", "$1"))


def point_quality(source_sort: Column, lineage: Column, trace: Column, form: Column, filed_key: Column, point_key: Column, object_id: Column) -> Column:
    """Struct that orders the copies of a point: newest filing, traced, from a filing, of the exact period, then the id."""
    traced = F.when(lineage == "linked", 20).otherwise(0) + F.when(trace == "complete", 10).otherwise(0)
    filed = F.when(form.isin("10-K", "10-Q"), 5).otherwise(0)
    exact = F.when(filed_key == point_key, 5).otherwise(0)
    return F.struct(F.coalesce(source_sort, F.lit(0)).alias("a"), F.coalesce(traced, F.lit(0)).alias("b"), F.coalesce(filed, F.lit(0)).alias("c"), F.coalesce(exact, F.lit(0)).alias("d"), F.coalesce(object_id, F.lit("")).alias("e"))
