"""Scalar functions on labels, periods, sections and numbers, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_sort_key(period: Column) -> Column:
    """FY2024 and CY2024 give 20245, CY2024Q3 gives 20243, CY2024M03 gives 202403; else null."""
    year = F.regexp_extract(period, r"^(?:FY|CY)(\d{4})(?:[QM]\d{1,2})?$", 1)
    quarter, month = F.regexp_extract(period, r"^CY\d{4}Q([1-4])$", 1), F.regexp_extract(period, r"^CY\d{4}M(\d{2})$", 1)
    return F.when(quarter != "", F.concat(year, quarter)).when(month != "", F.concat(year, month)).when(period.rlike(r"^(FY|CY)\d{4}$"), F.concat(year, F.lit("5"))).try_cast("int")


def valid_period(period: Column) -> Column:
    return F.coalesce(period.rlike(r"^(FY\d{4}|CY\d{4}(Q[1-4]|M(0[1-9]|1[0-2]))?)$"), F.lit(False))


def section_key(name: Column) -> Column:
    """Canonical section of a spelled section name: item1, item1a, item7, ...; null if unknown."""
    slug = F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "")
    item = F.regexp_extract(F.lower(F.trim(name)), r"^item[ _.-]*(\d+[a-c]?)(?![a-z])", 1)
    # Titles that stand for an item.
    titles = {"business": "item1", "riskfactors": "item1a", "mda": "item7", "managementsdiscussionandanalysis": "item7", "financialstatements": "item8", "controls": "item9a", "controlsandprocedures": "item9a", "marketrisk": "item7a"}
    named = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv])
    return F.coalesce(F.try_element_at(named, slug), F.when(item != "", F.concat(F.lit("item"), item)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def scoped_id(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def compact_number(value: Column, unit: Column) -> Column:
    """$1.2B, $3.4M, $5.6K, 7.8%, or the number with its unit."""
    a = F.abs(value)
    usd = F.when(a >= 1e9, F.format_string("$%.1fB", value / 1e9)).when(a >= 1e6, F.format_string("$%.1fM", value / 1e6)).when(a >= 1e3, F.format_string("$%.1fK", value / 1e3)).otherwise(F.format_string("$%.0f", value))
    return F.when(F.upper(unit) == "USD", usd).when(F.lower(unit).isin("percent", "%"), F.format_string("%.1f%%", value)).otherwise(F.concat_ws(" ", F.format_number(value, 2), unit))


def metric_period_type(days: Column, spelled: Column | None = None) -> Column:
    """instant, quarter, ytd or annual: as spelled, else by the days covered (1, 70-115, 160-300, 330-400); else null."""
    by_days = F.when(days == 1, "instant").when(days.between(70, 115), "quarter").when(days.between(160, 300), "ytd").when(days.between(330, 400), "annual")
    if spelled is None:
        return by_days
    # Spellings of period types.
    names = {"annual": "annual", "year": "annual", "fy": "annual", "quarter": "quarter", "quarterly": "quarter", "three_months": "quarter", "year_to_date": "ytd", "ytd": "ytd", "instant": "instant"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), slug(F.coalesce(spelled, F.lit("")))), by_days)


def context_period(start: Column, end: Column, instant: Column) -> Column:
    """Struct (period_type, days, fiscal_year) of a fact's context: an instant is one day, a span both its ends."""
    days = F.when(instant.isNotNull(), F.lit(1)).otherwise(F.datediff(F.try_to_date(end), F.try_to_date(start)) + 1)
    return F.struct(metric_period_type(days).alias("period_type"), days.alias("days"), F.year(F.try_to_date(F.coalesce(instant, end))).alias("fiscal_year"))


def calendar_year(start: Column, end: Column) -> Column:
    """Whether a span is a whole calendar year: January 1 to December 31 of one year."""
    a, b = F.try_to_date(start), F.try_to_date(end)
    return F.coalesce((F.dayofyear(a) == 1) & (F.month(b) == 12) & (F.dayofmonth(b) == 31) & (F.year(a) == F.year(b)), F.lit(False))


def derived_period(start: Column, end: Column) -> Column:
    """CYyyyy for a whole calendar year, else FYyyyy of the year in which the span ends; null without an end."""
    year = F.year(F.try_to_date(end)).cast("string")
    return F.when(calendar_year(start, end), F.concat(F.lit("CY"), year)).otherwise(F.concat(F.lit("FY"), year))


def dimension_map(text: Column) -> Column:
    """Axes and members of a JSON object as a map of plain names: prefixes, Axis and Member are taken off; null without any."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"^.*[:#]", ""), r"(Axis|Member|Domain)$", "")
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    made = F.map_from_entries(F.array_sort(F.transform(F.filter(entries, lambda e: e.value.isNotNull()), lambda e: F.struct(plain(e.key).alias("key"), plain(e.value).alias("value")))))
    return F.when(F.cardinality(made) > 0, made)


def dimension_from_text(text: Column) -> Column:
    """The segment, product or region that a text names (`in the Europe segment`, `for Cloud products`); null if none."""
    named = F.regexp_extract(text, r"\b(?:in|for|of)\s+(?:the\s+|our\s+)?([A-Z][\w&-]*(?:\s+[A-Z][\w&-]*){0,3})\s+(?:segment|product|products|region|business)\b", 1)
    return F.nullif(named, F.lit(""))
