"""Metric series of a question: bundles, computed values, coverage, reservation, facts and derived metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of calculation that can be asked for.
AXES = ("value", "absolute_change", "growth_rate", "value_difference")


def period_index(year: Column, quarter: Column) -> Column:
    """A whole number in which periods that follow each other differ by 10, annual ones and quarters apart from each other."""
    return F.when(quarter.isNull(), year * 10).otherwise((year * 4 + quarter) * 10 + 1)


def window_gap(quarter: Column, window: str) -> Column:
    """Distance of period_index between the periods of a pair: adjacent, or a year apart."""
    return F.when(quarter.isNull(), 10).otherwise(10 if window == "period_over_period" else 40)


def metric_bundles(points: DataFrame, series: list[str], window: str | None = None, depth: int = 2) -> DataFrame:
    """(series, bundle, position, period, value, object_id): what answers a question about each series.

    The newest period with differing values is a `conflict` and comes whole; else, with a `window`, the newest compatible `pair`;
    else the `latest` periods, `depth` of them. points: series, fiscal_year, fiscal_quarter, period, value, source_sort_key,
    object_id. Null values are left out. Of equal values in a period the newest filing, then the greatest id counts.
    A series is one group of at most its calendar's periods.
    """
    context = [*series, "fiscal_year", "fiscal_quarter", "period"]
    values = points.filter("value IS NOT NULL").groupBy(*context, "value").agg(F.max(F.struct("source_sort_key", "object_id")).alias("f"))
    entry = F.struct("value", F.col("f.object_id").alias("object_id"), F.col("f.source_sort_key").alias("filed"))
    contexts = values.groupBy(*context).agg(F.array_sort(F.collect_list(entry)).alias("vs"))
    index = period_index(F.col("fiscal_year"), F.col("fiscal_quarter"))
    gap = window_gap(F.col("fiscal_quarter"), window or "period_over_period")
    one = F.struct(F.coalesce("fiscal_year", F.lit(0)).alias("y"), F.coalesce("fiscal_quarter", F.lit(0)).alias("q"), "period", index.alias("i"), (index - gap).alias("before"), "vs")
    s = contexts.groupBy(*series).agg(F.sort_array(F.collect_list(one), asc=False).alias("cs"))
    s = s.withColumn("conflicts", F.expr("filter(cs, c -> size(c.vs) > 1)"))
    paired = F.expr("filter(cs, c -> exists(cs, p -> p.i = c.before))") if window else F.expr("filter(cs, c -> false)")
    s = s.withColumn("pairs", paired)
    flat = lambda cs: F.flatten(F.transform(cs, lambda c: F.transform(c.vs, lambda v: F.struct(c.period.alias("period"), v.value.alias("value"), v.object_id.alias("object_id")))))
    pair = F.expr("array_append(slice(pairs, 1, 1), element_at(filter(cs, p -> p.i = element_at(pairs, 1).before), 1))")
    chosen = (
        F.when(F.size("conflicts") > 0, F.struct(F.lit("conflict").alias("bundle"), flat(F.slice("conflicts", 1, 1)).alias("rows")))
        .when(F.size("pairs") > 0, F.struct(F.lit("pair").alias("bundle"), flat(pair).alias("rows")))
        .otherwise(F.struct(F.lit("latest").alias("bundle"), flat(F.slice("cs", 1, depth)).alias("rows")))
    )
    s = s.select(*series, chosen.alias("b")).select(*series, "b.bundle", F.posexplode("b.rows").alias("position", "r"))
    return s.select(*series, "bundle", "position", "r.period", "r.value", "r.object_id")


def interleave(bundles: DataFrame, group: list[str], series: list[str], limit: int) -> DataFrame:
    """Rows of bundles in turns of their groups: (turn, row), conflicts first in a group; whole bundles until `limit` rows."""
    first = bundles.filter("position = 0").select(*series, (F.col("bundle") != "conflict").cast("int").alias("__late"), F.col("period").alias("__newest"))
    # places of the bundles of a group, by what can be counted without their rows
    sizes = bundles.groupBy(*series).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*group).orderBy("__late", F.col("__newest").desc(), *[F.col(c).asc_nulls_first() for c in series])
    b = first.join(sizes, series).withColumn("__start", F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return bundles.join(b.filter(F.col("__start") < limit).select(*series, "__start"), series).withColumn("turn", (F.col("__start") + F.col("position")).cast("int")).drop("__start")


def reconciled(points: DataFrame, keys: list[str]) -> DataFrame:
    """One value for each key: equal ones collapse, keys with differing values drop out; with the least and greatest source id."""
    v = points.filter("value IS NOT NULL").groupBy(*keys).agg(F.min("value").alias("value"), F.max("value").alias("__top"), F.min("object_id").alias("source_id"))
    return v.filter("value = __top").drop("__top")


def period_basis(period: Column) -> Column:
    """fiscal or calendar, annual or quarterly, of a period label; unknown if it is no such label."""
    convention = F.when(period.startswith("FY"), "fiscal").when(period.startswith("CY"), "calendar").otherwise("unspecified")
    cadence = F.when(period.rlike(r"\d{4}Q[1-4]"), "quarterly").otherwise("annual")
    return F.when(period.rlike(r"^(FY|CY)?(19|20)\d{2}(Q[1-4])?$"), F.concat_ws("_", convention, cadence)).otherwise("unknown")


def computed_values(points: DataFrame, axes: list[str], window: str, tickers: list[str] | None = None) -> DataFrame:
    """All calculations that the points support, each with the eleven parts it must agree in to be compared.

    points: ticker, metric, unit, currency, scope_key, metric_scope, duration, fiscal_year, fiscal_quarter, period, value,
    object_id. value: one per company and period; absolute_change and growth_rate: pairs of one series in the window, growth
    only from a positive to a non-negative value; value_difference: left less right of the requested companies, by name.
    """
    identity = ["metric", "unit", "currency", "scope_key", "metric_scope", "period_basis", "duration_basis"]
    p = points.withColumns({"period_basis": period_basis(F.col("period")), "duration_basis": F.coalesce("duration", F.lit("unknown"))})
    p = p.filter("fiscal_year IS NOT NULL AND metric IS NOT NULL AND ticker IS NOT NULL AND unit IS NOT NULL")
    r = reconciled(p, ["ticker", *identity, "period", "fiscal_year", "fiscal_quarter"])
    parts = []
    none = F.lit(None).cast("string")
    if "value" in axes:
        parts.append(r.select(F.lit("value").alias("kind"), *identity, none.alias("from_period"), "period", none.alias("calculation_window"), "ticker", none.alias("other_ticker"), "value"))
    if {"absolute_change", "growth_rate"} & set(axes):
        i = r.withColumn("i", period_index(F.col("fiscal_year"), F.col("fiscal_quarter"))).withColumn("before", F.col("i") - window_gap(F.col("fiscal_quarter"), window))
        if window != "year_over_year":
            i = i.filter("duration_basis != 'year_to_date'")
        prior = i.select("ticker", *identity, F.col("i").alias("before"), F.col("value").alias("previous"), F.col("period").alias("from_period"))
        j = i.join(prior, ["ticker", *identity, "before"])
        change = F.struct(F.lit("absolute_change").alias("kind"), F.col("unit").alias("u"), (F.col("value") - F.col("previous")).alias("v"))
        growth = F.when((F.col("previous") > 0) & (F.col("value") >= 0), F.struct(F.lit("growth_rate").alias("kind"), F.lit("ratio").alias("u"), ((F.col("value") - F.col("previous")) / F.col("previous")).alias("v")))
        wanted = [x for x, a in ((change, "absolute_change"), (growth, "growth_rate")) if a in axes]
        j = j.withColumn("x", F.explode(F.filter(F.array(*wanted), lambda x: x.isNotNull())))
        parts.append(j.select("x.kind", "metric", F.col("x.u").alias("unit"), *identity[2:], "from_period", "period", F.lit(window).alias("calculation_window"), "ticker", none.alias("other_ticker"), F.col("x.v").alias("value")))
    if "value_difference" in axes and tickers:
        # pairs of the companies asked for only
        a = r.filter(F.col("ticker").isin(tickers)).select(*identity, "period", "ticker", "value")
        b = a.select(*identity, "period", F.col("ticker").alias("other_ticker"), F.col("value").alias("other"))
        d = a.join(b, [*identity, "period"]).filter("ticker < other_ticker")
        parts.append(d.select(F.lit("value_difference").alias("kind"), *identity, none.alias("from_period"), "period", none.alias("calculation_window"), "ticker", "other_ticker", (F.col("value") - F.col("other")).alias("value")))
    return reduce(DataFrame.unionByName, parts)


ALIGNMENT = ["kind", "metric", "from_period", "period", "unit", "currency", "scope_key", "metric_scope", "period_basis", "duration_basis", "calculation_window"]


def calculation_coverage(values: DataFrame, asked: DataFrame, tickers: list[str]) -> DataFrame:
    """(metric, axis, status, covered): for each metric and axis asked for, covered, partial or missing.

    A group of values that agree in all parts of ALIGNMENT is complete if it has every company, and for differences every pair of
    them. covered: the most companies of the request in one group.
    """
    wanted = F.array(*[F.lit(t) for t in tickers])
    named = F.filter(F.array("ticker", "other_ticker"), lambda t: t.isNotNull())
    g = values.groupBy(*ALIGNMENT).agg(F.array_distinct(F.flatten(F.collect_set(named))).alias("ts"), F.count_if(F.col("ticker").isin(tickers) & F.col("other_ticker").isin(tickers)).alias("pairs"))
    held = F.size(F.array_intersect("ts", wanted))
    pairs = len(tickers) * (len(tickers) - 1) // 2
    complete = (held == len(set(tickers))) & ((F.col("kind") != "value_difference") | ((F.col("pairs") >= pairs) & F.lit(len(tickers) > 1)))
    best = g.select("metric", F.col("kind").alias("axis"), held.alias("held"), complete.alias("complete")).groupBy("metric", "axis").agg(F.max("held").alias("covered"), F.max("complete").alias("complete"))
    status = F.when(F.col("covered").isNull(), "missing").when(F.col("complete"), "covered").otherwise("partial")
    return asked.join(best, ["metric", "axis"], "left").select("metric", "axis", status.alias("status"), F.coalesce("covered", F.lit(0)).alias("covered"))


def filing_bucket_order(rows: DataFrame, requested: list[str], filing_period: str, period: str) -> Column:
    """0 for rows whose own filing is of a requested period, 1 for those that only observe it, 2 for others."""
    r = F.array(*[F.lit(x) for x in requested])
    return F.when(F.array_contains(r, F.col(filing_period)), 0).when(F.array_contains(r, F.col(period)), 1).otherwise(2)


def reserve_periods(rows: DataFrame, requested: list[str], period: str, rank: str, limit: int, quota: int = 2) -> DataFrame:
    """The best `limit` rows, in which each requested period keeps up to `quota` if at least two of the periods have rows.

    rank: a unique whole number, 1 best. Rows that are brought in come first, in order, and displace the lowest rows that are
    not of a requested period. The pool that matters is the window and `quota` rows for each period: nothing else is kept.
    """
    asked = F.col(period).isin(requested)
    inside = Window.partitionBy(period).orderBy(rank)
    r = rows.withColumns({"__asked": asked, "__place": F.row_number().over(inside)})
    r = r.filter((F.col(rank) <= limit) | (asked & (F.col("__place") <= quota)))
    present = r.filter("__asked").agg(F.countDistinct(period)).scalar()
    r = r.withColumns({"__base": F.col(rank) <= limit, "__enough": present >= 2})
    # at most the window and the quotas of the periods
    everything = Window.partitionBy(F.lit(1))
    brought = ~F.col("__base") & F.col("__enough")
    free = F.greatest(F.lit(limit) - F.count_if("__base").over(everything), F.lit(0))
    droppable = F.col("__base") & ~F.col("__asked")
    r = r.withColumns({"__new": brought, "__drop": droppable})
    r = r.withColumns({"__free": free, "__droppable": F.count_if("__drop").over(everything), "__order": F.row_number().over(Window.partitionBy("__new").orderBy(rank)), "__from_end": F.row_number().over(Window.partitionBy("__drop").orderBy(F.col(rank).desc()))})
    r = r.withColumn("__accepted", F.col("__new") & (F.col("__order") <= F.col("__free") + F.col("__droppable")))
    lost = F.greatest(F.count_if("__accepted").over(everything) - F.col("__free"), F.lit(0))
    r = r.withColumn("__lost", lost)
    kept = r.filter(F.col("__accepted") | (F.col("__base") & ~(F.col("__drop") & (F.col("__from_end") <= F.col("__lost")))))
    return kept.withColumn("reserved", F.col("__accepted")).drop(*[c for c in kept.columns if c.startswith("__")])


def best_facts(facts: DataFrame, keys: list[str], tags: dict[str, int], units: dict[str, int]) -> DataFrame:
    """The fact that stands for each key: without dimensions, by rank of its tag, then of its unit, then newest filing, then id."""
    rank = lambda m, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(c)), F.lit(len(m)))
    order = F.struct((-rank(tags, "tag")).alias("t"), (-rank(units, "unit")).alias("u"), "source_sort_key", "object_id")
    f = facts.filter("scope_kind = 'company' AND value IS NOT NULL")
    return f.groupBy(*keys).agg(F.max(F.struct(order.alias("o"), "value", "unit", "tag")).alias("b")).select(*keys, "b.value", "b.unit", "b.tag", F.col("b.o.object_id").alias("object_id"))


def derived_metrics(values: DataFrame, keys: list[str], ratios: dict[str, tuple[str, str]], differences: dict[str, tuple[str, str]]) -> DataFrame:
    """(keys, metric, value, first_input, second_input) of ratios and differences of two metrics of the same key.

    One pass: the inputs of a key are pivoted by conditional aggregates. A ratio needs a denominator that is not zero.
    """
    needed = sorted({m for pair in [*ratios.values(), *differences.values()] for m in pair})
    wide = values.filter(F.col("metric").isin(needed)).groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"__{m}") for m in needed], *[F.max(F.when(F.col("metric") == m, F.col("object_id"))).alias(f"__id_{m}") for m in needed])
    made = []
    for name, (a, b) in ratios.items():
        made.append(F.struct(F.lit(name).alias("metric"), F.when(F.col(f"__{b}") != 0, F.col(f"__{a}") / F.col(f"__{b}")).alias("value"), F.col(f"__id_{a}").alias("first_input"), F.col(f"__id_{b}").alias("second_input")))
    for name, (a, b) in differences.items():
        made.append(F.struct(F.lit(name).alias("metric"), (F.col(f"__{a}") - F.col(f"__{b}")).alias("value"), F.col(f"__id_{a}").alias("first_input"), F.col(f"__id_{b}").alias("second_input")))
    return wide.select(*keys, F.inline(F.array(*made))).filter("value IS NOT NULL")


def yearly_growth(values: DataFrame, keys: list[str], single: bool) -> DataFrame:
    """Growth of each year over the one exactly before, in percent of the absolute base; a base of zero gives none.

    With `single`, only years that hold exactly one distinct value of their key count; else every pair of values does not
    arise, as the greatest value stands for its year.
    """
    y = values.filter("value IS NOT NULL AND fiscal_year IS NOT NULL").groupBy(*keys, "fiscal_year").agg(F.max("value").alias("value"), F.countDistinct("value").alias("n"))
    if single:
        y = y.filter("n = 1")
    prior = y.select(*keys, (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("value").alias("previous"))
    return y.join(prior, [*keys, "fiscal_year"]).filter("previous != 0").select(*keys, "fiscal_year", ((F.col("value") - F.col("previous")) / F.abs("previous") * 100).alias("growth_percent"))
