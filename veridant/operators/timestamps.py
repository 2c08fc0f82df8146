"""Mixed written times to one UTC instant, by a mixture of formats for each source.

A text may be readable in several formats: 1700000000000 is milliseconds of 2023 or
microseconds of 1970, 01/02/2024 is January or February. Each source is a mixture of
formats and of years. Expectation-maximisation re-estimates both from all values at once:
a value spreads its weight over its valid readings, in proportion to the share of the
format times the share of the year. The posterior picks the reading; a value whose best
posterior stays under `certain` is marked ambiguous instead of silently decided. A stated convention enters
as a prior, which the values of a source can outweigh.

Scale: values are reduced to counts of signatures (the set of formats and years a value
can mean) with map-side combination, so the iterations see a few thousand rows a source
however many values there are, and no group of values is ever gathered. The verdicts go
back by a join on the signature, broadcast after a count.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridant.functions.timeparse import time_candidates, utc_text
from veridant.session import cut_lineage, small_side

#: Years that a source's times lie in before anything is known of it; others have weight FAR.
PRIOR_YEARS = (1980, 2060)
FAR = 0.05
#: Values that each format counts for beforehand, where no convention is given.
PRIOR_VALUES = 1e-3
#: Bytes of a row of the fitted mixture, for the check before a broadcast.
FITTED_ROW = 200


def fit_format_mixture(counts: pd.DataFrame, convention: dict[str, float] | None = None, rounds: int = 50, tolerance: float = 1e-9) -> pd.DataFrame:
    """The mixture of one source, from its signature counts; the posterior of each reading.

    counts: columns source, signature (`fmt@year|fmt@year`), n; convention: how many values a
    format counts for before any is seen (a Dirichlet prior). Returns for each signature
    the format chosen, its posterior and that of the runner-up.
    """
    convention = convention or {}
    cases = [([tuple(x.rsplit("@", 1)) for x in s.split("|")], int(n)) for s, n in zip(counts["signature"], counts["n"], strict=True)]
    formats = sorted({f for readings, _ in cases for f, _ in readings})
    years = sorted({y for readings, _ in cases for _, y in readings})
    base = {y: 1.0 if PRIOR_YEARS[0] <= int(y) <= PRIOR_YEARS[1] else FAR for y in years}
    before = {f: convention.get(f, PRIOR_VALUES) for f in formats}
    even = {f: convention.get(f, 1.0) for f in formats}
    share = {f: v / sum(even.values()) for f, v in even.items()}
    year = {y: b / sum(base.values()) for y, b in base.items()}

    def posterior(readings: list[tuple[str, str]]) -> list[float]:
        p = [share[f] * year[y] for f, y in readings]
        return [x / sum(p) for x in p] if sum(p) > 0 else [1 / len(p)] * len(p)

    for _ in range(rounds):
        by_format, by_year = dict(before), {y: b * PRIOR_VALUES for y, b in base.items()}
        for readings, n in cases:
            for (f, y), p in zip(readings, posterior(readings), strict=True):
                by_format[f] += n * p
                by_year[y] += n * p * base[y]
        moved = max(abs(share[f] - v / sum(by_format.values())) for f, v in by_format.items())
        share = {f: v / sum(by_format.values()) for f, v in by_format.items()}
        year = {y: v / sum(by_year.values()) for y, v in by_year.items()}
        if moved < tolerance:
            break
    rows = []
    for (readings, _), source, signature in zip(cases, counts["source"], counts["signature"], strict=True):
        ranked = sorted(zip(posterior(readings), (f for f, _ in readings), strict=True), key=lambda x: (-x[0], x[1]))
        rows.append((source, signature, ranked[0][1], ranked[0][0], ranked[1][0] if len(ranked) > 1 else 0.0))
    return pd.DataFrame(rows, columns=["source", "signature", "chosen", "posterior", "runner_up"])


def resolve_times(df: DataFrame, source: str, text: str, zone: Column | None = None, convention: dict[str, float] | None = None, certain: float = 0.9) -> DataFrame:
    """`df` with utc_sec, utc_time, time_format, time_posterior, time_readings and time_ambiguous.

    source: the column whose values have a mixture each; text: the column of written times;
    zone: the zone of times written without one (UTC if not given). convention: formats with
    the number of values they count for beforehand, such as {"slash": 50} where dates with slashes put
    the month first unless a source shows otherwise. time_readings: how many different instants the text can
    mean; the mixture decides where there are several. Unreadable, empty, filler
    and null times get nulls and are not ambiguous. Rows are neither added nor dropped;
    equal rows stay. An existing column of one of the added names is replaced.

    The signatures are counted in one pass, which fits the mixtures, and looked up in another: the
    fitted rows are few, so the times are not shuffled unless their count is over the broadcast limit.
    """
    added = ["utc_sec", "utc_time", "time_format", "time_posterior", "time_readings", "time_ambiguous"]
    df = df.drop(*added)
    df = time_candidates(df, F.col(text), F.lit("UTC") if zone is None else zone, "__c", ("month_first", "day_first"))
    year = "cast(year(date_from_unix_date(cast(floor(x.sec / 86400) AS INT))) AS STRING)"
    df = df.withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    df = df.withColumn("__signature", F.expr(f"nullif(array_join(array_sort(transform(__c, x -> concat(x.fmt, '@', {year}))), '|'), '')"))
    counts = df.filter("__signature IS NOT NULL").groupBy(F.col("__source").alias("source"), F.col("__signature").alias("signature")).agg(F.count("*").alias("n"))
    fitted = counts.groupBy("source").applyInPandas(lambda pdf: fit_format_mixture(pdf, convention), "source string, signature string, chosen string, posterior double, runner_up double")
    fitted = cut_lineage(fitted.select(F.col("source").alias("__source"), F.col("signature").alias("__signature"), F.col("chosen").alias("time_format"), F.col("posterior").alias("time_posterior")))
    out = df.join(small_side(fitted, fitted.count(), FITTED_ROW), ["__source", "__signature"], "left")
    out = out.withColumn("utc_sec", F.expr("try_element_at(filter(__c, x -> x.fmt = time_format), 1).sec"))
    out = out.withColumns({"utc_time": utc_text(F.col("utc_sec")), "time_readings": F.expr("size(array_distinct(transform(__c, x -> x.sec)))")})
    out = out.withColumn("time_ambiguous", F.coalesce((F.col("time_posterior") < certain) & (F.col("time_readings") > 1), F.lit(False)))
    return out.drop("__c", "__source", "__signature")
