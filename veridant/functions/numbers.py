"""Numbers in prose and their support by evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Scale words and their factors.
SCALES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "mn": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12}
_NUMBER = re.compile(
    r"(?P<open>\()?(?P<sign>[-−])?\s?(?P<cur>[$€£¥₹])?\s?(?P<num>\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s?(?P<unit>%|percent\b|percentage points?\b|basis points?\b|bps\b|thousand\b|million\b|billion\b|trillion\b|bn\b|mn\b|[kKmMbB]\b)?(?P<close>\))?"
)
_DATE = re.compile(r"\b(19|20)\d{2}\b|\b(?:item|note|page|section|exhibit)\s+\d+\w?|\d{1,2}/\d{1,2}/\d{2,4}", re.IGNORECASE)


def numeric_tokens(text: str) -> list[tuple[str, float, float]]:
    """(kind, value, tolerance) of the amounts, percentages and plain numbers; dates and labels are ignored."""
    ignored = [m.span() for m in _DATE.finditer(text)]
    out = []
    for m in _NUMBER.finditer(text):
        if any(a < m.end("num") and m.start("num") < b for a, b in ignored):
            continue
        v = float(m["num"].replace(",", ""))
        unit = (m["unit"] or "").lower()
        digits = len(m["num"].split(".")[1]) if "." in m["num"] else 0
        if m["sign"] or (m["open"] and m["close"]):
            v = -v
        if unit in ("%", "percent") or unit.startswith("percentage"):
            out.append(("percent", v, 0.05))
        elif unit in ("bps",) or unit.startswith("basis"):
            out.append(("percent", v / 100, 0.05))
        else:
            scale = SCALES.get(unit, 1.0)
            kind = "amount" if m["cur"] or scale > 1 else "number"
            out.append((kind, v * scale, max(0.01, 0.5 * 10**-digits * scale) if kind == "amount" else abs(v) * 1e-6))
    return out


def extract_numbers(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row per number of each text: key, position, kind, value, tolerance."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *n) for k, t in zip(pdf[key], pdf[text], strict=True) for i, n in enumerate(numeric_tokens(t))]
            yield pd.DataFrame(rows, columns=[key, "position", "kind", "value", "tolerance"])

    return texts.filter(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, position int, kind string, value double, tolerance double")


def unsupported_numbers(required: DataFrame, support: DataFrame, group: list[str]) -> DataFrame:
    """Required numbers without one of the same group and kind within tolerance.

    A band join made an equi-join: values fall into bins as wide as a power of two of the tolerance,
    and support is looked up in the bin and its neighbours.
    """
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("tolerance", F.lit(1e-9)))))
    r = required.withColumn("__w", width).withColumn("__bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("value") / F.col("__w")) + i)))
    s = support.select(*group, "kind", F.col("value").alias("__sv"))
    # few widths occur, as they are powers of two of the tolerances
    s = s.join(r.select(*group, "kind", "__w").distinct(), [*group, "kind"]).withColumn("__bin", F.floor(F.col("__sv") / F.col("__w")))
    hit = r.join(s, [*group, "kind", "__w", "__bin"]).filter(F.abs(F.col("value") - F.col("__sv")) <= F.col("tolerance"))
    return required.join(hit.select(*required.columns).distinct(), required.columns, "left_anti")
