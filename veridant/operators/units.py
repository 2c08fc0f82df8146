"""Quantities in different units and scales to common ones, through an alias dictionary.

Distinct unit spellings, and distinct patterns of formatted values with the number taken
out, are split into atoms (`USD (000s)`: usd, 000). Currency codes, signs and magnitude letters are read exactly; any
word is sought among the unit and magnitude names, of which there is one for each unit: candidates from a character
bigram inverted index are verified by a weighted edit distance, in which abbreviations, plurals and slips are near. The resulting dictionary
(spelling, dimension, power of ten to the common unit) is joined to all rows.

Scale: only distinct spellings reach Python; the dictionary is written once, counted, and broadcast if it is small;
everything per row is a Catalyst expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridant.session import cut_lineage, small_side

# Currency codes and signs, and other signs, with dimension and power of ten to its common unit.
SYMBOLS: dict[str, tuple[str, int]] = {
    "usd": ("usd", 0), "us$": ("usd", 0), "$": ("usd", 0), "eur": ("eur", 0), "€": ("eur", 0), "inr": ("inr", 0), "₹": ("inr", 0), "jpy": ("jpy", 0), "¥": ("jpy", 0),
    "gbp": ("gbp", 0), "£": ("gbp", 0), "chf": ("chf", 0), "cny": ("cny", 0), "cad": ("cad", 0), "c$": ("cad", 0), "aud": ("aud", 0), "a$": ("aud", 0), "%": ("percent", 0),
}
# Magnitude letters and digits with their powers of ten.
MAGNITUDES: dict[str, int] = {"k": 3, "000": 3, "m": 6, "mm": 6, "b": 9, "t": 12}
# Prefixes of watt hours and their powers of ten to MWh.
WATT_HOURS: dict[str, int] = {"wh": -6, "kwh": -3, "mwh": 0, "gwh": 3, "twh": 6}
# Unit names, one for each unit, in full and singular; their other forms are found by the index.
UNIT_NAMES: dict[str, tuple[str, int]] = {
    "dollar": ("usd", 0), "euro": ("eur", 0), "rupee": ("inr", 0), "yen": ("jpy", 0), "sterling": ("gbp", 0), "franc": ("chf", 0), "yuan": ("cny", 0), "share": ("shares", 0),
    "percent": ("percent", 0), "percentage": ("percent", 0), "basispoint": ("percent", -2), "fraction": ("percent", 2), "ratio": ("percent", 2), "decimal": ("percent", 2),
    "watthour": ("energy", -6), "kilowatthour": ("energy", -3), "megawatthour": ("energy", 0), "gigawatthour": ("energy", 3), "terawatthour": ("energy", 6),
    "employee": ("employees", 0), "headcount": ("employees", 0), "staff": ("employees", 0), "person": ("employees", 0), "people": ("employees", 0),
}
# Magnitude names and their powers of ten.
MAGNITUDE_NAMES: dict[str, int] = {"hundred": 2, "thousand": 3, "tausend": 3, "lakh": 5, "million": 6, "crore": 7, "billion": 9, "trillion": 12}
# Words that say nothing about the unit.
FILLER_WORDS = ("in", "of", "the", "per", "and", "us", "total", "number", "at", "to", "a")

#: Largest weighted distance per letter of the name, and how much further any other meaning must be.
MAX_DISTANCE, MARGIN = 0.2, 0.004
#: Cost of what abbreviations leave out of a name: vowels and doubled letters, other letters; and of a plural ending.
LEFT_OUT_VOWEL, LEFT_OUT, PLURAL = 0.1, 0.2, 0.1


def bigrams(word: str) -> set[str]:
    return {f"^{word}$"[i : i + 2] for i in range(len(word) + 1)}


def weighted_distance(spelling: str, name: str) -> float:
    """Cost of writing `name` as `spelling`: letters left out are cheap, swaps of neighbours dearer, other letters dearest.

    A letter of the name that stands beside its like, or is a vowel, costs LEFT_OUT_VOWEL to leave out, others LEFT_OUT;
    a letter doubled or a vowel put in costs half, an s at the end PLURAL, any other letter put in or replaced 1.
    """
    vowel = "aeiouy"
    out = [LEFT_OUT_VOWEL if c in vowel or (i and name[i - 1] == c) else LEFT_OUT for i, c in enumerate(name)]
    put = [PLURAL if c in "s'" and i == len(spelling) - 1 else 0.5 if c in vowel or (i and spelling[i - 1] == c) else 1.0 for i, c in enumerate(spelling)]
    rows = [[0.0] * (len(name) + 1) for _ in range(len(spelling) + 1)]
    for i in range(len(spelling)):
        rows[i + 1][0] = rows[i][0] + put[i]
    for j in range(len(name)):
        rows[0][j + 1] = rows[0][j] + out[j]
    for i in range(len(spelling)):
        for j in range(len(name)):
            a, b = spelling[i], name[j]
            best = min(rows[i][j] + (0.0 if a == b else 0.7 if a in vowel and b in vowel else 1.0), rows[i][j + 1] + put[i], rows[i + 1][j] + out[j])
            if i and j and a == name[j - 1] and spelling[i - 1] == b:
                best = min(best, rows[i - 1][j - 1] + 0.6)
            rows[i + 1][j + 1] = best
    return rows[-1][-1]


class AliasIndex:
    """Character bigram inverted index over the unit and magnitude names; signs and letters are read exactly."""

    def __init__(self) -> None:
        self.exact = {k: ("unit", d, e) for k, (d, e) in SYMBOLS.items()} | {k: ("unit", "energy", e) for k, e in WATT_HOURS.items()} | {k: ("magnitude", "", e) for k, e in MAGNITUDES.items()}
        self.names = {k: ("unit", d, e) for k, (d, e) in UNIT_NAMES.items()} | {k: ("magnitude", "", e) for k, e in MAGNITUDE_NAMES.items()}
        self.postings: dict[str, list[str]] = {}
        for w in sorted(self.names):
            for g in bigrams(w):
                self.postings.setdefault(g, []).append(w)

    def lookup(self, atom: str) -> tuple[str, str, int, str] | None:
        """(kind, dimension, power, how) of one atom; how is sign or index. Null if no name, or more than one meaning, is near."""
        if atom in self.exact:
            return *self.exact[atom], "sign"
        if atom in FILLER_WORDS or len(atom) < 2:
            return None
        near = {w for g in bigrams(atom) for w in self.postings.get(g, ()) if w[0] == atom[0]}
        scored = sorted((weighted_distance(atom, w) / len(w), w) for w in near)
        if not scored or scored[0][0] > MAX_DISTANCE:
            return None
        best = self.names[scored[0][1]]
        if any(d - scored[0][0] < MARGIN and self.names[w] != best for d, w in scored[1:]):
            return None
        return *best, "index"

    def meaning(self, spelling: str) -> tuple[str | None, int | None, bool, str | None]:
        """(dimension, power of ten, says something, how) of a unit spelling; unknown atoms say nothing.

        how is index if any atom was found by the index, else sign.
        """
        text = spelling.lower().replace("basis point", "basispoint")
        text = re.sub(r"(kilo|mega|giga|tera)?watt[ -]?hour", lambda m: m.group(0).replace(" ", "").replace("-", ""), text)
        atoms = re.findall(r"us\$|[ac]\$|[$€₹¥£%]|'?000(?=s?\b)|[^\W\d_]+", text)
        dimension, power, ways = None, 0, set()
        for atom in atoms:
            found = self.lookup(atom.lstrip("'"))
            if found is None:
                continue
            ways.add(found[3])
            power += found[2]
            if found[0] == "unit" and dimension is None:
                dimension = found[1]
        return dimension, power if ways else None, bool(ways), min(ways) if ways else None


def unit_aliases(spellings: DataFrame, column: str) -> DataFrame:
    """Dictionary (spelling, dimension, power, named, found_by) of the distinct non-null spellings.

    power is the power of ten from the spelled unit to the common one; named is false, and
    power null, for a spelling that names no unit, magnitude or currency. found_by is index if the
    bigram index and the edit distance gave any part of the meaning, sign if signs and letters alone did.
    """

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = AliasIndex()
        for pdf in batches:
            found = [index.meaning(s) for s in pdf["spelling"]]
            yield pd.DataFrame(
                {"spelling": pdf["spelling"], "dimension": [f[0] for f in found], "power": pd.array([f[1] for f in found], dtype="Int32"), "named": [f[2] for f in found], "found_by": [f[3] for f in found]}
            )

    distinct = spellings.select(F.col(column).alias("spelling")).filter("spelling IS NOT NULL").distinct()
    return distinct.mapInPandas(resolve, "spelling string, dimension string, power int, named boolean, found_by string")


#: Bytes of a row of the alias dictionary, for the check before a broadcast.
ALIAS_ROW = 200
#: A number as written: digits with thousands commas, a decimal part, an exponent.
NUMBER = r"(\d[\d,]*(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)"


def written_number(text: Column) -> Column:
    """Absolute value of the first number in the text, or null."""
    return F.regexp_replace(F.regexp_extract(text, NUMBER, 1), ",", "").try_cast("double")


def written_pattern(text: Column) -> Column:
    """The text with its first number taken out: the spelling of its unit."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"^([^\d.]*){NUMBER}", "$1 "), r"\s+", " "))


def to_common_units(points: DataFrame, value: str, formatted: str, unit: str) -> DataFrame:
    """`points` with exp10 (int), common_value, unit_dimension, unit_evidence and unit_found_by.

    value x 10^exp10 is the value in the common unit. If the formatted text names a unit, a
    magnitude or a currency, it states the true quantity (rounded) and exp10 is the power of
    ten between it and the value; a number of zero there states no power. Else the unit
    column decides; if it is silent too, exp10 is null and evidence `none`. A null value has
    null exp10. Rows are neither added nor dropped; columns of the added names are replaced.
    """
    points = points.drop("exp10", "common_value", "unit_dimension", "unit_evidence", "unit_found_by")
    p = points.withColumns({"__pattern": written_pattern(F.col(formatted)), "__number": written_number(F.col(formatted))})
    spelled = p.select(F.explode(F.array("__pattern", unit)).alias("__s"))
    aliases = cut_lineage(unit_aliases(spelled, "__s"))
    aliases = small_side(aliases, aliases.count(), ALIAS_ROW)
    a = lambda prefix: aliases.select(F.col("spelling").alias(f"__{prefix}_s"), F.col("dimension").alias(f"__{prefix}_d"), F.col("power").alias(f"__{prefix}_p"), F.col("named").alias(f"__{prefix}_n"), F.col("found_by").alias(f"__{prefix}_by"))
    p = p.join(a("f"), F.col("__pattern") == F.col("__f_s"), "left").join(a("u"), F.col(unit) == F.col("__u_s"), "left")
    v = F.abs(F.col(value).cast("double"))
    true = F.col("__number") * F.pow(F.lit(10.0), F.col("__f_p"))
    states = F.col("__f_n") & (F.col("__number") > 0) & (v > 0)
    from_text = F.when(states, F.round(F.log10(true / v)).cast("int"))
    evidence = F.when(F.col(value).isNull(), "none").when(states, "text").when(F.col("__u_n"), "unit").otherwise("none")
    exp10 = F.when(F.col(value).isNotNull(), F.coalesce(from_text, F.when(F.col("__u_n"), F.col("__u_p"))))
    p = p.withColumns({"exp10": exp10, "unit_evidence": evidence, "unit_dimension": F.when(states, F.coalesce("__f_d", "__u_d")).otherwise(F.col("__u_d")), "unit_found_by": F.when(states, F.col("__f_by")).otherwise(F.col("__u_by"))})
    p = p.withColumn("common_value", F.col(value) * F.pow(F.lit(10.0), F.col("exp10")))
    return p.select(*[F.col(f"`{c}`") for c in points.columns], "exp10", "common_value", "unit_dimension", "unit_evidence", "unit_found_by")
