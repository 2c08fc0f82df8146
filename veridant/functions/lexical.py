"""Words of texts as a search index sees them, as Catalyst expressions.

Texts are folded: letter case, diacritics and full-width forms are ignored. Words are runs of letters and digits of any script.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points with letters that decompose to a letter and marks, or to another form of a letter.
FOLDED_RANGES = ((0x00C0, 0x0250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F))
#: Words that carry no meaning in a question.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "how", "in", "is", "of", "on", "or", "that", "the", "to", "was", "were", "what", "which", "with")


@cache
def _folding() -> tuple[str, str]:
    """Characters and the single ones that they fold to, by Unicode decomposition."""
    pairs = []
    for low, high in FOLDED_RANGES:
        for c in map(chr, range(low, high)):
            base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x)).lower()
            if len(base) == 1 == len(c.lower()) and base != c.lower():
                pairs.append((c.lower(), base))
    pairs = dict(pairs)
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Text without letter case, diacritics and marks; null gives an empty text."""
    a, b = _folding()
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_replace(F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), a, b), r"\p{Mn}", "")


def words(text: Column) -> Column:
    """Folded runs of letters and digits; null gives an empty array."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def normal_text(text: Column) -> Column:
    """The words of a text with single blanks between."""
    return F.array_join(words(text), " ")


def word_runs(ws: Column, longest: int) -> Column:
    """All runs of 1 to `longest` words of an array column, joined by blanks, without repeats; give a column, as an expression is taken anew for each run."""
    runs = [F.transform(ws, lambda w, i: F.array_join(F.slice(ws, i + 1, F.lit(n)), " ")) for n in range(1, longest + 1)]
    kept = [F.slice(r, F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(0))) for n, r in enumerate(runs, 1)]
    return F.array_distinct(F.concat(*kept))


def character_pairs(text: Column) -> Column:
    """Distinct pairs of neighbouring characters of a folded text."""
    # split into characters first, so that the text is folded once
    cs = F.split(fold(text), "")
    pairs = F.transform(F.arrays_zip(F.slice(cs, F.lit(1), F.greatest(F.size(cs) - 1, F.lit(0))).alias("a"), F.slice(cs, F.lit(2), F.greatest(F.size(cs) - 1, F.lit(0))).alias("b")), lambda p: F.concat(p["a"], p["b"]))
    return F.filter(F.array_distinct(pairs), lambda p: F.length(p) == 2)


# --- terms of a question, which is a short text of the caller


def python_words(text: str) -> list[str]:
    """`words` of a question, on the driver; distinct, in order."""
    base = "".join(x for x in unicodedata.normalize("NFKD", text.lower().replace("ß", "ss")) if not unicodedata.combining(x)).lower()
    out, word = [], ""
    for c in [*base, " "]:
        if unicodedata.category(c)[0] in "LN":
            word += c
        elif word:
            out.append(word)
            word = ""
    return list(dict.fromkeys(out))


def query_terms(text: str) -> list[str]:
    """Distinct words of a question of more than one character, without stop words."""
    return [w for w in python_words(text) if len(w) > 1 and w not in STOP_WORDS]


def singular(word: str) -> str:
    """A word without a plural s where that is safe: from five letters on, not after i, o, s or u, and not sales or series."""
    return word[:-1] if len(word) >= 5 and word[-1] == "s" and word[-2] not in "iosu" and word not in ("sales", "series") else word


def prefix_terms(text: str) -> list[str]:
    """Distinct singular forms of the terms of a question, to be looked for as prefixes."""
    return list(dict.fromkeys(singular(w) for w in query_terms(text)))


def expand_terms(terms: list[str], synonyms: dict[str, list[str]]) -> list[str]:
    """The terms with their synonyms, in order and without repeats."""
    return list(dict.fromkeys(x for t in terms for x in [t, *synonyms.get(t, [])]))


def split_queries(text: str, limit: int = 12) -> list[list[str]]:
    """Smaller questions: words joined by underscores together, pairs of neighbours, single words; at most `limit`."""
    compounds = [query_terms(w.replace("_", " ")) for w in text.split() if "_" in w]
    terms = query_terms(text.replace("_", " "))
    parts = [*compounds, *([a, b] for a, b in zip(terms, terms[1:], strict=False)), *([t] for t in terms)]
    return [list(p) for p in dict.fromkeys(map(tuple, parts)) if p][:limit]


def or_terms(text: str, limit: int = 8) -> list[str]:
    """The first terms of a question, to be joined by or."""
    return query_terms(text)[:limit]


def scope_tokens(**scope: str) -> list[str]:
    """Tokens that stand for a scope in an index: ticker_x, doctype_y and the like."""
    return [f"{k}_{''.join(python_words(v))}" for k, v in scope.items() if v]


# Words of a question on a metric that name no dimension.
METRIC_WORDS = ("revenue", "sales", "income", "margin", "debt", "cash", "flow", "growth", "rate", "total", "net", "gross", "operating", "share", "year", "quarter", "annual", "quarterly", "company")


def metric_question(text: str) -> str:
    """A question on a metric in a plain form: words only, years and periods taken out, singular."""
    return " ".join(singular(w) for w in query_terms(text) if not (w.isdigit() and len(w) == 4) and not (w[:2] in ("fy", "cy") and w[2:6].isdigit()))


def dimension_anchors(text: str) -> list[str]:
    """The words of a question on a metric that may name a dimension: neither metric words nor years."""
    return [w for w in metric_question(text).split() if w not in METRIC_WORDS and not w.isdigit()]
