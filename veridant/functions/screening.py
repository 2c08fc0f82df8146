"""Rules that keep or skip spans and recognise events in texts, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sections whose spans are kept, sections of exhibits, and lines that only name a part.
TARGET_SECTIONS = ("item1", "item1a", "item1c", "item7", "item7a", "item8", "part1_item1", "part1_item2", "part1_item3", "part1_item4", "part2_item1", "part2_item1a")
EXHIBIT_SECTIONS = ("item15", "item16", "part2_item6")
STRUCTURAL_LABELS = ("table of contents", "part i", "part ii", "part iii", "part iv", "signatures", "exhibits", "index")
# Words of a sentence worth a review.
QUOTE_WORDS = (
    "adverse", "affect", "risk", "uncertain", "competition", "competitive", "regulatory", "litigation", "supply", "supplier", "manufacturing", "inventory", "revenue", "sales", "net sales", "margin",
    "gross", "operating", "cost", "expense", "growth", "increased", "decreased", "cash", "liquidity", "capital", "expected", "anticipate", "believe", "may", "could", "material",
)
# Words that tell of an event, and words of each kind of event in the order in which they are tried.
EVENT_WORDS = ("executed", "entered into", "filed", "applied", "approved", "authorized", "achieved cod", "cod", "delayed", "terminated", "amended", "completed", "withdrew", "submitted", "appeal", "appeals")
EVENT_KINDS = {"approval_update": ("ferc", "doe", "approval", "authorization", "permit"), "project_execution_update": ("cod", "commercial operations", "deadline", "delay"), "contract_update": ("spa", "contract", "agreement", "executed", "entered into")}
#: Least and most characters of a sentence worth a review, and letters and digits of a span that is more than layout.
SENTENCE, LAYOUT = (60, 1200), 12
MONTH_YEAR = r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})\b"
_CONTENTS_LINE = r"(?i)^(item\s+\d{1,2}[a-z]?|part\s+[ivx]+)\b.+\s+\d{1,4}$"


def has_any(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def sentences(text: Column) -> Column:
    """Sentences of a text with its white space squeezed: parted before a capital, digit, quote or bracket."""
    return F.split(squeezed(text), r"""(?<=[.!?])\s+(?=[A-Z0-9"'(\[])""")


def worth_review(sentence: Column, core: Column) -> Column:
    return F.length(sentence).between(*SENTENCE) & (core | has_any(F.lower(sentence), QUOTE_WORDS))


def eligibility(text: Column, section: Column) -> Column:
    """Why a span is skipped, or why it is kept (core_section, has_quote_candidates); the first rule that applies."""
    plain = squeezed(text)
    low = F.lower(plain)
    label = F.regexp_replace(low, r"^[ .:\-]+|[ .:\-]+$", "")
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.size(F.filter(lines, lambda x: x.rlike(_CONTENTS_LINE)))
    contents = ((listed >= 3) & (listed * 2 >= F.size(lines))) | (low.startswith("table of contents") & (listed >= 2))
    core = F.coalesce(section.isin(*TARGET_SECTIONS), F.lit(False))
    candidates = F.size(F.filter(sentences(text), lambda s: worth_review(s, core)))
    return (
        F.when(plain == "", "empty_span")
        .when(F.length(F.regexp_replace(plain, r"[^\p{L}\p{N}]", "")) < LAYOUT, "layout_fragment")
        .when(contents, "toc_like")
        .when(label.isin(*STRUCTURAL_LABELS), "structural_label")
        .when(section == "cover", "cover_metadata")
        .when(has_any(low, ("/s/", "pursuant to the requirements of section")), "signature_or_certification_boilerplate")
        .when(section.isin(*EXHIBIT_SECTIONS), "exhibit_index_or_list")
        .when(candidates == 0, "no_quote_candidates")
        .when(core, "core_section")
        .otherwise("has_quote_candidates")
    )


def event_kind(text: Column) -> Column:
    """The kind of event that a text tells of; null if it tells of none."""
    low = F.lower(text)
    kind = reduce(lambda c, kv: c.when(has_any(low, kv[1]), kv[0]), list(EVENT_KINDS.items())[1:], F.when(has_any(low, next(iter(EVENT_KINDS.values()))), next(iter(EVENT_KINDS))))
    return F.when(has_any(low, EVENT_WORDS), kind.otherwise("business_update"))
