"""Oversized texts cut into overlapping pieces at lexical-cohesion valleys.

A text is divided into paragraphs; one that does not fit a piece next to the overlap is divided
into sentences, and such a sentence into words. Their ends are the places for cuts. At each place the
words before and after it, in blocks, are compared; valleys of the similarity mark changes
of topic, and in each window of sizes the deepest valley among the coarsest places is cut. Each piece then starts
`overlap` characters before the cut.

Scale: a text is one row and is cut where it is read, without a shuffle. Work is linear in its
length: block counts are taken at the places for cuts only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("paragraph", "sentence", "word")
_BLANK = re.compile(r"\n\s*\n")
_AFTER_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_BLANKS = re.compile(r"\s+")
_WORD = re.compile(r"[^\W_]+")
#: Texts whose blocks are counted together.
BATCH_TEXTS = 64
#: Words in each of the two blocks that are compared.
BLOCK_WORDS = 60


def _between(text: str, start: int, end: int, separator: re.Pattern) -> list[tuple[int, int]]:
    """Offsets of the non-blank parts of text[start:end] between separators, without blanks at their ends."""
    parts, a = [], start
    for m in [*separator.finditer(text, start, end), None]:
        b = m.start() if m else end
        part = text[a:b]
        inner = part.strip()
        if inner:
            lead = len(part) - len(part.lstrip())
            parts.append((a + lead, a + lead + len(inner)))
        a = m.end() if m else end
    return parts


def units(text: str, level: str) -> list[tuple[int, int]]:
    """Offsets of all paragraphs, sentences or words."""
    paragraphs = _between(text, 0, len(text), _BLANK)
    if level == "paragraph":
        return paragraphs
    separator = _AFTER_SENTENCE if level == "sentence" else _BLANKS
    return [u for a, b in paragraphs for u in _between(text, a, b, separator)]


def coarsest_boundary(text: str, most: int) -> tuple[str, list[tuple[int, int]]]:
    """The coarsest level all of whose units have at most `most` characters, with its units; else none."""
    found: list[tuple[int, int]] = []
    for level in LEVELS:
        found = units(text, level)
        if all(b - a <= most for a, b in found):
            return level, found
    return "none", found


def cut_places(text: str, most: int) -> dict[int, str]:
    """Level of each offset at which the text can be cut, in order; finer units only inside a unit of over `most` characters."""
    places: dict[int, str] = {}
    found = units(text, "paragraph")
    for level, separator in zip(LEVELS, (_AFTER_SENTENCE, _BLANKS, None), strict=True):
        for x in (x for u in found for x in u if 0 < x < len(text)):
            places.setdefault(x, level)
        if separator:
            found = [u for a, b in found if b - a > most for u in _between(text, a, b, separator)]
    return dict(sorted(places.items()))


def block_similarities(words: np.ndarray, begin: np.ndarray, end: np.ndarray, places: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Cosine of the counts of the BLOCK_WORDS words before and after each place of many texts.

    words: ids of the texts' words one after the other, different in different texts; begin, end: the words of each text;
    places: the word that follows each place, of: its text. Each pair of equal words less than two blocks apart counts for the
    places that have both in one block or one in each, so the work is linear in the number of words.
    """
    n, size = len(words), BLOCK_WORDS
    found = [np.flatnonzero(words[lag:] == words[:-lag]) for lag in range(1, min(2 * size, n))]
    i = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    j = i + np.repeat(np.arange(1, len(found) + 1), [len(f) for f in found])
    text = np.repeat(np.arange(len(begin)), end - begin)[i] if n else i
    low, high = begin[text], end[text]

    def count(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """At each place, the pairs with first <= place <= last."""
        some = first <= last
        change = np.bincount(first[some], minlength=n + 2) - np.bincount(last[some] + 1, minlength=n + 2)
        return np.cumsum(change)[places]

    near = j - i < size
    cross = count(np.maximum(i + 1, j - size + 1), np.minimum(j, i + size))
    left = count((j + 1)[near], np.minimum(i + size, high)[near])
    right = count(np.maximum(j - size + 1, low)[near], i[near])
    before, after = np.minimum(places - begin[of], size), np.minimum(end[of] - places, size)
    norm = np.sqrt((before + 2 * left) * (after + 2.0 * right))
    return np.where(norm > 0, cross / np.maximum(norm, 1e-12), 0.0)


def valley_depths(similarity: list[float]) -> list[float]:
    """Depth of the similarity valley at each place: how far it lies below the peaks on both sides."""
    n = len(similarity)
    peak_left, peak_right = similarity[:], similarity[:]
    # a peak is where similarity stops rising when walking away from the place
    for i in range(1, n):
        peak_left[i] = peak_left[i - 1] if similarity[i - 1] >= similarity[i] else similarity[i]
    for i in range(n - 2, -1, -1):
        peak_right[i] = peak_right[i + 1] if similarity[i + 1] >= similarity[i] else similarity[i]
    return [peak_left[i] + peak_right[i] - 2 * similarity[i] for i in range(n)]


def text_depths(texts: list[str], places: list[list[int]]) -> list[list[float]]:
    """Valley depths at the offsets `places` of each text."""
    ids, begin, end, at, known, words = [], [], [], [], 0, 0
    for text, where in zip(texts, places, strict=True):
        low = text.lower()
        found = [(m.start(), m.group()) for m in _WORD.finditer(low if len(low) == len(text) else text)]
        vocabulary: dict[str, int] = {}
        ids += [vocabulary.setdefault(w, known + len(vocabulary)) for _, w in found]
        known += len(vocabulary)
        begin.append(words)
        at.append(words + np.searchsorted(np.array([s for s, _ in found], dtype=np.int64), np.array(where, dtype=np.int64)))
        words += len(found)
        end.append(words)
    if not texts:
        return []
    of = np.repeat(np.arange(len(texts)), [len(w) for w in places])
    similarity = block_similarities(np.array(ids, dtype=np.int64), np.array(begin), np.array(end), np.concatenate(at).astype(np.int64), of).tolist()
    depths, k = [], 0
    for where in places:
        depths.append(valley_depths(similarity[k : k + len(where)]))
        k += len(where)
    return depths


def cut(text: str, limit: int, overlap: int, least: float = 0.5) -> tuple[str, list[tuple[int, int, str]]]:
    """`cut_many` of one text."""
    return cut_many([text], limit, overlap, least)[0]


def cut_many(texts: list[str], limit: int, overlap: int, least: float = 0.5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(coarsest boundary, pieces as (start, end, boundary at the end)) of each text; offsets are code points.

    Pieces have at most `limit` characters and each but the first starts exactly `overlap`
    characters before the end of the one before. A text within the limit is one piece. A word that
    does not fit is cut at the limit.
    """
    reach = limit - overlap
    long = [i for i, t in enumerate(texts) if len(t) > limit]
    levels = [cut_places(texts[i], reach) for i in long]
    depths = dict(zip(long, zip(levels, text_depths([texts[i] for i in long], [list(x) for x in levels]), strict=True), strict=True))
    return [(coarsest_boundary(t, reach)[0], _pieces(t, *depths[i], limit, overlap, least) if i in depths else [(0, len(t), "end")]) for i, t in enumerate(texts)]


def _pieces(text: str, levels: dict[int, str], depth: list[float], limit: int, overlap: int, least: float) -> list[tuple[int, int, str]]:
    reach = limit - overlap
    places, rank = list(levels), [LEVELS.index(k) for k in levels.values()]
    pieces, start, done, i = [], 0, 0, 0
    while len(text) - start > limit:
        end = (start if not pieces else done) + (limit if not pieces else reach)
        while i < len(places) and places[i] <= done:
            i += 1
        j = i
        best, last = None, None
        while j < len(places) and places[j] <= end:
            last = j
            if places[j] >= done + least * (end - done) and (best is None or (-rank[j], depth[j]) >= (-rank[best], depth[best])):
                best = j
            j += 1
        chosen = best if best is not None else last
        at, kind = (places[chosen], levels[places[chosen]]) if chosen is not None else (end, "none")
        if at <= overlap:
            at, kind = end, "none"
        pieces.append((start, at, kind))
        start, done = at - overlap, at
    pieces.append((start, len(text), "end"))
    return pieces


def split_texts(spans: DataFrame, span_id: str, text: str, section: str, start_char: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Pieces of all texts: id, section, piece_index, piece_count, offsets in the text and in the document.

    Columns: span_id, section_name, piece_index (from 0), piece_count, piece_start, piece_end (code points
    in the text), document_start, document_end (with start_char added; null if that is null), boundary,
    coarsest_boundary, piece_text. Null texts give no piece, an empty text one empty piece. Rows are not
    deduplicated.
    """
    schema = "span_id string, section_name string, piece_index int, piece_count int, piece_start int, piece_end int, document_start bigint, document_end bigint, boundary string, coarsest_boundary string, piece_text string"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            found = (x for at in range(0, len(pdf), BATCH_TEXTS) for x in cut_many(pdf["t"].iloc[at : at + BATCH_TEXTS].tolist(), limit, overlap))
            for i, t, s, o, (level, pieces) in zip(pdf["i"], pdf["t"], pdf["s"], pdf["o"], found, strict=True):
                at = None if pd.isna(o) else int(o)
                rows += [(i, s, k, len(pieces), a, b, None if at is None else at + a, None if at is None else at + b, kind, level, t[a:b]) for k, (a, b, kind) in enumerate(pieces)]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"document_start": "Int64", "document_end": "Int64"})

    one = spans.filter(F.col(text).isNotNull()).select(F.col(span_id).cast("string").alias("i"), F.col(text).alias("t"), F.col(section).alias("s"), F.col(start_char).cast("bigint").alias("o"))
    return one.mapInPandas(run, schema)
