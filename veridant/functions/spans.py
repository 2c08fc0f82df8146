"""Fixed windows and sentences of section texts, with exact offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"\S.*?(?:[.!?](?=\s|$)|$)", re.DOTALL)


def windows(text: str, most: int = 1200, least: int = 500, overlap: int = 150, hard: int = 1500) -> list[tuple[int, int]]:
    """Windows that end at the last sentence end within `most`, else at `most`; a tail under `least` joins the window before it if that stays within `hard`."""
    out, start = [], 0
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text):
            stops = [m.end() for m in re.finditer(r"[.!?](?=\s)", text[start:end])]
            if stops and stops[-1] >= least:
                end = start + stops[-1]
        out.append((start, end))
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    if len(out) > 1 and out[-1][1] - out[-1][0] < least and out[-1][1] - out[-2][0] <= hard:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def _explode(df: DataFrame, key: str, text: str, cut) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, a, b, t[a:b]) for k, t in zip(pdf[key], pdf[text], strict=True) for i, (a, b) in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=[key, "position", "start", "stop", "part"])

    return df.filter(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, position int, start int, stop int, part string")


def span_windows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, start, stop, part) of the windows of each text."""
    return _explode(df, key, text, windows)


def sentence_candidates(df: DataFrame, key: str, text: str, least: int = 60, most: int = 1200) -> DataFrame:
    """Sentences of `least` to `most` characters with their offsets."""
    return _explode(df, key, text, lambda t: [m.span() for m in _SENTENCE.finditer(t) if least <= m.end() - m.start() <= most])
