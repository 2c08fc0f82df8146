"""Evaluation items inside training texts: BM25 index of the items, block-max WAND, verification.

The items are indexed as an inverted index with BM25 impacts, postings in blocks with their
greatest impact. Training texts are cut into overlapping passages; a word that no item has can be in no
shared run, so passages are stretches of indexed words. Each passage is a
query, and WAND with block maxima retrieves all items that score at least the item's
threshold. The threshold of an item is the least score of any run of `words` words of it,
so no passage that holds such a run is lost. What is retrieved is verified word by word against the passage, and the
overlap with the item's question and answer is measured.

Scale: training texts are streamed through the index where they
are read, without a shuffle; a passage is as long as `passage` words whatever the text. The index of
up to `index_limit` bytes of items is broadcast, a size that is counted first. Larger test sets are split into parts by
item: each part is one more broadcast and one more pass over the texts, and the driver holds one part at a time.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
BLOCK = 16
#: Where the answer of an item begins; before it is the question, without it all is question.
ANSWER = re.compile(r"\b(?:answer|antwort|réponse|respuesta|solution)\s*:", re.IGNORECASE)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, letter case ignored."""
    return WORD.findall(text.casefold())


class ItemIndex:
    """BM25 inverted index over items, with block maxima and one threshold for each item.

    Items are numbered by increasing threshold, so that a bound under the threshold of one item is under those of all
    after it, and whole blocks can be skipped. `scored` counts the postings that were read for scores.
    """

    def __init__(self, items: list[tuple[int, str]], run: int) -> None:
        self.run = run
        self.scored = 0
        parts = [(i, words_of(t), ANSWER.search(t), t) for i, t in items]
        n = len(parts)
        mean = sum(len(ws) for _, ws, _, _ in parts) / max(n, 1) or 1.0
        held = Counter(w for _, ws, _, _ in parts for w in set(ws))
        idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in held.items()}
        self.term = {w: k for k, w in enumerate(sorted(held))}
        rows = []
        for i, ws, answer, t in parts:
            norm = K1 * (1 - B + B * len(ws) / mean)
            impact = {self.term[w]: idf[w] * f * (K1 + 1) / (f + norm) for w, f in Counter(ws).items()}
            ids = np.array([self.term[w] for w in ws], dtype=np.int32)
            runs = [sum(impact[k] for k in set(ids[s : s + run].tolist())) for s in range(len(ws) - run + 1)]
            spoken = set(words_of(t[: answer.start()])) if answer else set(ws)
            replied = set(words_of(t[answer.end() :])) if answer else set()
            of = lambda part: np.array(sorted(self.term[w] for w in part), dtype=np.int32)
            rows.append((min(runs, default=math.inf) * (1 - 1e-9), i, ids, impact, of(spoken), of(replied)))
        rows.sort(key=lambda r: (r[0], r[1]))
        self.threshold = [r[0] for r in rows]
        self.ids = [r[1] for r in rows]
        self.words = [r[2] for r in rows]
        self.question = [r[4] for r in rows]
        self.answer = [r[5] for r in rows]
        self.docs: list[list[int]] = [[] for _ in self.term]
        self.impacts: list[list[float]] = [[] for _ in self.term]
        for d, r in enumerate(rows):
            if r[0] < math.inf:
                for k, x in r[3].items():
                    self.docs[k].append(d)
                    self.impacts[k].append(x)
        starts = [range(0, len(x), BLOCK) for x in self.docs]
        self.block_last = [[x[min(i + BLOCK, len(x)) - 1] for i in s] for x, s in zip(self.docs, starts, strict=True)]
        self.block_max = [[max(x[i : i + BLOCK]) for i in s] for x, s in zip(self.impacts, starts, strict=True)]
        self.upper = np.array([max(x, default=0.0) for x in self.impacts] or [0.0])

    def retrieve(self, terms: list[int]) -> list[int]:
        """All items whose score for the distinct query terms reaches their threshold (block-max WAND)."""
        cursors = [[self.docs[t][0], 0, t] for t in terms if self.docs[t]]
        found: list[int] = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (doc, _, t) in enumerate(cursors):
                bound += self.upper[t]
                if bound >= self.threshold[doc]:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            # block maxima bound the score of `doc` and of all items up to the nearest block end
            tight, end = 0.0, math.inf
            for _, p, t in cursors[: pivot + 1]:
                block = bisect_left(self.block_last[t], doc, p // BLOCK)
                if block < len(self.block_last[t]):
                    tight += self.block_max[t][block]
                    end = min(end, self.block_last[t][block])
            if tight < self.threshold[doc]:
                to = end + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                cursors = self._forward(cursors, pivot + 1, to)
            elif cursors[0][0] == doc:
                self.scored += pivot + 1
                if sum(self.impacts[t][p] for _, p, t in cursors[: pivot + 1]) >= self.threshold[doc]:
                    found.append(doc)
                cursors = self._forward(cursors, pivot + 1, doc + 1)
            else:
                cursors = self._forward(cursors, pivot + 1, doc)
        return found

    def _forward(self, cursors: list[list[int]], count: int, to: float) -> list[list[int]]:
        """The cursors, the first `count` of them moved to the first item from `to` on; those at their end are dropped."""
        for c in cursors[:count]:
            if c[0] < to:
                docs = self.docs[c[2]]
                c[1] = bisect_left(docs, to, c[1])
                c[0] = docs[c[1]] if c[1] < len(docs) else -1
        return [c for c in cursors if c[0] >= 0]

    def shared_run(self, passage: np.ndarray, d: int) -> int:
        """Length of the longest run of words that the passage and item `d` share, in order."""
        same = passage[:, None] == self.words[d][None, :]
        length = np.zeros(same.shape[1] + 1, dtype=np.int32)
        best = 0
        for row in same:
            length[1:] = (length[:-1] + 1) * row
            best = max(best, int(length.max()))
        return best

    def passages(self, text: str, size: int) -> Iterator[np.ndarray]:
        """Stretches of indexed words of at least a run, in passages of `size` words that overlap by a run less one."""
        ids = [self.term.get(w, -1) for w in words_of(text)]
        if len(ids) < self.run:
            return
        terms = np.array(ids, dtype=np.int32)
        edges = np.flatnonzero(np.diff((terms >= 0).astype(np.int8), prepend=0, append=0))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            for s in range(a, b - self.run + 1, size - self.run + 1):
                yield terms[s : min(s + size, b)]

    def leaks(self, text: str, size: int) -> list[tuple[int, int, int, float, float | None]]:
        """(item id, passages that hold a run, longest run, greatest share of the question's and of the answer's words) of one text."""
        hits: dict[int, list] = {}
        for passage in self.passages(text, size):
            query = np.unique(passage)
            for d in self.retrieve(query.tolist()):
                run = self.shared_run(passage, d)
                if run >= self.run:
                    h = hits.setdefault(d, [0, 0, 0.0, 0.0 if len(self.answer[d]) else None])
                    h[0] += 1
                    h[1] = max(h[1], run)
                    for at, part in ((2, self.question[d]), (3, self.answer[d])):
                        if len(part):
                            h[at] = max(h[at], float(np.isin(part, query).mean()))
        return [(self.ids[d], *h) for d, h in hits.items()]


def find_leaks(
    documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, words: int = 12, passage: int = 48, index_limit: int = 8 << 20
) -> DataFrame:
    """(doc_id, item_id, passages, longest_run, question_overlap, answer_overlap) of each text that holds `words` consecutive words of an item.

    Words are runs of letters and digits; letter case and what stands between words are
    ignored. The overlaps are the greatest shares of the distinct words of the item's question and answer in one such
    passage; answer_overlap is null for items without a marked answer. Items or texts that are null, empty or shorter leak nothing. Repeated rows give
    one row. The items' text is counted first, in a job of its own; each part that is broadcast stays under
    `index_limit` bytes of text, unless a single item is longer.
    """
    spark = documents.sparkSession
    listed = items.filter(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).distinct()
    total = listed.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(total / (0.8 * index_limit))) if total > index_limit else 1
    columns = [doc_id, item_id, "passages", "longest_run", "question_overlap", "answer_overlap"]
    schema = f"{doc_id} {dict(documents.dtypes)[doc_id]}, {item_id} {dict(items.dtypes)[item_id]}, passages int, longest_run int, question_overlap double, answer_overlap double"
    texts = documents.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    out = None
    for part in range(parts):
        rows = sorted((r.i, r.t) for r in listed.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).collect())
        shipped = spark.sparkContext.broadcast(ItemIndex(rows, words))
        del rows

        def scan(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            index = shipped.value
            for pdf in batches:
                found = [(d, *leak) for d, t in zip(pdf["d"], pdf["t"], strict=True) for leak in index.leaks(t, passage)]
                yield pd.DataFrame(found, columns=columns).astype({"question_overlap": float, "answer_overlap": float})

        one = texts.mapInPandas(scan, schema)
        out = one if out is None else out.unionByName(one)
    # a NaN stands for no answer
    most = out.groupBy(doc_id, item_id).agg(*[F.max(c).alias(c) for c in columns[2:]])
    return most.withColumn("answer_overlap", F.nullif("answer_overlap", F.lit(float("nan"))))
