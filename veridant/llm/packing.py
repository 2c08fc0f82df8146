"""Texts into containers of fixed capacity with little room left unused.

Sizes are tokens of a public tokenizer. A text is split only if it alone exceeds the
capacity: into full containers and a rest. The rest of the items are packed best-fit, largest first: an
item goes into the open container that it leaves the least room in. Several container sizes may be permitted; where a
container must be opened it is of the size whose share left unused by the items still waiting would be least, a larger one being preferred unless
a smaller one saves more than `SAVING` of the room, and in the end each container is downsized to the smallest permitted size that holds its contents.

Scale: only (id, size) is shuffled, never a text. Items are spread by a hash over shards of
about `shard_items`, packed independently; a shard wastes at most its last containers, so
the loss is one container in thousands however many shards there are. Packing works on the
counts of the sizes, of which there are at most as many as the capacity.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that the tokenizer parts texts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITIES = (256, 512, 1024, 2048)
#: Share of the room that a smaller container must save to be opened.
SAVING = 0.02


def count_tokens(documents: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of all non-null texts, by the ranks file `tokenizer` at that path on every executor.

    pattern parts a text before byte pairs are merged. Strings of special tokens are ordinary text.
    """
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({doc_id: pdf["d"], "n_tokens": [len(encoding.encode_ordinary(t)) for t in pdf["t"]]})

    return documents.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInPandas(run, f"{doc_id} {kind}, n_tokens int")


def pack_sizes(sizes: list[int], capacities: tuple[int, ...]) -> list[tuple[int, list[int]]]:
    """Containers (capacity, indexes of items) for sizes of at least 1 and at most the largest capacity.

    Items go largest first into the open container that they leave the least room in. Where none has the room, a
    container is opened of the permitted size that costs least: the share that the items still waiting would leave unused in it.
    """
    waiting: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        waiting.setdefault(s, []).append(i)
    present = sorted(waiting)
    capacities = tuple(sorted(capacities))

    def unused(room: int) -> int:
        """Room that would stay unused if waiting items, the largest that fit first, filled it; nothing is placed."""
        taken, top = {}, len(present)
        while room:
            top = bisect.bisect_right(present, room, 0, top)
            while top and taken.get(present[top - 1], 0) >= len(waiting[present[top - 1]]):
                top -= 1
            if not top:
                break
            s = present[top - 1]
            n = min(room // s, len(waiting[s]) - taken.get(s, 0))
            taken[s] = taken.get(s, 0) + n
            room -= n * s
        return room

    bins: list[list[int]] = []
    rooms: list[int] = []
    open_bins: dict[int, list[int]] = {}
    while present:
        s = present[-1]
        i = waiting[s].pop()
        if not waiting[s]:
            present.pop()
        at = bisect.bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            k = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
        else:
            costs = [(unused(c - s) / c, -c) for c in capacities if c >= s]
            # of sizes that cost about the same the largest, which takes more of what comes
            room = -min((c for cost, c in costs if cost <= min(costs)[0] + SAVING), default=-capacities[-1])
            k = len(bins)
            bins.append([])
        bins[k].append(i)
        left = room - s
        if left:
            if left not in open_bins:
                bisect.insort(rooms, left)
            open_bins.setdefault(left, []).append(k)
    held = [sum(sizes[i] for i in b) for b in bins]
    return [(next(c for c in capacities if c >= h), b) for h, b in zip(held, bins, strict=True)]


def pack_containers(items: DataFrame, item_id: str, size: str, capacities: tuple[int, ...] = CAPACITIES, shard_items: int = 20000, about: int | None = None) -> DataFrame:
    """Each item's place: container_id, capacity, item, part, part_start, part_size, position_in_container.

    A part is the whole item unless it exceeds the largest capacity. Items of null or zero size
    need no room and are left out. Item ids are taken as unique. `about` is the number of items, to
    set the number of shards by; if not given it is counted first, which computes the sizes twice.
    """
    biggest = max(capacities)
    sized = items.filter(F.col(size) > 0)
    shards = max(1, -(-(sized.count() if about is None else about) // shard_items))
    starts = F.sequence(F.lit(0), F.col(size) - 1, F.lit(biggest))
    parts = sized.select(item_id, F.col(size).alias("__n"), F.posexplode(starts).alias("part", "part_start"))
    parts = parts.select(item_id, F.col("part").cast("int"), F.col("part_start").cast("int"), F.least(F.lit(biggest), F.col("__n") - F.col("part_start")).cast("int").alias("part_size"))
    parts = parts.withColumn("shard", F.pmod(F.xxhash64(item_id, "part"), F.lit(shards)).cast("int"))
    kind = dict(items.dtypes)[item_id]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([item_id, "part"]).reset_index(drop=True)
        shard = int(pdf["shard"].iloc[0])
        rows = [(f"{shard:06d}-{k:06d}", c, i, p) for k, (c, held) in enumerate(pack_sizes(pdf["part_size"].tolist(), capacities)) for p, i in enumerate(held)]
        place = pd.DataFrame(rows, columns=["container_id", "capacity", "at", "position_in_container"])
        return pdf.loc[place["at"]].reset_index(drop=True).join(place)[["container_id", "capacity", item_id, "part", "part_start", "part_size", "position_in_container"]]

    return parts.groupBy("shard").applyInPandas(run, f"container_id string, capacity int, {item_id} {kind}, part int, part_start int, part_size int, position_in_container int")


def packing_summary(packed: DataFrame) -> DataFrame:
    """Containers, tokens and the share of room used, by capacity."""
    c = packed.groupBy("container_id", "capacity").agg(F.sum("part_size").alias("held"))
    return c.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("held").alias("tokens"), (F.sum("held") / F.sum("capacity")).alias("used_share"))
