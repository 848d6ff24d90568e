"""Sharding by minimax contiguous partition, in DataFrame functions only.

Equal texts are the atomic groups, laid out in the order of a 64-bit hash of the
text.  The driver gets their sizes added up by the leading bits of the hash (at
most 2**16 bundles, whatever the input) and finds by binary search the smallest
capacity for which a greedy pass needs no more than ``shards`` shards.  Where a cut
may fall inside a bundle, that bundle alone is split by further bits, down to the
texts, until no smaller capacity is left: the capacity is that of the texts
themselves.  The cuts are literals of the plan, so that rows are assigned without a
join.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.shared import materialize

#: Bits of the hash that a step of splitting takes; the driver gathers at most 2**BITS sizes for each bundle that is split.
BITS = 16
#: Rows of a shard are numbered in independent cells of about so many, or of the square root of their number.
CELL = 1000
#: Cells (shard, cell, first slot: 16 bytes) that are broadcast; more are joined by a shuffle.
BROADCAST_CELLS = 200_000


def greedy_cuts(sizes: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """First group of each further shard when filling up to ``capacity``; None if it needs more shards."""
    ends, cuts, start, base = np.cumsum(sizes), [], 0, 0
    for _ in range(shards):
        start = int(np.searchsorted(ends, base + capacity, "right"))
        if start == len(sizes):
            return cuts
        if start and ends[start - 1] > base:
            base = int(ends[start - 1])
        elif sizes[start] > capacity:
            return None
        cuts.append(start)
    return None


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible shard capacity for ordered atomic ``sizes``, and the cuts.

    No sizes: capacity 0 and no cuts.  Ties go to the leftmost shard.
    """
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return 0, []
    low, high = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, greedy_cuts(sizes, low, shards)


def least_fluid(sizes: np.ndarray, atomic: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """Smallest capacity if groups that are not ``atomic`` could be cut anywhere, and those in which its cuts fall.

    No finer groups allow a smaller capacity.
    """
    ends = np.cumsum(sizes)
    total = int(ends[-1])

    def cut(capacity: int) -> list[int] | None:
        base, inside = 0, []
        for _ in range(shards):
            if base + capacity >= total:
                return inside
            g = int(np.searchsorted(ends, base + capacity, "right"))
            start = int(ends[g] - sizes[g])
            if not atomic[g] and base + capacity > start:
                inside.append(g)
                base += capacity
            elif start > base:
                base = start
            else:
                return None
        return None

    low, high = max(-(-total // shards), int(sizes[atomic].max(initial=0))), total
    while low < high:
        middle = (low + high) // 2
        if cut(middle) is None:
            low = middle + 1
        else:
            high = middle
    return low, cut(low)


def hash_cuts(slim: DataFrame, shards: int) -> list[int]:
    """First hash of each further shard, for rows with ``h`` (64-bit hash, in signed order) and ``size``."""

    def split(within: Column, bits: int) -> tuple[np.ndarray, np.ndarray]:
        key = F.shiftright("h", 64 - bits)
        found = slim.filter(within).groupBy(key.alias("key")).agg(F.sum("size").alias("size")).toPandas().sort_values("key")
        return found["key"].to_numpy(np.int64) << (64 - bits), found["size"].to_numpy(np.int64)

    first, sizes = split(F.lit(True), BITS)
    bits = np.full(len(first), BITS)
    while len(first):
        capacity, cuts = minimax_cuts(sizes, shards)
        least, inside = least_fluid(sizes, bits == 64, shards)
        if least == capacity or not inside:
            return [int(first[c]) for c in cuts]
        parts = [(np.delete(first, inside), np.delete(sizes, inside), np.delete(bits, inside))]
        for b in np.unique(bits[inside]).tolist():
            ranges = (F.col("h").between(low, low + (1 << (64 - b)) - 1) for low in first[inside][bits[inside] == b].tolist())
            h, n = split(reduce(or_, ranges), b + BITS)
            parts.append((h, n, np.full(len(h), b + BITS)))
        order = np.argsort(np.concatenate([p[0] for p in parts]))
        first, sizes, bits = (np.concatenate(x)[order] for x in zip(*parts, strict=True))
    return []


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    size is the text's UTF-8 bytes plus one (null text: no bytes, crc 0), whatever
    its length; the law is ``bytes``: shard sizes are as equal as contiguous cuts
    between groups of equal texts allow, so copies stay together (null is a text
    of its own).  Texts with one hash, which are equal but for one chance in
    2**64, are one group.  slot is gapless from 0 in a shard, ordered by cell, id
    and crc; rows with null or repeated ids are rows like others.  grown_shard is
    null under this law.  No rows: no rows.  Columns other than the id and the text
    are ignored, whatever their names.
    """
    text = F.col(text_col)
    raw = F.coalesce(text, F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    slim = materialize(slim, "shard-rows")
    shard = sum(((F.col("h") >= h).cast("int") for h in hash_cuts(slim, shards)), F.lit(0)).cast("int")
    total = slim.count()
    cells = total // (shards * max(CELL, math.isqrt(total // shards))) + 1
    cell = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells))
    rows = slim.select("doc_id", "size", "text_crc32", shard.alias("shard"), cell.alias("cell"))
    # only the cells' counts are added up in order
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    if cells * shards <= BROADCAST_CELLS:
        starts = F.broadcast(starts)
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32")
    numbered = rows.withColumn("n", F.row_number().over(inside) - 1).join(starts, ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("n")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
