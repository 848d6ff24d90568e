"""SimHash near-duplicate detection with tiled exact comparison.

Fingerprints are compared exactly: distinct ones are laid out by population count
into groups of bounded size, every pair of groups whose counts come within the
radius is one task, and a task goes through tiles with numpy's exclusive-or and
bit count, skipping tile pairs whose population counts differ beyond the radius.
A task returns a spanning forest of its links instead of the links, so that a
group of very many near copies is never written out as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm.texts import BLANK, LOWER, slices, text_bytes, words
from convlake.operators.components import components
from convlake.shared import materialize, release

WORDS, SEED, RADIUS = 4, 42, 4
#: Distinct fingerprints in a group: a sixteenth of all, within these bounds.
GROUPS, LEAST, MOST = 16, 1024, 1 << 17
#: Rows and columns of a tile.
TILE = (512, 2048)


def fingerprints(data: np.ndarray, at: np.ndarray, n: int = WORDS, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash of each row over its n-word shingles, repeats included.

    Fewer words than n: the whole sequence is the one shingle; no words: zero.  A
    bit is set if more than half of the shingle hashes have it.
    """
    rows = len(at) - 1
    out = np.zeros(rows, np.uint64)
    start, end, row = words(data, at)
    if not len(start):
        return out
    size = end - start
    # the words of all rows, each followed by one blank
    to = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size + 1, out=to[1:])
    text = np.full(to[-1], 32, np.uint8)
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(to[:-1], size) + offset] = LOWER[data[np.repeat(start, size) + offset]]
    blob = memoryview(text.tobytes())
    first = np.searchsorted(row, np.arange(rows), "left")
    count = np.searchsorted(row, np.arange(rows), "right") - first
    shingles = np.where(count, np.maximum(count - n + 1, 1), 0)
    begin = np.repeat(first, shingles) + np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = begin + np.repeat(np.minimum(count, n), shingles) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(blob[a:b], seed) for a, b in zip(to[begin].tolist(), (to[last] + size[last]).tolist(), strict=True)), np.uint64, len(begin))
    some = np.flatnonzero(shingles)
    where = np.cumsum(shingles[some]) - shingles[some]
    ones = np.add.reduceat(np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), where, axis=0, dtype=np.int32)
    bits = 2 * ones > shingles[some, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, mark (64-bit hash of id and text) and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = fingerprints(*text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(fp.view(np.int64))], names=["doc_id", "mark", "fp"])

    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, fp long")


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links within ``left``, or between ``left`` and ``right``."""
    both = left if right is None else np.concatenate([left, right])
    label = np.arange(len(both))

    def bit_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = np.bitwise_count(x).astype(np.int16)
        order = np.argsort(count, kind="stable")
        return order, x[order], count[order]

    a_order, a, a_count = bit_order(left)
    b_order, b, b_count = (a_order, a, a_count) if right is None else bit_order(right)
    shift = 0 if right is None else len(left)
    for i in range(0, len(a), TILE[0]):
        low, high = a_count[i] - radius, a_count[min(i + TILE[0], len(a)) - 1] + radius
        tile = a[i : i + TILE[0], None]
        begin = max(int(np.searchsorted(b_count, low, "left")), i if right is None else 0)
        for j in range(begin, int(np.searchsorted(b_count, high, "right")), TILE[1]):
            near = np.bitwise_count(tile ^ b[None, j : j + TILE[1]]) <= radius
            if right is None and j < i + TILE[0]:
                near[np.arange(i, min(i + TILE[0], len(a)))[:, None] >= np.arange(j, min(j + TILE[1], len(b)))[None]] = False
            hit = np.flatnonzero(near)
            if not len(hit):
                continue
            x = label[a_order[i + hit // near.shape[1]]]
            y = label[b_order[j + hit % near.shape[1]] + shift]
            apart = x != y
            if apart.any():
                pairs = np.unique(np.stack([np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])], 1), axis=0)
                merge(label, pairs)
    child = np.flatnonzero(label != np.arange(len(both)))
    return both[child], both[label[child]]


def merge(label: np.ndarray, pairs: np.ndarray) -> None:
    """Join the classes named in ``pairs``; every label stays the least index of its class."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for x, y in pairs.tolist():
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    to = np.arange(len(label))
    for x in parent:
        to[x] = find(x)
    label[:] = to[label]


def groups_of(counts: dict[int, int], size: int) -> list[tuple[int, int, int]]:
    """(lowest, highest population count, parts) of consecutive groups of about ``size`` fingerprints."""
    out: list[tuple[int, int, int]] = []
    low, have = None, 0
    for c in sorted(counts):
        if have and have + counts[c] > size:
            out.append((low, last, 1))
            low, have = None, 0
        if counts[c] > size:
            out.append((c, c, -(-counts[c] // size)))
        else:
            low, last, have = c if low is None else low, c, have + counts[c]
    if have:
        out.append((low, last, 1))
    return out


def meetings(nodes: DataFrame, radius: int = RADIUS, size: int | None = None) -> DataFrame:
    """fp, own (its group), g and h for every pair of groups (g <= h) that the group of ``fp`` is compared in.

    Groups of one range of population counts are numbered in a row, so that the
    partners of a group are a few ranges of numbers: the driver holds the ranges
    (65 at most, however many the groups), never the groups or their pairs.
    """
    bits = F.bit_count("fp")
    counts = {r["bits"]: r["count"] for r in nodes.groupBy(bits.alias("bits")).count().collect()}  # 65 rows at most
    size = size or min(MOST, max(LEAST, sum(counts.values()) // GROUPS))
    ranges, first = [], 0
    for low, high, parts in groups_of(counts, size):
        ranges.append((low, high, first, parts))
        first += parts
    near = lambda low, high: [(first, first + parts - 1) for other, top, first, parts in ranges if other - high <= radius and low - top <= radius]
    plan = nodes.sparkSession.createDataFrame([(c, first, parts, near(low, high)) for low, high, first, parts in ranges for c in range(low, high + 1)], "bits int, first int, parts int, near array<struct<a:int,b:int>>")
    own = (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int")
    placed = nodes.select("fp", bits.alias("bits")).join(F.broadcast(plan), "bits").select("fp", own.alias("own"), F.explode("near").alias("near"))
    dealt = placed.select("fp", "own", F.explode(F.sequence("near.a", "near.b")).alias("other"))
    return dealt.select("fp", "own", F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"))


def links(nodes: DataFrame, radius: int = RADIUS, size: int | None = None) -> DataFrame:
    """Edges (src, dst) whose components are those of all links between the distinct ``fp`` of ``nodes``."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g, h = key
        fp, own = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["own"].to_numpy()
        child, root = forest(fp, None, radius) if g == h else forest(fp[own == g], fp[own == h], radius)
        return pd.DataFrame({"src": child.view(np.int64), "dst": root.view(np.int64)})

    return meetings(nodes, radius, size).groupBy("g", "h").applyInPandas(run, "src long, dst long")


def roots_of(table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root (one fingerprint of its component) and least (its smallest doc_id) of every distinct fingerprint."""
    nodes = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = materialize(links(nodes, radius), "links")
    joined = components(edges)
    release(edges)
    roots = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    return materialize(roots, "roots")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    Documents link if their fingerprints differ in at most ``radius`` bits; the
    component is named by the smallest doc_id that is reached.  Null texts count
    as empty: fingerprint zero, linked like any other.  Rows with a null doc_id
    take part, but name no component (null if all of its rows are such).  Repeated
    rows are linked to each other.  No rows: no rows.  Columns other than doc_id
    and text are ignored, whatever their names.
    """
    table = materialize(fingerprint_table(docs), "fingerprints")
    roots = roots_of(table, radius)
    names = materialize(roots.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    classes = materialize(roots.join(names, "root").select("fp", "component_id"), "classes")
    return table.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with the columns as they are: that of the smallest doc_id.

    Rows with a null doc_id come last; among rows with the same doc_id and
    different texts one is kept by a hash, of repeated rows one.
    """
    table = materialize(fingerprint_table(docs), "fingerprints")
    roots = roots_of(table, radius)
    rows = table.join(roots.select("fp", "root"), "fp")
    kept = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark")).alias("kept"))
    kept = materialize(kept.select(F.col("kept.mark").alias("__kept")), "kept")
    return docs.withColumn("__mark", F.xxhash64("doc_id", "text")).join(kept, F.col("__mark") == F.col("__kept"), "left_semi").dropDuplicates(["__mark"]).drop("__mark")
