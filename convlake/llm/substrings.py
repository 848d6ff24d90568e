"""Exact removal of repeated substrings, by suffix buckets refined across the corpus.

Every window of ``LENGTH`` bytes is assigned to one of its q-grams: the leftmost
with the least hash.  Equal windows have equal q-grams, so these are the initial
buckets of all suffixes, and what two windows have in common is decided inside a
bucket.  Neighbouring windows with the same q-gram form one span, a row.

1. Buckets with a single row are done.
2. Equal spans of a bucket are reduced to the first of them; the others are
   repeats as a whole.
3. Buckets that still hold different spans are refined by bucket pointers: the
   suffixes of their bytes are sorted by the bucket identifiers of later offsets
   (8, 16, 32, 64 and 100 bytes deep), each pass using the identifiers of the one
   before and leaving buckets of one suffix alone.
4. A bucket with more different spans than a task should hold is refined in the
   same way by the cluster: its windows become rows with the identifiers of their
   q-grams, and each round makes the identifier of a greater depth from those of
   later offsets and leaves buckets of one window alone.

All keys are hashed; minima are pre-aggregated and joined back, both sides as
plain exchanges, so that the rows of a hot key may be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from convlake.llm.langid import mix
from convlake.llm.texts import slices, text_bytes
from convlake.shared import materialize, release

#: Bytes of a string whose repeats go, and of the q-gram that names its bucket.
LENGTH, Q = 100, 24
#: Different spans of a bucket that are refined in one task.
TOGETHER = 2048
#: Bytes of spans that are refined at once, but for a bucket with more.
CHUNK = 1 << 20
#: Bits of a place that hold the number of its windows; the others hold its first byte.
WINDOW_BITS = 16
NO_ID = 2**63 - 1

_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q bytes at each position that has so many."""
    out, have = None, 0
    power, width = _CODE[data], 1
    left = q
    while left:
        if left & 1:
            if out is None:
                out, have = power, width
            else:
                n = len(data) - have - width + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + power[have : have + n]
                have += width
        left >>= 1
        if left:
            n = len(data) - 2 * width + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            power = power[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width : width + n]
            width *= 2
    return mix(out[: max(0, len(data) - q + 1)])


def spans(data: np.ndarray, at: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket hash, first window, number of windows and row of every span."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none, none, none
    wide = length - q + 1
    h = gram_hashes(data, q)
    blocks = -(-len(h) // wide)
    key = np.full(blocks * wide, np.uint64(2**64 - 1))
    key[: len(h)] = h
    key = (key & ~np.uint64(127)).reshape(blocks, wide) | np.arange(wide, dtype=np.uint64)
    head = np.minimum.accumulate(key, axis=1).ravel()
    tail = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    size = np.maximum(np.diff(at) - length + 1, 0)
    p = np.repeat(at[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    a, b = tail[p], head[p + wide - 1]
    seven = np.uint64(127)
    first = (a >> np.uint64(7)) <= (b >> np.uint64(7))
    anchor = np.where(first, p - p % wide + (a & seven).astype(np.int64), p + wide - 1 - (p + wide - 1) % wide + (b & seven).astype(np.int64))
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
    start = np.flatnonzero(new)
    return h[anchor[start]], p[start], np.diff(np.append(start, len(p))), np.searchsorted(at, p[start], "right") - 1


def pack_place(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First byte and number of windows of a span in one number, ordered by the first byte."""
    return start << WINDOW_BITS | n


def start_of(place: Column) -> Column:
    return F.shiftright(place, WINDOW_BITS)


def span_rows(batches: Iterator[pa.RecordBatch], length: int, q: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            data, at = text_bytes(part.column("text"))
            h, start, n, row = spans(data, at, length, q)
            blob = memoryview(data.tobytes())
            digest = xxhash.xxh3_64_intdigest
            same = np.fromiter((digest(blob[a:b]) for a, b in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)), np.uint64, len(start))
            doc, mark = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "mark"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), same.view(np.int64), doc[row], mark[row], pack_place(start - at[row], n))], names=["bucket", "same", "doc", "mark", "place"])


def window_buckets(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For windows of ``length`` bytes at ``starts``: equal numbers for equal windows.

    Bucket-pointer refinement over all suffixes of ``data``: a bucket's identifier
    is the place of its first suffix in sorted order, so a refined bucket keeps
    its place and the identifiers of later offsets stay comparable.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    depth = min(8, length)
    gram = np.zeros(n, np.uint64)
    for k in range(depth):
        gram = gram << np.uint64(8) | padded[k : k + n]
    order = np.argsort(gram, kind="stable")
    pointer = np.empty(n, np.int64)
    pointer[order] = places(gram[order])
    while depth < length:
        step = min(depth, length - depth)
        size = np.bincount(pointer, minlength=n)
        many = np.flatnonzero(size[pointer] > 1)
        later = np.where(many + step < n, pointer[np.minimum(many + step, n - 1)] + 1, 0)
        key = pointer[many] * (n + 1) + later
        order = np.argsort(key, kind="stable")
        many, key = many[order], key[order]
        inside = places(key)
        base = places(pointer[many])
        pointer[many] = pointer[many] + inside - base
        depth += step
    return pointer[starts]


def places(ordered: np.ndarray) -> np.ndarray:
    """For each element of a sorted array, the place of the first equal one."""
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))


def refine(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated stretches (doc, mark, start, stop) of spans that come ordered by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) < CHUNK:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        bucket = table.column("bucket").to_numpy()
        cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
        if cut:
            yield from refined(table.slice(0, cut), length)
        held = table.slice(cut).to_batches()
    if held:
        yield from refined(pa.Table.from_batches(held), length)


def refined(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    data, at = text_bytes(table.column("bytes"))
    doc, mark, place = (table.column(c).to_numpy() for c in ("doc", "mark", "place"))
    n = place & (1 << WINDOW_BITS) - 1
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    kind = window_buckets(data, at[row] + step, length)
    # one number for both columns of a document, in their order
    by_doc = np.lexsort((mark, doc))
    other = np.ones(len(n), bool)
    other[1:] = (doc[by_doc][1:] != doc[by_doc][:-1]) | (mark[by_doc][1:] != mark[by_doc][:-1])
    owner = np.empty(len(n), np.int64)
    owner[by_doc] = np.cumsum(other)
    owner, start = owner[row], (place[row] >> WINDOW_BITS) + step
    order = np.lexsort((start, owner, kind))
    lead = order[places(kind[order])]
    again = np.zeros(len(order), bool)
    again[order] = (owner[order] != owner[lead]) | (start[order] != start[lead])
    hit = np.flatnonzero(again)
    if not len(hit):
        return
    # windows of one span that follow each other are one stretch
    new = np.ones(len(hit), bool)
    new[1:] = (row[hit][1:] != row[hit][:-1]) | (start[hit][1:] != start[hit][:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1
    of = row[hit[first]]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[of], mark[of], start[hit[first]], start[hit[last]] + length)], names=["doc", "mark", "start", "stop"])


STRETCH = "doc long, mark long, start long, stop long"
SPAN = "bucket long, same long, doc long, mark long, place long"


def later_copies(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """The first of each kind of equal spans (bucket, same), and the stretches of all others."""
    firsts = materialize(rows.groupBy("bucket", "same").agg(F.min(F.struct("doc", "mark", "place")).alias("first")).select("bucket", "same", "first.*"), "firsts")
    lead = firsts.select("bucket", "same", F.col("doc").alias("lead_doc"), F.col("mark").alias("lead_mark"), start_of("place").alias("lead_start"))
    start = start_of("place")
    others = rows.join(lead, ["bucket", "same"]).filter((F.col("doc") != F.col("lead_doc")) | (F.col("mark") != F.col("lead_mark")) | (start != F.col("lead_start")))
    return firsts, others.select("doc", "mark", start.alias("start"), (start + F.col("place").bitwiseAND((1 << WINDOW_BITS) - 1) + (length - 1)).alias("stop"))


def gram_offsets(length: int, q: int) -> list[int]:
    """Offsets of the q-grams that cover a window: one behind the other, the last at the window's end."""
    return [*range(0, length - q, q), length - q]


def refined_rows(windows: DataFrame, grams: int) -> DataFrame:
    """Windows of hot buckets (rows with the identifiers ``g`` of their q-grams) that are equal to others: bucket and same name each kind.

    Depth is up to three times that of the round before: an identifier is made from
    those of neighbouring parts, and only windows that share theirs with another go on.
    """
    made = [windows]
    while grams > 1:
        parts = [f"xxhash64({', '.join(f'g[{i}]' for i in range(k, min(k + 3, grams)))})" for k in range(0, grams, 3)]
        grams = len(parts)
        deeper = windows.withColumn("g", F.expr(f"array({', '.join(parts)})")).withColumn("bucket", F.xxhash64("bucket", "g")).withColumn("same", F.xxhash64("same", F.reverse("g")))
        many = deeper.groupBy("bucket", "same").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", "same")
        windows = materialize(deeper.join(many, ["bucket", "same"]), "windows")
        release(made.pop())
        made.append(windows)
    return windows


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (binary) of every row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier:
    in a smaller doc_id, or earlier in the same document.  Texts of any length are
    taken whole.  Null texts are empty; a null doc_id counts as the largest, and
    different texts with one doc_id (or none) are ordered by a 64-bit hash.  A row
    that is repeated starts nowhere earlier than its twin, so both are judged
    alike.  No rows: no rows.  Columns other than doc_id and text are ignored,
    whatever their names.  doc_id must be an integer, q less than length, and
    length - q at most 127: others raise ValueError.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise ValueError("doc_id must be an integer")
    if not 1 <= q < length or length - q > 127:
        raise ValueError("q must be less than length, and length - q at most 127")
    rows = docs.select("doc_id", "text").withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "mark": F.xxhash64("text")})
    found = materialize(rows.select("doc", "mark", "text").mapInArrow(lambda b: span_rows(b, length, q), SPAN), "spans")
    repeated = materialize(found.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "buckets")
    shared = materialize(found.join(repeated, "bucket"), "shared-spans")
    release(found)
    release(repeated)
    firsts, copies = later_copies(shared, length)
    stretches = [materialize(copies, "copies")]
    release(shared)

    kinds = materialize(firsts.groupBy("bucket").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "kinds")
    todo = firsts.join(kinds, "bucket").select("doc", "mark", F.struct("bucket", (F.col("kinds") > together).alias("hot"), "place").alias("span"))
    per_doc = todo.groupBy("doc", "mark").agg(F.collect_list("span").alias("spans"))
    offsets = gram_offsets(length, q)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes of each span; of hot buckets, the identifiers of the q-grams of each window."""
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                for doc, mark, text, wanted in zip(*(part.column(c).to_pylist() for c in ("doc", "mark", "text", "spans")), strict=True):
                    raw = text.encode()
                    for s in wanted:
                        start, n = s["place"] >> WINDOW_BITS, s["place"] & (1 << WINDOW_BITS) - 1
                        if not s["hot"]:
                            out.append((s["bucket"], doc, mark, s["place"], raw[start : start + n + length - 1], None))
                            continue
                        for k in range(start, start + n):
                            out.append((s["bucket"], doc, mark, k << WINDOW_BITS | 1, None, [signed(digest(raw[k + o : k + o + q])) for o in offsets]))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "doc", "mark", "place", "bytes", "g"])

    pieces = materialize(rows.select("doc", "mark", "text").join(per_doc, ["doc", "mark"]).select("doc", "mark", "text", "spans").mapInArrow(cut, "bucket long, doc long, mark long, place long, bytes binary, g array<long>"), "span-bytes")
    any_hot = not kinds.filter(F.col("kinds") > together).isEmpty()
    release(firsts)
    release(kinds)
    cold = pieces.filter("g is null").select("bucket", "doc", "mark", "place", "bytes")
    stretches.append(materialize(cold.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: refine(b, length), STRETCH), "refined"))
    if any_hot:
        hot = materialize(pieces.filter("g is not null").select("bucket", F.lit(0).cast("long").alias("same"), "doc", "mark", "place", "g"), "windows")
        stretches.append(later_copies(refined_rows(hot, len(offsets)).drop("g"), length)[1])
    release(pieces)

    gone = reduce(DataFrame.union, stretches)
    gone = gone.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    schema = docs.select("doc_id").schema
    kind = schema["doc_id"].dataType.simpleString()
    return rows.join(gone, ["doc", "mark"], "left").select("doc_id", "text", "gone").mapInArrow(keep_rest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def keep_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            data, at = text_bytes(part.column("text"))
            out = []
            for r, gone in enumerate(part.column("gone").to_pylist()):
                raw = data[at[r] : at[r + 1]].tobytes()
                kept, spans_, stop = [], 0, 0
                for a, b in sorted((g["start"], g["stop"]) for g in gone or ()):
                    if not spans_ or a > stop:
                        spans_ += 1
                        kept.append(raw[stop:a])
                        stop = b
                    else:
                        stop = max(stop, b)
                kept.append(raw[stop:])
                rest = b"".join(kept)
                out.append((len(raw), len(raw) - len(rest), spans_, hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
