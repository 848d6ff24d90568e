"""Best-fit packing of token sequences by large-item matching.

Which documents share a sequence depends on lengths alone, so the packing is
planned on the histogram of piece lengths: at most ``capacity`` counts, whatever
the number of documents.  The plan is a bounded list of patterns ("so many
sequences with pieces of these lengths"); each piece finds its sequence from its
rank among the pieces of its length.

Lengths above a third of the capacity are large: at most two fit in a sequence,
and they are matched greedily, the longest with the longest that still fits.
Smaller lengths then go, longest first, to the sequence with the least gap that
takes them.  A sequence keeps taking copies of a length while they fit, as
one-by-one best fit would.
"""

from __future__ import annotations

import math
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.llm.texts import slices, text_bytes
from convlake.shared import materialize

CAPACITY = 1024
END_ID = 2
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Distinct runs of text whose ids a Python worker remembers.
REMEMBERED = 150_000
#: Bytes of text that are encoded at once.
SLICE = 2 << 20
#: Pieces of one length are numbered in independent cells of about so many, or of the square root of their number.
CELL = 1000
#: Cells (length, cell, first rank: 20 bytes) that are broadcast; more are joined by a shuffle.
BROADCAST_CELLS = 200_000

PIECE_FIELDS = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]


# --- lengths to sequences ---------------------------------------------------


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a sequence, number of such sequences) that use every counted piece once."""
    left = {s: n for s, n in counts.items() if n > 0}
    bins: dict[int, list[tuple[list[int], int]]] = {}
    gaps: list[int] = []

    def put(pattern: list[int], n: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append((pattern, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        n = left[s]
        i = bisect_left(large, capacity - s + 1) - 1
        if i < 0:
            put([s], n)
            left[s] = 0
        elif (mate := large[i]) == s:
            if n // 2:
                put([s, s], n // 2)
            left[s] = n % 2
            if left[s]:
                if i:
                    put([s, large[i - 1]], 1)
                    left[large[i - 1]] -= 1
                    if not left[large[i - 1]]:
                        large.pop(i - 1)
                else:
                    put([s], 1)
                left[s] = 0
        else:
            both = min(n, left[mate])
            put([s, mate], both)
            left[s] -= both
            left[mate] -= both
            if not left[mate]:
                large.pop(i)
        if not left[s]:
            large.remove(s)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            i = bisect_left(gaps, s)
            if i == len(gaps):
                put([], -(-n // (capacity // s)))
                i = bisect_left(gaps, s)
            gap = gaps[i]
            pattern, have = bins[gap].pop()
            if not bins[gap]:
                del bins[gap], gaps[i]
            fit = gap // s
            full = min(have, n // fit)
            if full:
                put(pattern + [s] * fit, full)
                n -= full * fit
            if have > full and n:
                part = min(n, fit)
                put(pattern + [s] * part, 1)
                n -= part
                full += 1
            if have > full:
                put(pattern, have - full)
    return [(p, n) for group in bins.values() for p, n in group if p]


def plan_rows(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first sequence, offset): where the pieces of a length go by rank.

    Copies of a length in one pattern are neighbours: rank r of a row with c such
    copies is in sequence first + (r - first rank) div c.  To keep rows simple,
    each copy is a row of its own.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in patterns:
        at = 0
        for s in pattern:
            rank = used.get(s, 0)
            rows.append((s, rank, rank + n, sequence, at))
            used[s] = rank + n
            at += s
        sequence += n
    return rows


# --- texts to pieces ---------------------------------------------------------


def run_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets at which a byte-level BPE pre-tokenizer always begins a new token.

    These are the row starts; a lone space or newline between two other
    characters (and what follows the newline); and a punctuation mark other than
    an apostrophe after an ASCII letter or digit.  Next to non-ASCII blanks no cut
    is made.
    """
    n = len(data)
    if not n:
        return at[:-1][at[:-1] < n]
    odd = np.isin(data, np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8))
    low = data < 0x21
    before = np.zeros(n, bool)
    before[1:] = ~low[:-1]
    before[2:] &= ~odd[:-2]
    before[3:] &= ~odd[:-3]
    after = np.zeros(n, bool)
    after[:-1] = ~(low | odd)[1:]
    lone = before & after
    cut = lone & (data == 32)
    line = lone & (data == 10)
    cut |= line
    cut[1:] |= line[:-1]
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = True
    mark = np.zeros(256, bool)
    mark[list(b'.,!#$%&*|";:?@=()/')] = True
    cut[1:] |= mark[data[1:]] & word[data[:-1]]
    cut[at[:-1][at[:-1] < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Token ids of whole texts; runs of text that occur again are encoded once.

    The ids of remembered runs lie in one array; a dictionary gives their places.
    Runs beyond the bound of the memory are encoded each time they are met.  The
    tokenizer is used as its file says: where the string of an added token stands
    in a text, it gives that token.  Such a string is never cut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added if t.content]
        # tokens that take blanks or words beside them along: texts that hold one are encoded whole
        self.greedy = [t.content.encode() for t in added if t.content and (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.known: dict[bytes, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_runs(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct runs in one array, and each run's start and size there.

        A newline between two runs without blanks (but for a leading space) is a
        token of its own, so that many runs are encoded as one text and parted at
        those tokens; the others are encoded one by one.
        """
        texts = [k.decode("utf-8", "replace") for k in keys]
        cores = [t[1:] if t[:1] == " " else t for t in texts]
        plain = np.array([c.split() == [c] for c in cores], bool)
        if self.added:
            plain &= np.array([not any(a in k for a in self.added) for k in keys], bool)
        lines = np.flatnonzero(plain)
        joined = ["\n".join(texts[i] for i in lines[a : a + 500]) + "\n" for a in range(0, len(lines), 500)]
        single = np.flatnonzero(~plain)
        start, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        encode = lambda x: [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint32), *encode(joined)])
        ends = np.flatnonzero(flat == self.newline[0])
        start[lines] = np.append(0, ends[:-1] + 1)[: len(lines)]
        size[lines] = ends - start[lines]
        more = encode([texts[i] for i in single])
        size[single] = [len(x) for x in more]
        start[single] = len(flat) + np.cumsum(size[single]) - size[single]
        return np.concatenate([flat, *more]), start, size

    def apart(self, data: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``starts`` but for those inside the string of an added token (inside its whole row, if the token is greedy)."""
        blob, inside = data.tobytes(), None
        for token in self.added:
            i = blob.find(token)
            while i >= 0:
                row = int(np.searchsorted(at, i, "right")) - 1
                if i + len(token) <= at[row + 1]:
                    inside = np.zeros(len(data), bool) if inside is None else inside
                    a, b = (at[row], at[row + 1]) if token in self.greedy else (i, i + len(token))
                    inside[a + 1 : b] = True
                i = blob.find(token, i + 1)
        return starts if inside is None else starts[~inside[starts]]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and their n + 1 offsets."""
        starts = self.apart(data, at, run_starts(data, at))
        bounds = np.append(starts, len(data)).astype(np.int64)
        runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pc.dictionary_encode(runs)
        keys = coded.dictionary.to_pylist()
        place = np.array([self.known.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(place < 0)
        ids, start, size = self.encode_runs([keys[i] for i in new])
        place[new] = len(self.start) + np.arange(len(new))
        ids, start, size = np.concatenate([self.ids, ids]), np.concatenate([self.start, start + len(self.ids)]), np.concatenate([self.size, size])
        if len(start) <= REMEMBERED:
            self.known.update(zip((keys[i] for i in new), place[new].tolist(), strict=True))
            self.ids, self.start, self.size = ids, start, size
        pick = place[coded.indices.to_numpy(zero_copy_only=False)]
        long, first = size[pick], start[pick]
        to = np.zeros(len(pick) + 1, np.int64)
        np.cumsum(long, out=to[1:])
        return ids[np.repeat(first - to[:-1], long) + np.arange(to[-1])], to[np.searchsorted(starts, at)]


#: One encoder for each tokenizer file in a Python worker, which serves many tasks.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(tokenizer)
    for batch in batches:
        for part in slices(batch, most=SLICE):
            flat, to = encoder.encode(*text_bytes(part.column("text")))
            ends = np.array([end_id], np.uint32)
            rows: list[tuple[int, int, int, int, int]] = []
            for row in range(part.num_rows):
                ids = np.concatenate([flat[to[row] : to[row + 1]], ends])
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((row, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            docs = part.column("doc_id").take(pa.array(columns[0], pa.int64()))
            own = [pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([docs, *own], names=["doc_id", *(f.name for f in PIECE_FIELDS)])


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; only documents longer than a sequence are cut."""
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(lambda batches: cut_pieces(batches, tokenizer, capacity, end_id), T.StructType([docs.schema["doc_id"], *PIECE_FIELDS]))


def cells(n: int) -> int:
    """Cells for n pieces: their number and the pieces of each grow as the square root at most."""
    return -(-n // max(CELL, math.isqrt(n)))


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``pieces`` with their rank among those of their length, from 0, by cell, doc_id, piece and crc.

    The cells of a length grow in number with its pieces, so that no task takes a
    length whole; only the cells' own counts are added up in order.
    """
    spark = pieces.sparkSession
    fan = spark.createDataFrame([(n, cells(c)) for n, c in counts.items()], "length long, cells long")  # one row for each length
    pieces = pieces.join(F.broadcast(fan), "length").withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("cells"))).drop("cells")
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = pieces.groupBy("length", "cell").count().select("length", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    if sum(map(cells, counts.values())) <= BROADCAST_CELLS:
        firsts = F.broadcast(firsts)
    inside = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    return pieces.withColumn("n", F.row_number().over(inside) - 1).join(firsts, ["length", "cell"]).withColumn("rank", F.col("first") + F.col("n")).drop("cell", "n", "first")


def place(batches: Iterator[pa.RecordBatch], rows: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Sequence and offset of pieces from length and rank; ``rows`` is ordered by both."""
    lengths = np.unique(rows[:, 0])
    at = np.append(np.searchsorted(rows[:, 0], lengths), len(rows))
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        to = np.zeros(batch.num_rows, np.int64)
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            k = int(np.searchsorted(lengths, n))
            to[own] = at[k] + np.searchsorted(rows[at[k] : at[k + 1], 1], rank[own], "right") - 1
        sequence = rows[to, 3] + rank - rows[to, 1]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(rows[to, 4])], names=[*names, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with their sequence_id and offset.

    A null or empty text is its end id alone.  A text of any length is encoded
    whole and then cut: its last pieces are full sequences, the first takes the
    remainder.  Rows with null or repeated doc_id (of any type that can be
    ordered) are packed as documents of their own; pieces that tie in length and
    id are alike.  No documents: no rows.  Columns other than doc_id and text are
    ignored, whatever their names.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    # at most ``capacity`` counts
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    names = pieces.columns
    rows = np.array(sorted(plan_rows(plan(counts, capacity))), np.int64).reshape(-1, 5)
    # its size follows the patterns of the lengths, not the number of pieces
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked(pieces, counts).select(*names, "rank").mapInArrow(lambda batches: place(batches, sent.value, names), schema)
