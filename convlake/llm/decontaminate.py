"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are looked for inside long documents.  Of a document only the
shingles that some item has can count, so each document is first reduced to
those, which no containment can lose; equal reduced sets become one.  The sets are
partitioned by size: within a size class an item's containment threshold gives a
least Jaccard similarity, and that the bands of the class, chosen so that a pair
at the threshold is missed with a probability of at most ``MISS``.  Where even the
longest signature can't promise that (items much smaller than what a document
shares with all items), an item's rarest shingles, so many that a pair at the
threshold shares one of them, are joined instead.  Candidates are verified by exact
containment of the shingles' texts.

Items of fewer than five words are one shingle, the whole item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlake.llm.langid import mix
from convlake.llm.texts import LOWER, as_strings, slices, text_bytes, words
from convlake.shared import materialize

WORDS, CONTAINMENT = 5, 0.8
#: Values of a signature, and the allowed probability to miss a pair at the threshold.
SIGNATURE, MISS = 256, 1e-6
#: Item shingles that one pass over the documents looks for.
VOCABULARY = 4_000_000

_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False
_SEEDS = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """The words of a slice of rows: runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters."""

    def __init__(self, part: pa.RecordBatch):
        data, at = text_bytes(part.column("text"))
        self.start, self.end, self.row = words(data, at, _BREAK)
        self.blob = LOWER[data].tobytes()
        self.hash = np.zeros(0, np.uint64)
        if len(self.start):
            coded = pc.dictionary_encode(as_strings(LOWER[data], self.start, self.end))
            self.hash = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]
        self.count = np.bincount(self.row, minlength=part.num_rows)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each run of n words of a row."""
        size = len(self.hash) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.full(size, n % WORDS, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.hash[k : size + k]
        whole = np.flatnonzero(self.row[:size] == self.row[n - 1 :])
        return mix(h[whole]), whole

    def text(self, first: int, n: int) -> str:
        return b" ".join(self.blob[a:b] for a, b in zip(self.start[first : first + n].tolist(), self.end[first : first + n].tolist(), strict=True)).decode()


GRAMS = "grams array<long>, texts array<string>"


def sets_of(part: pa.RecordBatch, keys: list[str], found: Words, h: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Sorted distinct hashes of each row that has any, and the shingles' texts in the same order."""
    row = found.row[first]
    order = np.lexsort((h, row))
    h, row, first, n = h[order], row[order], first[order], n[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row, first, n = h[new], row[new], first[new], n[new]
    some, begin = np.unique(row, return_index=True)
    at = pa.array(np.append(begin, len(h)), pa.int32())
    texts = [found.text(a, m) for a, m in zip(first.tolist(), n.tolist(), strict=True)]
    lists = [pa.ListArray.from_arrays(at, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(texts, pa.string()))]
    return pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(some)) for k in keys), *lists], names=[*keys, "grams", "texts"])


def item_sets(items: DataFrame, least_words: int) -> DataFrame:
    """item_id, words of a shingle, grams and texts of every item that has so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = Words(part)
                for n in range(least_words, WORDS + 1):
                    h, first = found.shingles(n)
                    own = found.count[found.row[first]]
                    fit = own == n if n < WORDS else own >= n
                    got = sets_of(part, ["item_id"], found, h[fit], first[fit], np.full(fit.sum(), n))
                    yield got.add_column(1, "words", pa.array(np.full(got.num_rows, n, np.int32)))

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, words int, {GRAMS}")


def reduced_sets(docs: DataFrame, vocabulary: np.ndarray, lengths: list[int]) -> DataFrame:
    """doc_id, mark, grams and texts of the documents that have shingles of the vocabulary (sorted, at most ``VOCABULARY``)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        low = np.uint64((1 << 22) - 1)
        maybe = np.zeros(1 << 22, bool)
        maybe[known & low] = True
        for batch in batches:
            for part in slices(batch):
                found, got = Words(part), []
                for n in lengths:
                    h, first = found.shingles(n)
                    near = np.flatnonzero(maybe[h & low])
                    near = near[known[np.minimum(np.searchsorted(known, h[near]), len(known) - 1)] == h[near]]
                    got.append((h[near], first[near], np.full(len(near), n)))
                h, first, n = (np.concatenate(x) for x in zip(*got, strict=True))
                if len(h):
                    yield sets_of(part, ["doc_id", "mark"], found, h, first, n)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, f"doc_id {kind}, mark long, {GRAMS}")


def bands(similarity: float, signature: int = SIGNATURE, miss: float = MISS) -> tuple[int, int] | None:
    """(bands, values of a band): the longest values that miss the similarity rarely enough; None if none do."""
    for rows in range(8, 0, -1):
        hit = min(similarity**rows, 1 - 1e-12)
        need = math.ceil(math.log(miss) / math.log1p(-hit))
        if need * rows <= signature:
            return need, rows
    return None


def least_similarity(item_class: int, set_class: int, containment: float = CONTAINMENT) -> float:
    """Jaccard similarity at the threshold of an item of [2^i, 2^(i+1)) and a set of [2^s, 2^(s+1)) shingles, at the worst."""
    small, large = 2**item_class, 2 ** (set_class + 1) - 1
    shared = math.ceil(containment * small)
    return min(1.0, shared / (small + max(large, shared) - shared))


def band_rows(sets: DataFrame, key: str, others: list[int], own_is_item: bool, containment: float) -> DataFrame:
    """(item class, set class, band, value, key) of each set against the size classes of the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("grams")
            keys, out = batch.column(key), []
            for r in range(batch.num_rows):
                g = np.asarray(lists[r].values.to_numpy()).view(np.uint64)
                signature = mix(g[None, :] ^ _SEEDS[:, None]).min(axis=1)
                own = len(g).bit_length() - 1
                for other in others:
                    i, s = (own, other) if own_is_item else (other, own)
                    if not pair_possible(i, s, containment) or (plan := bands(least_similarity(i, s, containment))) is None:
                        continue
                    count, width = plan
                    for b in range(count):
                        out.append((i, s, b, xxhash.xxh64_intdigest(signature[b * width : (b + 1) * width].tobytes()) - 2**63, r))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            plain = [pa.array(c, t) for c, t in zip(columns[:4], (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*plain, keys.take(pa.array(columns[4], pa.int64()))], names=["i", "s", "band", "value", key])

    kind = sets.schema[key].dataType.simpleString()
    return sets.select(key, "grams").mapInArrow(run, f"i int, s int, band int, value long, {key} {kind}")


def pair_possible(item_class: int, set_class: int, containment: float) -> bool:
    return 2 ** (set_class + 1) - 1 >= containment * 2**item_class


def rarest(items: DataFrame, sets: DataFrame, containment: float) -> DataFrame:
    """Pairs (item, key) that share one of an item's rarest shingles, in each size class of sets.

    A pair at the threshold lacks too few shingles of the item to lack all of
    these.  A shingle that most sets have is so joined for items without rarer ones only.
    """
    known = sets.groupBy("s", "gram").agg(F.count("*").alias("sets"))
    order = Window.partitionBy("item", "s").orderBy(F.coalesce("sets", F.lit(0)), "gram")
    ranked = items.join(known, ["s", "gram"], "left").withColumn("nth", F.row_number().over(order))
    probes = ranked.filter(F.col("nth") <= F.col("n") - F.ceil(containment * F.col("n") - 1e-9) + 1)
    return probes.select("item", "s", "gram").join(sets, ["s", "gram"]).select("item", "key").distinct()


def find_leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, vocabulary: int = VOCABULARY, least_words: int = 1) -> DataFrame:
    """doc_id, mark, item_id, n_item, n_shared and containment of every document that has enough of an item.

    An item is found if ``containment`` of its distinct five-word shingles, or
    more, stand anywhere in the document, whatever the length of that; an item of
    fewer words (``least_words`` at least) if it stands there whole.  Null texts
    and texts without words are never found.  ``mark`` is the 64-bit hash of the
    text: documents that share a doc_id (or have none) are told apart by it, and
    repeated rows are one.  Repeated item_ids are items of their own.  No documents
    or no items: no rows.  Columns other than doc_id, item_id and text are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    own = materialize(item_sets(items, least_words).withColumn("set", F.xxhash64("grams", "texts")), "items")
    known = own.select(F.explode("grams").alias("gram")).distinct()
    total = known.count()
    if not total:
        kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (items, "item_id"))}
        return spark.createDataFrame([], f"doc_id {kinds['doc_id']}, mark long, item_id {kinds['item_id']}, n_item long, n_shared long, containment double")
    lengths = sorted(r["words"] for r in own.select("words").distinct().collect())  # five at most
    passes = -(-total // vocabulary)
    found = []
    for k in range(passes):
        part = known.filter(F.pmod(F.xxhash64("gram"), F.lit(passes)) == k).toPandas()["gram"].to_numpy(np.int64).view(np.uint64)
        if len(part):
            found.append(reduced_sets(docs, np.sort(part), lengths))
    sets = reduce(DataFrame.union, found)
    if passes > 1:
        # the hashes and their texts, each once and in the order of the hashes
        both = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("grams", "texts")))))
        sets = sets.groupBy("doc_id", "mark").agg(both.alias("both")).select("doc_id", "mark", F.col("both.grams").alias("grams"), F.col("both.texts").alias("texts"))
    members = materialize(sets.distinct().withColumns({"set": F.xxhash64("grams", "texts"), "turned": F.xxhash64(F.reverse("texts"))}), "doc-sets")
    # copies and documents with the same passage are one set
    sets = materialize(members.groupBy("set", "turned").agg(F.first("grams").alias("grams"), F.first("texts").alias("texts")).withColumn("key", F.struct("set", "turned")), "sets")
    klass = lambda c: (F.length(F.bin(F.size(c))) - 1).cast("int")
    item_classes = [r[0] for r in own.select(klass("grams")).distinct().collect()]  # the logarithm of a text's length at most
    set_classes = [r[0] for r in sets.select(klass("grams")).distinct().collect()]
    lone = own.groupBy("set").agg(F.first("grams").alias("grams"), F.first("texts").alias("texts")).withColumnRenamed("set", "item")
    lone = materialize(lone, "item-sets")
    pairs = band_rows(lone, "item", set_classes, True, containment).join(band_rows(sets, "key", item_classes, False, containment), ["i", "s", "band", "value"]).select("item", "key").distinct()
    rest = [(i, s) for i in item_classes for s in set_classes if pair_possible(i, s, containment) and bands(least_similarity(i, s, containment)) is None]
    if rest:
        classes = spark.createDataFrame(rest, "i int, s int")
        few = lone.withColumn("i", klass("grams")).join(F.broadcast(classes), "i").select("item", "s", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
        many = sets.withColumn("s", klass("grams")).join(F.broadcast(classes.select("s").distinct()), "s").select("key", "s", F.explode("grams").alias("gram"))
        pairs = pairs.union(rarest(few, many, containment)).distinct()
    checked = pairs.join(lone.select("item", F.col("texts").alias("of_item")), "item").join(sets.select("key", "texts"), "key")
    checked = checked.select("item", "key.set", "key.turned", F.size("of_item").cast("long").alias("n_item"), F.size(F.array_intersect("of_item", "texts")).cast("long").alias("n_shared")).filter(F.col("n_shared") >= containment * F.col("n_item"))
    return members.select("doc_id", "mark", "set", "turned").join(checked, ["set", "turned"]).join(own.select(F.col("set").alias("item"), "item_id"), "item").select("doc_id", "mark", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` in which no item is found, columns as they are."""
    leaks = find_leaks(docs, items, containment).select(F.col("doc_id").alias("__leak_id"), F.col("mark").alias("__leak_mark")).distinct()
    same = docs["doc_id"].eqNullSafe(leaks["__leak_id"]) & (F.xxhash64(docs["text"]) == leaks["__leak_mark"])
    return docs.join(leaks, same, "left_anti")
