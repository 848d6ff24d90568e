"""Language identification with language-bitmask n-gram filters.

One Bloom filter for each language over the character n-grams of its sample, laid
out bit-sliced: a position of the table holds one bit for every language, so that
two probes give all languages that have an n-gram.  A text's hits are counted for
each language, corrected for the filter's false positives, and the largest share
decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.llm.texts import LOWER, as_strings, slices, text_bytes, words
from convlake.shared import materialize

N = 4
#: Documents of a language that are learned from, about: of more, a sample by hash.
PER_LANGUAGE = 3000
#: An n-gram enters a language's filter if this share of its sample has it, and two documents at least (one, in a sample of fewer than ``FEW``).
SHARE, FEW = 0.004, 20
#: Learned languages up to which their sampling rates are broadcast.
LANGUAGES = 4096
#: Positions of the table, as a power of two, and probes of an n-gram.
BITS, PROBES = 20, 2
#: Rows with a score below this are not taken for a text in any learned language.
LEAST_SCORE = 0.05

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = _NOT_LETTER[128:] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit mixing hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(distinct: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each word between blanks, and the word that each belongs to."""
    text = np.frombuffer("".join(f" {w} " for w in distinct).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.array([len(w) + 2 for w in distinct], np.int64)
    count = np.maximum(length - n + 1, 1)
    word = np.repeat(np.arange(len(distinct)), count)
    at = np.repeat(np.cumsum(length) - length, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    h, end = np.zeros(len(at), np.uint64), np.cumsum(length)[word]
    for k in range(n):
        inside = at + k < end
        h = h * np.uint64(0x100000001B3) + np.where(inside, text[np.minimum(at + k, max(len(text) - 1, 0))] if len(text) else 0, 0)
    return mix(h), word


def split_words(part: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-cased words of a batch, the words in order as indices, and their rows."""
    data, at = text_bytes(part.column("text"))
    start, end, row = words(data, at, _NOT_LETTER)
    coded = pc.dictionary_encode(as_strings(LOWER[data], start, end))
    return [w.decode("utf-8", "replace").lower() for w in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False), row


@dataclass(frozen=True)
class Model:
    """languages[i] has bit i of the table; false[i] is its filter's share of false positives."""

    languages: tuple[str, ...]
    table: np.ndarray
    false: np.ndarray

    def contains(self, h: np.ndarray) -> np.ndarray:
        """One column a language: whether its filter has each hash."""
        mask = self.table[(h >> np.uint64(64 - BITS)).astype(np.int64)]
        mask = mask & self.table[(h & np.uint64((1 << BITS) - 1)).astype(np.int64)]
        return np.unpackbits(np.ascontiguousarray(mask), axis=1, count=len(self.languages), bitorder="little")

    def judge(self, part: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
        """Language and score of each text of a batch."""
        rows = part.num_rows
        letters = pc.fill_null(pc.match_substring_regex(part.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages:
            return ["und"] * rows, np.zeros(rows)
        distinct, code, row = split_words(part)
        hits, n = np.zeros((rows, len(self.languages))), np.zeros(rows)
        if distinct:
            h, word = grams(distinct)
            at = np.searchsorted(word, np.arange(len(distinct)))
            per_word = np.add.reduceat(self.contains(h), at, axis=0, dtype=np.int64)
            size = np.bincount(word, minlength=len(distinct))
            n = np.bincount(row, weights=size[code], minlength=rows)
            for k in range(len(self.languages)):
                hits[:, k] = np.bincount(row, weights=per_word[code, k], minlength=rows)
        real = (hits - n[:, None] * self.false) / (1 - self.false)
        best = real.argmax(1)
        score = np.clip(real[np.arange(rows), best] / np.maximum(n, 1), 0, 1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, share: float = SHARE) -> Model:
    """Filters from text and lang of the rows of ``docs``; null texts and langs teach nothing.

    Of a language with more than ``per_language`` documents, about so many are
    taken, by a hash of the doc_id.  The table has a bit for each lang value, so
    these should be languages, some thousands at most; the driver gets no more n-grams than frequent
    ones of such samples (at most mean n-grams of a document / ``share`` for each
    language).  No usable rows: a model without languages.
    """
    rows = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    counts = materialize(rows.groupBy("lang").count().select("lang", F.least(F.lit(1.0), per_language / F.col("count")).alias("rate")), "languages")
    few = counts.count() <= LANGUAGES
    if few:
        counts = F.broadcast(counts)  # beyond that both sides are plain exchanges, of which Spark splits the large partitions
    sample = rows.join(counts, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("rate") * (1 << 20)).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                distinct, code, row = split_words(part)
                known, lang = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
                if distinct:
                    h, word = grams(distinct)
                    at = np.append(np.searchsorted(word, np.arange(len(distinct))), len(word))
                    for r in range(part.num_rows):
                        own = np.unique(code[np.searchsorted(row, r, "left") : np.searchsorted(row, r, "right")])
                        if len(own):
                            got = np.unique(np.concatenate([h[at[w] : at[w + 1]] for w in own]))
                            found.append((got, np.full(len(got), lang[r])))
                gram, of = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((gram, of))
                gram, of = gram[order], of[order]
                first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (of[1:] != of[:-1]))) if len(gram) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(gram)))
                yield pa.RecordBatch.from_arrays([pa.array(known[of[first]].tolist(), pa.string()), pa.array(gram[first].view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(known.tolist(), pa.string()), pa.nulls(len(known), pa.int64()), pa.array(np.bincount(lang, minlength=len(known)))], names=["lang", "gram", "n"])

    found = materialize(sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    least = found.filter("gram is null").select("lang", F.when(F.col("n") < FEW, 1.0).otherwise(F.greatest(F.lit(2.0), F.col("n") * share)).alias("least"))
    kept = found.filter("gram is not null").join(F.broadcast(least) if few else least, "lang").filter("n >= least").select("lang", "gram").toPandas()
    languages = tuple(sorted(r["lang"] for r in least.select("lang").collect()))
    table = np.zeros((1 << BITS, -(-len(languages) // 8)), np.uint8)
    for k, lang in enumerate(languages):
        h = kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        for at in (h >> np.uint64(64 - BITS), h & np.uint64((1 << BITS) - 1)):
            table[at.astype(np.int64), k // 8] |= np.uint8(1 << k % 8)
    fill = np.unpackbits(table, axis=1, count=len(languages), bitorder="little").mean(0) if languages else np.zeros(0)
    return Model(languages, table, np.minimum(fill**PROBES, 0.99))


def predict(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns: the language (``und``: null text or no letter) and a score from 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS positions of a byte for eight languages
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lang, value = sent.value.judge(part)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(value, pa.float64())], names=[*part.schema.names, pred, score])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    Learns from the rows that are not held out; their lang, the source and the
    doc_id are no inputs of a prediction.  Texts of any length are judged whole.
    Of languages that score alike the first by name is taken.  Null doc_ids are not
    held out; repeated rows are rows like others; no rows: no rows.  Other columns
    are ignored, whatever their names.
    """
    model = learn(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` in a learned language, columns as they are.

    Rejected are null texts, texts without a letter, and texts whose share of
    n-grams known to the best language is below ``least_score``.  If no language
    can be learned, only the first two are.
    """
    model = learn(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    judged = predict(docs, model, "__lang_pred", "__lang_score")
    return judged.filter((F.col("__lang_pred") != "und") & (F.col("__lang_score") >= least_score)).drop("__lang_pred", "__lang_score")
