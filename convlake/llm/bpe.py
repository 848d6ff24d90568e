"""Byte-level BPE with word ends: texts to token ids and back.

The words of many texts are merged together.  Their symbols lie in one flat
array; in each round every word merges its lowest-ranked pair at all places, and
ranks are looked up by binary search over the sorted keys of all pairs.  Only
pairs beside a merge are looked up again, and finished words leave the arrays.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from convlake.llm.texts import ragged, slices

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Bytes of text that are worked on at once.
SLICE = 1 << 19
#: Distinct words whose ids a Python worker remembers; others are merged again when they are met.
REMEMBERED = 100_000
#: Characters after which a long text is cut at the next ASCII blank; no word or composed character crosses one.
PIECE = 1 << 19
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter for each byte: printable Latin-1 characters stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """``text`` in parts, cut before an ASCII blank once they are longer than ``most``."""
    at = 0
    while at < len(text):
        m = regex.compile("[ \t\n\r]").search(text, at + most)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def lowered(text: str) -> str:
    """Lower case character by character: no form depends on its neighbours."""
    return text.replace("Σ", "σ").lower()


def untold(c: str) -> bool:
    """Whether tables of another Unicode version may compose or class a character otherwise: marks newer than 3.2, and unassigned ones."""
    kind = unicodedata.category(c)
    return kind == "Cn" or kind[0] == "M" and unicodedata.ucd_3_2_0.category(c) == "Cn"


class Codec:
    """Words, merges and tokens of a tokenizer file."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, model = dict(spec["model"]["vocab"]), spec["model"]
        self.suffix = model["end_of_word_suffix"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {k.encode(): v for k, v in added.items()}
        self.added_pattern = regex.compile("(" + "|".join(regex.escape(k) for k in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        self.size = 1 + max(max(vocab.values()), *added.values())
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        token = {v: k for k, v in vocab.items()} | {v: k for k, v in added.items()}
        shown = [token.get(i, "").encode() + b" " for i in range(self.size)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.cumsum([0, *map(len, shown)])
        self.path, self.library = path, None
        self.known: dict[str | bytes, int] = {}
        self.ids, self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    # --- words ---------------------------------------------------------------

    def by_library(self, text: str) -> list[str]:
        """Words of a text with characters on which Unicode versions differ, by the file's own normalizer."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        back = {c: b for b, c in enumerate(byte_letters())}
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in shown]

    def words_of(self, text: str) -> list[str | bytes]:
        """Words in order; the string of an added token is an entry of its own, as bytes."""
        out: list[str | bytes] = []
        for piece in pieces(text):
            parts = self.added_pattern.split(piece) if self.added_pattern else [piece]
            for i, part in enumerate(parts):
                if i % 2:
                    out.append(part.encode())
                elif part.isascii():
                    out += self.words.findall(part.lower())
                elif any(map(untold, set(part))):
                    out += self.by_library(part)
                else:
                    out += self.words.findall(lowered(unicodedata.normalize("NFC", part)))
        return out

    # --- merges --------------------------------------------------------------

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of neighbours; pairs that never merge have the largest number."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all ``words`` in one array, and the start and count of each."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        symbol = self.inner[data]
        last = at[1:][size > 0] - 1
        symbol[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(symbol), NONE, np.int32)  # of the pair that begins here
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.ranks(symbol[inside], symbol[inside + 1])
        done_symbols, done_words = [], []
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            long = np.diff(np.append(first, len(symbol)))
            over = np.repeat(lowest == NONE, long)
            if over.any():
                done_symbols.append(symbol[over])
                done_words.append(word[over])
                symbol, word, rank = symbol[~over], word[~over], rank[~over]
                lowest, long = lowest[lowest != NONE], long[lowest != NONE]
                if not len(symbol):
                    break
            place = np.flatnonzero(rank == np.repeat(lowest, long))
            # of pairs that overlap (one symbol again and again) every second merges, from the left
            run = np.append(True, (place[1:] != place[:-1] + 1) | (word[place[1:]] != word[place[:-1]]))
            of = np.arange(len(place))
            place = place[(of - np.maximum.accumulate(np.where(run, of, 0))) % 2 == 0]
            symbol[place] = self.merged[rank[place]]
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            moved = place - np.arange(len(place))
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            again = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            again = again[again < len(symbol)]
            joined = np.zeros(len(again), bool)
            follows = again < len(symbol) - 1
            joined[follows] = word[again[follows]] == word[again[follows] + 1]
            rank[again] = NONE
            pair = again[joined]
            rank[pair] = self.ranks(symbol[pair], symbol[pair + 1])
        symbols, of = np.concatenate([np.zeros(0, np.int64), *done_symbols]), np.concatenate([np.zeros(0, np.int64), *done_words])
        order = np.argsort(of, kind="stable")
        count = np.bincount(of, minlength=len(words))
        return symbols[order], np.cumsum(count) - count, count

    # --- texts ---------------------------------------------------------------

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their n + 1 offsets; null is empty."""
        words: list[str | bytes] = []
        to = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            words += self.words_of(text or "")
            to[i + 1] = len(words)
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        unseen = np.flatnonzero(place < 0)
        new = list(dict.fromkeys(words[i] for i in unseen.tolist()))
        plain = [w for w in new if isinstance(w, str)]
        special = [w for w in new if isinstance(w, bytes)]
        ids, start, count = self.merge([w.encode("utf-8", "surrogateescape") for w in plain])
        base = len(self.start)
        start = np.concatenate([self.start, start + len(self.ids), np.arange(len(special)) + len(self.ids) + len(ids)])
        count = np.concatenate([self.count, count, np.ones(len(special), np.int64)])
        ids = np.concatenate([self.ids, ids, np.array([self.added[w] for w in special], np.int64)])
        found = {w: base + i for i, w in enumerate([*plain, *special])}
        place[unseen] = [found[words[i]] for i in unseen.tolist()]
        if len(start) <= REMEMBERED:
            self.known.update(found)
            self.ids, self.start, self.count = ids, start, count
        size = count[place]
        at = np.zeros(len(place) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        return ids[np.repeat(start[place] - at[:-1], size) + np.arange(at[-1])], at[to]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The text of each row of ids: its tokens with a blank between two; ids without a token are left out."""
        shown, to = ragged(self.shown, self.shown_at, ids)
        blob = shown.tobytes()
        return [blob[a : b - 1] if b > a else b"" for a, b in zip(to[at[:-1]].tolist(), to[at[1:]].tolist(), strict=True)]


#: One codec for each tokenizer file in a Python worker, which serves many tasks.
_CODECS: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and ids (array of int) of every whole text of ``docs`` (doc_id, text).

    A null or empty text has no ids.  Texts of any length are encoded whole, in
    parts that no word crosses.  Rows are worked on one by one, so that null,
    repeated and tied doc_ids and repeated rows each give a row; no rows give none.
    Columns other than doc_id and text are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                flat, at = codec_of(tokenizer).encode(part.column("text").to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def id_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and n + 1 offsets of a column of id lists; a null list is empty."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(size))


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and the text of ``encoded`` (doc_id, ids); rows and other columns as in :func:`encode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = codec_of(tokenizer).decode(*id_rows(batch.column("ids")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.decode() for x in text], pa.string())], names=["doc_id", "text"])

    encoded = encoded.select("doc_id", "ids")
    return encoded.mapInArrow(run, T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 of ``docs``.

    Texts are encoded and decoded in one pass, so that a task has one codec in its
    memory; rows as in :func:`encode`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                ids, at = codec.encode(part.column("text").to_pylist())
                own, ends = ids.astype("<u4"), at.tolist()
                of_ids = [hashlib.sha256(own[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
                of_text = [hashlib.sha256(x).hexdigest() for x in codec.decode(ids, at)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select("doc_id", "text")
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *fields]))
