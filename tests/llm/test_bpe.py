import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from convlake.llm import bpe

PARTS = [*"abcdeABC   '''.,!\n\t  　ΣσİéÉñ", "'s", "'ll", "'re", "<|endoftext|>", "<|startoftext|>", "<|endof", "é", "́", "가", "각", "😀", "👩‍🚀", "ſ", "K", "ﬁ", "Ǆ", "ͅ", "漢字", "123", "٣", "\x00", "\x85", "՘", "Ᲊ", "aaaaaaa", "ababab", "the ", "ing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.TOKENIZER)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_codec_equals_the_library(library):
    rng = random.Random(3)
    wild = lambda: chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x10000, 0x1FFFF)]))
    texts = ["".join(rng.choice(PARTS) if rng.random() < 0.8 else wild() for _ in range(rng.randrange(60))) for _ in range(4000)]
    codec = bpe.Codec()
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        ids, at = codec.encode(part)
        shown = codec.decode(ids, at)
        for k, text in enumerate(part):
            assert (ids[at[k] : at[k + 1]].tolist(), shown[k].decode()) == expected(library, text)


def test_forgetting_and_cutting_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "PIECE", 7)
    text = "The café isn't OPEN,<|endoftext|> it's clośed\nsince 1999. " * 5
    codec = bpe.Codec()
    for _ in range(2):
        ids, at = codec.encode([text, None, text[:31]])
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(3)] == [expected(library, t)[0] for t in (text, "", text[:31])]


def test_long_words(library):
    for word in ("a" * 20_000, "abcabd" * 5_000, "!?" * 3_000):
        ids, at = bpe.Codec().encode([word])
        assert ids.tolist() == expected(library, word)[0] and at.tolist() == [0, len(ids)]


def test_merge_of_nothing():
    ids, start, count = bpe.Codec().merge([])
    assert len(ids) == len(start) == len(count) == 0


def test_rows_of_all_kinds(spark, library):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, None), (2, ""), (3, " \n"), (4, "long words " * 30_000), (None, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(0), "n_tokens": F.lit("x")})
    coded = bpe.encode(docs)
    got = sorted(map(str, bpe.round_trip(docs).collect()))
    want = []
    for doc, text in rows:
        ids, shown = expected(library, text)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert got == sorted(f"Row(doc_id={d}, n_tokens={n}, ids_sha256={a!r}, decoded_sha256={b!r})" for d, n, a, b in want)
    assert sorted(map(str, bpe.decode(coded).collect())) == sorted(f"Row(doc_id={d}, text={expected(library, t)[1]!r})" for d, t in rows)
    assert bpe.round_trip(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in bpe.decode(nulls).collect()] == ["", ""]


def test_query_equals_the_library(spark, sf, library):
    from convlake.llm import queries

    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_bpe_codec(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, shown = expected(library, d["text"])
        assert got[d["doc_id"]] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
