import hashlib
import random

import numpy as np
import pytest

from convlake.llm import substrings


def brute(rows, length, marks={}):
    raw = [(t or "").encode() for _, t in rows]
    mark = {b: i for i, b in enumerate(sorted(set(raw), key=lambda b: marks.get(b, 0)))}
    key = [(substrings.NO_ID if d is None else d, mark[b]) for (d, _), b in zip(rows, raw)]
    first = {}
    for r, b in enumerate(raw):
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, (key[r], p)), (key[r], p))
    out = []
    for r, b in enumerate(raw):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (key[r], p):
                gone[p : p + length] = True
        n = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((rows[r][0], len(b), int(gone.sum()), n, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, mark string")
    got = substrings.remove_repeats(df, **kw).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    return sorted(repr(tuple(r)[:5]) for r in got)


def corpus(seed, n=60):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdé fgh\n") for _ in range(r.randint(40, 400))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.5 else "".join(r.choice("klmn opü") for _ in range(r.randint(0, 150))) for _ in range(r.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(200, rows[3][1]), (200, rows[3][1]), (201, "a" * 700), (202, "ab" * 300), (203, "a" * 120), (204, None), (205, ""), (None, rows[5][1]), (None, "only here " * 3), (206, "x" * 99), (207, "period 7" * 40 + "z" + "period 7" * 40)]
    r.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    for seed in range(2):
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows, 100)


def test_hot_buckets_and_other_lengths(spark):
    rows = corpus(7)
    assert run(spark, rows, together=1) == brute(rows, 100)
    assert run(spark, rows, length=40, q=9) == brute(rows, 40)
    assert run(spark, rows, length=40, q=9, together=2) == brute(rows, 40)
    assert run(spark, rows, length=140, q=24) == brute(rows, 140)


def test_parameters_that_do_not_fit_are_refused(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for kw in ({"length": 200}, {"length": 24}, {"q": 0}):
        with pytest.raises(ValueError):
            substrings.remove_repeats(df, **kw)
    with pytest.raises(ValueError):
        substrings.remove_repeats(df.withColumn("doc_id", df["doc_id"].cast("string")))


def test_very_long_texts(spark):
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh ") for _ in range(150_000))
    rows = [(1, long), (2, "new " + long[70_000:90_000] + " end"), (3, "z" * 50_000), (None, long[:500])]
    assert run(spark, rows) == brute(rows, 100)


def test_no_rows(spark):
    assert run(spark, []) == []


def test_same_id_with_different_texts(spark):
    header = "the same header of all the texts without an id, which is longer than one hundred bytes, as some headers are; "
    rows = [(1, "q" * 50 + "shared words " * 12), (1, "other " + "shared words " * 12), (0, "shared words " * 9)] + [(None, header + f"text {i}") for i in range(5)]
    marks = {r["text"].encode(): r["m"] for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "xxhash64(text) AS m").collect()}
    assert run(spark, rows) == brute(rows, 100, marks) == run(spark, rows, together=1)


def test_window_buckets_tell_windows_apart():
    r = np.random.default_rng(3)
    data = r.integers(0, 2, 3000).astype(np.uint8)
    data[1000:1500] = data[200:700]
    for length in (5, 8, 13, 100):
        starts = np.arange(len(data) - length + 1)
        kind = substrings.window_buckets(data, starts, length)
        text = [data[s : s + length].tobytes() for s in starts]
        assert len(set(zip(kind.tolist(), text))) == len(set(kind.tolist())) == len(set(text))
