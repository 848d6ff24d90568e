import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from convlake.llm import packing, sharding, urlfilter
from convlake.llm.texts import text_bytes


def brute_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:end], rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in urlfilter.RULES:
        h, p = rule.partition("/")[0], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best[0] if best else None, best[1] if best else "allow"


def test_urls_match_brute_force(spark):
    urls = [None, "", "nothing", "http://", "x://COM/", "http://example.com/en/", "https://WWW.example.com/en/x?y", "http://a.net/es/1", "http://net/es/", "http://anet/es/", "http://b.net/fr", "http://b.net/fr/#/", "http://com", "http://a.com?/en/", "a://b://c.com/", "http://" + "a." * 3000 + "com/" + "p" * 5000, "http://Énet.net/fr/é", "http://xn.example.com/en", "http://.com/", "http://a..net/es/"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(3, "http://a.net/es/1", "again"), (None, "http://a.com/", "x")]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *brute_judge(u))) for i, u, _ in rows)
    small = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string"), file_bytes=60).collect()
    assert sorted(map(repr, small)) == sorted(map(repr, got))
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_digest_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter, "digests", lambda strings: np.full(len(list(strings)), 7, np.uint64))
    (tmp_path / "d").write_bytes(urlfilter.DigestArray.pack({"a": 1, "b": 2, "": 3}))
    assert urlfilter.DigestArray(str(tmp_path / "d")).find(["b", "x", "a", ""]).tolist() == [2, -1, 1, 3]


def one_by_one(counts, capacity):
    """The packing that the planned one stands for, piece by piece."""
    bins, large = [], sorted((s for s, n in counts.items() if 3 * s > capacity for _ in range(n)), reverse=True)
    while large:
        s = large.pop(0)
        mate = next((i for i, x in enumerate(large) if x + s <= capacity), None)
        bins.append(s if mate is None else s + large.pop(mate))
    for s in sorted((s for s, n in counts.items() if 3 * s <= capacity for _ in range(n)), reverse=True):
        fits = [(capacity - b, i) for i, b in enumerate(bins) if b + s <= capacity]
        if fits:
            bins[min(fits)[1]] += s
        else:
            bins.append(s)
    return len(bins)


def test_plan_equals_one_by_one_packing():
    for seed in range(300):
        r = random.Random(seed)
        capacity = r.choice([7, 10, 30, 100])
        counts = {r.randint(1, capacity): r.randint(1, 20) for _ in range(r.randint(1, 30))}
        patterns, used = packing.plan(counts, capacity), {}
        for lengths, n in patterns:
            assert 0 < sum(lengths) <= capacity and sum(3 * s > capacity for s in lengths) <= 2
            for s in lengths:
                used[s] = used.get(s, 0) + n
        assert used == counts
        assert sum(n for _, n in patterns) == one_by_one(counts, capacity)


TEXTS = [None, "", " ", "a  b\n\nc d.e 's it's don't   x\u00a0y \u3000z", "é à b  c <|endoftext|> 12,3 .. a..b\t\nq", "x \ny\n z \r\n w\x1c d e \x85 f’s\x00", "word " * 3000, "word " * 3000, "\ud7ff😀 z", "a\n" * 1024]
TEXTS += ["word <|endoftext|> end", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "x\n<|endoftext|>\ny", " <|endoftext|> ", "cut <|endof text|> <|endoftext", "|> z", "q  <|endoftext|>\u3000r.<|endoftext|>!"]


def test_packing_round_trip(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again"), (None, "null id", "s")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 1024
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_equal_whole_texts_with_added_tokens():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder, r = Tokenizer.from_file(path), packing.Encoder(path), random.Random(2)
    for _ in range(60):
        texts = ["".join(r.choice(["<|endoftext|>", " ", "\n", "ab", "é", ".", "<|", "|>", "endoftext", "7", "'s", "\t"]) for _ in range(r.randint(0, 30))) for _ in range(20)]
        ids, to = encoder.encode(*text_bytes(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(to, to[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_string_ids_are_packed(spark):
    got = packing.pack(spark.createDataFrame([("a", "x y"), ("b", None), (None, "z")], "doc_id string, text string")).collect()
    assert {r["doc_id"] for r in got} == {"a", "b", None} and len({r["offset"] for r in got}) == 3


def test_minimax_cuts_are_optimal():
    def best(sizes, k):
        reach = {0: [0]}
        table = [[float("inf")] * (k + 1) for _ in range(len(sizes) + 1)]
        table[0] = [0] * (k + 1)
        for i in range(1, len(sizes) + 1):
            for s in range(1, k + 1):
                table[i][s] = min(max(table[j][s - 1], sum(sizes[j:i])) for j in range(i))
        return table[len(sizes)][k]

    for seed in range(60):
        r = random.Random(seed)
        sizes = [r.randint(1, 50) for _ in range(r.randint(1, 14))]
        k = r.randint(1, 5)
        capacity, cuts = sharding.minimax_cuts(np.array(sizes), k)
        parts = [sum(p) for p in np.split(np.array(sizes), cuts)]
        assert capacity == best(sizes, k) == max(parts) and len(parts) <= k
    assert sharding.minimax_cuts(np.array([], np.int64), 8) == (0, [])


def test_shards(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS * 3)] + [(None, "x", 1), (1, "", 1), (1, "", 1)] + [(1000 + i, "copy " * 40, 0) for i in range(50)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, shard int")).collect()
    want = sorted(repr((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t, _ in rows)
    assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == want
    by_text, slots = {}, {}
    for r in got:
        by_text.setdefault(r["text_crc32"] if r["size"] > 1 else r["doc_id"], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values()) and set(slots) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_capacity_is_that_of_the_texts_themselves(spark):
    r = random.Random(6)
    for shards in (1, 3, 8):
        texts = ["".join(r.choice("xyz") for _ in range(r.randint(0, 4))) for _ in range(400)] + ["long " * r.randint(1, 90) for _ in range(30)] + [None] * 9 + ["hot" * 50] * 40
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        sizes = [x["n"] for x in df.groupBy("text").agg(F.expr("sum(octet_length(coalesce(text, '')) + 1) AS n"), F.expr("xxhash64(text) AS h")).orderBy("h").collect()]
        got = sharding.assign_shards(df, shards).groupBy("shard").sum("size").collect()
        assert max(x["sum(size)"] for x in got) == sharding.minimax_cuts(np.array(sizes), shards)[0]


def test_shards_are_near_equal(spark, sf):
    got = sharding.assign_shards(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")).groupBy("shard").sum("size").toPandas()
    assert len(got) == 8 and got["sum(size)"].max() < 1.25 * got["sum(size)"].mean()
