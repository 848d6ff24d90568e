import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from convlake.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - int(math.copysign(abs(c) % 5, c)), [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(rows):
    convs = rebuilt(rows)
    members = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for path, ids in members.items():
        subtree = [p for p in members if p[: len(path)] == path]
        kids = [p for p in subtree if len(p) == len(path) + 1]
        leaves = [p for p in subtree if not any(q[: len(p)] == p and len(q) > len(p) for q in subtree)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in subtree if p)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(path))))
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def found(spark, rows, size=trie.SEGMENT):
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id1", "depth", "position", "n", "parent")})
    return sorted(str(tuple(r)) for r in trie.prefix_trie(table, size=size).collect())


def conversations(seed, count, most, words, ids=None):
    rng = random.Random(seed)
    rows = []
    for c in ids or range(count):
        rows += [(c, t, rng.choice("ua"), rng.choice(words)) for t in range(rng.randrange(1, most))]
    return rows


@pytest.fixture
def many_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [2, 3, 64])
def test_random_conversations(spark, many_ranges, size):
    rows = conversations(size, 60, 14, ["a", "bb"])
    assert found(spark, rows, size) == brute(rows)


def test_copies_prefixes_and_long_ones(spark, many_ranges):
    long = [(t, "u", f"turn {t}") for t in range(40)]
    rows = [(5 * c, *t) for c in range(12) for t in long[: 40 - c]] + [(100 + 5 * c, *t) for c in range(20) for t in long[:9]]
    rows += [(1000, t, "u", f"turn {t}" if t < 30 else f"own {t}") for t in range(70)]
    assert found(spark, rows, 4) == brute(rows)


def test_nulls_ties_repeats_and_extremes(spark):
    rows = [(None, 1, "u", "x"), (1, None, None, None), (1, None, "u", ""), (1, 2, "u", "é😀"), (1, 2, "u", "b"), (1, 2, "u", "b"), (-3, 0, "u", "y"), (-3, -1, "a", "z"), (-5, 0, "u", "y" * 200_000), (2**62, 0, "u", "q")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, rows[:1]) == []


def test_many_members_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "LISTED", 7)
    ends = spark.range(100).select((F.col("id") % 3).alias("id1"), F.lit(0).cast("long").alias("id2"), F.col("id").alias("conv_id"))
    got = {r["id1"]: r["ends_sha256"] for r in trie.member_digests(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(100) if i % 3 == k).encode()).hexdigest() for k in range(3)}
