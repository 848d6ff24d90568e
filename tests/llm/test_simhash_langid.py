import random
import re

import numpy as np
import xxhash

from convlake.llm import langid, simhash


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 4 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    names = [min((rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    return sorted(repr((d, f"{f:016x}", n)) for (d, _), f, n in zip(rows, fp, names))


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    return sorted(repr(tuple(r)) for r in simhash.near_duplicates(df).collect())


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ö.", "A,b"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two  three\tfour"), (6, "one two three four five"), (7, "x\u00a0y z"), (None, "one"), (None, "alone here " * 9), (8, "long " * 30000)]
    for i in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 200))]
        for k in range(r.randint(1, 4)):
            copy = list(base)
            for _ in range(k):
                copy[r.randrange(len(copy))] = "changed"
            rows.append((100 + 10 * i + k, " ".join(copy)))
    rows.append(rows[-1])
    assert run(spark, rows) == brute_components(rows)
    assert run(spark, []) == []


def test_links_over_many_groups_match_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 60).astype(np.uint64)
    base[:5] = [0, 1, (1 << 64) - 1, 0xFFFF, 0xFF]
    flips = [x ^ np.uint64(sum(1 << int(b) for b in r.choice(64, k, replace=False))) for x in base for k in (2, 4, 5)]
    fps = np.unique(np.concatenate([base, np.array(flips, np.uint64)]))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= simhash.RADIUS
    want = np.arange(len(fps))
    while True:
        new = np.where(near, want[None], len(fps)).min(1)
        if (new == want).all():
            break
        want = new
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    for size in (6, 40, None):
        got = np.arange(len(fps))
        for edge in simhash.links(nodes, size=size).collect():
            a, b = got[place[edge["src"]]], got[place[edge["dst"]]]
            got[got == max(a, b)] = min(a, b)
        assert (got == want).all()
    # each fingerprint meets every group within reach once, its own too
    rows = simhash.meetings(nodes, size=6).collect()
    own = {row["fp"]: row["own"] for row in rows}
    met = {(row["own"], row["h"] if row["own"] == row["g"] else row["g"]) for row in rows}
    assert len(set(own.values())) > 20 and len({tuple(row) for row in rows}) == len(rows)
    for i, j in zip(*np.nonzero(near)):
        assert (own[int(fps.view(np.int64)[i])], own[int(fps.view(np.int64)[j])]) in met


def test_forest_finds_all_links_and_no_more():
    r = np.random.default_rng(1)
    for right in (False, True):
        a = r.integers(0, 1 << 12, 900).astype(np.uint64)
        a |= a << np.uint64(30)
        a = np.unique(a)
        half = len(a) // 2
        child, root = simhash.forest(a[:half], a[half:]) if right else simhash.forest(a, None)
        near = np.bitwise_count(a[:, None] ^ a[None]) <= 4
        if right:
            near[:half, :half] = near[half:, half:] = False
        label = np.arange(len(a))
        while True:
            new = np.where(near, label[None], len(a)).min(1)
            new = np.minimum(label, new)
            if (new == label).all():
                break
            label = new
        place = {x: i for i, x in enumerate(a.tolist())}
        mine = np.arange(len(a))
        for c, p in zip(child.tolist(), root.tolist()):
            mine[place[c]] = place[p]
        assert len({(x, y) for x, y in zip(label, mine)}) == len(set(label)) == len(set(mine))


def test_language_id_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = langid.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(got) == 1000 and 200 < len(held) < 300
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_id_edges(spark):
    rows = [(i, f"alpha beta gamma delta word{i % 7}", "aa", 0.5) for i in range(40)] + [(100 + i, f"zorro quixote jazz fizz{i % 7}", "zz", 0.5) for i in range(40)]
    rows += [(200, None, "aa", 0.1), (201, "", "zz", 0.1), (202, "12 34 !!", None, 0.1), (None, "ALPHA BETA gamma", None, 0.1), (203, "jazz", None, 0.1), (203, "jazz", None, 0.1), (204, "zorro quixote " * 20000, None, 0.1), (205, "日本", None, 0.1)]
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")).collect()}
    assert {(200, "und"), (201, "und"), (202, "und"), (None, "aa"), (203, "zz"), (204, "zz")} <= got
    assert all(p in ("aa", "zz") for d, p in got if d not in (200, 201, 202))
    few = spark.createDataFrame([(1, "alpha beta", "aa"), (3, "zorro jazz", "zz"), (4, "zorro", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(few).collect()} == {1: "aa", 3: "zz", 4: "zz"}
    none = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(none).collect()} == {"und"}
    assert langid.identify(none.limit(0)).collect() == []
