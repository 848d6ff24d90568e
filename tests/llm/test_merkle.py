import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from convlake.llm import merkle

COLUMNS = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    values = [r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4]]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        yield "".join(level[i - i % 2 : i]), "".join(level[i + 1 : i - i % 2 + 2])
        i //= 2


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    own = {k: sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in keys}
    trees = {k: levels([leaf(r) for r in own[k]]) for k in keys}
    top = levels([trees[k][-1][0] for k in keys]) if keys else []
    out = []
    for j, k in enumerate(keys):
        for i, r in enumerate(own[k]):
            proof = [*siblings(trees[k], i), *siblings(top, j)]
            done = leaf(r, 1 if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for a, b in proof:
                done = h(a, done, b)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in proof)), done, done == top[-1][0]))
    return sorted(map(str, out))


def found(spark, rows, levels_of_a_block=merkle.BLOCK_LEVELS):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "position", "proof", "leaf", "root", "block")})
    return sorted(str(tuple(r)) for r in merkle.manifest(docs, levels=levels_of_a_block).select(*COLUMNS).collect())


@pytest.mark.parametrize("block", [1, 2, 9])
def test_all_sizes_against_brute_force(spark, block):
    rows = [(i, "s", f"l{n:02d}", i, f"text {i}") for n in (1, 2, 3, 4, 5, 7, 8, 9, 33) for i in range(100 * n, 101 * n)]
    assert found(spark, rows, block) == brute(rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None)] * 3 + [(1, "s", "", 2, ""), (1, "s", "", 2, None), (1, "s", "", 2, ""), (2, None, "é", 1, "é😀"), (-7, "s", "z", 2**63 - 1, "x" * 300_000)]
    rows += [(i, "s", "en", 1, "t") for i in range(40)] + [(5, "s", "en", 1, "t")] * 30
    assert found(spark, rows, 2) == brute(rows)


def test_one_row_and_none(spark):
    assert found(spark, [(3, "s", "en", 1, "t")]) == brute([(3, "s", "en", 1, "t")])
    assert found(spark, []) == []


def test_proof_leads_to_the_root(spark, sf):
    rows = merkle.manifest(spark.read.parquet(f"{sf}/documents.parquet")).select("leaf", "proof", "root").collect()
    for r in rows:
        done = r["leaf"]
        for s in r["proof"]:
            assert len(s["left"] + s["right"]) in (0, 64)
            done = h(s["left"], done, s["right"])
        assert done == r["root"]
