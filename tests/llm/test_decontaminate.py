import random
import re

import pytest

from convlake.llm import decontaminate


def brute(docs, items, t=0.8):
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = set()
    for d, text in docs:
        has = {n: grams(words(text), n) for n in range(1, 6)}
        has = set().union(*has.values())
        for i, item in items:
            w = words(item)
            g = grams(w, min(len(w), 5)) if w else set()
            if g and len(g & has) >= t * len(g):
                out.add(repr((d, i, len(g), len(g & has))))
    return sorted(out)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, mark string")
    i = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    return sorted({repr(tuple(r)) for r in decontaminate.find_leaks(d, i, **kw).select("doc_id", "item_id", "n_item", "n_shared").collect()})


def corpus(seed):
    r = random.Random(seed)
    w = lambda n: " ".join(r.choice("alpha beta gamma delta épée zeta eta theta iota kappa".split()) + str(r.randint(0, 60)) for _ in range(n))
    items = [(i, w(r.choice([5, 6, 9, 20, 35, 80, 200]))) for i in range(40)] + [(90, None), (91, ""), (92, "too short"), (93, w(30)), (94, None)]
    items.append((95, items[3][1]))
    docs = []
    for d in range(80):
        parts = [w(r.randint(0, 300))]
        for _ in range(r.choice([0, 0, 1, 2, 12])):
            words = (r.choice(items)[1] or "").split()
            for _ in range(r.choice([0, 0, 1, 2])):
                if words:
                    words[r.randrange(len(words))] = "other"
            parts += [r.choice([" ", "*** ", "\n"]).join(words).upper() if r.random() < 0.3 else " ".join(words), w(r.randint(0, 40))]
        docs.append((d, " ".join(parts)))
    docs.append((500, " ".join(t for _, t in items if t)))
    return docs + [(600, None), (601, ""), (None, items[8][1]), (602, docs[5][1]), (5, docs[5][1]), (603, items[5][1] + " filler" * 20000)], items


def test_matches_brute_force(spark):
    for seed in range(2):
        docs, items = corpus(seed)
        assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, vocabulary=500) == brute(docs, items)


def test_empty_sides(spark):
    docs, items = corpus(3)
    assert run(spark, [], items) == [] == run(spark, docs, []) == run(spark, docs, [(1, None)])


def test_filter_keeps_clean_rows_and_columns(spark):
    docs, items = corpus(4)
    rows = [(d, t, "en", d) for d, t in docs] + [(0, "clean text with the id of another row", "en", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, mark long")
    i = spark.createDataFrame(items, "item_id long, text string")
    bad = {x for x in brute(docs, items)}
    leaky = {eval(x)[0] for x in bad}
    kept = decontaminate.without_leaks(d, i)
    assert kept.columns == d.columns
    got = sorted(repr(tuple(r)) for r in kept.collect())
    assert got == sorted(repr(r) for r in rows if r[0] not in leaky or r[1].startswith("clean text"))


def test_bands_keep_their_promise():
    for similarity in (0.11, 0.3, 0.5, 0.8, 1.0):
        count, width = decontaminate.bands(similarity)
        assert (1 - similarity**width) ** count <= 1.1e-6 and count * width <= decontaminate.SIGNATURE
    assert decontaminate.bands(0.03) is None


def test_short_items_are_looked_for_whole(spark):
    items = [(1, "Alpha"), (2, "beta gamma"), (3, "one two, three four"), (4, "...")]
    docs = [(1, "x ALPHA y"), (2, "beta x gamma"), (3, "a beta-gamma b one two three four"), (4, "alphabet betagamma"), (5, None)]
    assert run(spark, docs, items) == brute(docs, items)
    assert {eval(r)[1] for r in run(spark, docs, items, least_words=2)} == {2, 3}


def test_many_sets_with_one_common_shingle(spark):
    """Items and documents that all share shingles, in size classes that signatures can't tell apart."""
    r = random.Random(8)
    common = "shared by all of them here"
    items = [(i, f"{common} w{i} x{i}") for i in range(60)]
    docs = [(d, " . ".join([common] + [f"{common} w{k} x{k}" for k in r.sample(range(80), r.choice([1, 3, 60]))])) for d in range(40)]
    assert run(spark, docs, items) == brute(docs, items)
