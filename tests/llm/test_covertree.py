import numpy as np

from convlake.llm import covertree


def brute(queries, vectors, k=10):
    def ints(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            return None
        return [int(np.floor(1024 * float(x))) for x in v]

    data = [(i, ints(v)) for i, v in vectors if i is not None and ints(v) is not None]
    out = []
    for i, q in {(i, tuple(ints(v))) for i, v in queries if i is not None and ints(v) is not None}:
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in data if j != i and len(v) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, queries, vectors, **kw):
    frame = lambda rows: spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    return sorted(tuple(r) for r in covertree.top_k(frame(queries), frame(vectors), **kw).collect())


def test_matches_brute_force(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(8, 6))
    vectors = [(i, (centres[i % 8] + r.normal(size=6) * 0.1).tolist()) for i in range(900)]
    vectors += [(1000 + i, vectors[5][1]) for i in range(60)] + [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, [0.1] * 6), (2004, [0.5, 0.25]), (2005, [0.5, 0.5]), (2006, []), (2007, []), (2008, [0.0] * 6), (7, vectors[7][1])]
    queries = [v for v in vectors if v[0] is None or v[0] % 20 == 0 or v[0] >= 2000]
    assert run(spark, queries, vectors, data_block=200, query_block=16) == brute(queries, vectors)
    assert run(spark, queries, vectors, k=3) == brute(queries, vectors, 3)
    assert run(spark, [], vectors) == [] == run(spark, queries, [])


def test_large_components_stay_exact(spark):
    vectors = [(i, [float(2**20 + i), float(2**21 - i), 3.25]) for i in range(30)]
    assert run(spark, vectors[:4], vectors) == brute(vectors[:4], vectors)


def test_repeated_ids_and_one_very_common_vector(spark):
    r = np.random.default_rng(9)
    same = r.normal(size=4).tolist()
    vectors = [(i, same) for i in range(300)] + [(7, same)] * 20 + [(i, r.normal(size=4).tolist()) for i in range(400, 500)]
    queries = [v for v in vectors if v[0] in (0, 7, 20, 450)]
    assert run(spark, queries, vectors, data_block=60, query_block=2) == brute(queries, vectors)


def test_tree_covers_separates_and_nests():
    r = np.random.default_rng(0)
    for points in (np.concatenate([r.normal(size=(500, 3)) * 5 + c for c in ((0, 0, 0), (900, 0, 0), (0, 900, 400))]), r.normal(size=(700, 40)), np.repeat(r.integers(-3, 3, (5, 2)), 50, 0).astype(float)):
        tree = covertree.CoverTree(points)
        assert sorted(tree.order.tolist()) == list(range(len(points)))
        for node, centre in enumerate(tree.centre):
            own = tree.order[tree.first[node] : tree.last[node]]
            assert np.sqrt(((points[own] - points[centre]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-6
            if tree.children[node]:
                kids = tree.children[node]
                inside = sorted((tree.first[c], tree.last[c]) for c in kids)
                assert inside[0][0] == tree.first[node] and inside[-1][1] == tree.last[node] and sum(b - a for a, b in inside) == len(own)
                centres = points[[tree.centre[c] for c in kids]]
                apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[~np.eye(len(kids), dtype=bool)]
                assert centre in [tree.centre[c] for c in kids]
                assert apart.min() > max(tree.radius[c] for c in kids) - 1e-6
            else:
                assert len(own) <= covertree.LEAF or not tree.radius[node]


def rows_of(points):
    return covertree.unpack(covertree.block_row(points.shape[1], "b", points, [[i] for i in range(len(points))], [[1]] * len(points)))


def test_pruning_saves_products_on_clustered_data():
    r = np.random.default_rng(1)
    centres = r.normal(size=(60, 32))
    centres *= 1024 / np.sqrt((centres**2).sum(1, keepdims=True))
    data = np.floor(np.repeat(centres, 40, 0) + r.normal(size=(2400, 32)) * 8).astype(np.int64)
    asked = data[::10]
    search = covertree.Search(rows_of(asked), rows_of(data), 10)
    assert search.products < len(asked) * len(data) / 5
    exact = np.sort(asked @ data.T, 1)[:, ::-1]
    at, _, found, score = search.hits()
    for i in range(0, len(asked), 7):
        # a query's own id is no candidate, so one of its own place's scores is missing
        want = sorted((asked[i] @ data.T)[np.arange(len(data)) != i], reverse=True)[:10]
        assert score[at == i].tolist() == want
    # with k-th scores known beforehand even less is computed
    again = covertree.Search(rows_of(asked), rows_of(data), 10, exact[:, 10].astype(float))
    assert again.products < search.products


def test_pairs_of_blocks_are_few_on_clustered_data_and_none_is_missing(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(60, 16))
    centres *= 1024 / np.sqrt((centres**2).sum(1, keepdims=True))
    data = np.floor(np.repeat(centres, 40, 0) + r.normal(size=(2400, 16)) * 8).astype(np.int64)
    frame = lambda picked: spark.createDataFrame([(16, data[i].tolist(), [(i, 1)]) for i in picked], "dims int, vector array<long>, ids array<struct<vec_id:long,n:long>>")
    cells = {16: covertree.far_apart(data.astype(float), 60)}
    asked = range(0, 2400, 10)
    left = covertree.materialize(covertree.with_trees(covertree.in_blocks(frame(asked), cells, 4)), "left")
    right = covertree.materialize(covertree.with_trees(covertree.in_blocks(frame(range(2400)), cells, 40)), "right")
    block_of = lambda df: {int(i): row["block"] for row in df.collect() for i in covertree.unpack(row.asDict())["ids"]}
    q_block, d_block = block_of(left), block_of(right)
    best = {i: sorted((j for j in range(2400) if j != i), key=lambda j: (-int(data[i] @ data[j]), j))[:10] for i in asked}
    worst = {}
    for i in asked:
        worst[q_block[i]] = min(worst.get(q_block[i], float("inf")), float(data[i] @ data[best[i][-1]]))
    heads = left.join(spark.createDataFrame(list(worst.items()), "block string, worst double"), "block")
    pairs = {(row["q_block"], row["block"]) for row in covertree.block_pairs(heads, right).collect()}
    assert {(q_block[i], d_block[j]) for i in asked for j in best[i]} <= pairs
    assert len(pairs) < left.count() * right.count() / 5
    opening = covertree.block_pairs(left, right, 2).collect()
    by_query = {}
    for row in opening:
        by_query.setdefault(row["q_block"], []).append((row["bound"], row["block"]))
    everything = {}
    for row in covertree.block_pairs(left.withColumn("worst", covertree.F.lit(float("-inf"))), right).collect():
        everything.setdefault(row["q_block"], []).append((row["bound"], row["block"]))
    assert all(len(rows) == right.count() for rows in everything.values())
    assert all(sorted(by_query[q])[-2:] == sorted(rows)[-2:] for q, rows in everything.items())


def test_vectors_that_prune_nothing_meet_in_few_steps(monkeypatch):
    r = np.random.default_rng(3)
    data = np.floor(r.normal(size=(2000, 64)) * 128).astype(np.int64)
    asked, steps = data[::10], []
    for name in ("bounds", "compare"):
        own = getattr(covertree.Search, name)
        monkeypatch.setattr(covertree.Search, name, lambda self, *a, own=own: steps.append(1) or own(self, *a))
    search = covertree.Search(rows_of(asked), rows_of(data), 10)
    # by matrices, not by a step for each query and a few nodes
    assert len(steps) < len(asked) / 2
    assert search.products < 1.2 * len(asked) * len(data)
    at, _, found, score = search.hits()
    for i in range(len(asked)):
        got = asked[i] @ data.T
        want = sorted((-int(got[j]), j) for j in range(len(data)) if j != i)[:10]
        assert sorted(zip((-score[at == i]).tolist(), found[at == i].tolist(), strict=True)) == want


def test_query_blocks_in_many_bundles_and_an_id_of_many_vectors(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BUNDLE", 8)
    r = np.random.default_rng(6)
    vectors = [(i, r.normal(size=12).tolist()) for i in range(600)] + [(40, (np.array([3.0] * 12) + r.normal(size=12) * 0.01).tolist()) for _ in range(30)] + [(700 + i, [0.0] * 12) for i in range(5)]
    queries = vectors[:600:20] + vectors[-5::5]
    assert run(spark, queries, vectors, data_block=100, query_block=4) == brute(queries, vectors)


def test_a_data_block_is_sent_once_for_all_query_blocks(spark):
    r = np.random.default_rng(7)
    frame = lambda rows, ids: spark.createDataFrame([(8, v, [(i, 1)]) for i, v in zip(ids, rows.tolist(), strict=True)], "dims int, vector array<long>, ids array<struct<vec_id:long,n:long>>")
    data = np.floor(r.normal(size=(200, 8)) * 1024).astype(np.int64)
    cells = {8: covertree.far_apart(data.astype(float), 4)}
    left = covertree.materialize(covertree.with_trees(covertree.in_blocks(frame(data[::4], range(0, 200, 4)), cells, 2)), "left")
    right = covertree.materialize(covertree.with_trees(covertree.in_blocks(frame(data, range(200)), cells, 80)), "right")
    pairs = left.select(covertree.F.col("block").alias("q_block")).crossJoin(right.select("block"))
    sent = covertree.bundles(pairs, left, right)
    assert left.count() > 20 and sent.count() == right.count()
    assert sent.agg(covertree.F.sum(covertree.F.size("queries"))).first()[0] == left.count() * right.count()
