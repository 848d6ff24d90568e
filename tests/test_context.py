import random

from convlake.operators import context


def test_newest_that_fit_by_cells(spark):
    rng = random.Random(9)
    rows = [(g, i, float(rng.randrange(20)), rng.randrange(1, 60)) for g in ("a", "b") for i in range(120)] + [("c", 1, 0.0, 9000), ("c", 2, -1.0, 5), ("d", 1, 0.0, 400)]
    for budget in (50, 400, 10_000):
        want = []
        for g in "abcd":
            used = 0
            for k, (_, i, newest, size) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))):
                used += min(size, budget) if k == 0 else size + 2
                if k and used > budget:
                    break
                want.append((g, i, k + 1))
        got = context.newest_that_fit(spark.createDataFrame(rows, "group_id string, id long, newest double, size long"), budget, cell=7)
        assert sorted((r["group_id"], r["id"], r["k"]) for r in got.collect()) == sorted(want)
