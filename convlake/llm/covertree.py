"""Exact top-k inner products by dual-tree search over cover trees.

Data and queries are indexed together: centres far from each other, chosen from a
bounded sample, cut both into blocks of vectors that are near each other, and a
cover tree is built over each block once.  The summaries of the blocks (centre,
covering radius, longest vector) bound the inner products of every pair of blocks.
Each query block first meets the blocks that promise most; the k-th scores found
there are carried along, so that a pair of blocks whose bound is below the worst
of them is pruned before anything of it is shuffled.  The query blocks that are left
for a data block travel to it in bundles.  Inside a pair both trees are descended
together, and a pair of nodes is pruned in the same way; points are compared by a
product of matrices where a node's children hold too few to be worth a bound.

Equal vectors are one point; of their ids only the k + 1 smallest can be among the
k best of a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlake.shared import materialize, release

K, SCALE = 10, 1024
#: Vectors of a data block and of a query block, about.
DATA_BLOCK, QUERY_BLOCK = 4096, 512
#: Vectors that the centres of the blocks are chosen from, and the most centres.
SAMPLE, CELLS = 8192, 1024
#: Blocks of data that a query block meets first.
FIRST = 2
#: A node covers within BASE**level; one with so few points has no children.
BASE, LEAF = 1.3, 8
#: Bytes of query block summaries that one pass over the data block summaries takes along.
PASS_BYTES = 64 << 20
#: Points whose distances are computed at once while a tree grows; inner products that are held at once.
BATCH, AT_ONCE = 64, 1 << 18
#: Points of a child, on average, that a bound is worth; below that all points of a node are compared at once.
WORTH = 8
#: Below this share of pairs that can help, nodes descend apart.
DENSE = 0.5
#: Queries, about, that a data block meets in one row.
BUNDLE = 4096

LOWEST, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class CoverTree:
    """Nodes in pre-order over points reordered so that a node's points are one slice.

    A node of level i covers its points within radius BASE**i of its centre, which
    is also the centre of its first child (nesting); its children, of level i - 1
    or lower, have centres more than BASE**(i - 1) apart (separation).
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.square = (points**2).sum(1)
        self.whole = bool(len(points)) and 4 * float(self.square.max(initial=0)) < 2**52
        self.order = np.arange(len(points))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.children: list[list[int]] = []
        if len(points):
            self.grow(0, np.arange(len(points)), self.distances(np.array([0]), np.arange(len(points)))[0])

    def distances(self, centres: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances of centres (rows of the result) to points; without cancellation where squares can round."""
        if self.whole:
            square = self.square[centres, None] + self.square[None, rows] - 2 * (self.points[centres] @ self.points[rows].T)
            return np.sqrt(np.maximum(square, 0))
        return np.stack([np.sqrt(((self.points[rows] - self.points[c]) ** 2).sum(1)) for c in centres])

    def net(self, centre: int, rows: np.ndarray, distance: np.ndarray, reach: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(centre, points, distances) of parts: each point is with the first centre within reach, the node's own first."""
        near = distance <= reach
        parts = [(centre, rows[near], distance[near])]
        rest = rows[~near]
        while len(rest):
            some = self.distances(rest[:BATCH], rest)
            free = np.ones(len(rest), bool)
            for i in range(len(some)):
                if free[i]:
                    own = free & (some[i] <= reach)
                    parts.append((int(rest[i]), rest[own], some[i][own]))
                    free &= ~own
            rest = rest[free]
        return parts

    def grow(self, centre: int, rows: np.ndarray, distance: np.ndarray) -> None:
        """Build the nodes below a centre; a list of pending nodes in place of recursion, so that depth is free."""
        pending = [(centre, rows, distance, math.inf, 0, -1)]
        while pending:
            centre, rows, distance, level, at, parent = pending.pop()
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(distance.max()))
            self.first.append(at)
            self.last.append(at + len(rows))
            self.children.append([])
            self.order[at : at + len(rows)] = rows
            if parent >= 0:
                self.children[parent].append(node)
            if len(rows) <= LEAF or not self.radius[-1]:
                continue
            level = min(level, math.ceil(math.log(self.radius[-1], BASE)))
            for part in self.net(centre, rows, distance, BASE ** (level - 1)):
                pending.append((*part, level - 1, at, node))
                at += len(part[1])

    def packed(self) -> dict[str, np.ndarray]:
        length = np.sqrt(self.square)
        longest = [length[self.order[a:b]].max() for a, b in zip(self.first, self.last, strict=True)]
        return {"order": self.order, "centre": np.array(self.centre, np.int64), "radius": np.array(self.radius, np.float64), "longest": np.array(longest, np.float64), "first": np.array(self.first, np.int64), "last": np.array(self.last, np.int64), "child": np.array([c for x in self.children for c in x], np.int64), "upto": np.cumsum([0, *(len(x) for x in self.children)], dtype=np.int64)}


FIELDS = ("order", "centre", "radius", "longest", "first", "last", "child", "upto", "ids", "times", "at")
FLOATS = ("radius", "longest")
BLOCK = "dims int, block string, n int, middle array<double>, reach double, long double, width int, points binary, " + ", ".join(f"{f} binary" for f in FIELDS)


def block_row(dims: int, name: str, points: np.ndarray, ids: list[list[int]], times: list[list[int]]) -> dict[str, object]:
    """A block with its tree: distinct points, and for each the ids that have it and how often."""
    tree = CoverTree(points.astype(np.float64)).packed()
    at = np.cumsum([0, *map(len, ids)], dtype=np.int64)
    flat = {"ids": np.array([i for x in ids for i in x], np.int64), "times": np.array([t for x in times for t in x], np.int64), "at": at}
    width = np.dtype(np.int16 if not points.size or np.abs(points).max() < 2**15 else np.int64)
    top = {"middle": points[tree["centre"][0]].astype(float).tolist(), "reach": float(tree["radius"][0]), "long": float(tree["longest"][0])}
    return {"dims": dims, "block": name, "n": int(at[-1]), **top, "width": width.itemsize, "points": points.astype(width).tobytes(), **{f: x.tobytes() for f, x in {**tree, **flat}.items()}}


def unpack(row: dict[str, object]) -> dict[str, np.ndarray]:
    out = {f: np.frombuffer(row[f], np.float64 if f in FLOATS else np.int64) for f in FIELDS}
    flat = np.frombuffer(row["points"], f"i{row['width']}").astype(np.int64)
    points = flat.reshape(len(out["at"]) - 1, row["dims"])
    real = points.astype(np.float64)
    return {**out, "points": points, "real": real, "length": np.sqrt((real**2).sum(1)), "roots": np.array([0])}


def joined(trees: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Trees of one length side by side."""
    shift = lambda sizes: np.cumsum([0, *sizes[:-1]], dtype=np.int64)
    node, point = shift([len(x["centre"]) for x in trees]), shift([len(x["order"]) for x in trees])
    out = {f: np.concatenate([x[f] for x in trees]) for f in ("radius", "longest", "ids", "times", "points", "real", "length")}
    out |= {f: np.concatenate([x[f] + p for x, p in zip(trees, point, strict=True)]) for f in ("order", "centre", "first", "last")}
    out |= {f: np.concatenate([x[f] + n for x, n in zip(trees, node, strict=True)]) for f in ("child", "roots")}
    return out | {f: np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[f]) for x in trees]))]) for f in ("at", "upto")}


def bound(dot: np.ndarray, q: tuple, d: tuple) -> np.ndarray:
    """Largest inner product that two balls allow; each is (length of the centre, radius, longest vector).

    By the radii, or by the lengths and the distance that the radii leave between
    two vectors (2 qd = qq + dd - |q - d|^2), whichever is less.
    """
    (ql, qr, qm), (dl, dr, dm) = q, d
    ball = dot + qr * dl + dr * ql + qr * dr
    gap = np.maximum(np.sqrt(np.maximum(ql**2 + dl**2 - 2 * dot, 0)) - qr - dr, 0)
    by_length = (qm**2 + dm**2) * (0.5 + 1e-9) - gap**2 / 2
    least = np.where(qr + dr > 0, np.minimum(ball, by_length), ball)
    return least + 1e-6 + 1e-9 * (ql + qr) * (dl + dr)


class Search:
    """The k best of a data block for each query of joined query blocks; ``products`` counts inner products, bounds included.

    Sets of query nodes and of data nodes descend together.  Their bounds are one
    product of matrices; where few pairs can help, the nodes of the side that has
    fewer go on one by one, each with those of the other side that can.
    """

    def __init__(self, q: dict[str, np.ndarray], d: dict[str, np.ndarray], k: int, known: np.ndarray | None = None):
        self.q, self.d, self.k = q | single_leaves(q), d, k
        q = self.q
        self.of = np.repeat(np.arange(len(q["at"]) - 1), np.diff(q["at"]))  # the point of each query
        n = len(q["ids"])
        self.worst = np.full(n, -np.inf) if known is None else known.astype(np.float64)
        # no partial sum of an inner product is above the product of the lengths; below these it can't round
        most = q["length"].max(initial=0) * d["length"].max(initial=0)
        self.number = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64
        self.left, self.right = q["points"].astype(self.number), d["points"].astype(self.number)
        # queries in the order of the tree, and the places of a node's queries there
        self.line = spread(q["at"], q["order"])[0]
        upto = np.concatenate([[0], np.cumsum(np.diff(q["at"])[q["order"]])])
        self.begin, self.end = upto[q["first"]], upto[q["last"]]
        self.leaf, self.size = np.diff(q["upto"]) == 0, d["last"] - d["first"]
        kids = np.diff(d["upto"])
        self.small = (kids == 0) | (self.size < WORTH * kids)
        self.products = 0
        self.forget()
        if n and len(d["ids"]):
            if not self.small[0] and np.isneginf(self.worst).any():
                self.seed()
            self.descend()

    def forget(self) -> None:
        n = len(self.worst)
        self.scores, self.found = np.full((n, self.k), LOWEST), np.full((n, self.k), NO_ID)

    def bounds(self, a: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Bounds of query nodes (rows) and data nodes."""
        q, d = self.q, self.d
        c, m = q["centre"][a], d["centre"][nodes]
        self.products += len(a) * len(nodes)
        of_q = tuple(x[:, None] for x in (q["length"][c], q["radius"][a], q["longest"][a]))
        return bound(q["real"][c] @ d["real"][m].T, of_q, (d["length"][m], d["radius"][nodes], d["longest"][nodes]))

    def least(self, a: np.ndarray) -> np.ndarray:
        """The worst k-th score of each query node."""
        ends = np.stack([self.begin[a], self.end[a]], 1).ravel()
        return np.minimum.reduceat(np.append(self.worst[self.line], np.inf), ends)[::2]

    def queries(self, a: np.ndarray) -> np.ndarray:
        return self.line[spread_ranges(self.begin[a], self.end[a])]

    def points(self, nodes: np.ndarray) -> np.ndarray:
        return self.d["order"][spread_ranges(self.d["first"][nodes], self.d["last"][nodes])]

    def seed(self) -> None:
        """First k-th scores, of the node that promises most to each query; what is found is found again later."""
        leaves = np.flatnonzero(self.leaf)
        groups = [(leaves[np.isneginf(self.least(leaves))], 0)]
        while groups and len(groups[0][0]):
            a, node = groups.pop()
            best = np.zeros(len(a), np.int64)
            if not self.small[node]:
                opened = kids(self.d, np.array([node]))
                best = opened[self.bounds(a, opened).argmax(1)]
            on = (self.size[best] > self.k) & (best > 0)
            if not on.all():
                self.compare(self.queries(a[~on]), self.points(np.array([node]))[: WORTH * (self.k + 1)])
            groups += [(a[on & (best == x)], int(x)) for x in np.unique(best[on])]
        self.forget()

    def descend(self) -> None:
        stack = [(self.q["roots"], np.array([0]))]
        while stack:
            a, nodes = stack.pop()
            fits = self.bounds(a, nodes) >= self.least(a)[:, None]
            some, near = fits.any(1), fits.any(0)
            if not some.any():
                continue
            a, nodes, fits = a[some], nodes[near], fits[some][:, near]
            if fits.mean() >= DENSE:
                stack += self.opened(a, nodes)
            elif len(a) < len(nodes):
                for x, near in zip(a, fits, strict=True):
                    stack += self.opened(np.array([x]), nodes[near])
            else:
                for x, some in zip(nodes, fits.T, strict=True):
                    stack += self.opened(a[some], np.array([x]))

    def opened(self, a: np.ndarray, nodes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Compares leaves with nodes not worth opening; of the rest the wider side is opened."""
        (leaf, inner), (small, wide) = (a[self.leaf[a]], a[~self.leaf[a]]), (nodes[self.small[nodes]], nodes[~self.small[nodes]])
        if len(leaf) and len(small):
            self.compare(self.queries(leaf), self.points(small))
        out = [(leaf, kids(self.d, wide)), (kids(self.q, inner), small)]
        if len(inner) and len(wide):
            queries_first = self.q["radius"][inner].max() > self.d["radius"][wide].max()
            out.append((kids(self.q, inner), wide) if queries_first else (inner, kids(self.d, wide)))
        return [(x, y) for x, y in out if len(x) and len(y)]

    def compare(self, rows: np.ndarray, points: np.ndarray) -> None:
        """Queries against points, so many at a time."""
        few = max(1, AT_ONCE // len(points))
        theirs = self.right[points].T
        # a point that has one id is none for a query of this id
        single = np.where(np.diff(self.d["at"])[points] == 1, self.d["ids"][self.d["at"][points]], NO_ID)
        for i in range(0, len(rows), few):
            some = rows[i : i + few]
            got = self.left[self.of[some]] @ theirs
            self.products += got.size
            # a score outside of what float32 counts exactly is rounded, but not to the other side of ``got``
            near = got >= self.worst[some, None].astype(np.float32 if self.number == np.float32 else np.float64)
            if np.count_nonzero(near) > 2 * self.k * len(some):
                many = np.flatnonzero(np.count_nonzero(near, axis=1) > 2 * self.k)
                other = np.where(single == self.q["ids"][some[many], None], -np.inf, got[many])
                near[many] &= got[many] >= np.partition(other, -self.k, axis=1)[:, -self.k, None]
            r, p = np.divmod(np.flatnonzero(near), len(points))
            if len(r):
                self.keep(some[r], points[p], got[r, p].astype(np.int64))

    def keep(self, rows: np.ndarray, points: np.ndarray, score: np.ndarray) -> None:
        """Joins scores of queries and points with the k best so far."""
        place, of = spread(self.d["at"], points)
        ids, rows, score = self.d["ids"][place], rows[of], score[of]
        times = np.where(ids == self.q["ids"][rows], 0, self.d["times"][place])
        ids, rows, score = (np.repeat(x, times) for x in (ids, rows, score))
        own = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(own, self.k)])
        score, ids = np.concatenate([score, self.scores[own].ravel()]), np.concatenate([ids, self.found[own].ravel()])
        order = np.lexsort((ids, ~score, rows))
        first = np.searchsorted(rows[order], own)
        best = order[first[:, None] + np.arange(self.k)]  # each has k at least, as empty places count
        self.scores[own], self.found[own] = score[best], ids[best]
        full = own[self.found[own, -1] != NO_ID]
        self.worst[full] = np.maximum(self.worst[full], self.scores[full, -1])

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query in its block, query id, vector id, score) of what was found."""
        at, nth = np.nonzero(self.found != NO_ID)
        return at, self.q["ids"][at], self.found[at, nth], self.scores[at, nth]


def single_leaves(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Fields of the tree with a node for each point of a leaf that has several."""
    counts, size, n = np.diff(tree["upto"]), tree["last"] - tree["first"], len(tree["centre"])
    several = (counts == 0) & (size > 1)
    place = spread_ranges(tree["first"][several], tree["last"][several])
    points = tree["order"][place]
    more = {"centre": points, "radius": np.zeros(len(points)), "longest": tree["length"][points], "first": place, "last": place + 1}
    upto = np.concatenate([[0], np.cumsum(np.where(several, size, counts)), np.zeros(len(points), np.int64)])
    upto[n + 1 :] = upto[n]
    child = np.empty(upto[-1], np.int64)
    child[spread_ranges(upto[:n][~several], upto[1 : n + 1][~several])] = tree["child"]
    child[spread_ranges(upto[:n][several], upto[1 : n + 1][several])] = n + np.arange(len(points))
    return {f: np.concatenate([tree[f], x]) for f, x in more.items()} | {"upto": upto, "child": child}


def kids(tree: dict[str, np.ndarray], nodes: np.ndarray) -> np.ndarray:
    return tree["child"][spread(tree["upto"], nodes)[0]]


def spread_ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    size = last - first
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def spread(at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at[i] to at[i + 1] of each i of ``pick``, and the place in ``pick`` that each belongs to."""
    return spread_ranges(at[pick], at[pick + 1]), np.repeat(np.arange(len(pick)), at[pick + 1] - at[pick])


# --- blocks -------------------------------------------------------------------


def scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dims and the integer vector of every usable row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda c: c.cast("double")).alias("x"))
    finite = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
    return rows.select("vec_id", F.size("x").alias("dims"), F.transform("x", lambda c: F.floor(F.lit(SCALE) * c)).alias("vector"))


def distinct_points(rows: DataFrame, k: int) -> DataFrame:
    """dims, vector, ids: of equal vectors one row, with the k + 1 smallest ids and how often each has it (k at most)."""
    counted = rows.groupBy("dims", "vector", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    order = Window.partitionBy("dims", "vector").orderBy("vec_id")
    near = counted.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    return near.groupBy("dims", "vector").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` points (at most), each the farthest from those before it."""
    away, out = np.full(len(points), np.inf), [0]
    while len(out) < n:
        away = np.minimum(away, ((points - points[out[-1]]) ** 2).sum(1))
        if not away.max() > 0:
            break
        out.append(int(away.argmax()))
    return points[out]


def in_blocks(points: DataFrame, centres: dict[int, np.ndarray], size: int) -> DataFrame:
    """``points`` with ``block``: its nearest centre, and a part where a centre has more than ``size`` points."""
    sent = points.sparkSession.sparkContext.broadcast(centres)  # at most CELLS vectors of a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column("dims").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for n in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == n)
                near = sent.value.get(n)
                if n and near is not None:
                    x = batch.column("vector").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(np.float64)
                    cell[rows] = np.argmin((near**2).sum(1)[None, :] - 2 * x @ near.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    dealt = materialize(points.mapInArrow(run, schema + ", cell int"), "celled")
    parts = dealt.groupBy("dims", "cell").agg(F.ceil(F.count("*") / size).alias("parts"))
    # one row for each length and centre
    part = F.pmod(F.xxhash64("vector", "ids"), F.col("parts")).cast("string")
    return dealt.join(parts, ["dims", "cell"]).withColumn("block", F.concat_ws("/", F.col("dims").cast("string"), F.col("cell").cast("string"), part)).drop("cell", "parts")


def with_trees(points: DataFrame) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dims, name = key
        vectors = np.stack(pdf["vector"].to_numpy()).reshape(len(pdf), dims) if dims else np.zeros((len(pdf), 0), np.int64)
        ids, times = ([[x[f] for x in row] for row in pdf["ids"]] for f in ("vec_id", "n"))
        return pd.DataFrame([block_row(dims, name, vectors.astype(np.int64), ids, times)])

    return points.groupBy("dims", "block").applyInPandas(run, BLOCK)


class Heads:
    """Summaries of query blocks of one length, and for each the ``worst`` of the k-th scores found so far."""

    def __init__(self, rows: pd.DataFrame, dims: int):
        self.names = rows["block"].to_numpy()
        self.middle = np.stack(rows["middle"].to_numpy()).astype(np.float64).reshape(len(rows), dims)
        self.length = np.sqrt((self.middle**2).sum(1))
        self.reach, self.long = rows["reach"].to_numpy(), rows["long"].to_numpy()
        self.worst = rows["worst"].to_numpy() if "worst" in rows else None

    def bounds(self, row: dict[str, object]) -> np.ndarray:
        """Largest inner product of each query block with a data block."""
        own = np.array(row["middle"], np.float64)
        return bound(self.middle @ own, (self.length, self.reach, self.long), (np.sqrt((own**2).sum()), row["reach"], row["long"]))


class Best:
    """The ``n`` data blocks that promise most to each query block, of those seen."""

    def __init__(self, heads: Heads, n: int):
        self.heads, self.values, self.which, self.names = heads, np.full((len(heads.names), n), -np.inf), np.full((len(heads.names), n), -1), []

    def see(self, row: dict[str, object]) -> None:
        values, least = self.heads.bounds(row), self.values.argmin(1)
        more = np.flatnonzero((values > self.values[np.arange(len(values)), least]) | (self.which[np.arange(len(values)), least] < 0))
        self.values[more, least[more]], self.which[more, least[more]] = values[more], len(self.names)
        self.names.append(row["block"])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, nth = np.nonzero(self.which >= 0)
        return self.heads.names[q], np.array(self.names, object)[self.which[q, nth]], self.values[q, nth]


def block_pairs(left: DataFrame, right: DataFrame, first: int | None = None) -> DataFrame:
    """q_block, block and bound of pairs of a query block and a data block of one length, from their summaries alone.

    With ``first``, each task gives the ``first`` data blocks of its own that
    promise most to each query block.  Without, ``left`` has ``worst``, and only
    pairs whose bound reaches it are given.  The pairs of all blocks with all are
    never rows: bounds are computed where the data blocks' summaries are read.
    """
    spark = left.sparkSession
    heads = left.select("dims", "block", "middle", "reach", "long", *([] if first else ["worst"]))
    total = heads.agg(F.sum(F.col("dims") * 8 + 72)).first()[0] or 0
    passes, out = max(1, -(-total // PASS_BYTES)), None
    for p in range(passes):
        some = heads.filter(F.pmod(F.xxhash64("block"), F.lit(passes)) == p).toPandas()  # PASS_BYTES, about
        sent = spark.sparkContext.broadcast({int(n): Heads(g, int(n)) for n, g in some.groupby("dims")})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[int, Best] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    heads = sent.value.get(row["dims"])
                    if heads is None:
                        continue
                    if first:
                        best.setdefault(row["dims"], Best(heads, first)).see(row)
                        continue
                    values = heads.bounds(row)
                    fit = np.flatnonzero(values >= heads.worst)
                    if len(fit):
                        yield pairs_batch(heads.names[fit], np.full(len(fit), row["block"], object), values[fit])
            for found in best.values():
                yield pairs_batch(*found.pairs())

        part = right.select("dims", "block", "middle", "reach", "long").mapInArrow(run, "q_block string, block string, bound double")
        out = part if out is None else out.union(part)
    return out


def pairs_batch(q_block: np.ndarray, block: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q_block, pa.string()), pa.array(block, pa.string()), pa.array(values, pa.float64())], names=["q_block", "block", "bound"])


HITS = "q_block string, at int, query_id long, vec_id long, score long"


def bundles(pairs: DataFrame, left: DataFrame, right: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Data blocks, each with ``queries``: a bundle of the query blocks that it is paired with, about ``BUNDLE`` queries.

    So a data block is sent once for a bundle and not for each pair.  ``known`` has
    the k-th score of each query of a block so far.
    """
    fields = [c for c in left.columns if c not in ("dims", "n", "middle", "reach", "long")]
    mine = left.select(F.col("block").alias("q_block"), F.struct(*fields).alias("asked"))
    mine = mine.withColumn("known", F.lit(None).cast("array<double>")) if known is None else mine.join(known.select("q_block", "known"), "q_block")
    # of one data block as many rows as query blocks are left for it, names and counts alone
    before = Window.partitionBy("block").orderBy("q_block").rowsBetween(Window.unboundedPreceding, -1)
    bundle = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / BUNDLE)
    dealt = pairs.select("q_block", "block").join(left.select(F.col("block").alias("q_block"), "n"), "q_block").select("q_block", "block", bundle.alias("bundle"))
    sent = dealt.join(mine, "q_block").groupBy("block", "bundle").agg(F.collect_list(F.struct("asked", "known")).alias("queries"))
    return sent.drop("bundle").join(right.select("dims", *fields), "block")


def meet(pairs: DataFrame, left: DataFrame, right: DataFrame, k: int, known: DataFrame | None = None) -> DataFrame:
    """Hits of the given pairs of blocks; ``known`` has the k-th score of each query of a block so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r].as_py() for name in batch.schema.names}
                asked = [one["asked"] for one in row["queries"]]
                trees = [unpack({"dims": row["dims"], **x}) for x in asked]
                known = np.concatenate([np.full(len(x["ids"]), -np.inf) if one["known"] is None else np.array([-np.inf if s is None else s for s in one["known"]]) for x, one in zip(trees, row["queries"], strict=True)])
                at, *found = Search(joined(trees), unpack(row), k, known).hits()
                begin = np.cumsum([0, *(len(x["ids"]) for x in trees)])
                nth = np.searchsorted(begin, at, "right") - 1
                names = np.array([x["block"] for x in asked], object)[nth]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(at - begin[nth], pa.int32()), *(pa.array(x) for x in found)], names=["q_block", "at", "query_id", "vec_id", "score"])

    return bundles(pairs, left, right, known).mapInArrow(run, HITS)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k highest integer inner products, ties to the smaller id.

    Components become floor(1024 * x).  A query's own id is no candidate.  Vectors
    that are null, hold null or non-finite components or have no id take no part;
    only vectors of equal length meet (those of length 0 score 0).  Rows with the
    same id are candidates of their own; of equal queries (id and vector) one is
    answered, different queries with one id share its k places.  Fewer candidates
    than k: all.  Inner products are 64-bit integers.  No queries or no vectors:
    no rows.  Other columns are ignored, whatever their names.

    Blocks are cut by the nearest of at most ``CELLS`` centres, and below that by
    a hash.  Pairs of blocks are rows only if they are among a query block's first
    or their bound reaches its worst k-th score so far.
    """
    asked = scaled(queries, id_col, vector_col).distinct().select("dims", "vector", F.array(F.struct("vec_id", F.lit(1).cast("long").alias("n"))).alias("ids"))
    points = materialize(distinct_points(scaled(vectors, id_col, vector_col), k), "points")
    n = points.count()
    # a bounded sample, by hash
    sample = points.select("dims", "vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toPandas()
    cells = lambda dims, m: max(1, min(CELLS, m // 4, (PASS_BYTES // (8 * max(dims, 1))), -(-n // data_block)))
    centres = {int(d): far_apart(np.stack(g["vector"].to_numpy()).astype(np.float64), cells(d, len(g))) for d, g in sample.groupby("dims") if d}
    left = materialize(with_trees(in_blocks(asked, centres, query_block)), "query-blocks")
    right = materialize(with_trees(in_blocks(points, centres, data_block)), "data-blocks")
    release(points)

    nth = Window.partitionBy("q_block").orderBy(F.desc("bound"), "block")
    opening = block_pairs(left, right, FIRST).withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= FIRST)
    opening = materialize(opening.select("q_block", "block"), "first-pairs")
    first = materialize(meet(opening, left, right, k), "first-hits")
    # the k-th score of each query so far: of different queries in one place none is lost
    best = Window.partitionBy("q_block", "at").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == k).select("q_block", "at", F.col("score").cast("double").alias("score"))
    known = kth.groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("at", "score"))).alias("by"))
    known = left.select(F.col("block").alias("q_block"), "n").join(known, "q_block", "left").select("q_block", F.expr("transform(sequence(0, n - 1), i -> by[i])").alias("known"))
    known = known.withColumn("worst", F.when(F.exists("known", lambda s: s.isNull()), float("-inf")).otherwise(F.array_min("known")))
    known = materialize(known, "known")
    heads = left.join(known.select(F.col("q_block").alias("block"), "worst"), "block")
    rest = block_pairs(heads, right).join(opening, ["q_block", "block"], "left_anti")
    hits = first.union(meet(rest, left, right, k, known)).select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
