"""The prefix trie of conversations, from their sorted order.

Equal conversations become one item; items are sorted by their turns and cut into
ranges.  In a range, edges between neighbours carry the length of their common
prefix; union-find takes them from the deepest to the shallowest, and each merge
of components makes a branching node.  What hangs below the range's first and
last item may go on in the ranges beside it: a range's forest is contracted to
the nodes on those two paths, and these are merged across the ranges by a hash of
their prefix.

A long conversation is several items, of ``SEGMENT`` turns each; the segments that
follow one prefix are a group.  Groups of deeper segments are done first and
come back as an item of their prefix.  Segments that only one conversation
reaches are a single path and need no sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate
from operator import xor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.operators.ranking import positions
from convlake.shared import materialize

#: Turns of an item.
SEGMENT = 64
#: Hex digits of a turn's digest.
WIDTH = 32
#: Ids in one row while a node's members are listed.
LISTED = 4096
#: Nodes on the edges of ranges that are broadcast; more are joined by a shuffle.
BROADCAST_NODES = 200_000

ITEM = ["g1", "g2", "seq", "h1", "h2", "b", "n", "c", "children", "leaves", "below", "ended"]
NODE = "kind string, id1 long, id2 long, depth long, conv_id long, n long, children long, leaves long, saved long, ended boolean, parent long, p1 long, p2 long, bytes long, path1 array<long>, path2 array<long>"
NAMES = [f.split()[0] for f in NODE.split(", ")]
TYPES = pa.schema([pa.field(n, {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}.get(t, pa.list_(pa.int64()))) for n, t in (f.split() for f in NODE.split(", "))])


# --- turns -------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position, digest and bytes of every turn; turns that tie are ordered by their digest."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(WIDTH))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return positions(rows, ["conv_id"], ["turn", "digest"]).drop("turn")


def rebuilt(rows: DataFrame, every: int = 5, longest: int = 8) -> DataFrame:
    """conv_id, depth, digest, bytes: the first h turns of a family's first conversation, then the own ones after h.

    A family is ``every`` ids; h is crc32 of the id modulo ``longest`` + 1.  Each
    conversation also has a row of depth 0 without a digest.
    """
    heads = rows.filter((F.col("conv_id") % every == 0) & (F.col("position") < longest)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("position", "digest", "bytes"))).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (longest + 1)).cast("int")
    ids = rows.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h")))
    ids = materialize(ids.join(heads, "base", "left").select("conv_id", "h", head.alias("head"), F.coalesce(F.size(head), F.lit(0)).alias("taken")), "heads")
    own = rows.join(ids.select("conv_id", "h", "taken"), "conv_id").filter("position >= h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "bytes")
    shared = ids.select("conv_id", F.posexplode("head").alias("k", "t")).select("conv_id", (F.col("k") + 1).cast("long").alias("depth"), "t.digest", "t.bytes")
    start = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return own.unionByName(shared).unionByName(start)


def segments(rows: DataFrame, size: int) -> DataFrame:
    """conv_id, s, g1, g2 (hash of all turns before), seq, h1, h2, b, x1, x2 (hash of its own turns), last.

    The hash of a prefix is the exclusive-or of two 64-bit hashes of each turn with
    its depth, so that it can be continued from any depth.
    """
    hashed = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", "digest")).otherwise(0).alias(f"h{k}") for k in (1, 2)]
    rows = rows.select("*", *hashed, F.expr(f"greatest(depth - 1, 0) div {size}").alias("s"))
    turn = F.when(F.col("depth") > 0, F.struct("depth", "digest", "h1", "h2", "bytes"))
    out = rows.groupBy("conv_id", "s").agg(F.array_sort(F.collect_list(turn)).alias("t"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    by = Window.partitionBy("conv_id").orderBy("s")  # a row for each segment
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    prefix = [F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0).cast("long")).alias(f"g{k}") for k in (1, 2)]
    return out.select("conv_id", "s", *prefix, F.array_join("t.digest", "").alias("seq"), F.col("t.h1").alias("h1"), F.col("t.h2").alias("h2"), F.col("t.bytes").alias("b"), "x1", "x2", F.lead("s").over(by).isNull().alias("last"))


# --- forests of ranges ---------------------------------------------------------


def common(a: str, b: str) -> int:
    """Turns that two sequences share from their start."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // WIDTH
    i = 0
    while a[i : i + WIDTH] == b[i : i + WIDTH]:
        i += WIDTH
    return i // WIDTH


class Forest:
    """The trie of a range of sorted items, as nodes at the ends of its unbranched paths."""

    def __init__(self, items: dict[str, list], base: int):
        self.items, self.base = items, base
        self.ends = [len(b) for b in items["b"]]
        self.bottom, self.n, self.c = list(self.ends), list(items["n"]), list(items["c"])
        self.children, self.leaves, self.below, self.ended = (list(items[k]) for k in ("children", "leaves", "below", "ended"))
        count = len(self.ends)
        self.item, self.parent, self.same = list(range(count)), [-1] * count, list(range(count))
        self.sums = [[0, *accumulate(b)] for b in items["b"]]
        group = list(zip(items["g1"], items["g2"], strict=True))
        edges = [(common(items["seq"][i], items["seq"][i + 1]), i) for i in range(count - 1) if group[i] == group[i + 1]]
        joined, top = list(range(count)), list(range(count))  # union-find over items; the node on top of a component
        for depth, i in sorted(edges, key=lambda e: (-e[0], e[1])):
            a, b = find(joined, i), find(joined, i + 1)
            joined[b] = a
            top[a] = self.merged(self.lifted(top[a], depth), self.lifted(top[b], depth))
        for i in range(count):
            if joined[i] == i:
                self.lifted(top[i], 0)

    def node(self, x: int) -> int:
        return find(self.same, x)

    def total(self, x: int, depth: int) -> int:
        """Saved tokens of the subtree that x's path begins below ``depth``."""
        sums = self.sums[self.item[x]]
        return self.below[x] + (self.n[x] - 1) * (sums[self.bottom[x]] - sums[depth])

    def leaf_count(self, x: int) -> int:
        return self.leaves[x] if self.children[x] else 1

    def lifted(self, x: int, depth: int) -> int:
        """The node at ``depth`` over x: x itself if it ends there."""
        if self.bottom[x] == depth:
            return x
        self.parent[x] = y = len(self.bottom)
        for column, value in ((self.bottom, depth), (self.n, self.n[x]), (self.c, self.c[x]), (self.children, 1), (self.leaves, self.leaf_count(x)), (self.below, self.total(x, depth)), (self.ended, False), (self.item, self.item[x]), (self.parent, -1), (self.same, y)):
            column.append(value)
        return y

    def merged(self, a: int, b: int) -> int:
        """One node in place of two of the same depth and prefix."""
        self.same[b] = a
        for column in (self.n, self.children, self.leaves, self.below):
            column[a] += column[b]
        self.c[a], self.ended[a] = min(self.c[a], self.c[b]), self.ended[a] or self.ended[b]
        return a

    def rows(self) -> Iterator[tuple]:
        """Finished nodes, roots of finished groups, and the parts of nodes over the first and last item."""
        items, base = self.items, self.base
        ids = [[list(accumulate([items[g][i], *items[h][i]], xor)) for g, h in (("g1", "h1"), ("g2", "h2"))] for i in range(len(self.ends))]
        upper = [self.node(p) if p >= 0 else -1 for p in self.parent]
        edge: set[int] = set()
        for x in (self.node(0), self.node(len(self.ends) - 1)):
            while x >= 0:
                edge.add(x)
                x = upper[x]
        below_edge: dict[int, list[int]] = {}
        for x in edge:
            below_edge.setdefault(upper[x], []).append(x)
        for x in range(len(self.bottom)):
            if self.same[x] != x:
                continue
            p, end, (one, two), sums = upper[x], self.bottom[x], ids[self.item[x]], self.sums[self.item[x]]
            top = self.bottom[p] + 1 if p >= 0 else 0
            for d in range(top, end + 1):
                at_end = d == end
                children, ended = self.children[x] if at_end else 1, self.ended[x] and at_end
                if x in edge:
                    kids = below_edge.get(x, []) if at_end else []
                    children = children - len(kids) if at_end else 0
                    leaves = self.leaves[x] - sum(map(self.leaf_count, kids)) if at_end else 0
                    saved = self.below[x] - sum(self.total(y, end) for y in kids) if at_end else 0
                    yield "open", one[d], two[d], base + d, self.c[x], self.n[x], children, leaves, saved, ended, None, one[d - 1] if d else None, two[d - 1] if d else None, sums[d] - sums[d - 1] if d else 0, one[: d + 1], two[: d + 1]
                    continue
                saved = self.total(x, d - 1) if d else self.below[x]
                known = d > top or p >= 0 and p not in edge and (self.bottom[p] > 0 or not base)
                parent = (self.c[x] if d > top else self.c[p]) if known else None
                to = (one[d - 1], two[d - 1]) if d and not known else (None, None)
                yield "node" if d else "root", one[d], two[d], base + d, self.c[x], self.n[x], children, self.leaf_count(x), saved, ended, parent, *to, None, None, None


def find(of: list[int], x: int) -> int:
    while of[x] != x:
        of[x] = of[of[x]]
        x = of[x]
    return x


def forest(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[pa.RecordBatch]:
    whole = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if whole is None:
        return
    rows: list[tuple] = []
    for row in Forest({c: whole.column(c).to_pylist() for c in ITEM}, base).rows():
        rows.append(row)
        if len(rows) == 10_000:
            yield packed(rows)
            rows = []
    yield packed(rows)


def packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES.types, strict=True)], schema=TYPES)


# --- ranges together -----------------------------------------------------------


def joined_edges(parts: DataFrame) -> DataFrame:
    """Nodes on the edges of ranges, whole: sums of their parts, and of all that hangs below them."""
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    same = [F.min(c).alias(c) for c in ("depth", "conv_id", "p1", "p2", "bytes", "path1", "path2")]
    nodes = materialize(parts.groupBy("id1", "id2").agg(*sums, *same, F.max("ended").alias("ended")), "edges")
    kids = nodes.filter("p1 is not null").groupBy(F.col("p1").alias("id1"), F.col("p2").alias("id2")).agg(F.count("*").alias("kids"))
    nodes = nodes.join(kids, ["id1", "id2"], "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0)))
    own = nodes.select(F.explode(F.arrays_zip("path1", "path2")).alias("up"), (F.col("leaves") + F.when(F.col("children") == 0, 1).otherwise(0)).alias("leaves"), (F.col("saved") + (F.col("n") - 1) * F.col("bytes")).alias("saved"))
    below = own.groupBy(F.col("up.path1").alias("id1"), F.col("up.path2").alias("id2")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    out = nodes.drop("leaves", "saved").join(below, ["id1", "id2"])
    return materialize(out.withColumn("parent", F.lit(None).cast("long")).withColumn("inner", F.size("path1") - 1), "edge-nodes")


def layer(items: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """Finished nodes and roots of a layer of items, and the nodes on the edges of its ranges."""
    order = ["g1", "g2", "seq"]
    ranges = items.select(*ITEM).repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(ranges.mapInArrow(lambda batches: forest(batches, base), NODE), "forest")
    return found.filter("kind <> 'open'"), joined_edges(found.filter("kind = 'open'"))


def member_digests(ends: DataFrame) -> DataFrame:
    """id1, id2, ends_sha256: sha256 of the ids (conv_id) that share a key, ascending, with commas between.

    Sorted ranges list ids in rows of at most ``LISTED``; those rows are hashed in
    order as a stream, so that many members of one key need no memory.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        out: list[tuple] = []
        for batch in batches:
            for a, b, i in zip(*(batch.column(c).to_pylist() for c in ("id1", "id2", "conv_id")), strict=True):
                if (a, b) != key or len(ids) == LISTED:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = (a, b), []
                ids.append(i)
            if len(out) > 1000:
                yield as_lists(out)
                out = []
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
        yield as_lists(out)

    def as_lists(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["id1", "id2", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("id1", "id2", "ids")), strict=True):
                if (a, b) != key:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield as_hashes(done)
        if state is not None:
            yield as_hashes([(*key, state.hexdigest())])

    def as_hashes(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["id1", "id2", "ends_sha256"])

    ranges = ends.repartitionByRange("id1", "id2", "conv_id").sortWithinPartitions("id1", "id2", "conv_id")
    listed = ranges.mapInArrow(lists, "id1 long, id2 long, first long, ids string")
    return listed.repartition("id1", "id2").sortWithinPartitions("id1", "id2", "first").mapInArrow(hashes, "id1 long, id2 long, ends_sha256 string")


def items_of(cut: DataFrame, ended: Column, n: Column, c: Column, children: Column, leaves: Column, below: Column) -> DataFrame:
    return cut.select("g1", "g2", "seq", "h1", "h2", "b", n.cast("long").alias("n"), c.alias("c"), children.cast("long").alias("children"), leaves.cast("long").alias("leaves"), below.cast("long").alias("below"), ended.alias("ended"))


def lone_tails(cut: DataFrame) -> tuple[DataFrame, int]:
    """conv_id and the first segment (lone) that no other conversation reaches; and the last segment that several reach."""
    reached = cut.filter("s > 0").groupBy("s", "g1", "g2").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    reached = materialize(reached, "reached")
    deepest = reached.filter("n > 1").agg(F.max("s")).first()[0] or 0
    return materialize(reached.filter("n = 1").groupBy("conv_id").agg(F.min("s").alias("lone")), "lone"), deepest


def path_nodes(tails: DataFrame, size: int) -> DataFrame:
    """The nodes of segments that one conversation alone reaches."""
    t = tails.select("*", F.posexplode("h1").alias("k", "own"))
    end = F.col("last") & (F.col("k") == F.size("h1") - 1)
    first = (F.col("s") == F.col("lone")) & (F.col("k") == 0)
    one = F.lit(1).cast("long")
    key = {f"id{i}": F.when(end, F.col(f"g{i}").bitwiseXOR(F.col(f"x{i}"))) for i in (1, 2)}
    up = {f"p{i}": F.when(first, F.col(f"g{i}")) for i in (1, 2)}
    values = {**key, "depth": F.col("s") * size + F.col("k") + 1, "conv_id": F.col("conv_id"), "n": one, "children": F.when(end, 0).otherwise(1).cast("long"), "leaves": one, "saved": F.lit(0).cast("long"), "ended": end, "parent": F.when(~first, F.col("conv_id")), **up}
    return t.select(*(v.alias(k) for k, v in values.items()))


def prefix_trie(conversations: DataFrame, every: int = 5, longest: int = 8, size: int = SEGMENT) -> DataFrame:
    """One row for each node of the trie of rebuilt ``conversations`` (conv_id, turn, role, text).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.  Null roles and texts are empty ones; a null turn comes first, and
    turns that tie, repeated rows too, are ordered by a digest of role and text.
    Rows without a conv_id belong to no conversation.  Texts of any length count
    whole.  No rows give no nodes.  Other columns are ignored, whatever their names.
    """
    cut = materialize(segments(rebuilt(turns(conversations), every, longest), size), "segments")
    lone, deepest = lone_tails(cut)
    cut = cut.join(lone, "conv_id", "left")
    shared = F.col("lone").isNull() | (F.col("s") < F.col("lone"))
    columns = ["id1", "id2", "depth", "conv_id", "n", "children", "leaves", "saved", "ended", "parent", "p1", "p2"]
    out, goals, below = [path_nodes(cut.filter(~shared), size)], [], None
    zero, one, yes, no = F.lit(0), F.lit(1), F.lit(True), F.lit(False)
    for s in range(deepest, -1, -1):
        own = cut.filter((F.col("s") == s) & shared)
        copies = own.filter("last").groupBy("g1", "g2", "seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("c"), F.min_by(F.struct("h1", "h2", "b"), "conv_id").alias("t"))
        items = items_of(copies.select("*", "t.*"), yes, F.col("n"), F.col("c"), zero, zero, zero)
        # what goes on as one conversation's path, and what goes on as a group
        items = items.unionByName(items_of(own.filter(F.col("lone") == s + 1), no, one, F.col("conv_id"), one, one, zero))
        if below is not None:
            rooted = own.join(below.withColumnsRenamed({c: f"r_{c}" for c in below.columns}), F.col("conv_id") == F.col("r_conv_id"))
            items = items.unionByName(items_of(rooted, no, F.col("r_n"), F.col("r_conv_id"), F.col("r_children"), F.col("r_leaves"), F.col("r_saved")))
        done, edges = layer(items, s * size)
        roots = ["conv_id", "n", "children", "leaves", "saved"]
        below = done.filter("kind = 'root'").select(*roots).unionByName(edges.filter("inner = 0").select(*roots)) if s else None
        edges = edges.filter("inner > 0") if s else edges
        done = done.filter("kind = 'node'")
        out += [done.select(*columns), edges.select(*columns)]
        goals += [edges.select("id1", "id2", "conv_id"), done.filter(F.col("depth") % size == 0).select("id1", "id2", "conv_id")]
    nodes = out[0].select(*columns)
    for more in out[1:]:
        nodes = nodes.unionByName(more)
    nodes = materialize(nodes, "nodes")
    goal = goals[0]
    for more in goals[1:]:
        goal = goal.unionByName(more)
    goal = materialize(goal.select(F.col("id1").alias("p1"), F.col("id2").alias("p2"), F.col("conv_id").alias("parent")), "parents")
    if goal.count() <= BROADCAST_NODES:
        goal = F.broadcast(goal)
    waiting = nodes.filter("p1 is not null").drop("parent").join(goal, ["p1", "p2"])
    nodes = nodes.filter("p1 is null").unionByName(waiting.select(nodes.columns))
    ends = member_digests(cut.filter("last").select(F.col("g1").bitwiseXOR(F.col("x1")).alias("id1"), F.col("g2").bitwiseXOR(F.col("x2")).alias("id2"), "conv_id"))
    some = nodes.filter("ended").join(ends, ["id1", "id2"])
    rest = nodes.filter("not ended").withColumn("ends_sha256", F.sha2(F.lit(""), 256))
    return some.unionByName(rest.select(some.columns)).select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
