"""Connected components of a graph given as an edge table.

Large-star and small-star rounds (Kiveris et al., 2014): each is one grouped
minimum and one equi-join, and the number of rounds grows with the logarithm of
the number of nodes.  Every round is written to the shared folder, so that a lost
executor repeats one round at most.  The minima are written too before they are
joined: both sides of the join are then plain exchanges, of which Spark splits
the partitions of nodes with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.shared import materialize, release

ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(directed: DataFrame, keep_source: bool) -> DataFrame:
    """For edges (u, v): each u's least neighbour m joined to its other neighbours."""
    mins = materialize(directed.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = directed.join(mins, "u")
    if keep_source:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    else:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
    out = materialize(out.filter("a <> b").distinct(), "star")
    release(mins)
    return out


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its least node.

    Loops, repeated edges and edges with a null end add nothing (a loop's node is
    in the result only if another edge has it).  No edges: no rows.
    """
    now = materialize(edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct(), "edges")
    state = _state(now)
    for _ in range(ROUNDS):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, keep_source=False)
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), keep_source=True)
        release(now)
        release(large)
        now, before, state = small, state, _state(small)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = now.select(F.col("b").alias("a"), "b").distinct()
    return now.union(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
