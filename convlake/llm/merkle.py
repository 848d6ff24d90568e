"""A Merkle manifest of a table: one digest for all rows, and a proof for each row.

The leaves of a group are cut into aligned blocks of 2 ** ``BLOCK_LEVELS`` places.
A block is one row that keeps each of its levels as one string of hex digests:
fixed-width substrings are hashed to the next level, and the substrings beside a
node are its siblings.  The digests on top of the blocks are the leaves of the
next round, until every group is down to one; the groups' digests, in order of
their keys, are then a group of their own.  Proofs go the same way back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.operators.ranking import positions
from convlake.shared import materialize

#: Levels of a block: 512 leaves, 32 KB of digests on its lowest level.
BLOCK_LEVELS = 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose crc32 of doc_id this number divides are the tampered ones.
TAMPER_EVERY = 7


def digest(columns: list[Column]) -> Column:
    """sha256 of the columns, each as its UTF-8 length, a colon and the value, or a dash for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", counted: str = "n_chars") -> DataFrame:
    """key (of the group, without null and in its order), doc_id, leaf, and tampered: the leaf with ``counted`` one higher, for the rows that are tampered with."""
    changed = [(F.col(c).cast("decimal(20,0)") + 1) if c == counted else F.col(c) for c in fields]
    hit = (F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0) & F.col(counted).isNotNull()
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # "-" sorts before "="
    return docs.select(key.alias("key"), "doc_id", digest([F.col(c) for c in fields]).alias("leaf"), F.when(hit, digest(changed)).alias("tampered"))


def blocks(nodes: DataFrame, kept: list[str], levels: int) -> DataFrame:
    """key, block, height, items (position, leaf, ``kept``) in order, levels (strings of hex digests, the lowest first) and top."""
    rows = nodes.groupBy("key", F.shiftright("position", levels).alias("block")).agg(F.array_sort(F.collect_list(F.struct("position", "leaf", *kept))).alias("items"))
    # the first block of a group may be its only one: it ends as soon as one digest is left
    rows = rows.withColumn("height", F.expr(f"if(block > 0, {levels}, if(size(items) = 1, 0, length(bin(size(items) - 1))))"))
    above = """
        aggregate(slice(sequence(1, {0}), 1, height), array(array_join(items.leaf, '')), (done, k) -> concat(done, array(array_join(transform(
            sequence(0, (octet_length(element_at(done, -1)) - 1) div 128),
            i -> sha2(substring(cast(element_at(done, -1) as binary), i * 128 + 1, 128), 256)), ''))))
    """.format(levels)
    return rows.withColumn("levels", F.expr(above)).withColumn("top", F.element_at("levels", -1))


def build(nodes: DataFrame, kept: list[str], levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """The rounds of blocks over ``nodes`` (key, position, leaf, ``kept``), the lowest first; the last has one block for each key."""
    rounds = []
    while True:
        rounds.append(materialize(blocks(nodes, kept, levels), "blocks"))
        if not rounds[-1].agg(F.max("block")).first()[0]:
            return rounds
        nodes, kept = rounds[-1].select("key", F.col("block").alias("position"), F.col("top").alias("leaf")), []


def prove(rounds: list[DataFrame], tops: DataFrame, kept: list[str], levels: int = BLOCK_LEVELS) -> DataFrame:
    """All nodes of the lowest round with ``proof``: their siblings (left, right) from level to level, up to the root.

    ``tops`` (key, block 0, proof, more) are the proofs of the groups' own digests;
    its further columns go to all nodes below.
    """
    place = f"shiftright(cast(x.position - block * {2**levels} as int), k)"  # of the node above x on level k, within its block
    level = "cast(levels[k] as binary)"
    left = f"cast(substring({level}, 64 * {place} - 63, 64 * ({place} % 2)) as string)"
    right = f"cast(substring({level}, 64 * {place} + 65, 64 * (1 - {place} % 2)) as string)"
    beside = f"transform(items, x -> struct(x as item, transform(slice(sequence(0, {levels}), 1, height), k -> struct({left} as left, {right} as right)) as own))"
    more = [c for c in tops.columns if c not in ("key", "block", "proof")]
    for i, rows in reversed(list(enumerate(rounds))):
        nodes = rows.select("key", "block", F.expr(beside).alias("nodes"))
        found = nodes.join(tops, ["key", "block"]).select("key", "proof", *more, F.explode("nodes").alias("n"))
        columns = [F.col(f"n.item.{c}") for c in ("leaf", *kept)] if i == 0 else []
        tops = found.select("key", F.col("n.item.position").alias("block"), F.concat("n.own", "proof").alias("proof"), *more, *columns)
    return tops


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda done, s: F.sha2(F.concat(s["left"], done, s["right"]), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", counted: str = "n_chars", levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (siblings by level), proof_sha256, folded_root and verified of every row of ``docs``.

    Null values are hashed as a dash, so that a null and an empty text differ; a null
    group is a group, the first.  Rows without a doc_id come first in their group;
    rows that share one are ordered by their leaf, and repeated rows are leaves of
    their own.  Texts of any length are hashed whole.  No rows give none.  Other
    columns are ignored, whatever their names.
    """
    kept = ["doc_id", "tampered"]
    rounds = build(positions(leaves(docs, fields, group, counted), ["key"], ["doc_id", "leaf"]), kept, levels)
    subroots = materialize(rounds[-1].select(F.lit("").alias("all"), F.col("key").alias("of"), F.col("top").alias("leaf")), "subroots")
    above = build(positions(subroots, ["all"], ["of"]).withColumnRenamed("all", "key"), ["of"], levels)
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    top = prove(above, above[-1].select("key", "block", none.alias("proof"), F.col("top").alias("root")), ["of"], levels)
    groups = materialize(top.select(F.col("of").alias("key"), F.lit(0).cast("long").alias("block"), "proof", F.col("leaf").alias("subroot"), "root"), "subproofs")
    rows = prove(rounds, groups, kept, levels)
    joined = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    out = rows.select("doc_id", "leaf", "subroot", "root", "proof", F.sha2(joined, 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
