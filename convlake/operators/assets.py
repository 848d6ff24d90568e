"""Content-addressed attachments and their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upload_name(c: Column) -> Column:
    """the last path part of an upload's name, safe for a file system."""
    name = F.regexp_replace(F.substring_index(F.substring_index(F.coalesce(c, F.lit("")), "/", -1), "\\", -1), r"[^0-9A-Za-z._-]+", "_")
    name = F.regexp_replace(name, r"^[._]+", "")
    return F.when(name == "", "file").otherwise(F.substring(name, 1, 120))


def asset_rows(files: DataFrame) -> DataFrame:
    """H1: one row for each content of files (path, original_filename, content): stable_id, sha256, size, storage path; of equal contents the first path."""
    rows = files.select("path", "original_filename", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("size_bytes"))
    kept = rows.groupBy("sha256").agg(F.min(F.struct("path", "original_filename", "size_bytes")).alias("f"), F.count("*").alias("n_copies"))
    name = upload_name(F.col("f.original_filename"))
    return kept.select(F.concat(F.lit("asset:sha256:"), "sha256").alias("stable_id"), "sha256", F.col("f.original_filename").alias("original_filename"), F.concat(F.lit("assets/sha256/"), F.substring("sha256", 1, 2), F.lit("/"), "sha256", F.lit("-"), name).alias("storage_path"), F.col("f.size_bytes").cast("long").alias("size_bytes"), F.lower(F.regexp_extract("f.original_filename", r"(\.[0-9A-Za-z]{1,10})$", 1)).alias("extension"), "n_copies")


def attach(links: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """H2: links with those of ``new`` whose pair (owner, asset_id) is not there, each once."""
    pair = [owner, "asset_id"]
    return links.unionByName(new.dropDuplicates(pair).join(links.select(*pair), pair, "left_anti"))


def listed(links: DataFrame, assets: DataFrame, owner: str) -> DataFrame:
    """H3: for each owner, its assets in order of attachment."""
    rows = links.join(assets.withColumnRenamed("id", "asset_id"), "asset_id")
    return rows.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("attached_at_unix", "asset_id", "stable_id", "original_filename"))), lambda x: F.struct(x["stable_id"].alias("stable_id"), x["original_filename"].alias("original_filename"))).alias("assets"))


def bundle_manifest(conversation_links: DataFrame, message_links: DataFrame, messages: DataFrame, assets: DataFrame) -> DataFrame:
    """H4: conversation_id and the JSON of its attachments: those of the conversation, then of its messages in order."""
    a = assets.withColumnRenamed("id", "asset_id")
    own = conversation_links.join(a, "asset_id").select("conversation_id", F.lit(0).alias("tier"), F.lit(-1).alias("seq"), "attached_at_unix", "asset_id", "stable_id", upload_name(F.col("original_filename")).alias("name"))
    theirs = message_links.join(messages.select(F.col("id").alias("message_id"), "conversation_id", "sequence_index"), "message_id").join(a, "asset_id").select("conversation_id", F.lit(1).alias("tier"), F.col("sequence_index").cast("int").alias("seq"), "attached_at_unix", "asset_id", "stable_id", upload_name(F.col("original_filename")).alias("name"))
    rows = own.unionByName(theirs).groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("tier", "seq", "attached_at_unix", "asset_id", "stable_id", "name"))).alias("x"))
    return rows.select("conversation_id", F.to_json(F.transform("x", lambda y: F.struct(y["stable_id"].alias("stable_id"), y["name"].alias("file"), F.when(y["tier"] == 0, "conversation").otherwise("message").alias("scope")))).alias("manifest"))
