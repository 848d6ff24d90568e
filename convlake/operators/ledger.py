"""Writes to the ledger: idempotent loads, import runs, flags, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.operators.ranking import global_index
from convlake.shared import materialize

KEY = ["source", "source_conversation_id"]


def new_conversations(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """Incoming conversations (source, source_conversation_id, path, position, ...) whose key is not in the ledger; of equal keys the first."""
    order = Window.partitionBy(*KEY).orderBy("path", "position")
    first = incoming.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")
    return first.join(ledger.select(*KEY), KEY, "left_anti")


def with_ids(rows: DataFrame, ledger: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows with ``id`` after the ledger's largest, in the order of their key."""
    last = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    return global_index(rows, order or KEY, "__at").join(F.broadcast(last), F.lit(True)).withColumn("id", F.col("last") + F.col("__at") + 1).drop("__at", "last")  # one row


def load(parsed: DataFrame, conversations: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New conversation rows, new message rows, and per source the counts of imported, messages and skipped.

    Fills title-derived tags; an incoming key that is known, or came before in the
    same load, is skipped.
    """
    incoming = parsed.withColumnRenamed("provider", "source").withColumn("title", F.coalesce("title", F.lit("Untitled Conversation")))
    fresh = materialize(with_ids(new_conversations(incoming, conversations), conversations), "fresh")
    new = fresh.select("id", *KEY, "title", F.col("created_at").alias("created_at_unix"), F.col("updated_at").alias("updated_at_unix"), F.lit(False).alias("is_archived"), F.lit(False).alias("is_starred"), T.auto_tag(F.col("title")).alias("tags"), F.to_json("metadata").alias("source_metadata_json"))
    said = fresh.select(F.col("id").alias("conversation_id"), F.explode("messages").alias("m")).select("conversation_id", "m.source_message_id", "m.role", "m.content", "m.sequence_index", F.col("m.created_at").alias("created_at_unix"))
    said = with_ids(said, messages, ["conversation_id", "sequence_index"])
    got = fresh.groupBy("source").agg(F.count("*").alias("imported"), F.sum(F.size("messages")).alias("messages"))
    counts = incoming.groupBy("source").agg(F.count("*").alias("seen")).join(got, "source", "left").select("source", F.coalesce("imported", F.lit(0)).alias("imported"), F.coalesce("messages", F.lit(0)).alias("messages"), (F.col("seen") - F.coalesce("imported", F.lit(0))).alias("skipped"))
    return new, said, counts


def outcome(imported: Column, skipped: Column, failed: Column, reached: Column) -> Column:
    """Status of an import attempt, by the first rule that holds."""
    some = imported + skipped > 0
    return F.when(~reached, "failed").when((failed > 0) & some, "partial").when(failed > 0, "failed").when(imported > 0, "success").when(skipped > 0, "duplicate_only").otherwise("failed")


def import_runs(attempts: DataFrame) -> DataFrame:
    """Log rows of attempts (id, provider, filename, imported_at, imported, messages, skipped, failed, reached, error)."""
    status = outcome(F.col("imported"), F.col("skipped"), F.col("failed"), F.col("reached"))
    return attempts.select("id", "provider", "filename", "imported_at", status.alias("status"), F.col("imported").cast("int").alias("conversations_imported"), F.col("messages").cast("int").alias("messages_imported"), F.col("skipped").cast("int").alias("conversations_skipped"), F.col("failed").cast("int").alias("conversations_failed"), F.substring("error", 1, 500).alias("error_message"))


def append(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Add rows to a log."""
    df.write.mode("append").format(form).save(path)


def rewrite(df: DataFrame, path: str, version: str) -> str:
    """A new version of a store beside the old ones; readers follow the returned path."""
    out = f"{path}/version={version}"
    df.write.mode("errorifexists").json(out)
    return out


def set_flags(conversations: DataFrame, updates: DataFrame) -> DataFrame:
    """Flags after updates (id, flag, value, at): the last of each flag holds; flags are is_archived and is_starred."""
    last = updates.groupBy("id").pivot("flag", ["is_archived", "is_starred"]).agg(F.max_by("value", "at"))
    return conversations.join(last.select("id", F.col("is_archived").alias("__a"), F.col("is_starred").alias("__s")), "id", "left").withColumns({"is_archived": F.coalesce("__a", "is_archived"), "is_starred": F.coalesce("__s", "is_starred")}).drop("__a", "__s")


def clip(messages: DataFrame, conversations: DataFrame, chosen: DataFrame) -> DataFrame:
    """A note for each chosen message (message_id), with its source below and the tag ``clipped``."""
    rows = messages.withColumnRenamed("id", "message_id").join(chosen, "message_id").join(conversations.select(F.col("id").alias("conversation_id"), "title", "source"), "conversation_id")
    cite = F.concat(F.lit('— from "'), "title", F.lit('" ('), "source", F.lit(")"))
    return rows.select("message_id", F.lit("user").alias("role"), F.concat_ws("\n", "content", F.lit(""), cite).alias("content"), F.lit("clipped").alias("tags"))


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows whose key is not in ``gone`` (id)."""
    return rows.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def without_any(records: DataFrame, ids: str, gone: DataFrame, key: str) -> DataFrame:
    """Records none of whose ids (an array column) is in ``gone`` (stable_id)."""
    hit = records.select(key, F.explode(ids).alias("stable_id")).join(gone, "stable_id", "left_semi").select(key).distinct()
    return records.join(hit, key, "left_anti")


def cascade_delete(gone: DataFrame, conversations: DataFrame, messages: DataFrame, links: DataFrame | None = None, stores: dict[str, tuple[DataFrame, str, str]] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of every table after deleting conversations (gone: id), and counts of what goes.

    ``stores`` maps a name to (records, key, column of stable-id arrays).
    """
    stable = gone.select(T.stable_id("imported_conversation", F.col("id")).alias("stable_id"))
    left = {"conversations": without(conversations, "id", gone), "messages": without(messages, "conversation_id", gone)}
    before = {"conversations": conversations, "messages": messages}
    if links is not None:
        left["links"], before["links"] = without(links, "conversation_id", gone), links
    for name, (records, key, ids) in (stores or {}).items():
        left[name], before[name] = without_any(records, ids, stable, key), records
    counts = None
    for name, kept in left.items():
        row = before[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n").unionByName(kept.agg((-F.count("*")).alias("n")).select(F.lit(name).alias("store"), "n")).groupBy("store").agg(F.sum("n").alias("deleted"))
        counts = row if counts is None else counts.unionByName(row)
    return left, counts
