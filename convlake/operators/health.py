"""Health checks of a ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages of no conversation."""
    return messages.join(conversations.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti")


def checks(conversations: DataFrame, messages: DataFrame, notes: DataFrame) -> DataFrame:
    """H5: (name, n, ok): rows of each table, and counts of what should not be there.

    Messages are counted by conversation and place, so that a hot conversation is
    in many tasks; its sequence is whole if the places are distinct and run from
    the number of messages without a place to the last one.
    """
    by_place = messages.groupBy(F.col("conversation_id").alias("id"), "sequence_index").agg(F.count("*").alias("n"))
    place = F.col("sequence_index")
    by_conversation = by_place.groupBy("id").agg(F.sum("n").alias("messages"), F.sum(F.when(place.isNull(), F.col("n")).otherwise(0)).alias("unplaced"), F.count(place).alias("places"), F.min(place).alias("low"), F.max(place).alias("high"))
    whole = (F.col("low") == F.col("unplaced")) & (F.col("high") == F.col("messages") - 1) & (F.col("places") == F.col("messages") - F.col("unplaced"))
    both = conversations.groupBy("id").agg(F.count("*").alias("conversations")).join(by_conversation, "id", "full")
    rows = [
        facts(
            both,
            conversations=F.sum("conversations"),
            messages=F.sum("messages"),
            orphan_messages=F.sum(F.when(F.col("conversations").isNull(), F.col("messages"))),
            repeated_conversation_ids=F.count_if(F.col("conversations") > 1),
            broken_sequences=F.count_if((F.col("places") > 0) & ~whole),
            empty_conversations=F.sum(F.when(F.col("messages").isNull(), F.col("conversations"))),
        ),
        facts(notes, notes=F.count("*")),
        facts(messages.groupBy("id").count(), repeated_message_ids=F.count_if(F.col("count") > 1)),
        facts(conversations.groupBy("source", "source_conversation_id").count(), repeated_source_keys=F.count_if(F.col("count") > 1)),
    ]
    return reduce(DataFrame.unionByName, rows)


def facts(rows: DataFrame, **counts: Column) -> DataFrame:
    """(name, n, ok) of several counts over one pass; all but the sizes of tables should be zero."""
    one = rows.agg(*(F.coalesce(n, F.lit(0)).cast("long").alias(name) for name, n in counts.items()))
    sizes = {"conversations", "messages", "notes"}
    lines = [F.struct(F.lit(name).alias("name"), F.col(name).alias("n"), (F.lit(True) if name in sizes else F.col(name) == 0).alias("ok")) for name in counts]
    return one.select(F.inline(F.array(*lines)))


def provider_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """H5: conversations and messages of each provider."""
    n = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("m"))
    return conversations.join(n, "id", "left").groupBy("source").agg(F.count("*").alias("conversations"), F.coalesce(F.sum("m"), F.lit(0)).alias("messages"))
