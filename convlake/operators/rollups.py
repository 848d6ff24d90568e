"""Activity roll-ups over both lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.operators.browse import message_counts, with_counts
from convlake.schemas import NATIVE, PROVIDERS


def totals(conversations: DataFrame, messages: DataFrame, notes: DataFrame) -> DataFrame:
    """A1: one row of counts; notes count as conversations and messages of their own in the two sums."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    rows = [one(conversations, "n").withColumn("what", F.lit("conversations")), one(messages, "n").withColumn("what", F.lit("messages")), one(notes, "n").withColumn("what", F.lit("notes"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("what", "n")


def provider_breakdown(conversations: DataFrame, notes: DataFrame) -> DataFrame:
    """A2: conversations of each provider, notes as ``native``, with percent of all (one decimal)."""
    rows = conversations.groupBy(F.col("source").alias("provider")).agg(F.count("*").alias("n")).unionByName(notes.agg(F.count("*").alias("n")).select(F.lit(NATIVE).alias("provider"), "n").filter("n > 0"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.join(F.broadcast(total), F.lit(True)).select("provider", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("percent"))  # one row for each provider


def times(conversations: DataFrame, notes: DataFrame) -> DataFrame:
    return conversations.select(F.col("created_at_unix").alias("at")).unionByName(notes.select(F.col("timestamp").cast("double").alias("at")))


def date_range(conversations: DataFrame, notes: DataFrame) -> DataFrame:
    """A3: first and last time of both lanes; conversations end with their last update."""
    ends = conversations.select(F.coalesce("updated_at_unix", "created_at_unix").alias("at"))
    return times(conversations, notes).agg(F.min("at").alias("first_unix")).join(ends.unionByName(notes.select(F.col("timestamp").cast("double").alias("at"))).agg(F.max("at").alias("last_unix")), F.lit(True))


def monthly_activity(messages: DataFrame, notes: DataFrame) -> DataFrame:
    """A4: messages (and notes) of each UTC month."""
    rows = messages.select(F.col("created_at_unix").alias("at")).unionByName(notes.select(F.col("timestamp").cast("double").alias("at")))
    return rows.filter("at is not null").groupBy(T.month(F.col("at")).alias("month")).agg(F.count("*").alias("n"))


def most_active_month(messages: DataFrame, notes: DataFrame) -> DataFrame:
    """A4: the month with most, the earliest of equals."""
    return monthly_activity(messages, notes).orderBy(F.desc("n"), "month").limit(1)


def longest_conversations(conversations: DataFrame, messages: DataFrame, n: int = 1) -> DataFrame:
    """A5: by messages, then smaller id."""
    return message_counts(messages).join(conversations.select("id", "title", "source"), "id").orderBy(F.desc("message_count"), "id").limit(n)


def average_messages(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """One decimal; null without conversations."""
    return with_counts(conversations, messages).agg(F.round(F.sum("message_count") / F.count("*"), 1).alias("average"))


def earliest_conversation(conversations: DataFrame) -> DataFrame:
    """By creation, only if two or more have a time."""
    timed = conversations.filter("created_at_unix is not null")
    return timed.agg(F.min_by(F.struct("id", "title", "created_at_unix"), F.struct("created_at_unix", "id")).alias("c"), F.count("*").alias("n")).filter("n >= 2").select("c.*")


def unfinished(conversations: DataFrame, messages: DataFrame, loops: DataFrame | None = None, most: int = 3) -> DataFrame:
    """Open loops (conversation_id, text) first, then conversations whose last message is the user's, newest first."""
    last = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.max_by("role", F.struct("sequence_index", "id")).alias("role"))
    asked = conversations.join(last.filter("role = 'user'"), "id").select(F.lit(2).alias("tier"), "id", "title", F.coalesce("updated_at_unix", "created_at_unix", F.lit(0.0)).alias("at"))
    if loops is not None:
        open_ = loops.select(F.col("conversation_id").alias("id")).distinct().join(conversations, "id").select(F.lit(1).alias("tier"), "id", "title", F.coalesce("updated_at_unix", "created_at_unix", F.lit(0.0)).alias("at"))
        asked = open_.unionByName(asked.join(open_.select("id"), "id", "left_anti"))
    return asked.orderBy("tier", F.desc("at"), F.desc("id")).limit(most)


def providers(spark: SparkSession) -> DataFrame:
    """The provider dimension."""
    return spark.createDataFrame(list(PROVIDERS.items()), "source string, display string")


def provider_recent(conversations: DataFrame) -> DataFrame:
    """Every known provider with its count and its most recently active conversation."""
    at = F.coalesce("updated_at_unix", "created_at_unix", F.lit(0.0))
    got = conversations.groupBy("source").agg(F.count("*").alias("n"), F.max_by(F.struct("id", "title"), F.struct(at, F.coalesce("created_at_unix", F.lit(0.0)), "id")).alias("last"))
    return F.broadcast(providers(conversations.sparkSession)).join(got, "source", "left").select("source", "display", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("last.id").alias("last_id"), F.col("last.title").alias("last_title"))


def latest_run_by_provider(runs: DataFrame) -> DataFrame:
    """The last import run of every known provider, null where there was none."""
    order = Window.partitionBy("provider").orderBy(F.desc("imported_at"), F.desc("id"))
    last = runs.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")
    return F.broadcast(providers(runs.sparkSession)).select(F.col("source").alias("provider")).join(last, "provider", "left")


def workspace(conversations: DataFrame, messages: DataFrame, notes: DataFrame) -> DataFrame:
    """A10: newest 6 conversations and 5 notes in one table of recents."""
    at = F.coalesce("updated_at_unix", "created_at_unix", F.lit(0.0))
    recent = conversations.select(F.lit("conversation").alias("kind"), "id", "title", at.alias("at")).orderBy(F.desc("at"), F.desc("id")).limit(6)
    noted = notes.select(F.lit("note").alias("kind"), "id", T.cut(T.squeeze(F.col("content")), 80).alias("title"), F.col("timestamp").cast("double").alias("at")).orderBy(F.desc("at"), F.desc("id")).limit(5)
    return recent.unionByName(noted)


def topic_highlights(scans: DataFrame, most: int = 5) -> DataFrame:
    """Nth and topic of the first clusters of the latest topic scan."""
    last = scans.agg(F.max_by("clusters", F.struct("generation_timestamp", "scan_id")).alias("c"))
    return last.select(F.posexplode(F.slice("c", 1, most)).alias("nth", "c")).select((F.col("nth") + 1).alias("nth"), "c.topic")
