"""Lists, lookups and filters over the ledger (keyword filters are literal and fold case)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions import text as T


def has(c: Column, keyword: str) -> Column:
    return F.contains(F.lower(c), F.lit(keyword.strip().lower()))


def newest_imported() -> list[Column]:
    """K1: by last update (else creation), creation, id; absent times count as 0."""
    return [F.coalesce("updated_at_unix", "created_at_unix", F.lit(0.0)).desc(), F.coalesce("created_at_unix", F.lit(0.0)).desc(), F.col("id").desc()]


def keyword_search(conversations: DataFrame, messages: DataFrame, keyword: str) -> DataFrame:
    """Conversations whose title or any message holds the keyword."""
    if not keyword.strip():
        return conversations
    by_message = messages.filter(has(F.col("content"), keyword)).select(F.col("conversation_id").alias("id")).distinct()
    by_title = conversations.filter(has(F.col("title"), keyword)).select("id")
    return conversations.join(by_message.union(by_title), "id", "left_semi")


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("message_count"))


def with_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with message_count, 0 where there is none."""
    return conversations.join(message_counts(messages), "id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)).cast("long"))


def page(df: DataFrame, number: int, size: int, total: int | None = None) -> DataFrame:
    """K7: a page of an ordered table, from 1; numbers beyond the last page give the last, if the total is told."""
    number = max(1, number)
    if total is not None:
        number = min(number, max(1, -(-total // size)))
    return df.offset((number - 1) * size).limit(size)


def conversation_list(conversations: DataFrame, messages: DataFrame, provider: str | None = None, keyword: str = "", archived: bool = False, number: int = 1, size: int = 50) -> DataFrame:
    """A page of conversations, newest id first."""
    rows = conversations.filter(F.col("is_archived") == archived)
    if provider:
        rows = rows.filter(F.col("source") == provider)
    rows = keyword_search(rows, messages, keyword)
    return page(with_counts(rows, messages).orderBy(F.desc("id")), number, size)


def tool_list(conversations: DataFrame, messages: DataFrame, provider: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Conversations with counts by last activity, limit 1 to 100."""
    rows = conversations if provider is None else conversations.filter(F.col("source") == provider)
    return with_counts(rows, messages).orderBy(*newest_imported()).offset(max(0, offset)).limit(min(max(limit, 1), 100))


def transcript_rows(conversations: DataFrame, messages: DataFrame, most: int | None = None) -> DataFrame:
    """P5: each message with its conversation, in order, the first ``most`` (1 to 1000) of each."""
    rows = messages.join(conversations.select(F.col("id").alias("conversation_id"), "title", "source"), "conversation_id")
    if most is not None:
        order = Window.partitionBy("conversation_id").orderBy("sequence_index", "id")
        rows = rows.withColumn("__nth", F.row_number().over(order)).filter(F.col("__nth") <= min(max(most, 1), 1000)).drop("__nth")
    return rows


def newest_conversations(conversations: DataFrame, n: int = 20) -> DataFrame:
    """P7."""
    return conversations.orderBy(F.desc("id")).limit(n)


def library(conversations: DataFrame, messages: DataFrame, notes: DataFrame, tag: str = "") -> tuple[DataFrame, DataFrame]:
    """The newest 100 notes with a tag substring, and the newest 100 starred conversations with counts."""
    found = notes.filter(has(F.coalesce("tags", F.lit("")), tag)) if tag else notes
    return found.orderBy(F.desc("timestamp"), F.desc("id")).limit(100), with_counts(conversations.filter("is_starred"), messages).orderBy(F.desc("id")).limit(100)


def notes_list(notes: DataFrame, n: int = 100) -> DataFrame:
    """P8."""
    return notes.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def prompt_toc(messages: DataFrame, most: int = 56) -> DataFrame:
    """The user turns of each conversation with a short label."""
    label = T.squeeze(F.col("content"))
    label = F.when(F.coalesce(label, F.lit("")) == "", "(empty prompt)").when(F.length(label) <= most, label).otherwise(F.concat(F.rtrim(F.substring(label, 1, most - 1)), F.lit("…")))
    return messages.filter("role = 'user'").select("conversation_id", "sequence_index", "id", label.alias("label"))


def inbox(captures: DataFrame) -> DataFrame:
    """P10: undecided captures, last received first."""
    return captures.filter(F.col("status").isin("pending", "triaged")).orderBy(F.desc("received_at_unix"), F.desc("id"))


def newest_records(records: DataFrame, time: str, key: str, limit: int) -> DataFrame:
    """Derived records, newest first."""
    return records.orderBy(F.col(time).desc(), F.col(key).desc()).limit(limit)


def records_of_conversation(records: DataFrame, ids: str, conversation: str) -> DataFrame:
    """Derived records whose id array holds the conversation."""
    return records.filter(F.array_contains(ids, conversation))


def record_by_id(records: DataFrame, key: str, value: str) -> DataFrame:
    """The newest derived record with an id."""
    return newest_records(records.filter(F.col(key) == value), "generation_timestamp", key, 1)


def records_of_type(records: DataFrame, kind: str, column: str = "artifact_type") -> DataFrame:
    """Derived records of one type."""
    return records.filter(F.col(column) == kind)


def resolve_first(owners: DataFrame, key: str, ids: str, conversations: DataFrame) -> DataFrame:
    """For each owner, the first stable id of an array that names a conversation."""
    named = owners.select(key, F.posexplode(ids).alias("pos", "stable_id")).withColumn("id", T.stable_number(F.col("stable_id"), "imported_conversation"))
    return named.join(conversations.select("id", "title"), "id").groupBy(key).agg(F.min_by(F.struct("stable_id", "title"), "pos").alias("first")).select(key, "first.stable_id", "first.title")
