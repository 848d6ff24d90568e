"""The ledger back to the providers' export shapes: (path, content), some conversations to a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions import text as T

PER_FILE = 20


def _with_messages(conversations: DataFrame, messages: DataFrame, source: str) -> DataFrame:
    rows = conversations.filter(F.col("source") == source)
    said = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sequence_index", "source_message_id", "role", "content", "created_at_unix"))).alias("m"))
    return rows.join(said, "id")


def _files(rows: DataFrame, item: Column, source: str, wrap: str = "[%s]") -> DataFrame:
    files = rows.select(F.floor(F.col("id") / PER_FILE).alias("file"), "id", item.alias("item")).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "item"))), lambda x: x["item"]), ",").alias("items"))
    return files.select(F.concat(F.lit(f"{source}/"), F.col("file").cast("string"), F.lit(".json")).alias("path"), F.format_string(wrap.replace("%s", "%1$s"), "items").alias("content"))


def to_chatgpt(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Trees of one branch, nodes last to first."""
    rows = _with_messages(conversations, messages, "chatgpt")
    at = lambda i: F.get("m", i)["source_message_id"]
    node = F.transform("m", lambda x, i: F.struct(x["source_message_id"].alias("key"), F.struct(x["source_message_id"].alias("id"), F.when(i > 0, at(i - 1)).alias("parent"), F.when(i + 1 < F.size("m"), F.array(at(i + 1))).otherwise(F.array().cast("array<string>")).alias("children"), F.struct(x["source_message_id"].alias("id"), F.struct(x["role"].alias("role")).alias("author"), x["created_at_unix"].alias("create_time"), F.struct(F.array(x["content"]).alias("parts")).alias("content")).alias("message")).alias("value")))
    item = F.to_json(F.struct(F.col("source_conversation_id").alias("id"), "title", F.col("created_at_unix").alias("create_time"), F.col("updated_at_unix").alias("update_time"), F.map_from_entries(F.reverse(node)).alias("mapping")))
    return _files(rows, item, "chatgpt")


def to_claude(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    rows = _with_messages(conversations, messages, "claude")
    said = F.transform("m", lambda x: F.struct(x["source_message_id"].alias("uuid"), x["sequence_index"].alias("index"), F.when(x["role"] == "user", "human").otherwise(x["role"]).alias("sender"), x["content"].alias("text"), T.iso(x["created_at_unix"]).alias("created_at")))
    item = F.to_json(F.struct(F.col("source_conversation_id").alias("uuid"), F.col("title").alias("name"), T.iso(F.col("created_at_unix")).alias("created_at"), T.iso(F.col("updated_at_unix")).alias("updated_at"), F.reverse(said).alias("chat_messages")))
    return _files(rows, item, "claude")


def to_grok(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    rows = _with_messages(conversations, messages, "grok")
    ms = lambda c: F.when(c.isNotNull(), F.struct(F.struct((c * 1000).cast("long").cast("string").alias("$numberLong")).alias("$date")))
    said = F.transform("m", lambda x: F.struct(F.struct(x["source_message_id"].alias("_id"), x["content"].alias("message"), F.when(x["role"] == "user", "human").otherwise(x["role"]).alias("sender"), ms(x["created_at_unix"]).alias("create_time")).alias("response")))
    item = F.to_json(F.struct(F.struct(F.col("source_conversation_id").alias("id"), "title", ms(F.col("created_at_unix")).alias("create_time"), T.iso(F.col("updated_at_unix")).alias("modify_time")).alias("conversation"), said.alias("responses")))
    return _files(rows, item, "grok", '{"conversations":[%s]}')


def to_gemini(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    rows = _with_messages(conversations, messages, "gemini")
    said = F.transform("m", lambda x: F.struct(x["source_message_id"].alias("id"), F.when(x["role"] == "assistant", "model").otherwise(x["role"]).alias("role"), x["content"].alias("content"), T.iso(x["created_at_unix"]).alias("timestamp")))
    item = F.to_json(F.struct(F.col("source_conversation_id").alias("id"), "title", T.iso(F.col("updated_at_unix")).alias("exportedAt"), said.alias("messages")))
    return _files(rows, item, "gemini")


def to_session_logs(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """One file for each conversation, one line for each message."""
    rows = _with_messages(conversations, messages, "claude_code")
    line = F.transform("m", lambda x: F.to_json(F.struct(F.when(x["role"] == "assistant", "assistant").otherwise("user").alias("type"), F.col("source_conversation_id").alias("sessionId"), x["source_message_id"].alias("uuid"), T.iso(x["created_at_unix"]).alias("timestamp"), F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["content"].alias("text"))).alias("content")).alias("message"))))
    return rows.select(F.concat(F.lit("claude_code/"), "source_conversation_id", F.lit(".jsonl")).alias("path"), F.array_join(line, "\n").alias("content"))


def export_files(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [f(conversations, messages) for f in (to_chatgpt, to_claude, to_grok, to_gemini, to_session_logs)])
