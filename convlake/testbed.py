"""Ledger views over the driver's tables, for the registered queries.

The SQL of the queries builds the same views; ``SQL`` holds them as common table
expressions conv, msg, notes and captures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.schemas import PROVIDERS, TAG_STOPWORDS

T0 = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    one = turns.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("said"), F.max("turn").alias("last"), F.max(F.col("role") == "user").alias("asked"))
    said = F.when(F.col("asked"), F.col("said"))
    title = F.coalesce(F.array_join(F.slice(F.split(said, " "), 1, 6), " "), F.lit("Untitled Conversation"))
    c = F.col("conv_id")
    start = F.lit(T0) + 3600 * c
    out = one.select(
        c.alias("id"),
        F.element_at(F.array(*(F.lit(p) for p in PROVIDERS)), (c % 5 + 1).cast("int")).alias("source"),
        F.concat(F.lit("conv-"), c).alias("source_conversation_id"),
        title.alias("title"),
        F.when(c % 17 != 0, start).cast("double").alias("created_at_unix"),
        F.when(c % 13 != 0, start + 60 * F.col("last")).cast("double").alias("updated_at_unix"),
        (c % 11 == 0).alias("is_archived"),
        (c % 7 == 0).alias("is_starred"),
    )
    return out.withColumn("tags", T.auto_tag(F.col("title")))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    c, t = F.col("conv_id"), F.col("turn")
    order = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select(
        (c * 1000 + t).alias("id"),
        c.alias("conversation_id"),
        F.concat(F.lit("msg-"), c * 1000 + t).alias("source_message_id"),
        "role",
        F.col("text").alias("content"),
        (F.row_number().over(order) - 1).alias("sequence_index"),
        F.when((c + t) % 19 != 0, F.lit(T0) + 3600 * c + 60 * t).cast("double").alias("created_at_unix"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.timestamp_seconds(F.lit(T0) + 1800 * F.col("doc_id")).alias("timestamp"),
        F.lit("user").alias("role"),
        F.col("text").alias("content"),
        F.concat_ws(", ", "source", "lang").alias("tags"),
        (F.col("doc_id") % 5 == 0).alias("is_starred"),
        F.lit(None).cast("long").alias("captured_via_id"),
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    size = F.length("text")
    return d.select(
        F.col("doc_id").alias("id"),
        F.element_at(F.array(F.lit("browser"), F.lit("cli"), F.lit("mail")), (size % 3 + 1).cast("int")).alias("adapter_id"),
        F.lit("1").alias("adapter_version"),
        F.element_at(F.array(F.lit("selection"), F.lit("text"), F.lit("message")), (size % 3 + 1).cast("int")).alias("payload_kind"),
        F.col("text").alias("body_text"),
        F.when(size % 2 != 0, F.concat(F.lit("http://x/"), "lang")).alias("source_url"),
        (F.lit(T0) + 7 * (size % 1000)).cast("double").alias("captured_at_unix"),
        (F.lit(T0) + 7200 + F.col("doc_id")).cast("double").alias("received_at_unix"),
    )


_IN_TAGS = ", ".join(f"'{w}'" for w in TAG_STOPWORDS)
#: F2 over a title: its first word that is no stopword, as a tag list.
_FIRST = f"coalesce(list_filter(regexp_split_to_array(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' '), lambda w: NOT list_contains([{_IN_TAGS}], lower(w)))[1], '')"
_TAG = f"""(SELECT coalesce(string_agg(p, ', ' ORDER BY n), '') FROM (
  SELECT p, min(n) AS n FROM (
    SELECT left(trim(lower(x)), 64) AS p, n FROM (SELECT unnest(string_split({_FIRST}, ',')) AS x, generate_subscripts(string_split({_FIRST}, ','), 1) AS n)
  ) WHERE p <> '' GROUP BY p))"""

SQL = f"""
conv0 AS (
  SELECT conv_id AS id, (['chatgpt', 'claude', 'claude_code', 'gemini', 'grok'])[conv_id % 5 + 1] AS source, 'conv-' || conv_id AS source_conversation_id,
    coalesce(array_to_string(string_split(min_by(text, turn) FILTER (WHERE role = 'user'), ' ')[1:6], ' '), 'Untitled Conversation') AS title,
    CASE WHEN conv_id % 17 <> 0 THEN CAST({T0} + 3600 * conv_id AS DOUBLE) END AS created_at_unix,
    CASE WHEN conv_id % 13 <> 0 THEN CAST({T0} + 3600 * conv_id + 60 * max(turn) AS DOUBLE) END AS updated_at_unix,
    conv_id % 11 = 0 AS is_archived, conv_id % 7 = 0 AS is_starred
  FROM conversations GROUP BY conv_id
),
msg AS (
  SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, 'msg-' || (conv_id * 1000 + turn) AS source_message_id, role, text AS content,
    CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS sequence_index,
    CASE WHEN (conv_id + turn) % 19 <> 0 THEN CAST({T0} + 3600 * conv_id + 60 * turn AS DOUBLE) END AS created_at_unix
  FROM conversations
),
notes AS (
  SELECT doc_id AS id, to_timestamp({T0} + 1800 * doc_id) AS timestamp, CAST({T0} + 1800 * doc_id AS DOUBLE) AS timestamp_unix, 'user' AS role, text AS content, source || ', ' || lang AS tags, doc_id % 5 = 0 AS is_starred
  FROM documents
),
captures AS (
  SELECT doc_id AS id, (['browser', 'cli', 'mail'])[length(text) % 3 + 1] AS adapter_id, '1' AS adapter_version, (['selection', 'text', 'message'])[length(text) % 3 + 1] AS payload_kind,
    text AS body_text, CASE WHEN length(text) % 2 <> 0 THEN 'http://x/' || lang END AS source_url,
    CAST({T0} + 7 * (length(text) % 1000) AS DOUBLE) AS captured_at_unix, CAST({T0} + 7200 + doc_id AS DOUBLE) AS received_at_unix
  FROM documents
)"""
#: conv with tags
TAGGED = f"conv AS (SELECT *, {_TAG} AS tags FROM conv0)"
PLAIN = "conv AS (SELECT * FROM conv0)"


def with_views(sql: str, tagged: bool = False) -> str:
    """A query over conv, msg, notes and captures as one statement."""
    head = f"WITH RECURSIVE {SQL}, {TAGGED if tagged else PLAIN}"
    sql = sql.strip()
    return f"{head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"{head} {sql}"
