"""Queries of imports, context, packages, notes, capture, health and chunks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake import testbed as B
from convlake.functions import text as T
from convlake.operators import assets, browse, capture, chunks, context, health, ledger, notes, package, rollups
from convlake.operators.similarity import described, lineage, neighbours
from convlake.plans.meaning import LINKS, continued, lineage_sql
from convlake.plans.registry import query
from convlake.schemas import PROVIDERS
from convlake.shared import materialize
from convlake.sources import exports, writers

NOW = "2024-06-01T00:00:00Z"


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return B.conversations(spark, sf), B.messages(spark, sf)


# --- imports -----------------------------------------------------------------


def _imported(spark: SparkSession, sf: str) -> DataFrame:
    return exports.import_files(materialize(writers.export_files(*_tables(spark, sf)), "export-files"))[0]


@query(r"""
WITH m AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS text FROM msg),
k AS (SELECT m.*, source, source_conversation_id, title FROM m JOIN (SELECT id AS conversation_id, source, source_conversation_id, title FROM conv) USING (conversation_id) WHERE text <> '' AND NOT (source = 'claude_code' AND created_at_unix IS NULL))
SELECT source AS provider, source_conversation_id, source_message_id, role, CASE WHEN source = 'claude_code' THEN content ELSE text END AS content, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY sequence_index) - 1 AS INTEGER) AS sequence_index, created_at_unix AS created_at FROM k""")
def import_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return _imported(spark, sf).select("provider", "source_conversation_id", F.explode("messages").alias("m")).select("provider", "source_conversation_id", "m.*")


@query(r"""
SELECT source AS provider, source_conversation_id, CASE WHEN source = 'claude_code' THEN 'Claude Code session ' || left(source_conversation_id, 8) ELSE regexp_replace(title, '^\s+|\s+$', '', 'g') END AS title,
  CASE source WHEN 'claude_code' THEN f WHEN 'gemini' THEN coalesce(f, updated_at_unix) ELSE created_at_unix END AS created_at, CASE WHEN source = 'claude_code' THEN l ELSE updated_at_unix END AS updated_at
FROM conv JOIN (SELECT conversation_id, arg_min(created_at_unix, sequence_index) FILTER (WHERE created_at_unix IS NOT NULL) AS f, arg_max(created_at_unix, sequence_index) FILTER (WHERE created_at_unix IS NOT NULL) AS l FROM msg GROUP BY 1) ON conversation_id = id""")
def import_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return _imported(spark, sf).select("provider", "source_conversation_id", "title", "created_at", "updated_at")


@query("SELECT source AS provider, count(DISTINCT CASE WHEN source = 'claude_code' THEN id ELSE id // 20 END) AS n FROM conv GROUP BY source")
def import_detection(spark: SparkSession, sf: str) -> DataFrame:
    files = writers.export_files(*_tables(spark, sf)).unionByName(B.table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")))
    return exports.detect(files).filter("provider is not null").groupBy("provider").agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT conversation_id, count(*) AS n, count(*) FILTER (WHERE created_at_unix IS NULL) AS z FROM msg GROUP BY 1)
SELECT source AS provider, count(*) FILTER (WHERE title = 'Untitled Conversation') AS untitled, count(*) FILTER (WHERE created_at_unix IS NULL) AS conversations_without_time, CAST(sum(z) AS BIGINT) AS messages_without_time
FROM conv JOIN m ON conversation_id = id WHERE source IN ('chatgpt', 'claude', 'grok') GROUP BY source""")
def import_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return exports.import_warnings(_imported(spark, sf)).filter("provider in ('chatgpt', 'claude', 'grok')")


@query("""
SELECT source, count(*) FILTER (WHERE id % 3 <> 0) AS imported, count(*) FILTER (WHERE id % 3 = 0) + count(*) AS skipped FROM conv GROUP BY source""")
def ledger_import_dedup(spark: SparkSession, sf: str) -> DataFrame:
    c, m = _tables(spark, sf)
    parsed = _imported(spark, sf)
    again = parsed.unionByName(parsed.withColumn("path", F.concat(F.lit("later/"), "path")))
    return ledger.load(again, c.filter("id % 3 = 0"), m)[2].drop("messages")


@query("""
WITH a AS (SELECT conv_id, turn, conv_id % 4 AS i, turn % 3 AS s, (conv_id + turn) % 5 // 3 AS f, turn % 7 <> 6 AS r FROM conversations)
SELECT conv_id, turn, CASE WHEN NOT r THEN 'failed' WHEN f > 0 AND i + s > 0 THEN 'partial' WHEN f > 0 THEN 'failed' WHEN i > 0 THEN 'success' WHEN s > 0 THEN 'duplicate_only' ELSE 'failed' END AS status FROM a""")
def import_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    t = B.table(spark, sf, "conversations")
    c, k = F.col("conv_id"), F.col("turn")
    return t.select("conv_id", "turn", ledger.outcome(c % 4, k % 3, F.floor((c + k) % 5 / 3), k % 7 != 6).alias("status"))


@query("""
WITH r AS (SELECT source AS provider, conversation_id, max(created_at_unix) AS t, count(*) AS n FROM msg JOIN (SELECT id AS conversation_id, source FROM conv) USING (conversation_id) GROUP BY ALL)
SELECT provider, arg_max(conversation_id, (coalesce(t, 0), conversation_id)) AS id, CAST(arg_max(n, (coalesce(t, 0), conversation_id)) AS INTEGER) AS messages_imported FROM r GROUP BY provider""")
def import_runs_latest(spark: SparkSession, sf: str) -> DataFrame:
    c, m = _tables(spark, sf)
    attempts = m.join(c.select(F.col("id").alias("conversation_id"), F.col("source").alias("provider")), "conversation_id").groupBy("provider", "conversation_id").agg(F.coalesce(F.max("created_at_unix"), F.lit(0.0)).alias("imported_at"), F.count("*").alias("messages"))
    attempts = attempts.select(F.col("conversation_id").alias("id"), "provider", F.lit("f.json").alias("filename"), "imported_at", F.lit(1).alias("imported"), "messages", F.lit(0).alias("skipped"), F.lit(0).alias("failed"), F.lit(True).alias("reached"), F.lit(None).cast("string").alias("error"))
    return rollups.latest_run_by_provider(ledger.import_runs(attempts)).filter("id is not null").select("provider", "id", "messages_imported")


_SESSION_SQL = """
WITH e AS (SELECT user_id, event_id, epoch(ts) AS t FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > {gap} THEN 1 ELSE 0 END AS o FROM e),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(min(t), 3) AS first, round(max(t), 3) AS last FROM s GROUP BY ALL"""


def _sessions(spark: SparkSession, sf: str, gap: float) -> DataFrame:
    e = B.table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return exports.sessions(e, "user_id", "t", gap, "event_id").groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.min("t"), 3).alias("first"), F.round(F.max("t"), 3).alias("last"))


@query(_SESSION_SQL.format(gap=1800))
def activity_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf, 1800)


@query(_SESSION_SQL.format(gap=21600))
def activity_sessions_6h(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf, 21600)


@query("""
WITH e AS (SELECT user_id, event_id, epoch(date_trunc('second', ts)) AS t, event_type || ' ' || json_extract_string(props, '$.k') AS prompt FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 1800 THEN 1 ELSE 0 END AS o FROM e),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM g)
SELECT 'activity/' || user_id AS path, CAST(session AS BIGINT) AS position, arg_min(prompt, (t, event_id)) AS title, min(t) AS created_at, max(t) AS updated_at, count(*) AS n FROM s GROUP BY ALL""")
def activity_conversations(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events")
    prompt = F.concat("event_type", F.lit(" "), F.get_json_object("props", "$.k"))
    entry = F.to_json(F.struct(F.lit("Gemini Apps").alias("header"), F.concat(F.lit("Prompted "), prompt).alias("title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time")))
    files = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("j")))), lambda x: x["j"]), ",").alias("j"))
    files = files.select(F.concat(F.lit("activity/"), F.col("user_id").cast("string")).alias("path"), F.concat(F.lit("["), "j", F.lit("]")).alias("content"))
    got = exports.parse_gemini(files)
    return got.select("path", F.col("position").cast("long").alias("position"), "title", "created_at", "updated_at", F.size("messages").cast("long").alias("n"))


# --- context -------------------------------------------------------------------


@query("""
WITH l AS (SELECT conversation_id, sequence_index, role, content, '[' || role || ']: ' || content AS line FROM msg),
u AS (SELECT *, sum(length(line) + 1) OVER w - 1 AS upto, row_number() OVER w AS k FROM l WINDOW w AS (PARTITION BY conversation_id ORDER BY sequence_index DESC)),
s AS (SELECT *, CASE WHEN k = 1 AND length(line) > 600 THEN '[' || role || ']: [message truncated] ' || right(content, 600 - length('[' || role || ']: [message truncated] ')) ELSE line END AS shown, k = 1 OR upto <= 600 AS kept FROM u)
SELECT conversation_id, CASE WHEN count(*) FILTER (WHERE NOT kept) > 0 THEN '[' || count(*) FILTER (WHERE NOT kept) || ' earlier messages truncated to fit context]' || chr(10) ELSE '' END || string_agg(shown, chr(10) ORDER BY sequence_index) FILTER (WHERE kept) AS transcript, count(*) FILTER (WHERE NOT kept) AS dropped
FROM s GROUP BY conversation_id""")
def transcript_budget(spark: SparkSession, sf: str) -> DataFrame:
    return context.transcript(B.messages(spark, sf), 600)


def _multi_sql(budget: int, group: str = "conv.id % 7") -> str:
    """Transcripts of groups of conversations under a budget in SQL, up to the kept ones (f)."""
    return f"""
WITH b AS (SELECT conv.id, {group} AS group_id, coalesce(created_at_unix, 0) AS t, '=== Conversation: ' || title || ' (provider: ' || source || ') ===' || chr(10) || lines AS block
  FROM conv JOIN (SELECT conversation_id, string_agg('[' || role || ']: ' || content, chr(10) ORDER BY sequence_index) AS lines FROM msg GROUP BY 1) ON conversation_id = conv.id),
k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY t DESC, id) AS k FROM b),
u AS (SELECT *, sum(CASE WHEN k = 1 THEN least(length(block), {budget}) ELSE length(block) + 2 END) OVER (PARTITION BY group_id ORDER BY k) AS upto FROM k),
f AS (SELECT *, min(CASE WHEN k > 1 AND upto > {budget} THEN k END) OVER (PARTITION BY group_id) AS stop FROM u)
"""


_MULTI_COLUMNS = """SELECT group_id, string_agg(CASE WHEN k = 1 THEN left(block, 9000) ELSE block END, chr(10) || chr(10) ORDER BY k) FILTER (WHERE stop IS NULL OR k < stop) AS transcript,
  bool_or((stop IS NOT NULL AND k >= stop) OR (k = 1 AND length(block) > 9000)) AS truncated, count(*) AS n_conversations, count(*) FILTER (WHERE stop IS NULL OR k < stop) AS n_kept FROM f GROUP BY group_id"""


@query(_multi_sql(9000) + _MULTI_COLUMNS)
def multi_transcript(spark: SparkSession, sf: str) -> DataFrame:
    c, m = _tables(spark, sf)
    return context.multi_transcript(c.select((F.col("id") % 7).alias("group_id"), "id"), c, m, 9000)


@query(_multi_sql(9000, "'all'") + _MULTI_COLUMNS)
def transcript_of_all(spark: SparkSession, sf: str) -> DataFrame:
    c, m = _tables(spark, sf)
    return context.multi_transcript(c.select(F.lit("all").alias("group_id"), "id"), c, m, 9000)


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    text = T.squeeze(F.col("content"))
    m = B.messages(spark, sf).groupBy("conversation_id").agg(F.min_by(text, "sequence_index").alias("summary"), F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("sequence_index", text.alias("t"))))), lambda x: x["t"]).alias("decisions"), F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("sequence_index", text.alias("t"))))), lambda x: x["t"]).alias("open_loops"))
    body = F.to_json(F.struct("summary", "decisions", "open_loops"))
    return m.select("conversation_id", F.when(F.col("conversation_id") % 9 == 4, "no object").otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("reply"))


def _artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return context.packets(_replies(spark, sf), NOW).filter("error is null").withColumn("conversation_id", T.stable_number(F.col("source_conversation_ids")[0], "imported_conversation"))


_ARTIFACT_SQL = r"""
WITH x AS (SELECT conversation_id, sequence_index AS s, role, trim(regexp_replace(content, '\s+', ' ', 'g')) AS t FROM msg),
l AS (SELECT conversation_id, arg_min(t, s) AS summary, list(t ORDER BY s) FILTER (WHERE role = 'assistant') AS decisions, list(t ORDER BY s) FILTER (WHERE role = 'user') AS loops FROM x GROUP BY 1),
i AS (SELECT conversation_id, 'summary' AS artifact_type, [summary] AS items FROM l UNION ALL SELECT conversation_id, 'decisions', decisions FROM l UNION ALL SELECT conversation_id, 'open_loops', loops FROM l),
a AS (SELECT conversation_id, artifact_type, items, CASE WHEN len(items) = 1 THEN items[1] ELSE array_to_string(list_transform(items, lambda z: '- ' || z), chr(10)) END AS content_text FROM i WHERE conversation_id % 9 <> 4 AND len(list_filter(coalesce(items, []), lambda z: z <> '')) > 0)
"""


@query(_ARTIFACT_SQL + "SELECT conversation_id, artifact_type, content_text FROM a")
def continuity_packets(spark: SparkSession, sf: str) -> DataFrame:
    return _artifacts(spark, sf).select("conversation_id", "artifact_type", "content_text")


def _bridge_sql(parents: bool) -> str:
    """Bridges in SQL: ``cut`` has conversation_id and t, cut at a line where it is longer than the budget."""
    prior = "nullif(concat_ws(chr(10) || chr(10), nullif(trim(q.s), ''), nullif(trim(q.d), '')), '')" if parents else "NULL"
    return _ARTIFACT_SQL + rf""", p AS (SELECT conversation_id, max(content_text) FILTER (WHERE artifact_type = 'summary') AS s, max(content_text) FILTER (WHERE artifact_type = 'decisions') AS d, max(content_text) FILTER (WHERE artifact_type = 'open_loops') AS o, max(items) FILTER (WHERE artifact_type = 'open_loops') AS li, count(*) AS n_artifacts FROM a GROUP BY 1),
b AS (SELECT p.conversation_id, '# Continuity Bridge: ' || title || chr(10) || '*Derived handoff — not canonical.*' || chr(10)
  || coalesce(chr(10) || '## Prior Objective' || chr(10) || nullif(trim(p.s), '') || chr(10), '') || coalesce(chr(10) || '## Prior Context (from parent)' || chr(10) || {prior} || chr(10), '')
  || coalesce(chr(10) || '## Key Decisions' || chr(10) || nullif(trim(p.d), '') || chr(10), '') || coalesce(chr(10) || '## Open Loops' || chr(10) || nullif(trim(p.o), '') || chr(10), '')
  || coalesce(chr(10) || '## Suggested Next Step' || chr(10) || 'Continue from these open threads:' || chr(10) || trim(array_to_string(list_transform(p.li[1:5], lambda z: '- ' || z), chr(10))) || chr(10), '') AS t, coalesce(q.n_artifacts, 0) AS n_parents, CASE WHEN q.conversation_id IS NULL THEN 1 ELSE 2 END AS n_sources
  FROM p JOIN conv ON id = p.conversation_id LEFT JOIN p q ON q.conversation_id = p.conversation_id - 1),
h AS (SELECT *, left(t, 11988) AS head FROM b),
k AS (SELECT *, strpos(reverse(head), chr(10)) AS after FROM h),
cut AS (SELECT conversation_id, n_parents, n_sources, CASE WHEN length(t) <= 12000 THEN t ELSE regexp_replace(CASE WHEN after > 0 AND 11988 - after > 5994 THEN left(head, 11988 - after) ELSE head END, '\s+$', '') || chr(10) || '[truncated]' END AS t FROM k)
"""


_BRIDGE_SQL = _bridge_sql(False)


@query(_BRIDGE_SQL + "SELECT conversation_id, t AS bridge_text FROM cut")
def bridge_text(spark: SparkSession, sf: str) -> DataFrame:
    titles = B.conversations(spark, sf).select(F.col("id").alias("conversation_id"), "title")
    return context.bridges(_artifacts(spark, sf), titles).select("conversation_id", "bridge_text")


@query(_ARTIFACT_SQL + "SELECT 'imported_conversation:' || conversation_id AS stable_id, title, unnest(items) AS loop, generate_subscripts(items, 1) - 1 AS nth FROM a JOIN conv ON id = conversation_id WHERE artifact_type = 'open_loops'")
def open_loops(spark: SparkSession, sf: str) -> DataFrame:
    return context.open_loops(_artifacts(spark, sf), B.conversations(spark, sf)).select("stable_id", "title", "loop", F.col("nth").cast("long").alias("nth"))


@query(_bridge_sql(True) + "SELECT conversation_id, length(t) AS size, n_sources AS sources, n_parents AS parents FROM cut")
def bridge_with_parents(spark: SparkSession, sf: str) -> DataFrame:
    c = B.conversations(spark, sf)
    parents = c.filter("id > 0").select(F.col("id").alias("conversation_id"), (F.col("id") - 1).alias("parent_id"))
    return context.bridges(_artifacts(spark, sf), c.select(F.col("id").alias("conversation_id"), "title"), parents).select("conversation_id", F.length("bridge_text").alias("size"), F.size("source_conversation_ids").alias("sources"), F.size("parent_packet_ids").alias("parents"))


@query(_multi_sql(180000) + """, g AS (SELECT group_id, bool_or((stop IS NOT NULL AND k >= stop) OR (k = 1 AND length(block) > 180000)) AS input_truncated, count(*) AS conversation_count FROM f GROUP BY group_id),
o AS (SELECT id % 7 AS group_id, source, min(id) AS first FROM conv GROUP BY ALL)
SELECT 'distillation:' || group_id AS distillation_id, conversation_count, (SELECT count(*) FROM msg WHERE conversation_id % 7 = group_id) AS message_count, input_truncated, (SELECT string_agg(source, ',' ORDER BY first) FROM o WHERE o.group_id = g.group_id) AS providers FROM g""")
def distillations(spark: SparkSession, sf: str) -> DataFrame:
    c, m = _tables(spark, sf)
    return context.distillation(c.select((F.col("id") % 7).alias("group_id"), "id"), c, m, NOW).select("distillation_id", F.col("conversation_count").cast("long").alias("conversation_count"), "message_count", "input_truncated", F.array_join("providers", ",").alias("providers"))


@query("SELECT 'summary:' || conversation_id AS summary_id, title, length(t) AS size FROM (SELECT conversation_id, string_agg('[' || role || ']: ' || content, chr(10) ORDER BY sequence_index) AS t FROM msg GROUP BY 1) JOIN conv ON id = conversation_id")
def summaries(spark: SparkSession, sf: str) -> DataFrame:
    c, m = _tables(spark, sf)
    return context.summaries(c, m, NOW).select("summary_id", "title", F.regexp_extract("summary_text", r"reply to (\d+)", 1).cast("long").alias("size"))


@query(_ARTIFACT_SQL + f"""SELECT 'continuity_artifact:' || sha256('imported_conversation:' || conversation_id || '|' || artifact_type || '|{NOW}') AS artifact_id,
  concat_ws('; ', CASE WHEN conversation_id % 7 = 0 THEN 'artifact_type must be one of the known types' END, CASE WHEN conversation_id % 5 = 0 THEN 'content_text is required' END) AS problems FROM a WHERE conversation_id % 7 = 0 OR conversation_id % 5 = 0""")
def artifact_problems(spark: SparkSession, sf: str) -> DataFrame:
    bad = _artifacts(spark, sf).withColumn("content_text", F.when(F.col("conversation_id") % 5 == 0, "").otherwise(F.col("content_text"))).withColumn("artifact_type", F.when(F.col("conversation_id") % 7 == 0, "other").otherwise(F.col("artifact_type")))
    return context.artifact_problems(bad).filter(F.size("problems") > 0).select("artifact_id", F.array_join("problems", "; ").alias("problems"))


# --- ledger changes ---------------------------------------------------------------


@query("""
SELECT 'conversations' AS store, count(*) AS deleted FROM conv WHERE id % 6 = 1 UNION ALL SELECT 'messages', count(*) FROM msg WHERE conversation_id % 6 = 1
UNION ALL SELECT 'digests', count(*) FROM conv WHERE id % 6 = 1 OR (id > 0 AND (id - 1) % 6 = 1)""")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    c, m = _tables(spark, sf)
    sid = lambda x: T.stable_id("imported_conversation", x)
    records = c.select(F.col("id").cast("string").alias("digest_id"), F.array(sid(F.col("id")), sid(F.col("id") - 1)).alias("ids"))
    return ledger.cascade_delete(c.filter("id % 6 = 1").select("id"), c, m, stores={"digests": (records, "digest_id", "ids")})[1]


@query("SELECT id, CASE WHEN id % 4 = 1 THEN id % 8 = 1 ELSE is_archived END AS is_archived, CASE WHEN id % 4 = 2 THEN true ELSE is_starred END AS is_starred FROM conv")
def flag_updates(spark: SparkSession, sf: str) -> DataFrame:
    c = B.conversations(spark, sf)
    a = c.filter("id % 4 = 1").select("id", F.lit("is_archived").alias("flag"), F.explode(F.array(F.struct(F.lit(True).alias("value"), F.lit(1).alias("at")), F.struct((F.col("id") % 8 == 1).alias("value"), F.lit(2).alias("at")))).alias("u")).select("id", "flag", "u.*")
    s = c.filter("id % 4 = 2").select("id", F.lit("is_starred").alias("flag"), F.lit(True).alias("value"), F.lit(1).alias("at"))
    return ledger.set_flags(c, a.unionByName(s)).select("id", "is_archived", "is_starred")


@query("SELECT msg.id AS message_id, content || chr(10) || chr(10) || '— from \"' || title || '\" (' || source || ')' AS content, 'clipped' AS tags FROM msg JOIN (SELECT id AS conversation_id, title, source FROM conv) USING (conversation_id) WHERE msg.id % 3 = 0")
def clipped_notes(spark: SparkSession, sf: str) -> DataFrame:
    c, m = _tables(spark, sf)
    return ledger.clip(m, c, m.filter("id % 3 = 0").select(F.col("id").alias("message_id"))).select("message_id", "content", "tags")


# --- packages and notes --------------------------------------------------------------


@query("SELECT 'imported_conversation:' || id AS stable_id, source AS source_provider, source_conversation_id AS source_record_id, title, strftime(make_timestamp(CAST(created_at_unix AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created_at_iso, updated_at_unix FROM conv")
def export_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return package.conversation_records(B.conversations(spark, sf)).select("stable_id", "source_provider", "source_record_id", "title", "created_at_iso", "updated_at_unix")


@query("SELECT 'imported_message:' || id AS stable_id, 'imported_conversation:' || conversation_id AS conversation_stable_id, source AS source_provider, source_message_id AS source_record_id, role, content, sequence_index FROM msg JOIN (SELECT id AS conversation_id, source FROM conv) USING (conversation_id)")
def export_messages(spark: SparkSession, sf: str) -> DataFrame:
    return package.message_records(*_tables(spark, sf)).select("stable_id", "conversation_stable_id", "source_provider", "source_record_id", "role", "content", "sequence_index")


_PROV_SQL = """
WITH p AS (
  SELECT 'canonical' AS unit_type, 'imported_conversation:' || id AS stable_id, source AS source_provider, coalesce(nullif(updated_at_unix, 0), created_at_unix) AS timestamp_unix, 'providers/' || source || '/conversations.jsonl' AS path FROM conv
  UNION ALL SELECT 'canonical', 'imported_message:' || id, source, created_at_unix, 'providers/' || source || '/messages.jsonl' FROM msg JOIN (SELECT id AS conversation_id, source FROM conv) USING (conversation_id)
  UNION ALL SELECT 'canonical', 'memory:' || id, 'native', timestamp_unix, 'native/memory_entries.jsonl' FROM notes
  UNION ALL SELECT 'derived', 'derived:markdown:imported_conversation:' || id, source, coalesce(nullif(updated_at_unix, 0), created_at_unix), 'markdown/conversations/imported_conversation:' || id || '.md' FROM conv
  UNION ALL SELECT 'derived', 'derived:markdown:memory:' || id, 'native', timestamp_unix, 'markdown/native/memory:' || id || '.md' FROM notes)
"""


@query(_PROV_SQL + "SELECT * FROM p")
def provenance_index(spark: SparkSession, sf: str) -> DataFrame:
    return package.provenance(*_tables(spark, sf), B.notes(spark, sf)).select("unit_type", "stable_id", "source_provider", "timestamp_unix", "path")


@query(_PROV_SQL + """SELECT (SELECT count(*) FROM conv) AS conversation_count, (SELECT count(*) FROM msg) AS message_count, (SELECT count(*) FROM notes) AS native_count, (SELECT count(*) FROM p) AS provenance_count,
  (SELECT string_agg(DISTINCT source_provider, ',' ORDER BY source_provider) FROM p) AS providers, (SELECT min(t) FROM (SELECT created_at_unix AS t FROM conv UNION ALL SELECT created_at_unix FROM msg UNION ALL SELECT timestamp_unix FROM notes)) AS min_unix, (SELECT max(timestamp_unix) FROM p) AS max_unix""")
def export_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return package.manifest(*_tables(spark, sf), B.notes(spark, sf)).select("conversation_count", "message_count", "native_count", "provenance_count", F.array_join("source_providers", ",").alias("providers"), "min_unix", "max_unix")


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    c, m = _tables(spark, sf)
    n = B.notes(spark, sf)
    cr, mr, nr = (materialize(df, "records") for df in (package.conversation_records(c), package.message_records(c, m), package.note_records(n)))
    num = F.substring_index("stable_id", ":", -1).cast("long")
    wrong = F.create_map(F.lit("source"), F.lit("elsewhere"), F.lit("source_conversation_id"), F.col("source_record_id"))
    cr = cr.withColumn("title", F.when(num % 9 == 2, " ").otherwise(F.col("title"))).withColumn("source_metadata", F.when(num % 8 == 3, wrong).otherwise(F.col("source_metadata")))
    mr = mr.filter(num % 97 != 5)
    p = materialize(package.provenance(c, m, n), "provenance").withColumn("path", F.when(F.col("stable_id").rlike("^imported_conversation:[0-9]*1$"), "elsewhere.jsonl").otherwise(F.col("path")))
    return package.validate(cr, mr, nr, p, materialize(package.manifest(c, m, n), "manifest"))


@query("""
WITH m2 AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence_index) - 1 AS k FROM msg WHERE id % 97 <> 5)
SELECT 'conversation_title_missing' AS code, 'W' AS severity, 'imported_conversation:' || id AS stable_id FROM conv WHERE id % 9 = 2
UNION ALL SELECT 'conversation_source_metadata_mismatch', 'E', 'imported_conversation:' || id FROM conv WHERE id % 8 = 3
UNION ALL SELECT 'conversation_timestamp_missing', 'W', 'imported_conversation:' || id FROM conv WHERE created_at_unix IS NULL
UNION ALL SELECT 'conversation_updated_timestamp_missing', 'W', 'imported_conversation:' || id FROM conv WHERE updated_at_unix IS NULL
UNION ALL SELECT 'message_timestamp_missing', 'W', 'imported_message:' || id FROM m2 WHERE created_at_unix IS NULL
UNION ALL SELECT DISTINCT 'message_sequence_invalid', 'E', 'imported_conversation:' || conversation_id FROM m2 WHERE k <> sequence_index
UNION ALL SELECT 'conversation_has_no_messages', 'W', 'imported_conversation:' || id FROM conv WHERE id NOT IN (SELECT conversation_id FROM m2)
UNION ALL SELECT 'provenance_canonical_reference_missing', 'E', 'imported_message:' || id FROM msg WHERE id % 97 = 5
UNION ALL SELECT 'provenance_canonical_path_mismatch', 'E', 'imported_conversation:' || id FROM conv WHERE id % 10 = 1
UNION ALL SELECT 'manifest_count_mismatch', 'E', NULL WHERE EXISTS (SELECT 1 FROM msg WHERE id % 97 = 5)
UNION ALL SELECT 'manifest_max_time_range_mismatch', 'E', NULL WHERE false""")
def validator_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _damaged(spark, sf)


@query("SELECT 0::BIGINT AS errors, (SELECT count(*) FROM conv WHERE created_at_unix IS NULL) + (SELECT count(*) FROM conv WHERE updated_at_unix IS NULL) + (SELECT count(*) FROM msg WHERE created_at_unix IS NULL) AS warnings, 'valid_with_warnings' AS status")
def validator_status(spark: SparkSession, sf: str) -> DataFrame:
    c, m = _tables(spark, sf)
    n = B.notes(spark, sf)
    parts = (package.conversation_records(c), package.message_records(c, m), package.note_records(n), package.provenance(c, m, n), package.manifest(c, m, n))
    return package.status(package.validate(*(materialize(df, "package") for df in parts)))


def _iso(c: str) -> str:
    return f"coalesce(strftime(make_timestamp(CAST({c} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ'), 'N/A')"


@query(rf"""
WITH p AS (SELECT conversation_id AS id, string_agg(chr(10) || '### [' || sequence_index || '] ' || role || chr(10) || '- Source Message ID: ' || source_message_id || chr(10) || '- Created At: ' || {_iso('created_at_unix')} || chr(10) || chr(10) || content, chr(10) ORDER BY sequence_index) AS parts FROM msg GROUP BY 1)
SELECT id, regexp_replace('# ' || title || chr(10) || chr(10) || '## Conversation Metadata' || chr(10) || '- Source: ' || source || chr(10) || '- Source Conversation ID: ' || source_conversation_id || chr(10) || '- Created At: ' || {_iso('created_at_unix')} || chr(10) || '- Updated At: ' || {_iso('updated_at_unix')} || chr(10) || chr(10) || '## Messages' || chr(10) || parts, '\s+$', '') || chr(10) AS markdown FROM conv JOIN p USING (id)""")
def markdown_conversation(spark: SparkSession, sf: str) -> DataFrame:
    return package.conversation_markdown(*_tables(spark, sf))


@query(rf"SELECT id, '# Native Memory Entry ' || id || chr(10) || chr(10) || '## Metadata' || chr(10) || '- Stable ID: memory:' || id || chr(10) || '- Source Lane: native_memory' || chr(10) || '- Source Provider: native' || chr(10) || '- Timestamp: ' || {_iso('timestamp_unix')} || chr(10) || '- Role: user' || chr(10) || '- Tags: ' || tags || chr(10) || chr(10) || '## Content' || chr(10) || content || chr(10) AS markdown FROM notes")
def markdown_notes(spark: SparkSession, sf: str) -> DataFrame:
    return package.note_markdown(B.notes(spark, sf))


_SHOWN = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PROVIDERS.items()) + " ELSE source END"


def _chat_sql(links: str) -> str:
    """Chat notes with summaries in SQL; ``links`` gives l (id, links)."""
    return rf"""
WITH {links},
tr AS (SELECT conversation_id AS id, count(*) AS n, string_agg('[' || role || ']: ' || content, chr(10) ORDER BY sequence_index) AS t FROM msg GROUP BY 1),
c AS (SELECT conv.*, {_SHOWN} AS shown, coalesce('[[' || strftime(make_timestamp(CAST(created_at_unix AS BIGINT) * 1000000), '%Y-%m-%d') || ']]', 'unknown') AS created, strftime(make_timestamp(CAST(updated_at_unix AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS updated,
  replace(replace(title, '\', '\\'), '"', '\"') AS quoted, n, '[stub reply to ' || length(t) || ' characters] ' || left(trim(regexp_replace(t, '\s+', ' ', 'g')), 120) AS summary, links FROM conv JOIN tr ON tr.id = conv.id LEFT JOIN l ON l.id = conv.id)
SELECT id, 'chats/' || source || '--' || id || '.md' AS path, concat_ws(chr(10), '---', 'type: "chat"', 'stable_id: "imported_conversation:' || id || '"', 'provider: "[[' || shown || ']]"', 'lane: "imported"', 'title: "' || quoted || '"', 'created: "' || created || '"', 'updated: "' || updated || '"',
  'categories:' || chr(10) || '  - "[[Chat]]"', 'tags:' || chr(10) || '  - "chat"' || chr(10) || '  - "imported"' || chr(10) || '  - "' || source || '"', '---' || chr(10)) || '# ' || title || chr(10) || '> **Provider:** [[' || shown || ']] · **Messages:** ' || n || ' · **Created:** ' || created || chr(10)
  || '<!-- AUTO:BEGIN -->' || chr(10) || chr(10) || concat_ws(chr(10) || chr(10), '## Summary' || chr(10) || chr(10) || summary, '## Related Conversations' || chr(10) || chr(10) || links) || chr(10) || chr(10) || '<!-- AUTO:END -->' || chr(10) AS content FROM c"""


_LINK_LINES = lineage_sql("abs(a.pos - b.pos) <= 25").split("WITH ", 1)[1].strip() + f""",
k3 AS ({LINKS}),
l AS (SELECT k3.source_conversation_id AS id, string_agg('- [[' || source || '--' || conv.id || ']] — ' || relation_type || ' (' || title || ')', chr(10) ORDER BY confidence DESC, conv.id) AS links FROM k3 JOIN conv ON conv.id = target_conversation_id GROUP BY 1)"""


@query(_chat_sql(_LINK_LINES))
def chat_notes(spark: SparkSession, sf: str) -> DataFrame:
    c, m = _tables(spark, sf)
    links = lineage(neighbours(described(c, continued(spark, sf)))).join(c.select(F.col("id").alias("target_conversation_id"), F.col("source").alias("target_source")), "target_conversation_id")
    made = context.summaries(c, m, NOW).select(T.stable_number(F.col("source_conversation_id"), "imported_conversation").alias("id"), F.col("summary_text").alias("summary"))
    return notes.chat_notes(c, browse.message_counts(m), made, links)


@query("SELECT 'daily/' || d || '.md' AS path, '# ' || d || chr(10) || chr(10) || string_agg('- [[' || source || '--' || id || '|' || title || ']]', chr(10) ORDER BY created_at_unix, id) || chr(10) AS content FROM (SELECT *, strftime(make_timestamp(CAST(created_at_unix AS BIGINT) * 1000000), '%Y-%m-%d') AS d FROM conv WHERE created_at_unix IS NOT NULL) GROUP BY d")
def daily_notes(spark: SparkSession, sf: str) -> DataFrame:
    return notes.daily_notes(B.conversations(spark, sf))


@query("""
WITH n AS (SELECT id, id % 3 AS batch_id, coalesce(nullif(left(trim(regexp_replace(left(title, 4), '[^0-9A-Za-z \\-_.]', '_', 'g')), 60), ''), 'untitled') AS base FROM conv),
o AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY batch_id, base) > 1 THEN base || '-' || id ELSE base END AS name FROM n)
SELECT batch_id, id, CASE WHEN row_number() OVER (PARTITION BY batch_id, name ORDER BY id) > 1 THEN name || '-' || id ELSE name END AS name FROM o""")
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    return notes.unique_names(B.conversations(spark, sf).select((F.col("id") % 3).alias("batch_id"), "id", F.substring("title", 1, 4).alias("title")))


@query("SELECT path, content FROM (" + _chat_sql("l AS (SELECT NULL::BIGINT AS id, NULL::VARCHAR AS links)") + ")")
def vault_refresh(spark: SparkSession, sf: str) -> DataFrame:
    c, m = _tables(spark, sf)
    n = browse.message_counts(m)
    made = context.summaries(c, m, NOW).select(T.stable_number(F.col("source_conversation_id"), "imported_conversation").alias("id"), F.col("summary_text").alias("summary"))
    return notes.refreshed(notes.chat_notes(c, n).drop("id"), notes.chat_notes(c, n, made).drop("id"))


# --- capture, attachments, health, chunks ------------------------------------------------


_HASH = r"sha256('[' || to_json(adapter_id) || ',' || to_json(payload_kind) || ',' || to_json(regexp_replace(body_text, '\s+$', '')) || ',' || to_json(coalesce(source_url, '')) || ',' || to_json(CAST(CAST(floor(captured_at_unix / 60) * 60 AS BIGINT) AS VARCHAR)) || ']')"


@query(f"WITH h AS (SELECT id, received_at_unix, {_HASH} AS content_hash FROM captures) SELECT arg_min(id, (received_at_unix, id)) AS id, content_hash FROM h GROUP BY content_hash")
def capture_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return capture.first_of_each(capture.hashed(B.captures(spark, sf)).select("id", "content_hash", "received_at_unix")).drop("received_at_unix")


@query(r"""SELECT id, sha256('{"adapter_id":' || to_json(adapter_id) || ',"adapter_version":' || to_json(adapter_version) || ',"body_html":null,"body_text":' || to_json(body_text) || ',"captured_at_unix":' || CAST(CAST(captured_at_unix AS BIGINT) AS VARCHAR) || '.5,"hints":{"a":[1,"x"],"b":' || id || '},"metadata":null,"payload_kind":' || to_json(payload_kind) || ',"source_title":' || to_json(source_url || ' "t"') || ',"source_url":' || coalesce(CAST(to_json(source_url) AS VARCHAR), 'null') || '}') AS raw_payload_hash FROM captures WHERE source_url IS NOT NULL""")
def capture_raw_hashes(spark: SparkSession, sf: str) -> DataFrame:
    e = B.captures(spark, sf).filter("source_url is not null").withColumn("captured_at_unix", F.col("captured_at_unix") + 0.5)
    e = e.withColumns({"hints": F.concat(F.lit('{ "b": '), "id", F.lit(', "a": [1, "x"]}')), "source_title": F.concat("source_url", F.lit(' "t"'))})
    return capture.hashed(e).select("id", "raw_payload_hash")


@query("""
WITH e AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'other' ELSE adapter_id END AS a, CASE WHEN id % 13 = 0 THEN 'video' ELSE payload_kind END AS k, CASE WHEN id % 17 = 0 THEN NULL ELSE body_text END AS b, CASE WHEN id % 19 = 0 THEN -1 ELSE captured_at_unix END AS t FROM captures)
SELECT id, CASE WHEN b IS NULL THEN 'missing_body' WHEN t < 0 THEN 'invalid_time' WHEN a = 'other' THEN 'unknown_adapter' WHEN k = 'video' THEN 'kind_not_allowed' WHEN strlen(b) > CASE a WHEN 'cli' THEN 262144 ELSE 65536 END THEN 'body_too_large' END AS problem FROM e""")
def capture_contract(spark: SparkSession, sf: str) -> DataFrame:
    e = B.captures(spark, sf)
    i = F.col("id")
    e = e.withColumns({"adapter_id": F.when(i % 11 == 0, "other").otherwise(F.col("adapter_id")), "payload_kind": F.when(i % 13 == 0, "video").otherwise(F.col("payload_kind")), "body_text": F.when(i % 17 != 0, F.col("body_text")), "captured_at_unix": F.when(i % 19 == 0, -1.0).otherwise(F.col("captured_at_unix"))})
    return capture.contract_problems(e, capture.adapters(spark)).select("id", "problem")


_ACTIONS = ("triage", "promote", "reject", "quarantine", "triage", "reject", "promote", "triage")


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events")
    return e.select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("command_id"), F.element_at(F.array(*(F.lit(a) for a in _ACTIONS)), (F.col("event_id") % 8 + 1).cast("int")).alias("action"), F.concat(F.lit("user"), F.col("event_id") % 3).alias("decided_by"), F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("because "), F.col("event_id"))).alias("reason"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_unix"))


_STEP = "CASE s || '>' || a WHEN 'pending>triage' THEN 'triaged' WHEN 'pending>promote' THEN 'promoted' WHEN 'pending>reject' THEN 'rejected' WHEN 'pending>quarantine' THEN 'quarantined' WHEN 'triaged>promote' THEN 'promoted' WHEN 'triaged>reject' THEN 'rejected' WHEN 'triaged>quarantine' THEN 'quarantined' WHEN 'quarantined>triage' THEN 'triaged' WHEN 'quarantined>reject' THEN 'rejected' END"


_LIFE_SQL = f"""
WITH c AS (SELECT user_id AS capture_id, (['triage', 'promote', 'reject', 'quarantine', 'triage', 'reject', 'promote', 'triage'])[event_id % 8 + 1] AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
  epoch_us(ts) / 1e6 AS t, 'user' || event_id % 3 AS who, CASE WHEN event_id % 5 > 0 THEN 'because ' || event_id END AS why FROM events),
r(capture_id, k, status, n, triaged_at_unix, decided_at_unix, decided_by, reject_reason, quarantine_reason) AS (
  SELECT DISTINCT capture_id, 0::BIGINT, 'pending', 0::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM c
  UNION ALL
  SELECT capture_id, k, coalesce(z, status), n + CASE WHEN z IS NULL THEN 0 ELSE 1 END, CASE WHEN z = 'triaged' THEN t ELSE triaged_at_unix END,
    CASE WHEN z <> 'triaged' THEN t ELSE decided_at_unix END, CASE WHEN z <> 'triaged' THEN who ELSE decided_by END,
    CASE WHEN z = 'rejected' THEN why ELSE reject_reason END, CASE WHEN z = 'quarantined' THEN why ELSE quarantine_reason END
  FROM (SELECT r.* EXCLUDE (k), c.k, c.t, c.who, c.why, {_STEP.replace("s ||", "r.status ||")} AS z FROM r JOIN c ON c.capture_id = r.capture_id AND c.k = r.k + 1)),
life AS (SELECT * EXCLUDE (k, n), n AS n_applied, k AS n FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY k DESC) AS last FROM r) WHERE last = 1)
"""


@query(_LIFE_SQL + "SELECT * EXCLUDE (n, last), n - n_applied AS n_rejected FROM life")
def capture_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    return capture.replay(_commands(spark, sf))


@query(_LIFE_SQL + "SELECT id AS captured_via_id, length(body_text) AS size, 'captured' AS tags FROM captures JOIN life ON capture_id = id WHERE status = 'promoted'")
def capture_promoted_notes(spark: SparkSession, sf: str) -> DataFrame:
    return capture.promoted_notes(B.captures(spark, sf), capture.replay(_commands(spark, sf))).select("captured_via_id", F.length("content").alias("size"), "tags")


@query("SELECT id, conversation_id FROM msg WHERE conversation_id NOT IN (SELECT id FROM conv WHERE id % 10 <> 7)")
def orphan_check(spark: SparkSession, sf: str) -> DataFrame:
    c, m = _tables(spark, sf)
    return health.orphans(m, c.filter("id % 10 <> 7")).select("id", "conversation_id")


@query("""
SELECT 'conversations' AS name, count(*) AS n, true AS ok FROM conv UNION ALL SELECT 'messages', count(*), true FROM msg UNION ALL SELECT 'notes', count(*), true FROM notes
UNION ALL SELECT unnest(['orphan_messages', 'repeated_conversation_ids', 'repeated_message_ids', 'repeated_source_keys', 'broken_sequences', 'empty_conversations']), 0, true""")
def health_counts(spark: SparkSession, sf: str) -> DataFrame:
    return health.checks(*_tables(spark, sf), B.notes(spark, sf))


@query("SELECT source, count(DISTINCT conv.id) AS conversations, count(*) AS messages FROM conv JOIN msg ON conversation_id = conv.id GROUP BY source")
def health_providers(spark: SparkSession, sf: str) -> DataFrame:
    return health.provider_counts(*_tables(spark, sf))


@query("SELECT 'asset:sha256:' || sha256(text) AS stable_id, 'assets/sha256/' || left(sha256(text), 2) || '/' || sha256(text) || '-' || regexp_replace(min(source || '/' || doc_id || '.txt'), '^.*/', '') AS storage_path, strlen(text) AS size_bytes, count(*) AS n_copies FROM documents GROUP BY text")
def asset_store(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = B.table(spark, sf, "documents").select(name.alias("path"), name.alias("original_filename"), F.col("text").cast("binary").alias("content"))
    return assets.asset_rows(files).select("stable_id", "storage_path", "size_bytes", "n_copies")


_WS = chunks.WS
_CHUNKS_SQL = rf"""
WITH lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS k, unnest(string_split(text, chr(10))) AS line FROM documents),
marked AS (SELECT *, sum(length(line) + 1) OVER w - length(line) - 1 AS st, starts_with(line, '```') AS fence, sum(CAST(starts_with(line, '```') AS INT)) OVER w AS fences FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
kinds AS (SELECT *, CASE WHEN fence OR fences % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^[{_WS}]*#') THEN 'heading' WHEN NOT regexp_matches(line, '^[{_WS}]*\z') THEN 'paragraph' END AS kind FROM marked),
opened AS (SELECT *, CASE WHEN kind = 'code' THEN fence AND fences % 2 = 1 WHEN kind = 'paragraph' THEN lag(kind) OVER (PARTITION BY doc_id ORDER BY k) IS DISTINCT FROM 'paragraph' ELSE kind IS NOT NULL END AS opens FROM kinds),
numbered AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY k) AS block FROM opened),
joined AS (SELECT doc_id, block, min(kind) AS kind, min(st) AS st, string_agg(line, chr(10) ORDER BY k) AS whole FROM numbered WHERE kind IS NOT NULL GROUP BY doc_id, block),
found AS (SELECT doc_id, block, kind, st, CASE kind WHEN 'code' THEN rtrim(whole, chr(10)) ELSE regexp_replace(whole, '[{_WS}]+\z', '') END AS text FROM joined),
sentences AS (
  SELECT doc_id, block, i, STRIP(t) AS t FROM (
    SELECT doc_id, block, unnest(string_split(regexp_replace(STRIP(text), '([.!?])[{_WS}]+', '\1' || chr(1), 'g'), chr(1))) AS t,
      unnest(range(len(string_split(regexp_replace(STRIP(text), '([.!?])[{_WS}]+', '\1' || chr(1), 'g'), chr(1))))) AS i FROM found WHERE kind = 'paragraph' AND length(text) > 1600)
  WHERE STRIP(t) <> ''),
cuts(doc_id, block, i, k, piece, rest) AS (
  SELECT doc_id, block, i, 0, '', t FROM sentences WHERE length(t) > 1600 UNION ALL SELECT doc_id, block, -1, 0, '', text FROM found WHERE kind <> 'paragraph' AND length(text) > 1600
  UNION ALL
  SELECT doc_id, block, i, k + 1, substr(rest, 1, n), ltrim(substr(rest, n + 1), ' ') FROM (
    SELECT *, CASE WHEN length(rest) <= 1600 THEN length(rest) WHEN length(regexp_extract(substr(rest, 1, 1600), '(?s)^(.*) ', 1)) > 0 THEN length(regexp_extract(substr(rest, 1, 1600), '(?s)^(.*) ', 1)) ELSE 1600 END AS n FROM cuts WHERE rest <> '')),
units AS (
  SELECT doc_id, block, t, alone, row_number() OVER (PARTITION BY doc_id, block ORDER BY i, k) AS u FROM (
    SELECT doc_id, block, i, 0 AS k, t, false AS alone FROM sentences WHERE length(t) <= 1600 UNION ALL SELECT doc_id, block, i, k, STRIP(piece), true FROM cuts WHERE i >= 0 AND STRIP(piece) <> '')),
fold(doc_id, block, u, size, g) AS (
  SELECT DISTINCT doc_id, block, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM units
  UNION ALL
  SELECT doc_id, block, u, CASE WHEN alone OR n >= 1000 THEN 0 ELSE n END, g FROM (
    SELECT f.doc_id, f.block, p.u, p.alone, length(p.t) + CASE WHEN f.size > 0 AND NOT p.alone AND f.size + 1 + length(p.t) <= 1600 THEN f.size + 1 ELSE 0 END AS n,
      f.g + CASE WHEN f.size > 0 AND NOT p.alone AND f.size + 1 + length(p.t) <= 1600 THEN 0 ELSE 1 END AS g
    FROM fold f JOIN units p ON p.doc_id = f.doc_id AND p.block = f.block AND p.u = f.u + 1)),
pieces AS (
  SELECT doc_id, block, 0 AS piece, kind, text AS t FROM found WHERE length(text) <= 1600
  UNION ALL SELECT doc_id, block, k, (SELECT kind FROM found x WHERE x.doc_id = cuts.doc_id AND x.block = cuts.block), STRIP(piece) FROM cuts WHERE i = -1 AND STRIP(piece) <> ''
  UNION ALL SELECT doc_id, block, g, 'sentence_group', string_agg(t, ' ' ORDER BY u) FROM fold JOIN units USING (doc_id, block, u) GROUP BY doc_id, block, g),
placed AS (
  SELECT p.*, f.st + coalesce(sum(length(t) + 1) OVER (PARTITION BY p.doc_id, p.block ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st,
    row_number() OVER (PARTITION BY p.doc_id ORDER BY p.block, piece) = 1 AND p.kind <> 'code' AND length(t) > 400 AS shrink FROM pieces p JOIN found f USING (doc_id, block)),
parts AS (
  SELECT doc_id, block, piece, 0 AS part, kind, t, st FROM placed WHERE NOT shrink
  UNION ALL
  SELECT doc_id, block, piece, part, kind, STRIP(x), st + CASE part WHEN 0 THEN 0 ELSE cut END + length(x) - length(regexp_replace(x, '^[{_WS}]+', '')) FROM (
    SELECT *, unnest([0, 1]) AS part, unnest([substr(t, 1, cut), substr(t, cut + 1)]) AS x FROM (
      SELECT *, CASE WHEN length(regexp_extract(substr(t, 1, 401), '(?s)^(.*[.!?][{_WS}]+)[^{_WS}]', 1)) > 0 THEN length(regexp_extract(substr(t, 1, 401), '(?s)^(.*[.!?][{_WS}]+)[^{_WS}]', 1))
        WHEN length(regexp_extract(substr(t, 1, 400), '(?s)^(.+ )', 1)) > 0 THEN length(regexp_extract(substr(t, 1, 400), '(?s)^(.+ )', 1)) ELSE 400 END AS cut FROM placed WHERE shrink))
  WHERE STRIP(x) <> ''),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block, piece, part) - 1 AS INT) AS index, kind, t AS text, CAST(st AS INT) AS char_start FROM parts)
"""
_CHUNKS_SQL = re.sub(r"STRIP\((\w+)\)", lambda m: rf"regexp_replace({m[1]}, '^[{_WS}]+|[{_WS}]+\z', '', 'g')", _CHUNKS_SQL)


@query(_CHUNKS_SQL + "SELECT doc_id, 'c' || CASE WHEN index < 999 THEN right('00' || (index + 1), 3) ELSE CAST(index + 1 AS VARCHAR) END AS chunk_id, index, kind, text, char_start, CAST(char_start + length(text) AS INT) AS char_end FROM chunks")
def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk(B.table(spark, sf, "documents"))


@query(_CHUNKS_SQL + "SELECT kind, count(*) AS n, round(avg(length(text)), 1) AS mean_chars, max(length(text)) AS max_chars FROM chunks GROUP BY kind")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk_stats(chunks.chunk(B.table(spark, sf, "documents")))
