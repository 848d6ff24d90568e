"""Queries of federated search, answers, topics, threads and lineage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake import testbed as B
from convlake.operators import federated, similarity
from convlake.plans.registry import query
from convlake.schemas import CONTINUATION_PHRASES, LINEAGE_STOPWORDS, QUESTION_STOPWORDS, THREAD_STOPWORDS, TOPIC_STOPWORDS


def _listed(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("""
WITH i AS (SELECT * FROM conv WHERE contains(lower(title), 'thing') OR id IN (SELECT conversation_id FROM msg WHERE contains(lower(content), 'thing'))
  ORDER BY coalesce(updated_at_unix, created_at_unix, 0) DESC, coalesce(created_at_unix, 0) DESC, id DESC LIMIT 25),
e AS (SELECT conversation_id, arg_min(content, sequence_index) AS evidence FROM msg WHERE contains(lower(content), 'thing') GROUP BY 1),
n AS (SELECT * FROM notes WHERE contains(lower(content), 'thing') ORDER BY timestamp DESC, id DESC LIMIT 25)
SELECT 'native_memory' AS source_lane, 'memory:' || id AS stable_id, content AS title, timestamp_unix, NULL AS evidence_text, is_starred AS starred FROM n
UNION ALL SELECT 'imported_conversation', 'imported_conversation:' || id, title, coalesce(nullif(updated_at_unix, 0), created_at_unix), evidence, is_starred FROM i LEFT JOIN e ON conversation_id = id""")
def federated_search(spark: SparkSession, sf: str) -> DataFrame:
    return federated.federated_search(B.conversations(spark, sf), B.messages(spark, sf), B.notes(spark, sf), "Thing").drop("source_metadata")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    own = B.messages(spark, sf).filter("role = 'user'").groupBy("conversation_id").agg(F.min_by("content", "sequence_index").alias("text"))
    own = own.select((F.col("conversation_id") * 2).alias("question_id"), F.get(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), F.lit(0)), F.lit(0)).alias("question"))
    asked = B.table(spark, sf, "benchmark").select((F.col("item_id") * 2 + 1).alias("question_id"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("question"))
    return own.unionByName(asked).filter("question is not null")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return federated.answered(_questions(spark, sf), B.conversations(spark, sf), B.messages(spark, sf), B.notes(spark, sf))


_ANSWER_SQL = rf"""
WITH q0 AS (
  SELECT conversation_id * 2 AS question_id, regexp_extract_all(lower(arg_min(content, sequence_index)), '[a-z0-9]{{4,}}')[1] AS question FROM msg WHERE role = 'user' GROUP BY conversation_id
  UNION ALL SELECT item_id * 2 + 1, array_to_string(string_split(text, ' ')[1:8], ' ') FROM benchmark
),
q AS (SELECT question_id, trim(question) AS question, list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains({_listed(QUESTION_STOPWORDS)}, w)) AS terms FROM q0 WHERE question IS NOT NULL),
a AS (SELECT DISTINCT question_id, unnest(terms) AS term FROM q),
mw AS (SELECT conversation_id, sequence_index, unnest(list_distinct(regexp_extract_all(strip_accents(lower(content)), '[\p{{L}}\p{{N}}]+'))) AS term FROM msg),
nw AS (SELECT id, timestamp_unix, unnest(list_distinct(regexp_extract_all(strip_accents(lower(content)), '[\p{{L}}\p{{N}}]+'))) AS term FROM notes),
ic AS (SELECT question_id, conversation_id, min(sequence_index) AS s FROM a JOIN mw USING (term) GROUP BY ALL),
ir AS (SELECT question_id, conv.id, s, title, source, source_conversation_id, coalesce(nullif(updated_at_unix, 0), created_at_unix) AS t,
  row_number() OVER (PARTITION BY question_id ORDER BY coalesce(updated_at_unix, created_at_unix, 0) DESC, coalesce(created_at_unix, 0) DESC, conv.id DESC) AS k FROM ic JOIN conv ON conv.id = conversation_id),
ih AS (SELECT question_id, 'imported_conversation' AS lane, 'imported_conversation:' || ir.id AS sid, t, lower(content) AS ev,
  '"' || CASE WHEN length(STRIP(content)) <= 200 THEN STRIP(content) ELSE left(STRIP(content), 200) || '…' END || '" — from "' || STRIP(title) || '" (' || source || ')' AS summary FROM ir JOIN msg ON conversation_id = ir.id AND sequence_index = s WHERE k <= 10),
nr AS (SELECT question_id, id, timestamp_unix, row_number() OVER (PARTITION BY question_id ORDER BY timestamp_unix DESC, id DESC) AS k FROM (SELECT DISTINCT question_id, id, timestamp_unix FROM a JOIN nw USING (term))),
nh AS (SELECT question_id, 'native_memory' AS lane, 'memory:' || notes.id AS sid, nr.timestamp_unix AS t, lower(regexp_replace(content, '^\s+|\s+$', '', 'g') || ' ' || tags || ' user') AS ev,
  STRIP(content) || ' (tags: ' || tags || ')' AS summary FROM nr JOIN notes ON notes.id = nr.id WHERE k <= 10),
h AS (SELECT h.*, len(list_filter(list_distinct(terms), lambda w: contains(ev, w))) AS overlap FROM (SELECT * FROM ih UNION ALL SELECT * FROM nh) h JOIN q USING (question_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, t DESC NULLS LAST, lane, sid) AS nth FROM h)
"""


_ANSWER_SQL = re.sub(r"STRIP\((\w+)\)", r"regexp_replace(\1, '^\\s+|\\s+$', '', 'g')", _ANSWER_SQL)


@query(_ANSWER_SQL + """, g AS (SELECT q.question_id, any_value(question) AS question, len(list_distinct(any_value(terms))) AS n, coalesce(max(overlap) FILTER (WHERE nth = 1), 0) AS best, coalesce(max(overlap) FILTER (WHERE nth = 2), 0) AS second,
  count(nth) AS hits, string_agg(summary, ' | ' ORDER BY nth) FILTER (WHERE nth <= 3) AS shown, string_agg('[' || nth || '] ' || sid || ' (' || lane || ')', '; ' ORDER BY nth) FILTER (WHERE nth <= 3) AS marks FROM q LEFT JOIN b ON b.question_id = q.question_id GROUP BY q.question_id),
s AS (SELECT *, second > 0 AND (best = second OR (best - second = 1 AND best < greatest(3, n))) AS doubt, chr(39) || question || chr(39) AS named FROM g)
SELECT question_id, CASE WHEN hits = 0 THEN 'I could not find grounded evidence for ' || named || ' in canonical records. Try different keywords.'
    WHEN best = 0 OR n = 0 THEN 'I found limited evidence for ' || named || '. Evidence snippets: ' || shown || '. Most relevant records: ' || marks || '. Please refine the question for a stronger grounded answer.'
    WHEN doubt THEN 'I found multiple plausible interpretations for ' || named || '. Competing evidence: ' || shown || '. Sources: ' || marks || '.'
    ELSE 'Grounded evidence for ' || named || ': ' || shown || '. Sources: ' || marks || '.' END AS answer_text,
  CASE WHEN hits = 0 THEN 'No matching records were found yet. Try different keywords or add more context.' WHEN n = 0 THEN 'Try a more specific question with a few distinctive keywords.'
    WHEN best = 0 THEN 'The closest records did not clearly match your wording. Try rephrasing with different terms.' WHEN doubt THEN 'Multiple top hits plausibly match; clarify the intended interpretation.' END AS note FROM s""")
def answer_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("question_id", "answer_text", "note")


@query(_ANSWER_SQL + """, g AS (SELECT q.question_id, len(list_distinct(any_value(terms))) AS n_terms, coalesce(max(overlap) FILTER (WHERE nth = 1), 0) AS best, coalesce(max(overlap) FILTER (WHERE nth = 2), 0) AS second FROM q LEFT JOIN b ON b.question_id = q.question_id GROUP BY q.question_id)
SELECT question_id, n_terms, best, second, CASE WHEN best = 0 OR n_terms = 0 THEN 'insufficient_evidence' WHEN second > 0 AND (best = second OR (best - second = 1 AND best < greatest(3, n_terms))) THEN 'ambiguous' ELSE 'grounded' END AS status FROM g""")
def answer_status(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("question_id", F.col("n_terms").cast("long"), F.col("best").cast("long"), F.col("second").cast("long"), "status")


@query(_ANSWER_SQL + "SELECT question_id, nth, lane AS source_lane, sid AS stable_id, overlap FROM b WHERE nth <= 3")
def answer_citations(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("question_id", F.explode("citations").alias("c")).select("question_id", F.col("c.nth").cast("long").alias("nth"), "c.source_lane", "c.stable_id", F.col("c.overlap").cast("long").alias("overlap"))


@query(_ANSWER_SQL + """, g AS (SELECT q.question_id, any_value(question) AS question, list_filter(any_value(terms), lambda w, i: list_position(any_value(terms), w) = i) AS terms, coalesce(max(overlap) FILTER (WHERE nth = 1), 0) AS best, coalesce(max(overlap) FILTER (WHERE nth = 2), 0) AS second,
  string_agg(DISTINCT lane, ',' ORDER BY lane) FILTER (WHERE nth <= 3) AS lanes FROM q LEFT JOIN b ON b.question_id = q.question_id GROUP BY q.question_id),
s AS (SELECT *, CASE WHEN best = 0 OR len(terms) = 0 THEN 'insufficient_evidence' WHEN second > 0 AND (best = second OR (best - second = 1 AND best < greatest(3, len(terms)))) THEN 'ambiguous' ELSE 'grounded' END AS status FROM g)
SELECT 'answer_trace:' || left(sha256(question || '|2024-06-01T00:00:00Z'), 32) AS trace_id, question, array_to_string(terms, ' ') AS retrieval_terms, status, coalesce(lanes, '') AS source_lanes, CASE WHEN status <> 'grounded' THEN status END AS fallback_reason FROM s""")
def answer_traces(spark: SparkSession, sf: str) -> DataFrame:
    made = federated.traces(_answers(spark, sf), "2024-06-01T00:00:00Z")
    return made.select("trace_id", "question", "retrieval_terms", "status", F.array_join("source_lanes", ",").alias("source_lanes"), "fallback_reason")


def _topic_sql(conversations: str) -> str:
    """Topics (t: topic, rank, ids) of a table of conversations, in SQL."""
    return rf"""
WITH w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(coalesce(nullif(title, ''), 'Untitled')), '[a-zA-Z]{{3,}}')) AS word FROM {conversations}),
c AS (SELECT word, count(*) AS n FROM w WHERE NOT list_contains({_listed(TOPIC_STOPWORDS)}, word) GROUP BY word HAVING count(*) >= 2 ORDER BY n DESC, word LIMIT 5),
r AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM c),
m AS (SELECT id, word, rank, n, min(rank) OVER (PARTITION BY id) AS first FROM w JOIN r USING (word)),
t AS (SELECT upper(left(word, 1)) || substr(word, 2) AS topic, rank, n, list(id ORDER BY id) AS ids FROM m GROUP BY word, rank, n HAVING bool_or(first = rank))
"""


#: The conversations that a topic scan looks at.
_NEWEST = "(SELECT * FROM conv ORDER BY id DESC LIMIT 50)"


@query(_topic_sql("conv") + "SELECT topic, rank, n, unnest(ids) AS id FROM t")
def topic_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.topic_members(B.conversations(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query(_topic_sql(_NEWEST) + "SELECT 'topic_scan:1' AS scan_id, topic, rank, 'low' AS confidence, array_to_string(list_transform(ids, lambda x: 'imported_conversation:' || x), ',') AS ids FROM t")
def topic_scan(spark: SparkSession, sf: str) -> DataFrame:
    scan = similarity.topic_scan(B.conversations(spark, sf), "topic_scan:1", "2024-06-01T00:00:00Z").select("scan_id", F.explode("clusters").alias("c"))
    return scan.select("scan_id", "c.topic", F.col("c.rank").cast("long").alias("rank"), "c.confidence", F.array_join("c.ids", ",").alias("ids"))


_THREADS = rf"""
WITH w AS (SELECT id, created_at_unix AS t, list_filter(list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(title), '[[:punct:]]', ' ', 'g'), '\s+', ' ', 'g')), ' ')), lambda x: length(x) >= 2 AND NOT list_contains({_listed(THREAD_STOPWORDS)}, x)) AS w FROM conv),
e AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.id <> b.id WHERE len(list_intersect(a.w, b.w)) >= 2 OR (len(list_intersect(a.w, b.w)) >= 1 AND abs(a.t - b.t) <= 172800)),
reach(id, root) AS (SELECT a, a FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.root),
member AS (SELECT id, min(root) AS thread FROM reach GROUP BY id)
"""


@query(_THREADS + "SELECT id, thread FROM member")
def thread_members(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.thread_members(B.conversations(spark, sf))


_DAY = "strftime(make_timestamp(CAST({} AS BIGINT) * 1000000), '%b %-d{}')"


def _range_sql(first: str, last: str) -> str:
    """F12 in SQL."""
    whole = [_DAY.format(c, ", %Y") for c in (first, last)]
    year = [f"year(make_timestamp(CAST({c} AS BIGINT) * 1000000))" for c in (first, last)]
    return f"coalesce(CASE WHEN {whole[0]} = {whole[1]} THEN {whole[0]} WHEN {year[0]} = {year[1]} THEN {_DAY.format(first, '')} || ' — ' || {whole[1]} ELSE {whole[0]} || ' — ' || {whole[1]} END, '')"


@query(_THREADS + """, mc AS (SELECT conversation_id AS id, count(*) AS n FROM msg GROUP BY 1),
c AS (SELECT thread, count(*) AS size, CAST(sum(n) AS BIGINT) AS total_messages, min(stamp) AS first_unix, max(stamp) AS last_unix FROM member JOIN mc USING (id) JOIN (SELECT id, coalesce(nullif(created_at_unix, 0), nullif(updated_at_unix, 0)) AS stamp FROM conv) USING (id) GROUP BY thread),
s AS (SELECT thread, word, count(*) AS n FROM (SELECT thread, unnest(w) AS word FROM member JOIN w USING (id)) GROUP BY ALL HAVING count(*) >= 2),
l AS (SELECT thread, string_agg(word, ' ' ORDER BY k) AS words FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY n DESC, word) AS k FROM s) WHERE k <= 3 GROUP BY thread)
SELECT thread, coalesce(upper(left(words, 1)) || substr(words, 2), 'Related conversations') AS label, size, first_unix, last_unix, """ + _range_sql("first_unix", "last_unix") + """ AS date_range, total_messages FROM c LEFT JOIN l USING (thread) ORDER BY size DESC, label, thread LIMIT 5""")
def threads(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.threads(B.conversations(spark, sf), B.messages(spark, sf))


@query(_THREADS + "SELECT thread, id, row_number() OVER (PARTITION BY thread ORDER BY coalesce(created_at_unix, 0) DESC, id) - 1 AS place FROM member JOIN conv USING (id)")
def thread_places(spark: SparkSession, sf: str) -> DataFrame:
    c = B.conversations(spark, sf)
    return similarity.thread_places(c, similarity.thread_members(c))


def continued(spark: SparkSession, sf: str) -> DataFrame:
    """Messages, of which the second of every ninth conversation takes up an earlier one."""
    m = B.messages(spark, sf)
    again = (F.col("conversation_id") % 9 == 2) & (F.col("sequence_index") == 1)
    return m.withColumn("content", F.when(again, F.concat(F.lit(f"{CONTINUATION_PHRASES[0].capitalize()} it. "), "content")).otherwise(F.col("content")))


def lineage_sql(pairs: str) -> str:
    """Scored pairs of conversations (f) in SQL; ``pairs`` says which of a and b meet."""
    return rf"""
WITH m AS (SELECT conversation_id, sequence_index, CASE WHEN conversation_id % 9 = 2 AND sequence_index = 1 THEN '{CONTINUATION_PHRASES[0].capitalize()} it. ' || content ELSE content END AS content FROM msg),
p AS (SELECT conversation_id AS id, string_agg(content, ' ' ORDER BY sequence_index) FILTER (WHERE sequence_index < 3) AS txt, lower(string_agg(content, ' ' ORDER BY sequence_index) FILTER (WHERE sequence_index < 2)) AS early FROM m GROUP BY 1),
d AS (SELECT conv.id, row_number() OVER (ORDER BY conv.id DESC) AS newest, title, created_at_unix AS t, list_filter({_listed(CONTINUATION_PHRASES)}, lambda x: contains(early, x))[1] AS phrase, row_number() OVER (ORDER BY coalesce(created_at_unix, 0), conv.id) AS pos,
  list_filter(list_distinct(regexp_extract_all(lower(title), '[a-zA-Z]{{3,}}')), lambda x: NOT list_contains({_listed(LINEAGE_STOPWORDS)}, x)) AS tw,
  list_filter(list_distinct(regexp_extract_all(lower(txt), '[a-zA-Z]{{3,}}')), lambda x: NOT list_contains({_listed(LINEAGE_STOPWORDS)}, x)) AS cw FROM conv LEFT JOIN p ON p.id = conv.id),
j AS (SELECT a.id AS s, a.phrase, list_sort(list_intersect(a.tw, b.tw)) AS both_words, len(list_intersect(a.cw, b.cw)) AS n_both, b.id AS g, b.title, a.t AS st, b.t AS gt, len(list_intersect(a.tw, b.tw)) / len(list_distinct(a.tw || b.tw)) AS tj, len(list_intersect(a.cw, b.cw)) / len(list_distinct(a.cw || b.cw)) AS cj, len(a.tw) * len(b.tw) AS tn, len(a.cw) * len(b.cw) AS cn, abs(a.t - b.t) / 3600 AS hours
  FROM d a JOIN d b ON a.id <> b.id AND {pairs}),
k AS (SELECT *, CASE WHEN tn > 0 AND tj >= 0.1 THEN tj ELSE 0 END AS ts, CASE WHEN hours <= 48 THEN 1.0::DOUBLE WHEN hours <= 168 THEN 0.5 WHEN hours <= 720 THEN 0.2 ELSE 0 END AS hs, CASE WHEN cn > 0 AND cj >= 0.05 THEN least(cj * 1.5::DOUBLE, 1) ELSE 0 END AS cs, CASE WHEN phrase IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS ps FROM j),
f AS (SELECT *, round(ts * 0.4::DOUBLE + hs * 0.2::DOUBLE + cs * 0.3::DOUBLE + ps * 0.1::DOUBLE, 3) AS confidence FROM k WHERE ts * 0.4::DOUBLE + hs * 0.2::DOUBLE + cs * 0.3::DOUBLE + ps * 0.1::DOUBLE >= 0.15)
"""


LINKS = """SELECT s AS source_conversation_id, g AS target_conversation_id, CASE WHEN ps > 0 OR (hs >= 1 AND ts >= 0.2) THEN 'continues' WHEN ts >= 0.5 AND gt > st THEN 'supersedes' WHEN ts >= 0.2 AND hs <= 0.2 THEN 'revisits' ELSE 'forks_from' END AS relation_type, confidence
FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY confidence DESC, g) AS n FROM f) WHERE n <= 3"""


@query(lineage_sql("abs(a.pos - b.pos) <= 25") + LINKS)
def lineage_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = similarity.described(B.conversations(spark, sf), continued(spark, sf))
    return similarity.lineage(similarity.neighbours(rows)).drop("target_title", "signals")


@query(lineage_sql("b.newest <= 51 AND b.newest <= CASE WHEN a.newest <= 50 THEN 51 ELSE 50 END") + LINKS.replace("confidence\n", """confidence, concat_ws('; ', CASE WHEN ts > 0 THEN 'title overlap (' || array_to_string(both_words[1:5], ', ') || ')' END,
  CASE WHEN hours <= 48 THEN 'within 48 hours' WHEN hours <= 168 THEN 'within 7 days' WHEN hours <= 720 THEN 'within 30 days' END, CASE WHEN cs > 0 THEN n_both || ' shared content keywords' END, 'continuation phrase: "' || phrase || '"') AS signals
"""))
def lineage_signals(spark: SparkSession, sf: str) -> DataFrame:
    rows = similarity.described(B.conversations(spark, sf), continued(spark, sf))
    return similarity.lineage(similarity.newest_others(rows, rows)).select("source_conversation_id", "target_conversation_id", "relation_type", "confidence", F.array_join("signals", "; ").alias("signals"))
