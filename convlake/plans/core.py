"""Queries of search, lists and roll-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake import testbed as B
from convlake.functions import text as T
from convlake.operators import browse, rollups, search
from convlake.plans.registry import query
from convlake.shared import folder

SEARCH = "than and"
#: The words that share a stem with those of the queries, by the published steps of the stemmer.
_FORMS = {"than": "than(s|ful|fuls|ness|nesses)?", "and": "and(s|e|es|ed|ing|ings|ful|fuls|ness|nesses)?", "thing": "thing(s|e|es|ed|ing|ings|ful|fuls|ness|nesses)?"}


def _search_sql(terms: list[str]) -> str:
    """Ranked search for the documents that have all terms, in SQL."""
    n = range(len(terms))
    found = " AND ".join(f"f{k} > 0" for k in n)
    counts = ", ".join(f"len(list_filter(w, lambda x: regexp_full_match(x, '{_FORMS[t]}'))) AS f{k}" for k, t in enumerate(terms))
    score = " + ".join(f"greatest(1e-6, ln((n - n_all + 0.5) / (n_all + 0.5))) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * length / mean))" for k in n)
    return rf"""
WITH docs AS (SELECT 'message' AS kind, id, content, created_at_unix AS t FROM msg UNION ALL SELECT 'note', id, content, timestamp_unix FROM notes),
w AS (SELECT kind, id, t, content, regexp_extract_all(strip_accents(lower(content)), '[\p{{L}}\p{{N}}]+') AS w FROM docs),
t AS (SELECT kind, id, t, content, len(w) AS length, {counts} FROM w),
s AS (SELECT kind, count(*) AS n, avg(length) AS mean FROM t GROUP BY kind),
m AS (SELECT kind, count(*) FILTER (WHERE {found}) AS n_all FROM t GROUP BY kind),
h AS (SELECT t.kind, t.id, t.t, t.content, {score} AS score FROM t JOIN s ON t.kind = s.kind JOIN m ON m.kind = t.kind WHERE {found})
"""


_SEARCH_SQL = _search_sql(["than", "and"])


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return search.documents_of(B.messages(spark, sf), B.notes(spark, sf))


#: Saved indexes of this process, by application and tables.
_SAVED: dict[tuple[str, str], str] = {}


def _saved(spark: SparkSession, sf: str) -> str:
    """The saved index of all messages and notes: built once in an application, for all queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SAVED or not search.segments(spark, _SAVED[key]):
        _SAVED[key] = f"{folder(spark)}/index-{uuid.uuid4().hex}"
        search.add_documents(_documents(spark, sf), _SAVED[key])
    return _SAVED[key]


def _hits(spark: SparkSession, sf: str, text: str = SEARCH) -> tuple[DataFrame, DataFrame]:
    return search.search(*search.read_index(spark, _saved(spark, sf), text), text), _documents(spark, sf)


@query(_SEARCH_SQL + "SELECT kind, id, round(score, 6) AS score FROM h ORDER BY round(score, 9) DESC, kind, id LIMIT 50")
def search_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked(*_hits(spark, sf)).select("kind", "id", F.round("score", 6).alias("score"))


@query(_SEARCH_SQL + "SELECT kind, id, round(score, 6) AS score FROM h ORDER BY t DESC NULLS LAST, kind, id LIMIT 50")
def search_newest(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked(*_hits(spark, sf), "newest").select("kind", "id", F.round("score", 6).alias("score"))


@query(_SEARCH_SQL + 'SELECT kind, id, t AS "at" FROM h ORDER BY t ASC NULLS LAST, kind, id LIMIT 1')
def search_oldest_first_hit(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked(*_hits(spark, sf), "oldest", 1).select("kind", "id", "at")


@query(r"""
WITH w AS (SELECT 'message' AS kind, id, unnest(regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+')) AS term FROM msg UNION ALL
  SELECT 'note', id, unnest(regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+')) FROM notes),
p AS (SELECT term, kind, id, count(*) AS tf FROM w GROUP BY ALL)
SELECT term, kind, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY term, kind""")
def index_postings(spark: SparkSession, sf: str) -> DataFrame:
    postings, _ = search.index(_documents(spark, sf), stemmed=False)
    return postings.groupBy("term", "kind").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@query(r"""
WITH w AS (SELECT id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+'), ' ') || ' ' AS w FROM msg)
SELECT id FROM w WHERE contains(w, ' of the ') AND contains(w, ' and ')""")
def search_phrase(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).filter("kind = 'message'")
    return search.search(*search.index(docs, stemmed=False), "of-the and", stemmed=False).select("id")


@query(_search_sql(["thing"]) + "SELECT kind, id, round(score, 6) AS score FROM h ORDER BY round(score, 9) DESC, kind, id LIMIT 50")
def search_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked(*_hits(spark, sf, "things")).select("kind", "id", F.round("score", 6).alias("score"))


@query(_SEARCH_SQL + rf"""
, b AS (SELECT kind, id, regexp_extract_all(content, '[\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}]*') AS p FROM (SELECT * FROM h ORDER BY round(score, 9) DESC, kind, id LIMIT 50)),
c AS (SELECT *, list_transform(p, lambda x: regexp_full_match(strip_accents(lower(regexp_extract(x, '[\p{{L}}\p{{N}}]+'))), '{_FORMS["than"]}|{_FORMS["and"]}')) AS hit FROM b),
d AS (SELECT *, greatest(1, list_position(hit, true) - 20) AS start FROM c),
e AS (SELECT *, list_transform(list_zip(p, hit)[start:start + 39], lambda x: CASE WHEN x[2] THEN regexp_replace(x[1], '^([\p{{L}}\p{{N}}]+)', '<mark>\1</mark>') ELSE x[1] END) AS shown FROM d)
SELECT kind, id, CASE WHEN start > 1 THEN '…' ELSE '' END || rtrim(array_to_string(shown, '')) || CASE WHEN len(p) > start + 39 THEN '…' ELSE '' END AS snippet FROM e""")
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    hits, docs = _hits(spark, sf)
    best = search.ranked(hits, docs).join(docs.select("kind", "id", "content"), ["kind", "id"])
    return best.select("kind", "id", search.snippet(F.col("content"), search.saved_forms(spark, _saved(spark, sf), SEARCH)).alias("snippet"))


_LIVE = "id % 7 <> 3 OR id % 14 = 3"


@query(_SEARCH_SQL.replace("FROM msg UNION ALL", f"FROM msg WHERE {_LIVE} UNION ALL").replace("timestamp_unix FROM notes)", f"timestamp_unix FROM notes WHERE {_LIVE})") + "SELECT kind, id, round(score, 6) AS score FROM h ORDER BY round(score, 9) DESC, kind, id LIMIT 50")
def search_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Search over a saved index to which documents were added (some of them twice), from which some were removed, and to which half of those came back."""
    docs, path = _documents(spark, sf), f"{folder(spark)}/index-{uuid.uuid4().hex}"
    search.add_documents(docs.filter("id % 4 <> 0"), path)
    search.add_documents(docs.filter("id % 4 < 2"), path)
    search.remove_documents(docs.filter("id % 7 = 3"), path)
    search.add_documents(docs.filter("id % 14 = 3"), path)
    return search.ranked(search.search(*search.read_index(spark, path, SEARCH), SEARCH), docs).select("kind", "id", F.round("score", 6).alias("score"))


@query("SELECT id, source, title FROM conv WHERE contains(lower(title), 'than') OR id IN (SELECT conversation_id FROM msg WHERE contains(lower(content), 'than'))")
def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    return browse.keyword_search(B.conversations(spark, sf), B.messages(spark, sf), "Than").select("id", "source", "title")


@query("SELECT id, title, tags, count(m) AS message_count FROM conv LEFT JOIN (SELECT conversation_id AS m FROM msg) ON m = id WHERE NOT is_archived AND source = 'claude' GROUP BY ALL ORDER BY id DESC LIMIT 50", tagged=True)
def conversation_list(spark: SparkSession, sf: str) -> DataFrame:
    return browse.conversation_list(B.conversations(spark, sf), B.messages(spark, sf), "claude").select("id", "title", "tags", "message_count")


@query("SELECT id, title, count(m) AS message_count FROM conv LEFT JOIN (SELECT conversation_id AS m FROM msg) ON m = id WHERE is_archived GROUP BY ALL ORDER BY id DESC LIMIT 50")
def archived_list(spark: SparkSession, sf: str) -> DataFrame:
    return browse.conversation_list(B.conversations(spark, sf), B.messages(spark, sf), archived=True).select("id", "title", "message_count")


@query("SELECT conversation_id, title, source, id, role, content, sequence_index FROM msg JOIN (SELECT id AS conversation_id, title, source FROM conv) USING (conversation_id) WHERE sequence_index < 3")
def conversation_page(spark: SparkSession, sf: str) -> DataFrame:
    return browse.transcript_rows(B.conversations(spark, sf), B.messages(spark, sf), 3).select("conversation_id", "title", "source", "id", "role", "content", "sequence_index")


@query("SELECT id, source, count(m) AS message_count FROM conv LEFT JOIN (SELECT conversation_id AS m FROM msg) ON m = id GROUP BY id, source, updated_at_unix, created_at_unix ORDER BY coalesce(updated_at_unix, created_at_unix, 0) DESC, coalesce(created_at_unix, 0) DESC, id DESC LIMIT 20 OFFSET 5")
def tool_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return browse.tool_list(B.conversations(spark, sf), B.messages(spark, sf), limit=20, offset=5).select("id", "source", "message_count")


@query("SELECT id, title FROM conv ORDER BY id DESC LIMIT 20")
def newest_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return browse.newest_conversations(B.conversations(spark, sf)).select("id", "title")


@query("SELECT id, title, count(m) AS message_count FROM conv LEFT JOIN (SELECT conversation_id AS m FROM msg) ON m = id WHERE is_starred GROUP BY ALL ORDER BY id DESC LIMIT 100")
def library_starred(spark: SparkSession, sf: str) -> DataFrame:
    return browse.library(B.conversations(spark, sf), B.messages(spark, sf), B.notes(spark, sf))[1].select("id", "title", "message_count")


@query("SELECT id, tags, length(content) AS size FROM notes WHERE contains(lower(tags), 'src1') ORDER BY timestamp DESC, id DESC LIMIT 100")
def library_notes(spark: SparkSession, sf: str) -> DataFrame:
    return browse.library(B.conversations(spark, sf), B.messages(spark, sf), B.notes(spark, sf), "src1")[0].select("id", "tags", F.length("content").cast("long").alias("size"))


@query("SELECT id, timestamp_unix FROM notes ORDER BY timestamp DESC, id DESC LIMIT 100")
def notes_list(spark: SparkSession, sf: str) -> DataFrame:
    return browse.notes_list(B.notes(spark, sf)).select("id", F.col("timestamp").cast("double").alias("timestamp_unix"))


@query(r"""
WITH l AS (SELECT conversation_id, sequence_index, id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS s FROM msg WHERE role = 'user')
SELECT conversation_id, sequence_index, id, CASE WHEN s = '' THEN '(empty prompt)' WHEN length(s) <= 56 THEN s ELSE rtrim(left(s, 55)) || '…' END AS label FROM l""")
def prompt_toc(spark: SparkSession, sf: str) -> DataFrame:
    return browse.prompt_toc(B.messages(spark, sf))


@query("SELECT 'conversations' AS what, count(*) AS n FROM conv UNION ALL SELECT 'messages', count(*) FROM msg UNION ALL SELECT 'notes', count(*) FROM notes")
def workspace_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.totals(B.conversations(spark, sf), B.messages(spark, sf), B.notes(spark, sf))


@query("WITH r AS (SELECT source AS provider, count(*) AS n FROM conv GROUP BY source UNION ALL SELECT 'native', count(*) FROM notes) SELECT provider, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 1) AS percent FROM r")
def provider_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.provider_breakdown(B.conversations(spark, sf), B.notes(spark, sf))


@query("WITH a AS (SELECT created_at_unix AS s, coalesce(updated_at_unix, created_at_unix) AS e FROM conv UNION ALL SELECT timestamp_unix, timestamp_unix FROM notes) SELECT min(s) AS first_unix, max(e) AS last_unix FROM a")
def date_range(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.date_range(B.conversations(spark, sf), B.notes(spark, sf))


_MONTHS = "WITH a AS (SELECT created_at_unix AS t FROM msg UNION ALL SELECT timestamp_unix FROM notes), m AS (SELECT strftime(make_timestamp(CAST(t AS BIGINT) * 1000000), '%Y-%m') AS month, count(*) AS n FROM a WHERE t IS NOT NULL GROUP BY 1) "


@query(_MONTHS + "SELECT * FROM m")
def monthly_activity(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.monthly_activity(B.messages(spark, sf), B.notes(spark, sf))


@query(_MONTHS + "SELECT * FROM m ORDER BY n DESC, month LIMIT 1")
def most_active_month(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.most_active_month(B.messages(spark, sf), B.notes(spark, sf))


@query("SELECT conv.id, title, source, count(*) AS message_count FROM msg JOIN conv ON conv.id = conversation_id GROUP BY ALL ORDER BY message_count DESC, conv.id LIMIT 10")
def longest_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.longest_conversations(B.conversations(spark, sf), B.messages(spark, sf), 10)


@query("SELECT round((SELECT count(*) FROM msg) / (SELECT count(*) FROM conv), 1) AS average")
def average_messages(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.average_messages(B.conversations(spark, sf), B.messages(spark, sf))


@query("SELECT id, title, created_at_unix FROM conv WHERE created_at_unix IS NOT NULL ORDER BY created_at_unix, id LIMIT 1")
def earliest_conversation(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.earliest_conversation(B.conversations(spark, sf))


@query('''WITH l AS (SELECT conversation_id AS id, max_by(role, sequence_index) AS role FROM msg GROUP BY 1) SELECT 2 AS tier, conv.id, title, coalesce(updated_at_unix, created_at_unix, 0) AS "at" FROM conv JOIN l ON l.id = conv.id AND role = 'user' ORDER BY "at" DESC, conv.id DESC LIMIT 3''')
def unfinished_threads(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.unfinished(B.conversations(spark, sf), B.messages(spark, sf))


@query("""
WITH p(source, display) AS (VALUES ('chatgpt', 'ChatGPT'), ('claude', 'Claude'), ('claude_code', 'Claude Code'), ('gemini', 'Gemini'), ('grok', 'Grok')),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(updated_at_unix, created_at_unix, 0) DESC, coalesce(created_at_unix, 0) DESC, id DESC) AS k, count(*) OVER (PARTITION BY source) AS n FROM conv)
SELECT p.source, display, coalesce(n, 0) AS n, id AS last_id, title AS last_title FROM p LEFT JOIN r ON r.source = p.source AND k = 1""")
def provider_recent(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.provider_recent(B.conversations(spark, sf))


@query(r"""
(SELECT 'conversation' AS kind, id, title, coalesce(updated_at_unix, created_at_unix, 0) AS "at" FROM conv ORDER BY "at" DESC, id DESC LIMIT 6) UNION ALL
(SELECT 'note', id, CASE WHEN length(s) <= 80 THEN s ELSE left(s, 80) || '…' END, timestamp_unix FROM (SELECT id, timestamp_unix, trim(regexp_replace(content, '\s+', ' ', 'g')) AS s FROM notes) ORDER BY timestamp_unix DESC, id DESC LIMIT 5)""")
def workspace_recent(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.workspace(B.conversations(spark, sf), B.messages(spark, sf), B.notes(spark, sf))


@query("SELECT id, title, tags FROM conv", tagged=True)
def tag_autotag(spark: SparkSession, sf: str) -> DataFrame:
    return B.conversations(spark, sf).select("id", "title", "tags")


@query(r"""
WITH p AS (SELECT doc_id, unnest(string_split(t, ',')) AS x, generate_subscripts(string_split(t, ','), 1) AS n FROM (SELECT doc_id, upper(source) || ',  ' || source || ' ,, ' || text AS t FROM documents)),
q AS (SELECT doc_id, left(trim(regexp_replace(lower(x), '\s+', ' ', 'g')), 64) AS x, n FROM p),
d AS (SELECT doc_id, x, min(n) AS n FROM q WHERE x <> '' GROUP BY ALL)
SELECT doc_id, string_agg(x, ', ' ORDER BY n) AS tags FROM d GROUP BY doc_id""")
def tag_normalize(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.upper("source"), F.lit(",  "), "source", F.lit(" ,, "), "text")
    return B.table(spark, sf, "documents").select("doc_id", T.normalize_tags(raw).alias("tags"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', chr(10), 'g'), '\n{2,}', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))
