"""Queries that run the streaming jobs over files made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake import testbed as B
from convlake.operators import capture
from convlake.plans.records import _HASH, _LIFE_SQL, _commands
from convlake.plans.registry import query
from convlake.shared import folder, materialize
from convlake.streaming import capture as S


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over the tasks of an exchange, so that the files and their writers follow the cluster, and not a fixed four."""
    return rows.repartition(max(4, rows.sparkSession.sparkContext.defaultParallelism))


def _home(spark: SparkSession) -> str:
    return f"{folder(spark)}/stream-{uuid.uuid4().hex}"


#: Blanks at the end of a body, which its hash leaves out.
_BLANKS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"


@query(f"""SELECT count(DISTINCT (adapter_id, payload_kind, regexp_replace(nfc_normalize(body_text), '{_BLANKS}', ''), coalesce(source_url, ''), floor(captured_at_unix / 60))) AS n FROM captures
WHERE body_text IS NOT NULL AND strlen(body_text) <= CASE adapter_id WHEN 'cli' THEN 262144 ELSE 65536 END""")
def stream_capture_dedup(spark: SparkSession, sf: str) -> DataFrame:
    home = _home(spark)
    _spread(B.captures(spark, sf)).write.json(f"{home}/inbox")
    kept = S.deduplicated(S.inbox(spark, f"{home}/inbox")).select("id", "content_hash")
    return S.run_now(kept, f"{home}/out", f"{home}/state").agg(F.count("*").alias("n"))


@query(_LIFE_SQL + "SELECT capture_id, status, n_applied, n - n_applied AS n_rejected FROM life")
def stream_capture_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    home = _home(spark)
    _spread(_commands(spark, sf)).write.json(f"{home}/commands")
    steps = S.life_cycle(spark.readStream.schema(S.COMMAND).json(f"{home}/commands"))
    return S.run_now(steps, f"{home}/out", f"{home}/state").groupBy("capture_id").agg(F.max_by("to_status", F.struct("at_unix", "command_id")).alias("status"), F.count_if("legal").alias("n_applied"), F.count_if(~F.col("legal")).alias("n_rejected"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 1800000000 THEN 1 ELSE 0 END AS o FROM e),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, count(*) AS n, min(t) AS first_us, max(t) AS last_us FROM s GROUP BY user_id, session HAVING max(t) + 1800000000 <= (SELECT max(t) // 1000 * 1000 - 3600000000 FROM e)""")
def stream_activity_sessions(spark: SparkSession, sf: str) -> DataFrame:
    home = _home(spark)
    events = B.table(spark, sf, "events").select("user_id", "ts")
    events.repartition(2).write.parquet(f"{home}/events")
    closed = S.activity_sessions(spark.readStream.schema(events.schema).parquet(f"{home}/events"), "user_id", "ts")
    return S.run_now(closed, f"{home}/out", f"{home}/state")


#: How the envelopes reach the inbox: four times files, after whose end the query runs to its end.
_ROUNDS, _LATE_S = 4, 1800


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    e = B.captures(spark, sf)
    return e.withColumns({"round": F.col("id") * 7 % _ROUNDS, "adapter_id": F.when(F.col("id") % 11 == 0, "other").otherwise(F.col("adapter_id")), "body_text": F.when(F.col("id") % 17 != 0, F.col("body_text"))})


@query(f"""
WITH a AS (SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN 'other' ELSE adapter_id END AS adapter_id, CASE WHEN id % 17 <> 0 THEN body_text END AS body_text), id * 7 % {_ROUNDS} AS round FROM captures),
h AS (SELECT *, CASE WHEN body_text IS NULL THEN 'missing_body' WHEN adapter_id = 'other' THEN 'unknown_adapter' WHEN strlen(body_text) > CASE adapter_id WHEN 'cli' THEN 262144 ELSE 65536 END THEN 'body_too_large' END AS problem, {_HASH} AS hash FROM a),
k AS (SELECT hash, min(id) AS known FROM h WHERE problem IS NULL AND id % 10 = 9 GROUP BY hash),
w AS (SELECT n, coalesce(max(captured_at_unix) FILTER (WHERE round < n) - {_LATE_S}, 0) AS mark FROM a, range({_ROUNDS}) t(n) GROUP BY n),
j AS (SELECT h.*, known, captured_at_unix < mark AS late FROM h JOIN w ON n = round LEFT JOIN k ON k.hash = h.hash AND problem IS NULL),
f AS (SELECT hash, min((round, received_at_unix, id)) AS first FROM j WHERE problem IS NULL AND known IS NULL AND NOT late GROUP BY hash)
SELECT id, problem, CASE WHEN problem IS NOT NULL THEN 'rejected' WHEN known IS NOT NULL THEN 'existing' WHEN first = (round, received_at_unix, id) THEN 'new' WHEN first < (round, received_at_unix, id) THEN 'existing' ELSE 'late' END AS outcome,
  CASE WHEN problem IS NULL THEN CASE WHEN known IS NOT NULL THEN known WHEN first <= (round, received_at_unix, id) THEN first[3] END END AS capture_id,
  CASE WHEN problem IS NULL THEN j.hash END AS content_hash
FROM j LEFT JOIN f ON f.hash = j.hash AND problem IS NULL""")
def stream_capture_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    home = _home(spark)
    ledger = capture.hashed(capture.contract_problems(_arrivals(spark, sf), capture.adapters(spark)).filter("problem is null and id % 10 = 9"))
    known = materialize(ledger.select("content_hash", "id", "raw_payload_hash"), "known-captures")
    for n in range(_ROUNDS):
        _spread(_arrivals(spark, sf).filter(F.col("round") == n).drop("round")).write.json(f"{home}/inbox/round={n}")
        S.filed(S.judged(S.inbox(spark, f"{home}/inbox/*", None), known, f"{_LATE_S} seconds"), f"{home}/out", f"{home}/state")
    S.forget_last_batch(spark, f"{home}/state")
    S.filed(S.judged(S.inbox(spark, f"{home}/inbox/*", None), known, f"{_LATE_S} seconds"), f"{home}/out", f"{home}/state")
    return spark.read.schema(S.JUDGED).parquet(f"{home}/out").select("id", "problem", "outcome", "capture_id", "content_hash")


@query(_LIFE_SQL + "SELECT id AS captured_via_id, 'user' AS role, body_text AS content, adapter_id AS tags, decided_at_unix, decided_by, 'memory_entry' AS promoted_to_kind, true AS linked FROM captures JOIN life ON capture_id = id WHERE status = 'promoted'")
def stream_promoted_notes(spark: SparkSession, sf: str) -> DataFrame:
    home = _home(spark)
    captures = B.captures(spark, sf).select("id", "body_text", F.col("adapter_id").alias("tags"))
    _spread(_commands(spark, sf)).write.json(f"{home}/commands")
    steps = S.life_cycle(spark.readStream.schema(S.COMMAND).json(f"{home}/commands"))
    S.promoted(steps, captures, home, f"{home}/state")
    S.forget_last_batch(spark, f"{home}/state")
    S.promoted(steps, captures, home, f"{home}/state")
    notes, links = (spark.read.parquet(f"{home}/{t}") for t in ("notes", "links"))
    both = notes.join(links, F.col("captured_via_id") == F.col("capture_id"))
    return both.select("captured_via_id", "role", "content", "tags", "decided_at_unix", "decided_by", "promoted_to_kind", (F.col("promoted_to_id") == F.col("id")).alias("linked"))
