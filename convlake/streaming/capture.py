"""Streaming forms of the capture inbox and of activity sessions.

The inbox is a folder into which whole JSON files are moved; the file source
needs no more.  Watermarks and the folder for late rows are ours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convlake.operators import capture
from convlake.schemas import CAPTURE_EDGES

ENVELOPE = "id long, adapter_id string, adapter_version string, payload_kind string, body_text string, source_url string, captured_at_unix double, received_at_unix double"
JUDGED = "id long, outcome string, problem string, capture_id long, content_hash string, raw_payload_hash string, adapter_id string, adapter_version string, payload_kind string, body_text string, source_url string, captured_at_unix double, received_at_unix double"
COMMAND = "capture_id long, command_id long, action string, decided_by string, reason string, at_unix double"
STEP = "capture_id long, command_id long, action string, from_status string, to_status string, legal boolean, at_unix double, decided_by string"


def inbox(spark: SparkSession, path: str, per_trigger: int | None = 1000) -> DataFrame:
    """Envelopes from JSON files that are moved into a folder; at most ``per_trigger`` files make a micro-batch."""
    files = spark.readStream.schema(ENVELOPE)
    return (files.option("maxFilesPerTrigger", per_trigger) if per_trigger else files).json(path)


def deduplicated(envelopes: DataFrame, late: str = "1 day") -> DataFrame:
    """Valid envelopes, one for each content hash within the watermark; state is dropped behind it."""
    valid = capture.contract_problems(envelopes, capture.adapters(envelopes.sparkSession)).filter("problem is null").drop("problem")
    timed = valid.withColumn("captured_at", F.timestamp_seconds("captured_at_unix")).withWatermark("captured_at", late)
    url = F.coalesce("source_url", F.lit(""))
    body = capture._nfc(F.col("body_text"))
    keyed = timed.withColumn("content_hash", capture.content_hash(F.col("adapter_id"), F.col("payload_kind"), body, url, F.col("captured_at_unix")))
    return keyed.dropDuplicatesWithinWatermark(["content_hash"])


def judged(envelopes: DataFrame, known: DataFrame | None = None, late: str = "1 day", digits: int = 3) -> DataFrame:
    """Every envelope with its ``outcome``, ``problem``, ``capture_id`` and both hashes.

    ``rejected``: it breaks the contract (problem names the rule).  ``existing``: a
    capture with its content hash is known, from ``known`` (content_hash, id,
    raw_payload_hash) or from this stream, however long ago; capture_id and
    raw_payload_hash are the known one's.  ``late``: it is behind the watermark on
    captured_at and its hash is unknown: for a dead-letter sink.  ``new``: a capture.
    So each row has one outcome, and none is lost.

    State is kept for each content hash and never dropped; use a state store on disk.
    Hashes with the same first ``digits`` share a row of state, at 3 in 4,096 rows.
    The rows of a hash in one micro-batch are judged in order of time of receipt and id.
    The operator drops no late rows, as it has no timeout.
    """
    rows = capture.hashed(capture.contract_problems(envelopes, capture.adapters(envelopes.sparkSession)))
    rows = rows.withColumn("content_hash", F.when(F.col("problem").isNull(), F.col("content_hash")))
    if known is None:
        rows = rows.withColumns({"known_id": F.lit(None).cast("long"), "known_raw": F.lit(None).cast("string")})
    else:
        first = known.groupBy("content_hash").agg(F.min(F.struct("id", "raw_payload_hash")).alias("k"))
        first = first.select("content_hash", F.col("k.id").alias("known_id"), F.col("k.raw_payload_hash").alias("known_raw"))
        rows = rows.join(first, "content_hash", "left")
    rows = rows.withColumn("captured_at", F.timestamp_seconds("captured_at_unix")).withWatermark("captured_at", late)
    # a Python group costs much more than its rows: hashes share one by their first digits
    spread = F.coalesce("content_hash", F.sha2(F.coalesce(F.col("id").cast("string"), F.lit("")), 256))
    rows = rows.withColumn("key", F.substring(spread, 1, digits))
    names = [c.split()[0] for c in JUDGED.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        hashes, ids, raws = state.get if state.exists else ((), (), ())
        seen = dict(zip(hashes, zip(ids, raws, strict=True), strict=True))
        n_seen, waiting = len(seen), []
        for b in batches:
            answered = b["problem"].notna() | b["content_hash"].isin(seen.keys())
            if answered.any():
                yield outcomes(b[answered], seen, mark)
            waiting.append(b[~answered])
        b = pd.concat(waiting)
        if len(b):
            yield outcomes(b.sort_values(["received_at_unix", "id"]), seen, mark)
        if len(seen) > n_seen:
            state.update((list(seen), [k for k, _ in seen.values()], [r for _, r in seen.values()]))

    def outcomes(b: pd.DataFrame, seen: dict, mark: int) -> pd.DataFrame:
        out = []
        for problem, h, known_raw, known_id, at, own, raw in zip(*(b[c] for c in ("problem", "content_hash", "known_raw", "known_id", "captured_at_unix", "id", "raw_payload_hash")), strict=True):
            if isinstance(problem, str):
                out.append(("rejected", None, raw))
                continue
            if h not in seen and isinstance(known_raw, str):
                seen[h] = (int(known_id), known_raw)
            if h in seen:
                out.append(("existing", *seen[h]))
            elif at * 1000 < mark:
                out.append(("late", None, raw))
            else:
                seen[h] = (int(own), raw)
                out.append(("new", int(own), raw))
        b = b.copy()
        b["outcome"], b["capture_id"], b["raw_payload_hash"] = zip(*out, strict=True)
        b["capture_id"] = b["capture_id"].astype("Int64")
        return b[names]

    return rows.groupBy("key").applyInPandasWithState(run, JUDGED, "hashes array<string>, capture_ids array<long>, raw_hashes array<string>", "append", GroupStateTimeout.NoTimeout)


def filed(judgements: DataFrame, home: str, checkpoint: str) -> None:
    """Write all that is there now to ``home``, by micro-batch and outcome.

    Each batch writes its own folder, in place of what an earlier run of the same
    batch left there, so that a batch that is run again adds nothing.
    """
    write_batches(judgements, lambda rows, n: rows.write.mode("overwrite").partitionBy("outcome").parquet(f"{home}/batch={n}"), checkpoint)


def promoted(steps: DataFrame, captures: DataFrame, home: str, checkpoint: str) -> None:
    """A note and a link back for each legal promotion in a stream of :func:`life_cycle` steps, written once for each batch.

    ``captures``: id, body_text, tags.  A note's id is a hash of its capture's id, so
    that a batch that is run again writes the same rows to the same folders.
    """

    def write(rows: DataFrame, n: int) -> None:
        done = rows.filter("legal and to_status = 'promoted'").select("capture_id", "at_unix", "decided_by")
        found = done.join(captures, done["capture_id"] == captures["id"]).withColumn("note_id", capture.note_id(F.col("capture_id"))).persist()
        note = found.select(F.col("note_id").alias("id"), F.timestamp_seconds("at_unix").alias("timestamp"), F.lit("user").alias("role"), F.col("body_text").alias("content"), "tags", F.lit(False).alias("is_starred"), F.col("capture_id").alias("captured_via_id"))
        note.write.mode("overwrite").parquet(f"{home}/notes/batch={n}")
        link = found.select("capture_id", F.lit("memory_entry").alias("promoted_to_kind"), F.col("note_id").alias("promoted_to_id"), F.col("at_unix").alias("decided_at_unix"), "decided_by")
        link.write.mode("overwrite").parquet(f"{home}/links/batch={n}")
        found.unpersist()

    write_batches(steps, write, checkpoint)


def life_cycle(commands: DataFrame) -> DataFrame:
    """Each command with the state before and after; state is kept by capture, illegal commands change nothing.

    Commands of a micro-batch are applied in order of time and command_id, those of
    a later one after them, whatever their time: in a stream the order is that of
    arrival, as for a service that is called.  :func:`capture.replay` sorts them all.
    """
    edges = {(a, b): c for a, b, c in CAPTURE_EDGES}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "pending"
        rows = []
        for c in pd.concat(list(batches)).sort_values(["at_unix", "command_id"]).itertuples():
            to = edges.get((now, c.action))
            rows.append((key[0], c.command_id, c.action, now, to or now, to is not None, c.at_unix, c.decided_by))
            now = to or now
        state.update((now,))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in STEP.split(", ")])

    return commands.groupBy("capture_id").applyInPandasWithState(run, STEP, "status string", "append", GroupStateTimeout.NoTimeout)


def activity_sessions(events: DataFrame, account: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """S25 over a stream: one row for each closed session of an account; a gap of more than ``gap`` ends one."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    w = F.session_window("__at", gap)
    out = timed.groupBy(account, w).agg(F.count("*").alias("n"), F.min("__at").alias("first"), F.max("__at").alias("last"))
    return out.select(account, "n", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


def write_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give each micro-batch of all that is there now to ``write``, with its number."""
    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def forget_last_batch(spark: SparkSession, checkpoint: str) -> int:
    """Take back the mark that the last micro-batch is done, as a crash before it would; the next run repeats that batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    last = max(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit())
    for name in (str(last), f".{last}.crc"):
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/{name}"), False)
    return last


def run_now(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now, and read its result."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
