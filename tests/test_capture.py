import hashlib
import json
import random
import time
import unicodedata

from pyspark.sql import functions as F

from convlake.operators import capture
from convlake.plans.catalog import QUERIES
from convlake.schemas import CAPTURE_EDGES
from convlake.streaming import capture as S

COMMANDS = "capture_id long, command_id long, action string, at_unix double, decided_by string, reason string"


def fold(rows):
    edges = {(a, b): c for a, b, c in CAPTURE_EDGES}
    state, out = {}, {}
    for c, n, action, at, by, why in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2])):
        now = state.get(c, "pending")
        o = out.setdefault(c, [now, 0, 0, None, None, None, None, None])
        to = edges.get((now, action))
        if to is None:
            o[2] += 1
            continue
        state[c] = o[0] = to
        o[1] += 1
        if to == "triaged":
            o[3] = at
        else:
            o[4:6] = at, by
        if to == "rejected":
            o[6] = why
        if to == "quarantined":
            o[7] = why
    return {c: tuple(o) for c, o in out.items()}


def test_replay_against_a_plain_fold(spark):
    rng = random.Random(4)
    actions = ["triage", "quarantine", "triage", "quarantine", "triage", "quarantine", "promote", "reject", "nonsense"]
    rows = [(rng.choice([None, 1, 2, 3, 3, 3]), i, rng.choice(actions[:6] if rng.random() < 0.97 else actions), float(rng.randrange(50)), rng.choice(["a", None]), rng.choice(["why", None])) for i in range(400)]
    got = {r["capture_id"]: tuple(r)[1:] for r in capture.replay(spark.createDataFrame(rows, COMMANDS), cell=3).collect()}
    assert got == fold([r for r in rows if r[0] is not None])
    assert capture.replay(spark.createDataFrame([], COMMANDS)).count() == 0


def test_a_hot_capture_is_folded_in_cells(spark):
    n = 300_000
    action = F.when(F.col("id") % 2 == 0, "triage").otherwise("quarantine")
    commands = spark.range(n, numPartitions=8).select(F.lit(7).cast("long").alias("capture_id"), F.col("id").alias("command_id"), action.alias("action"), F.col("id").cast("double").alias("at_unix"), F.lit("me").alias("decided_by"), F.col("id").cast("string").alias("reason"))
    (r,) = capture.replay(commands).collect()
    # pending, triaged, quarantined, triaged, ...: all are legal
    assert tuple(r) == (7, "quarantined", n, 0, float(n - 2), float(n - 1), "me", None, str(n - 1))


def envelope(i, body, captured, received, adapter="cli", kind="text"):
    return (i, adapter, "1", kind, body, None, float(captured), float(received))


def arrive(spark, home, n, rows):
    spark.createDataFrame(rows, S.ENVELOPE).coalesce(1).write.json(f"{home}/inbox/round={n}")


def test_every_envelope_has_one_outcome(spark, tmp_path):
    home, day = str(tmp_path), 86_400
    known = spark.createDataFrame([("none", 1, "raw")], "content_hash string, id long, raw_payload_hash string")
    old = capture.hashed(spark.createDataFrame([envelope(900, "in the ledger", 60, 0)], S.ENVELOPE)).select("content_hash", "id", "raw_payload_hash")
    rounds = [
        [envelope(1, "a", 10 * day, 5), envelope(2, "a ", 10 * day + 30, 4), envelope(3, "b", 10 * day, 6), envelope(4, "x", 10 * day, 1, adapter="fax"), envelope(5, None, 10 * day, 1)],
        [envelope(6, "a", 10 * day, 7), envelope(7, "never seen", 2 * day, 8), envelope(8, "in the ledger", 60, 9), envelope(9, "c", 17 * day, 9)],
        [envelope(10, "a", 10 * day, 10), envelope(11, "never seen", 2 * day, 11), envelope(12, "d", 17 * day, 12)],
    ]
    for n, rows in enumerate(rounds):
        arrive(spark, home, n, rows)
        time.sleep(0.01)
        S.filed(S.judged(S.inbox(spark, f"{home}/inbox/*"), known.union(old)), f"{home}/out", f"{home}/state")
    read = lambda: {r["id"]: (r["outcome"], r["capture_id"], r["problem"]) for r in spark.read.schema(S.JUDGED).parquet(f"{home}/out").collect()}
    want = {1: ("existing", 2, None), 2: ("new", 2, None), 3: ("new", 3, None), 4: ("rejected", None, "unknown_adapter"), 5: ("rejected", None, "missing_body")}
    want |= {6: ("existing", 2, None), 7: ("late", None, None), 8: ("existing", 900, None), 9: ("new", 9, None)}
    # a week after the first "a"; behind the watermark, a known hash is still answered
    want |= {10: ("existing", 2, None), 11: ("late", None, None), 12: ("new", 12, None)}
    assert read() == want
    assert spark.read.parquet(f"{home}/out").count() == sum(map(len, rounds))
    S.forget_last_batch(spark, f"{home}/state")
    S.filed(S.judged(S.inbox(spark, f"{home}/inbox/*"), known.union(old)), f"{home}/out", f"{home}/state")
    assert read() == want and spark.read.parquet(f"{home}/out").count() == sum(map(len, rounds))


def test_promotions_are_written_once(spark, tmp_path):
    home = str(tmp_path)
    captures = spark.createDataFrame([(1, "one", None), (2, "two", "t"), (3, "three", "t")], "id long, body_text string, tags string")
    rows = [(1, 1, "promote", "me", None, 5.0), (2, 2, "reject", "me", "no", 5.0), (3, 3, "triage", None, None, 5.0)], [(1, 4, "promote", "me", None, 6.0), (3, 5, "promote", "you", None, 7.0), (2, 6, "promote", "me", None, 7.0)]
    for n, part in enumerate(rows):
        spark.createDataFrame(part, S.COMMAND).coalesce(1).write.json(f"{home}/commands/part={n}")
        for again in (False, True):
            if again:
                S.forget_last_batch(spark, f"{home}/state")
            S.promoted(S.life_cycle(spark.readStream.schema(S.COMMAND).json(f"{home}/commands/*")), captures, home, f"{home}/state")
        notes = sorted((r["captured_via_id"], r["content"], r["tags"]) for r in spark.read.parquet(f"{home}/notes").collect())
        links = sorted((r["capture_id"], r["decided_by"]) for r in spark.read.parquet(f"{home}/links").collect())
        assert notes == [(1, "one", None), (3, "three", "t")][: n + 1] and links == [(1, "me"), (3, "you")][: n + 1]


def test_streams_agree_with_batch(spark, sf):
    stream = {tuple(r) for r in QUERIES["stream_capture_lifecycle"](spark, sf).collect()}
    batch = {tuple(r) for r in QUERIES["capture_lifecycle"](spark, sf).select("capture_id", "status", "n_applied", "n_rejected").collect()}
    assert stream == batch
    closed = {(r["user_id"], r["n"]) for r in QUERIES["stream_activity_sessions"](spark, sf).select("user_id", "n").collect()}
    assert closed and closed <= {(r["user_id"], r["n"]) for r in QUERIES["activity_sessions"](spark, sf).collect()}


def test_hashes_equal_those_of_a_canonical_writer(spark):
    bodies = ["plain", 'q " \\ / \n\r\t\b\f', "".join(map(chr, range(32))) + "\x7f", "é 😀 \\u001f", "", "é \x1f\x85　"]
    times = [0.0, 61.0, 1704067200.5, 1704067200.123456, 1e15, 119.25]
    rows = [(i, "cli", "1", "text", b, [None, "u"][i % 2], t, "h" if i % 2 else None, [None, '{"b": 1, "a": {"z": "é", "c": [true, null]}}'][i % 2]) for i, (b, t) in enumerate(zip(bodies, times, strict=True))]
    df = spark.createDataFrame(rows, "id long, adapter_id string, adapter_version string, payload_kind string, body_text string, source_url string, captured_at_unix double, body_html string, metadata string")
    dump = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    for r, (i, a, v, k, b, u, t, h, m) in zip(capture.hashed(df).orderBy("id").collect(), rows, strict=True):
        whole = {"adapter_id": a, "adapter_version": v, "payload_kind": k, "body_text": b, "body_html": h, "source_url": u, "source_title": None, "metadata": json.loads(m) if m else None, "hints": None, "captured_at_unix": t}
        assert r["raw_payload_hash"] == dump(whole), i
        assert r["content_hash"] == dump([a, k, unicodedata.normalize("NFC", b).rstrip(), u or "", str(int(t) // 60 * 60)]), i
