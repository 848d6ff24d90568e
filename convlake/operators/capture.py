"""The capture inbox: contract, hashes, dedup and life cycle, in batch form."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from convlake.operators.ranking import positions
from convlake.schemas import CAPTURE_EDGES
from convlake.shared import materialize

#: Adapters: version, allowed payload kinds, largest UTF-8 body.
ADAPTERS = (("browser", "1", ("selection",), 64 * 1024), ("cli", "1", ("text", "markdown", "paste"), 256 * 1024), ("mail", "1", ("message",), 64 * 1024))


def adapters(spark: SparkSession, rows: Iterable[tuple] = ADAPTERS) -> DataFrame:
    """The adapter dimension."""
    return spark.createDataFrame([(a, v, list(k), n) for a, v, k, n in rows], "adapter_id string, latest_version string, kinds array<string>, body_limit int")


def contract_problems(envelopes: DataFrame, dimension: DataFrame) -> DataFrame:
    """Envelopes with ``problem``, the first rule that each breaks, or null."""
    rows = envelopes.join(F.broadcast(dimension), "adapter_id", "left")  # one row for each adapter
    problem = (
        F.when(F.coalesce(F.col("adapter_id"), F.lit("")) == "", "missing_adapter")
        .when(F.col("body_text").isNull(), "missing_body")
        .when(F.col("captured_at_unix").isNull() | (F.col("captured_at_unix") < 0), "invalid_time")
        .when(F.col("body_limit").isNull(), "unknown_adapter")
        .when(~F.coalesce(F.array_contains("kinds", F.col("payload_kind")), F.lit(False)), "kind_not_allowed")
        .when(F.octet_length("body_text") > F.col("body_limit"), "body_too_large")
    )
    return rows.withColumn("problem", problem).drop("latest_version", "kinds", "body_limit")


def read_bodies(bodies: DataFrame, dimension: DataFrame) -> DataFrame:
    """R2: request bodies (id, body) with the envelope's fields and ``error``, the first check that fails, or null.

    In order: the body is a JSON object, its adapter is known, its fields have
    their types, the adapter takes the payload kind, the text is not too large.
    """
    # The codes of the errors.
    v = F.try_parse_json("body")
    rows = bodies.withColumn("v", v).withColumn("adapter_id", F.try_variant_get("v", "$.adapter_id", "string"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
    of = lambda name, *kinds: F.coalesce(kind(name).rlike(f"^(?:{'|'.join(kinds)})"), F.lit(False))
    absent = lambda name: F.coalesce(kind(name), F.lit("VOID")) == "VOID"
    typed = [of(name, "STRING") for name in ("adapter_id", "adapter_version", "payload_kind", "body_text")] + [of("captured_at_unix", "BIGINT", "DECIMAL", "DOUBLE")]
    typed += [absent(name) | of(name, "STRING") for name in ("body_html", "source_url", "source_title")] + [absent(name) | of(name, "OBJECT") for name in ("metadata", "hints")]
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    known = rows.join(F.broadcast(dimension), "adapter_id", "left")  # one row for each adapter
    error = (
        F.when(~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "invalid_json")
        .when(F.col("body_limit").isNull() | ~of("adapter_id", "STRING"), "unknown_adapter")
        .when(~reduce(lambda a, b: a & b, typed), "invalid_envelope")
        .when(~F.coalesce(F.array_contains("kinds", text("payload_kind")), F.lit(False)), "invalid_payload_kind")
        .when(F.octet_length(text("body_text")) > F.col("body_limit"), "body_too_large")
    )
    fields = [text(c).alias(c) for c in ("adapter_version", "payload_kind", "body_text", "source_url")]
    return known.select("id", "adapter_id", *fields, F.try_variant_get("v", "$.captured_at_unix", "double").alias("captured_at_unix"), error.alias("error"))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(envelopes: DataFrame, column: str = "body_text") -> DataFrame:
    """the column in NFC; only the texts with combining characters are sent to Python."""
    marked = F.coalesce(F.col(column).rlike(r"[\p{M}ᄀ-ᇿ゙゚̀-̓ΩKÅ]"), F.lit(False))
    # one evaluation for every row, with null where there is nothing to do
    normal = _nfc(F.when(marked, F.col(column)))
    return envelopes.withColumn(column, F.coalesce(normal, F.col(column)))


def json_string(c: Column) -> Column:
    """A JSON string as a canonical writer makes it: non-ASCII kept, control characters as short escapes or four small hex digits."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for sign, short in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(sign), F.lit(short))
    rare = out
    for i in range(32):
        if chr(i) not in "\n\r\t\b\f":
            rare = F.replace(rare, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(out), F.lit('"'))


def json_number(c: Column) -> Column:
    """A double as its shortest decimal with a point, as it is written between 0.0001 and 1e16."""
    exact = F.regexp_replace(c.cast("string").cast("decimal(38,20)").cast("string"), "0+$", "")
    return F.concat(exact, F.when(exact.endswith("."), "0").otherwise(""))


def content_hash(adapter: Column, kind: Column, body: Column, url: Column, captured: Column) -> Column:
    """sha256 over the JSON array of adapter, kind, body without blanks at its end, url (null as empty) and the minute."""
    minute = (F.floor(captured / 60) * 60).cast("long").cast("string")
    trimmed = F.regexp_replace(body, r"[\s\u001c-\u001f\u0085   -     　]+$", "")
    parts = [json_string(x) for x in (adapter, kind, trimmed, F.coalesce(url, F.lit("")), minute)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


#: The fields of an envelope, in the order of canonical JSON.
FIELDS = ("adapter_id", "adapter_version", "body_html", "body_text", "captured_at_unix", "hints", "metadata", "payload_kind", "source_title", "source_url")


def canonical_json(envelopes: DataFrame) -> Column:
    """an envelope as one object: keys sorted, compact, absent fields null; hints and metadata are JSON objects with sorted keys."""
    parts = []
    for name in FIELDS:
        value = F.lit(None).cast("string")
        if name in envelopes.columns:
            c = F.col(name)
            value = json_number(c) if name == "captured_at_unix" else F.to_json(F.try_parse_json(c)) if name in ("hints", "metadata") else json_string(c)
        parts.append(F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def hashed(envelopes: DataFrame) -> DataFrame:
    """Envelopes with content_hash and raw_payload_hash."""
    rows = nfc(envelopes.withColumn("raw_payload_hash", F.sha2(canonical_json(envelopes), 256)))
    return rows.withColumn("content_hash", content_hash(*(F.col(c) for c in ("adapter_id", "payload_kind", "body_text", "source_url", "captured_at_unix"))))


def first_of_each(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One capture for each content hash, the first received; hashes of ``known`` (content_hash) are left out.

    The first is found by a pre-aggregated minimum of time and id, which takes its
    row along: rows are hashed once, and copies do not meet in one place.
    """
    order = F.struct("received_at_unix", "id")
    kept = rows.groupBy("content_hash").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return kept if known is None else kept.join(known.select("content_hash").distinct(), "content_hash", "left_anti")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CAPTURE_EDGES), "status string, action string, next_status string")


def legal_step(status: Column, action: Column) -> Column:
    """The next state of a legal step, null for others."""
    table = F.create_map(*(F.lit(x) for a, b, c in CAPTURE_EDGES for x in (f"{a}>{b}", c)))
    return F.try_element_at(table, F.concat(status, F.lit(">"), action))


STATES = ("pending", "triaged", "promoted", "rejected", "quarantined")
#: What a run of commands makes of each state: the end state, the legal ones, and the last values that legal ones wrote.
_EFFECT = "struct<status: string, applied: long, triaged: double, decided: struct<at: double, by: string>, rejected: struct<reason: string>, quarantined: struct<reason: string>>"
_MAP = f"array<{_EFFECT}>"


def _effect(status: Column, applied: Column, *written: Column) -> Column:
    names = ("triaged", "decided", "rejected", "quarantined")
    return F.struct(status.alias("status"), applied.cast("long").alias("applied"), *(w.alias(n) for w, n in zip(written, names, strict=True))).cast(_EFFECT)


def state_map(action: Column, at: Column, by: Column, reason: Column) -> Column:
    """A command as a map of the five states, in the order of STATES.

    A legal triage writes its time; the other legal commands write who decided and
    when, and a rejection or quarantine its reason.  An illegal one writes nothing.
    """
    none = F.lit(None)
    out = []
    for state in STATES:
        to = legal_step(F.lit(state), action)
        decided = F.when(to.isNotNull() & (to != "triaged"), F.struct(at.alias("at"), by.alias("by")))
        why = [F.when(to == end, F.struct(reason.alias("reason"))) for end in ("rejected", "quarantined")]
        out.append(_effect(F.coalesce(to, F.lit(state)), to.isNotNull(), F.when(to == "triaged", at), F.coalesce(decided, none), *why))
    return F.array(*out)


def composed(maps: Column) -> Column:
    """The map of a list of maps, one after the other."""
    index = F.create_map(*(F.lit(x) for i, s in enumerate(STATES) for x in (s, i)))
    none = [F.lit(None)] * 4
    start = F.array(*(_effect(F.lit(s), F.lit(0), *none) for s in STATES)).cast(_MAP)

    def then(done: Column, m: Column) -> Column:
        after = F.element_at(m, F.element_at(index, done["status"]) + 1)
        return _effect(after["status"], done["applied"] + after["applied"], *(F.coalesce(after[c], done[c]) for c in ("triaged", "decided", "rejected", "quarantined")))

    return F.aggregate(maps, start, lambda done, m: F.transform(done, lambda e: then(e, m)).cast(_MAP))


def replay(commands: DataFrame, cell: int = 256) -> DataFrame:
    """Every capture after all its commands, in order of time and command_id; all begin as pending.

    capture_id, status, n_applied, n_rejected (illegal commands), triaged_at_unix,
    decided_at_unix, decided_by, reject_reason, quarantine_reason.  Commands:
    capture_id, command_id, action, at_unix, decided_by, reason; without a capture_id
    they are ignored.

    Maps compose whatever the grouping, so that a capture's commands are folded in
    cells of ``cell`` places, the cells' maps in cells again, until one is left: no
    task sees a hot capture whole.
    """
    columns = ["capture_id", "at_unix", "command_id", "action", "decided_by", "reason"]
    placed = positions(commands.filter("capture_id is not null").select(*columns), ["capture_id"], ["at_unix", "command_id", "action"])
    one = state_map(F.col("action"), F.col("at_unix"), F.col("decided_by"), F.col("reason"))
    maps = placed.select("capture_id", "position", one.alias("map"), F.lit(1).cast("long").alias("n"))
    while True:
        item = F.struct("position", "map")
        cells = maps.groupBy("capture_id", F.floor(F.col("position") / cell).alias("position")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("n").alias("n"))
        maps = materialize(cells.select("capture_id", "position", composed(F.col("items.map")).alias("map"), "n"), "state-maps")
        if not maps.agg(F.max("position")).first()[0]:
            break
    e = F.col("map")[0]
    return maps.select("capture_id", e["status"].alias("status"), e["applied"].alias("n_applied"), (F.col("n") - e["applied"]).alias("n_rejected"), e["triaged"].alias("triaged_at_unix"), e["decided"]["at"].alias("decided_at_unix"), e["decided"]["by"].alias("decided_by"), e["rejected"]["reason"].alias("reject_reason"), e["quarantined"]["reason"].alias("quarantine_reason"))


def note_id(capture_id: Column) -> Column:
    """The id of the note that a capture becomes: the same whenever it is promoted."""
    return F.xxhash64(F.lit("note of a capture"), capture_id)


def promoted_notes(captures: DataFrame, states: DataFrame) -> DataFrame:
    """A note for each promoted capture, with a link back."""
    done = states.filter("status = 'promoted'").select(F.col("capture_id").alias("id"), "decided_at_unix")
    return captures.join(done, "id").select(F.timestamp_seconds("decided_at_unix").alias("timestamp"), F.lit("user").alias("role"), F.col("body_text").alias("content"), F.lit("captured").alias("tags"), F.lit(False).alias("is_starred"), F.col("id").alias("captured_via_id"))


def with_status(captures: DataFrame, states: DataFrame) -> DataFrame:
    """Captures with their present status; those without commands are pending."""
    return captures.join(states.select(F.col("capture_id").alias("id"), "status"), "id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
