"""Export packages: records, provenance, manifest, Markdown, and the rules that a package must keep."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.schemas import IMPORTED_LANE, NATIVE, NATIVE_LANE
from convlake.shared import materialize, release
from convlake.sources.files import listing, texts, write_files

VERSION = "1"


def _meta(**columns: Column) -> Column:
    return F.create_map(*(x for k, v in columns.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))))


def conversation_records(conversations: DataFrame) -> DataFrame:
    """X1."""
    return conversations.select(T.stable_id("imported_conversation", F.col("id")).alias("stable_id"), F.lit(IMPORTED_LANE).alias("source_lane"), F.col("source").alias("source_provider"), F.col("source_conversation_id").alias("source_record_id"), "title", "created_at_unix", "updated_at_unix", T.iso(F.col("created_at_unix")).alias("created_at_iso"), T.iso(F.col("updated_at_unix")).alias("updated_at_iso"), _meta(source=F.col("source"), source_conversation_id=F.col("source_conversation_id")).alias("source_metadata"))


def message_records(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """X1."""
    rows = messages.join(conversations.select(F.col("id").alias("conversation_id"), "source", "source_conversation_id"), "conversation_id")
    return rows.select(T.stable_id("imported_message", F.col("id")).alias("stable_id"), T.stable_id("imported_conversation", F.col("conversation_id")).alias("conversation_stable_id"), F.lit(IMPORTED_LANE).alias("source_lane"), F.col("source").alias("source_provider"), F.col("source_message_id").alias("source_record_id"), "role", "content", "sequence_index", "created_at_unix", T.iso(F.col("created_at_unix")).alias("created_at_iso"), _meta(conversation_source_id=F.col("source_conversation_id"), source_message_id=F.col("source_message_id")).alias("source_metadata"))


def note_records(notes: DataFrame) -> DataFrame:
    """X1."""
    at = F.col("timestamp").cast("double")
    return notes.select(T.stable_id("memory", F.col("id")).alias("stable_id"), F.lit(NATIVE_LANE).alias("source_lane"), F.lit(NATIVE).alias("source_provider"), F.col("id").cast("string").alias("source_record_id"), at.alias("timestamp_unix"), T.iso(at).alias("timestamp_iso"), "role", "content", "tags", _meta(role=F.col("role"), tags=F.col("tags")).alias("source_metadata"))


def provenance(conversations: DataFrame, messages: DataFrame, notes: DataFrame, markdown: bool = True) -> DataFrame:
    """A canonical unit for every record and a derived one for every Markdown file, with their paths."""
    c = conversation_records(conversations).withColumn("at", F.coalesce(F.nullif(F.col("updated_at_unix"), F.lit(0.0)), F.col("created_at_unix")))
    m, n = message_records(conversations, messages).withColumn("at", F.col("created_at_unix")), note_records(notes).withColumn("at", F.col("timestamp_unix"))

    def unit(kind: str, df: DataFrame, key: Column, meta: Column, path: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("unit_type"), key.alias("stable_id"), "source_lane", "source_provider", "source_record_id", F.col("at").alias("timestamp_unix"), meta.alias("source_metadata"), path.alias("path"))

    own = lambda name: F.concat(F.lit("providers/"), "source_provider", F.lit(f"/{name}.jsonl"))
    sid, meta = F.col("stable_id"), F.col("source_metadata")
    units = [unit("canonical", c, sid, meta, own("conversations")), unit("canonical", m, sid, meta, own("messages")), unit("canonical", n, sid, meta, F.lit("native/memory_entries.jsonl"))]
    if markdown:
        derived = _meta(canonical_stable_id=sid, derived_kind=F.lit("markdown"))
        units += [unit("derived", df, F.concat(F.lit("derived:markdown:"), sid), derived, F.concat(F.lit(f"markdown/{folder}/"), sid, F.lit(".md"))) for df, folder in ((c, "conversations"), (n, "native"))]
    return reduce(DataFrame.unionByName, units)


def manifest(conversations: DataFrame, messages: DataFrame, notes: DataFrame, markdown: bool = True) -> DataFrame:
    """One row of counts, lanes, providers and time range."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    c = conversations.agg(F.count("*").alias("conversation_count"), F.array_sort(F.collect_set("source")).alias("providers"), F.min("created_at_unix").alias("c_min"), F.max(F.coalesce(F.nullif(F.col("updated_at_unix"), F.lit(0.0)), F.col("created_at_unix"))).alias("c_max"))
    m = messages.agg(F.count("*").alias("message_count"), F.min("created_at_unix").alias("m_min"), F.max("created_at_unix").alias("m_max"))
    n = notes.agg(F.count("*").alias("native_count"), F.min(F.col("timestamp").cast("double")).alias("n_min"), F.max(F.col("timestamp").cast("double")).alias("n_max"))
    p = one(provenance(conversations, messages, notes, markdown), "provenance_count")
    row = c.join(m, F.lit(True)).join(n, F.lit(True)).join(p, F.lit(True))  # one row each
    lanes = F.array_compact(F.array(F.when(F.col("conversation_count") > 0, IMPORTED_LANE), F.when(F.col("native_count") > 0, NATIVE_LANE)))
    providers = F.when(F.col("native_count") > 0, F.array_sort(F.array_union("providers", F.array(F.lit(NATIVE))))).otherwise(F.col("providers"))
    return row.select(F.lit(VERSION).alias("package_version"), "conversation_count", "message_count", "native_count", "provenance_count", lanes.alias("source_lanes"), providers.alias("source_providers"), F.least("c_min", "m_min", "n_min").alias("min_unix"), F.greatest("c_max", "m_max", "n_max").alias("max_unix"), F.lit(markdown).alias("includes_markdown"))


#: Required fields of a manifest file and the kinds of value that each may have.
MANIFEST_FIELDS = {"package_version": ("STRING",), "created_at": ("STRING",), "export_version": ("STRING",), "source_lanes": ("ARRAY",), "counts": ("OBJECT",), "source_providers": ("ARRAY",), "provenance": ("OBJECT",), "integrity_notes": ("STRING", "ARRAY")}
COUNTS = ("conversation_count", "message_count", "native_count", "provenance_count")
INDEX_FILE = "provenance/index.jsonl"


def manifest_text(manifest_: DataFrame, now: str) -> DataFrame:
    """The manifest (one row) as a file: path and content."""
    notes = F.array(F.lit("Records are canonical; Markdown is derived from them."))
    content = F.to_json(F.struct("package_version", F.lit(now).alias("created_at"), F.lit(VERSION).alias("export_version"), "source_lanes", F.struct(*COUNTS).alias("counts"), "source_providers", F.struct(F.lit(INDEX_FILE).alias("index_file")).alias("provenance"), notes.alias("integrity_notes"), F.col("includes_markdown").alias("markdown_included"), F.struct("min_unix", "max_unix").alias("time_range")))
    return manifest_.select(F.lit("manifest.json").alias("path"), content.alias("content"))


def write_package(path: str, conversations: DataFrame, messages: DataFrame, notes: DataFrame, markdown: bool = True, now: str = "") -> None:
    """A package in ``path``: JSON lines as the provenance index names them, Markdown files, manifest.json.

    A record file is a folder of parts, so that it may be of any size; rows of a
    conversation are together and in order.  The manifest is written last.
    """
    spark = conversations.sparkSession
    # every record file but the notes, the index and the manifest read them
    conversations = materialize(conversations.select("id", "source", "source_conversation_id", "title", "created_at_unix", "updated_at_unix"), "package-conversations")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    c = conversation_records(conversations).withColumn("provider", F.col("source_provider")).repartition("provider", "stable_id").sortWithinPartitions("provider", "stable_id")
    m = message_records(conversations, messages).withColumn("provider", F.col("source_provider")).repartition("provider", "conversation_stable_id").sortWithinPartitions("provider", "conversation_stable_id", "sequence_index")
    for name, rows in (("conversations", c), ("messages", m)):
        rows.write.partitionBy("provider").json(f"{path}/_{name}")
        # one folder for each provider
        for part in fs.listStatus(fs_path(f"{path}/_{name}")):
            if part.isDirectory():
                to = f"{path}/providers/{part.getPath().getName().split('=', 1)[1]}"
                fs.mkdirs(fs_path(to))
                fs.rename(part.getPath(), fs_path(f"{to}/{name}.jsonl"))
        fs.delete(fs_path(f"{path}/_{name}"), True)
    note_records(notes).write.json(f"{path}/native/memory_entries.jsonl")
    provenance(conversations, messages, notes, markdown).write.json(f"{path}/{INDEX_FILE}")
    if markdown:
        talks = conversation_markdown(conversations, messages).select(F.concat(F.lit("markdown/conversations/"), T.stable_id("imported_conversation", F.col("id")), F.lit(".md")).alias("path"), F.col("markdown").alias("content"))
        own = note_markdown(notes).select(F.concat(F.lit("markdown/native/"), T.stable_id("memory", F.col("id")), F.lit(".md")).alias("path"), F.col("markdown").alias("content"))
        write_files(talks.unionByName(own), path, True)
    write_files(manifest_text(manifest(conversations, messages, notes, markdown), now), path, True)
    release(conversations)


def conversation_markdown(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Id and the Markdown of each conversation, messages in order."""
    stamp = lambda c: F.coalesce(T.iso(F.col(c)), F.lit("N/A"))
    part = F.concat(F.lit("\n### ["), F.col("sequence_index").cast("string"), F.lit("] "), "role", F.lit("\n- Source Message ID: "), "source_message_id", F.lit("\n- Created At: "), stamp("created_at_unix"), F.lit("\n\n"), F.coalesce("content", F.lit("")))
    parts = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence_index", F.col("id").alias("m"), part.alias("part")))), lambda x: x["part"]), "\n").alias("parts"))
    head = F.concat(F.lit("# "), "title", F.lit("\n\n## Conversation Metadata\n- Source: "), "source", F.lit("\n- Source Conversation ID: "), "source_conversation_id", F.lit("\n- Created At: "), stamp("created_at_unix"), F.lit("\n- Updated At: "), stamp("updated_at_unix"), F.lit("\n\n## Messages"))
    whole = F.concat(head, F.coalesce(F.concat(F.lit("\n"), "parts"), F.lit("")))
    return conversations.join(parts, "id", "left").select("id", F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n")).alias("markdown"))


def note_markdown(notes: DataFrame) -> DataFrame:
    """X5."""
    at = F.coalesce(T.iso(F.col("timestamp").cast("double")), F.lit("N/A"))
    return notes.select("id", F.concat(F.lit("# Native Memory Entry "), F.col("id").cast("string"), F.lit("\n\n## Metadata\n- Stable ID: memory:"), F.col("id").cast("string"), F.lit(f"\n- Source Lane: {NATIVE_LANE}\n- Source Provider: {NATIVE}\n- Timestamp: "), at, F.lit("\n- Role: "), "role", F.lit("\n- Tags: "), F.coalesce("tags", F.lit("")), F.lit("\n\n## Content\n"), "content", F.lit("\n")).alias("markdown"))


# --- rules ---------------------------------------------------------------------


def broken(df: DataFrame, rules: list[tuple], key: str = "stable_id") -> DataFrame:
    """One pass over a table: a row for each rule (condition, code, severity and, if not the row's own, key) that a row breaks."""
    found = (F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(*own or (key,)).cast("string").alias("stable_id"))) for when, code, severity, *own in rules)
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.*")


def blank(c: str | Column) -> Column:
    return T.strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) == ""


def meta(key: str) -> Column:
    return F.try_element_at("source_metadata", F.lit(key))


def slim_records(conversations: DataFrame, messages: DataFrame, notes: DataFrame) -> DataFrame:
    """What rules compare between records, of all three kinds: identity, owner, place and times."""
    own = ("stable_id", "source_lane", "source_provider", "source_record_id")
    none = lambda kind: F.lit(None).cast(kind)
    last = F.coalesce(F.nullif(F.col("updated_at_unix"), F.lit(0.0)), F.col("created_at_unix"))
    c = conversations.select(F.lit("conversation").alias("kind"), *own, none("string").alias("owner"), none("int").alias("sequence_index"), F.least("created_at_unix", last).alias("first_unix"), F.greatest("created_at_unix", last).alias("last_unix"))
    m = messages.select(F.lit("message").alias("kind"), *own, F.col("conversation_stable_id").alias("owner"), F.col("sequence_index").cast("int").alias("sequence_index"), F.col("created_at_unix").alias("first_unix"), F.col("created_at_unix").alias("last_unix"))
    n = notes.select(F.lit("note").alias("kind"), *own, none("string").alias("owner"), none("int").alias("sequence_index"), F.col("timestamp_unix").alias("first_unix"), F.col("timestamp_unix").alias("last_unix"))
    return c.unionByName(m).unionByName(n)


def validate(conversations: DataFrame, messages: DataFrame, notes: DataFrame, provenance_: DataFrame, manifest_: DataFrame) -> DataFrame:
    """Every broken rule of a package as (code, severity, stable_id); severity is E or W.

    Each record table is read once for all rules of its rows, and once for the slim
    table that the rules between records are made from.
    """
    # The codes of the rules.
    slim = materialize(slim_records(conversations, messages, notes), "package-records")
    # how many records have an identity: a source id within its provider, of messages within their conversation
    place = F.when(F.col("kind") == "conversation", F.col("source_provider")).otherwise(F.col("owner"))
    shared = slim.filter(F.col("kind").isin("conversation", "message") & ~blank("source_record_id")).groupBy("kind", place.alias("place"), "source_record_id").agg(F.count_distinct("stable_id").alias("n")).filter("n > 1")
    shared = materialize(shared.select("kind", "place", "source_record_id", F.lit(True).alias("shared")), "shared-identities")
    # messages of a conversation are numbered 0 to n - 1: counted by number first, so that no task takes a conversation whole
    numbers = slim.filter("kind = 'message'").groupBy("owner", "sequence_index").agg(F.count("*").alias("n"))
    numbers = numbers.groupBy("owner").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.min("sequence_index").alias("low"), F.max("sequence_index").alias("high"), F.max(F.col("sequence_index").isNull()).alias("without"))
    in_order = ~F.col("without") & (F.col("most") == 1) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    numbers = materialize(numbers.select("owner", F.coalesce(in_order, F.lit(False)).alias("in_order")), "message-numbers")
    known = materialize(slim.groupBy("stable_id").agg(F.count("*").alias("n"), *(F.min_by(x, F.struct("kind", "source_lane", "source_provider", "source_record_id")).alias(f"own_{x}") for x in ("source_lane", "source_provider", "source_record_id"))), "known-records")

    no_meta = F.col("source_metadata").isNull() | (F.size("source_metadata") == 0)
    wrong = lambda key, own: ~blank(meta(key)) & (meta(key) != F.coalesce(own, F.lit("")))
    fields = [(blank(f), "field_missing_or_blank", "E") for f in ("stable_id", "source_lane", "source_provider", "source_record_id")]

    def common(df: DataFrame, what: str, kind: str, lane: str) -> list[tuple]:
        rules = [
            (~F.coalesce(F.col("stable_id").rlike(f"^{kind}:[0-9]+$"), F.lit(False)), f"{what}_stable_id_invalid", "E"),
            (~F.coalesce(F.col("source_lane") == lane, F.lit(False)), f"{what}_lane_invalid", "E"),
            (no_meta, f"{what}_source_metadata_missing", "W"),
        ]
        if "path" in df.columns and what != "native":
            rules.append((F.col("path").isNotNull() & ~F.contains("path", F.concat(F.lit("/"), "source_provider", F.lit("/"))), f"{what}_provider_path_mismatch", "E"))
        return [*rules, *fields]

    mine = shared.filter("kind = 'conversation'").select(F.col("place").alias("source_provider"), "source_record_id", "shared")
    c = conversations.join(mine, ["source_provider", "source_record_id"], "left").join(numbers.withColumnRenamed("owner", "stable_id"), "stable_id", "left")
    out = [broken(c, [
        *common(conversations, "conversation", "imported_conversation", IMPORTED_LANE),
        (F.col("shared"), "conversation_source_identity_conflict", "E"),
        (blank(meta("source")), "conversation_source_missing", "W"),
        (wrong("source", F.col("source_provider")), "conversation_source_metadata_mismatch", "E"),
        (blank(meta("source_conversation_id")), "conversation_source_id_missing", "W"),
        (wrong("source_conversation_id", F.col("source_record_id")), "conversation_source_id_mismatch", "E"),
        (F.col("created_at_unix").isNull(), "conversation_timestamp_missing", "W"),
        (F.col("updated_at_unix").isNull(), "conversation_updated_timestamp_missing", "W"),
        (blank("title"), "conversation_title_missing", "W"),
        (F.col("in_order").isNull(), "conversation_has_no_messages", "W"),
    ])]
    mine = shared.filter("kind = 'message'").select(F.col("place").alias("conversation_stable_id"), "source_record_id", "shared")
    # of conversations with one id, the owner is the first by its fields
    owner = slim.filter("kind = 'conversation'").groupBy(F.col("stable_id").alias("conversation_stable_id")).agg(F.min(F.struct("source_provider", "source_record_id")).alias("owner"))
    m = messages.join(mine, ["conversation_stable_id", "source_record_id"], "left").join(owner, "conversation_stable_id", "left")
    out.append(broken(m, [
        *common(messages, "message", "imported_message", IMPORTED_LANE),
        (F.col("shared"), "message_source_identity_conflict", "E"),
        (F.col("sequence_index").isNull() | (F.col("sequence_index") < 0), "field_invalid_integer", "E"),
        (blank(meta("source_message_id")), "message_source_id_missing", "W"),
        (wrong("source_message_id", F.col("source_record_id")), "message_source_id_mismatch", "E"),
        (blank(meta("conversation_source_id")), "message_conversation_source_id_missing", "W"),
        (F.col("created_at_unix").isNull(), "message_timestamp_missing", "W"),
        (F.col("owner").isNull(), "message_conversation_reference_missing", "E"),
        (F.col("owner.source_provider") != F.col("source_provider"), "message_provider_mismatch", "E"),
        (F.col("owner").isNotNull() & ~blank(meta("conversation_source_id")) & (meta("conversation_source_id") != F.col("owner.source_record_id")), "message_conversation_source_id_mismatch", "E"),
    ]))
    out.append(broken(numbers, [(~F.col("in_order"), "message_sequence_invalid", "E")], "owner"))
    out.append(broken(notes, [
        *common(notes, "native", "memory", NATIVE_LANE),
        (F.concat(F.lit("memory:"), F.coalesce("source_record_id", F.lit(""))) != F.col("stable_id"), "native_source_id_mismatch", "E"),
        (blank(meta("role")), "native_role_missing", "W"),
        (wrong("role", F.col("role")), "native_role_mismatch", "E"),
        (meta("tags").isNull(), "native_tags_missing", "W"),
        (F.col("timestamp_unix").isNull(), "native_timestamp_missing", "W"),
    ]))
    # a unit and the record that it is of, or is derived from; records without a canonical unit come with neither
    of = F.when(F.col("unit_type") == "derived", meta("canonical_stable_id")).when(F.col("unit_type") == "canonical", F.col("stable_id"))
    units = provenance_.withColumn("of", of)
    canonical, derived, there = F.col("unit_type") == "canonical", F.col("unit_type") == "derived", F.col("n").isNotNull()
    expected = F.when(F.col("stable_id").startswith("memory:"), "native/memory_entries.jsonl").otherwise(F.concat(F.lit("providers/"), "source_provider", F.when(F.col("stable_id").startswith("imported_message:"), "/messages.jsonl").otherwise("/conversations.jsonl")))
    differs = reduce(lambda a, b: a | b, [F.col(f"own_{x}") != F.col(x) for x in ("source_lane", "source_provider", "source_record_id")])
    out.append(broken(units.join(known.withColumnRenamed("stable_id", "of"), "of", "left"), [
        (blank("path"), "provenance_path_missing", "E"),
        (no_meta, "provenance_source_metadata_missing", "W"),
        (~F.coalesce(canonical | derived, F.lit(False)), "provenance_unit_type_invalid", "E"),
        (canonical & ~there, "provenance_canonical_reference_missing", "E"),
        (canonical & there & ~blank("path") & (F.col("path") != expected), "provenance_canonical_path_mismatch", "E"),
        (canonical & there & differs, "provenance_identity_mismatch", "E"),
        (derived & blank("of"), "provenance_derived_reference_invalid", "E"),
        (derived & ~blank("of") & ~there, "provenance_derived_reference_missing", "E"),
    ]))
    counted = provenance_.groupBy("stable_id").agg(F.count("*").alias("units"), F.count_if(canonical).alias("canonical"))
    both = known.select("stable_id", F.col("n").alias("records")).join(counted, "stable_id", "full")
    out.append(broken(both, [
        (F.col("records") > 1, "canonical_stable_id_duplicate", "E"),
        (F.col("units") > 1, "provenance_stable_id_duplicate", "E"),
        (F.col("records").isNotNull() & (F.coalesce("canonical", F.lit(0)) == 0), "provenance_index_missing", "E"),
    ]))
    out.append(manifest_findings(slim, provenance_, manifest_))
    return reduce(DataFrame.unionByName, out)


def manifest_findings(slim: DataFrame, provenance_: DataFrame, manifest_: DataFrame) -> DataFrame:
    """Rules of the manifest: its fields, and what they say against the records (one row each)."""
    laned = F.col("kind") != "message"
    facts = slim.agg(
        *(F.count_if(F.col("kind") == kind).alias(name) for kind, name in (("conversation", "n_c"), ("message", "n_m"), ("note", "n_n"))),
        F.min("first_unix").alias("lo"), F.max("last_unix").alias("hi"),
        F.array_sort(F.collect_set(F.when(laned, F.col("source_lane")))).alias("lanes"), F.array_sort(F.collect_set(F.when(laned, F.col("source_provider")))).alias("provs"),
    )
    facts = facts.join(provenance_.agg(F.count("*").alias("n_p")), F.lit(True))
    row = facts.join(manifest_.limit(1).withColumn("there", F.lit(True)), F.lit(True), "left").withColumn("stable_id", F.lit(None).cast("string"))
    there = F.col("there").isNotNull()
    fields = ("package_version", "conversation_count", "message_count", "native_count", "provenance_count", "source_lanes", "source_providers", "includes_markdown")
    counts = (("conversation_count", "n_c"), ("message_count", "n_m"), ("native_count", "n_n"), ("provenance_count", "n_p"))
    return broken(row, [
        (~there, "manifest_missing", "E"),
        *((there & F.col(f).isNull(), "manifest_missing_count" if f.endswith("_count") else "manifest_missing_field", "E") for f in fields),
        *((there & (F.col(f) < 0), "manifest_invalid_count", "E") for f, _ in counts),
        *((there & (F.col(f) != F.col(real)), "manifest_count_mismatch", "E") for f, real in counts),
        (there & (F.col("package_version") != VERSION), "unsupported_package_version", "E"),
        (there & F.exists("source_providers", lambda x: blank(x)), "manifest_invalid_list_value", "E"),
        (there & (F.array_sort("source_lanes") != F.col("lanes")), "manifest_source_lanes_mismatch", "E"),
        (there & (F.array_sort("source_providers") != F.col("provs")), "manifest_source_providers_mismatch", "E"),
        (there & (F.col("min_unix") > F.col("max_unix")), "manifest_invalid_time_range", "E"),
        (there & (F.col("min_unix").isNull() | F.col("max_unix").isNull()) & F.col("lo").isNotNull(), "manifest_time_range_missing", "W"),
        (there & (F.col("min_unix") != F.col("lo")), "manifest_min_time_range_mismatch", "E"),
        (there & (F.col("max_unix") != F.col("hi")), "manifest_max_time_range_mismatch", "E"),
    ])


def status(findings: DataFrame) -> DataFrame:
    """One row: invalid, valid_with_warnings or valid, and the numbers of errors and warnings."""
    n = findings.agg(F.count_if(F.col("severity") == "E").alias("errors"), F.count_if(F.col("severity") == "W").alias("warnings"))
    return n.withColumn("status", F.when(F.col("errors") > 0, "invalid").when(F.col("warnings") > 0, "valid_with_warnings").otherwise("valid"))


def judged_lines(lines: DataFrame, schema: str | dict[str, str]) -> DataFrame:
    """JSON lines with their record ``r`` and ``code``: record, blank, or why a line is no record; each line is parsed once.

    With a schema for each ``kind`` of lines, ``r`` has a field of each kind's name, and a line's own is filled.
    """
    record = F.col("line").rlike(r"^\s*\{")
    filled = F.coalesce(F.col("line").rlike(r"\S"), F.lit(False))  # not by a copy without blanks: a line may be long
    code = F.when(~filled, "blank").when(F.try_parse_json("line").isNull(), "jsonl_parse_error").when(record, "record").otherwise("jsonl_record_invalid_type")
    own = lambda kind, of: F.when((F.col("code") == "record") & of, F.from_json("line", kind))
    r = own(schema, F.lit(True)) if isinstance(schema, str) else F.struct(*(own(s, F.col("kind") == k).alias(k) for k, s in schema.items()))
    return lines.withColumn("code", code).withColumn("r", r).drop("line")


def line_findings(judged: DataFrame, file: str) -> DataFrame:
    """Findings on lines that are no records, by the ``file`` that they are in."""
    return judged.filter(F.col("code").startswith("jsonl_")).select("code", F.lit("E").alias("severity"), F.col(file).cast("string").alias("stable_id"))


def read_lines(lines: DataFrame, schema: str, file: str = "path") -> tuple[DataFrame, DataFrame]:
    """JSON lines (``file``, line) of a package read back: records with their path, and findings on lines that are none."""
    judged = judged_lines(lines, schema)
    return judged.filter("code = 'record'").select(file, "r.*"), line_findings(judged, file)


def manifest_file_findings(manifests: DataFrame) -> DataFrame:
    """Broken rules of manifest files (package, content; null if there is no such file), as code, severity, package."""
    # The codes of the rules.
    v, whole = F.col("v"), F.col("kind").startswith("OBJECT")
    rows = manifests.withColumn("v", F.try_parse_json("content")).withColumn("kind", F.coalesce(F.schema_of_variant("v"), F.lit("")))
    get = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    kind = lambda name: F.coalesce(F.schema_of_variant(get(name)), F.lit("VOID"))
    of = lambda name, *kinds: kind(name).rlike(f"^(?:{'|'.join(kinds)})")
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    odd = lambda name: F.exists(get(name).try_cast("array<variant>"), lambda x: (F.coalesce(F.schema_of_variant(x), F.lit("")) != "STRING") | blank(x.try_cast("string")))
    there = F.col("content").isNotNull()
    absent = lambda name: kind(name) == "VOID"
    counts = [f"counts.{c}" for c in COUNTS]
    return broken(rows, [
        (~there, "manifest_missing", "E"),
        (there & v.isNull(), "json_parse_error", "E"),
        (v.isNotNull() & ~whole, "manifest_invalid_type", "E"),
        *((whole & absent(f), "manifest_missing_field", "E") for f in MANIFEST_FIELDS),
        *((whole & ~absent(f) & ~of(f, *kinds), "manifest_invalid_field_type", "E") for f, kinds in MANIFEST_FIELDS.items()),
        (whole & of("integrity_notes", "ARRAY") & odd("integrity_notes"), "manifest_invalid_integrity_notes", "E"),
        (whole & (kind("package_version") == "STRING") & (text("package_version") != VERSION), "unsupported_package_version", "E"),
        *((whole & of(f, "ARRAY") & odd(f), "manifest_invalid_list_value", "E") for f in ("source_lanes", "source_providers")),
        *((whole & of("counts", "OBJECT") & absent(c), "manifest_missing_count", "E") for c in counts),
        *((whole & ~absent(c) & (~of(c, "BIGINT") | (F.try_variant_get(v, f"$.{c}", "long") < 0)), "manifest_invalid_count", "E") for c in counts),
        (whole & of("provenance", "OBJECT") & ((kind("provenance.index_file") != "STRING") | blank(text("provenance.index_file"))), "manifest_missing_provenance_index", "E"),
        (whole & ~absent("markdown_included") & (kind("markdown_included") != "BOOLEAN"), "manifest_invalid_markdown_flag", "E"),
        (whole & ~absent("time_range") & ~of("time_range", "OBJECT"), "manifest_invalid_time_range", "E"),
    ], "package")


_RECORD = "stable_id string, source_lane string, source_provider string, source_record_id string, source_metadata map<string, string>"
RECORD_FILES = {
    "conversations": (r"^providers/[^/]+/conversations\.jsonl$", f"{_RECORD}, title string, created_at_unix double, updated_at_unix double"),
    "messages": (r"^providers/[^/]+/messages\.jsonl$", f"{_RECORD}, conversation_stable_id string, role string, content string, sequence_index int, created_at_unix double"),
    "notes": (r"^native/memory_entries\.jsonl$", f"{_RECORD}, timestamp_unix double, role string, content string, tags string"),
    "provenance": (rf"^{re.escape(INDEX_FILE)}$", f"unit_type string, {_RECORD}, timestamp_unix double, path string"),
}


def record_parts(spark: SparkSession, folder: str, kinds: Iterable[str] = RECORD_FILES) -> DataFrame:
    """The parts of a package's record files, by the listing: uri, part (its path in the folder), path of the record file, kind and size."""
    files = listing(spark, folder, True).withColumnRenamed("path", "part").withColumn("path", F.regexp_replace("part", r"/part-[^/]*$", ""))
    kind = F.coalesce(*(F.when(F.col("path").rlike(RECORD_FILES[name][0]), name) for name in kinds))
    return files.withColumn("kind", kind).filter("kind is not null")


def part_lines(spark: SparkSession, folder: str, whole: bool) -> DataFrame:
    """Lines (value) of the parts in a folder; with ``whole`` a part that cannot be read to its end is an error, else it ends where the fault is."""
    return spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", not whole).option("ignoreMissingFiles", False).option("pathGlobFilter", "part-*").text(folder)


def record_lines(spark: SparkSession, folder: str, kinds: Iterable[str] = RECORD_FILES, whole: bool = False) -> DataFrame:
    """Lines of a package's record files with their part, path and kind, which are told once for each part and not for each line.

    With ``whole`` a part that cannot be read to its end is an error; without, who
    asks must say which parts were not (:func:`cut_parts`).
    """
    lines = part_lines(spark, folder, whole)
    # a list of files, which the driver has anyway
    return lines.select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("line")).join(F.broadcast(record_parts(spark, folder, kinds).drop("size")), "uri").drop("uri")


def cut_parts(spark: SparkSession, folder: str, lines: DataFrame) -> list[str]:
    """The parts that ``lines`` has some, but not all lines of: their lines are counted again, and a part that fails is searched for by halves."""
    # a row for each part
    had = {r["part"]: r["n"] for r in lines.groupBy("part").agg(F.count("*").alias("n")).collect()}
    names = {r["uri"]: r["part"] for r in record_parts(spark, folder).collect() if r["part"] in had}
    uri = F.col("_metadata.file_path")

    def judged(some: list[str]) -> list[str]:
        try:
            counts = part_lines(spark, folder, True).filter(uri.isin(some)).groupBy(uri.alias("uri")).agg(F.count("*").alias("n")).collect()
        except (Py4JJavaError, PySparkException) as e:
            if "FAILED_READ_FILE" not in str(e):
                raise
            half = len(some) // 2
            return judged(some[:half]) + judged(some[half:]) if half else some
        n = {r["uri"]: r["n"] for r in counts}
        return [u for u in some if n.get(u) != had[names[u]]]

    return [names[u] for u in judged(sorted(names))]


def read_package(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The record tables of a package in ``folder``, its manifest (a row, or none), and the findings on its files.

    A file that is listed but cannot be read, or not to its end, is a finding, and so
    is a line that is no JSON or no object; what can be read is read.
    """
    # one pass over all record files; what follows reads columns of it
    lines = materialize(judged_lines(record_lines(spark, folder), {name: schema for name, (_, schema) in RECORD_FILES.items()}), "package-lines")
    parts = {}
    for name in RECORD_FILES:
        good = lines.filter((F.col("kind") == name) & (F.col("code") == "record"))
        # units name paths of their own
        parts[name] = good.select(*(() if name == "provenance" else ("path",)), f"r.{name}.*")
    found = [line_findings(lines, "path")]
    unread = record_parts(spark, folder).filter("size > 0").join(lines.select("part").distinct(), "part", "left_anti").select("part")
    if cut := cut_parts(spark, folder, lines):
        unread = unread.unionByName(spark.createDataFrame([(part,) for part in cut], "part string"))
    found.append(unread.select(F.lit("file_read_error").alias("code"), F.lit("E").alias("severity"), F.col("part").alias("stable_id")))
    one = spark.range(1).select(F.lit(folder).alias("package"))
    head = materialize(one.join(texts(spark, folder, "manifest.json").filter("path = 'manifest.json'").select("content"), F.lit(True), "left"), "manifest-file")  # one row
    found.append(manifest_file_findings(head).withColumn("stable_id", F.lit(None).cast("string")))
    kinds = "package_version string, source_lanes array<string>, source_providers array<string>, markdown_included boolean, counts struct<{}>, time_range struct<min_unix: double, max_unix: double>".format(", ".join(f"{c}: long" for c in COUNTS))
    row = head.filter(F.try_parse_json("content").isNotNull() & F.col("content").rlike(r"^\s*\{")).select(F.from_json("content", kinds).alias("m"))
    parts["manifest"] = row.select("m.package_version", "m.counts.*", "m.source_lanes", "m.source_providers", "m.time_range.*", F.col("m.markdown_included").alias("includes_markdown"))
    return parts, reduce(DataFrame.unionByName, found)


def validate_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All findings on a package in ``folder``: of its files and of its records.  Without a manifest that can be read there are no others."""
    parts, found = read_package(spark, folder)
    stop = found.agg(F.max(F.col("code").isin("manifest_missing", "json_parse_error", "manifest_invalid_type")).alias("stop"))
    rules = validate(*(parts[k] for k in ("conversations", "messages", "notes", "provenance", "manifest")))
    # the manifest's own fields are judged in its file
    rules = rules.filter(~F.col("code").isin("manifest_missing", "manifest_missing_field", "manifest_missing_count", "manifest_invalid_count", "manifest_invalid_list_value", "unsupported_package_version"))
    return found.unionByName(rules.join(F.broadcast(stop), F.lit(True)).filter(~F.coalesce("stop", F.lit(False))).drop("stop"))  # one row


COUNTED = ("conversations", "messages", "notes")


def provider_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """How many records of each kind a package has of each provider."""
    kinds = [parts[k].groupBy(F.col("source_provider").alias("provider")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k in COUNTED]
    return _by_kind(reduce(DataFrame.unionByName, kinds))


def folder_provider_counts(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    """:func:`provider_counts` of a package in ``folder``, in one pass over its record files; no record is written again.

    With ``whole`` a part that cannot be read is an error; without, the counts are of
    what can be read, and :func:`validate_folder` has the parts that cannot.
    """
    judged = judged_lines(record_lines(spark, folder, COUNTED, whole), {k: RECORD_FILES[k][1] for k in COUNTED})
    provider = F.coalesce(*(F.col(f"r.{k}.source_provider") for k in COUNTED))
    # a condition of the count: as a filter it would go below the join with the parts and parse each line again
    rows = judged.groupBy("kind", provider.alias("provider")).agg(F.count_if(F.col("code") == "record").alias("n"))
    return _by_kind(rows.filter("n > 0"))


def _by_kind(rows: DataFrame) -> DataFrame:
    return rows.groupBy("provider").pivot("kind", list(COUNTED)).agg(F.sum("n")).na.fill(0)


def marker_name(c: Column) -> Column:
    """the last part of a file's name for a link: other characters than letters, digits, - _ . as one underscore, 80 at most."""
    bare = F.regexp_replace(F.substring_index(c, "/", -1), r"[^\p{L}\p{N}_.-]|_+", "_")
    bare = F.regexp_replace(F.regexp_replace(bare, "_+", "_"), r"^[._]+", "")
    return F.coalesce(F.nullif(F.substring(bare, 1, 80), F.lit("")), F.lit("unnamed_file"))


def download_markdown(conversations: DataFrame, messages: DataFrame, conversation_files: DataFrame, message_files: DataFrame, stems: DataFrame | None = None, exporter: str = "convlake") -> DataFrame:
    """Id, filename and the Markdown of each conversation as it is downloaded.

    conversation_files and message_files: conversation_id or message_id, asset_id,
    original_filename, sha256, mime_type, attached_at_unix.  stems (id, stem) names
    the folder of the files that links point to; else it is made from the title.
    """
    by_time = lambda row: F.struct(F.coalesce("attached_at_unix", F.lit(0.0)).alias("at"), "asset_id", row.alias("row"))
    joined = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["row"]), "\n")
    mime = F.coalesce("mime_type", F.lit("application/octet-stream"))
    link = lambda *name: F.concat(F.lit("[["), "stem", F.lit(".assets/"), *name, F.substring("sha256", 1, 12), F.lit("-"), marker_name(F.col("original_filename")), F.lit("]]"))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled conversation"))
    safe = F.trim(F.substring(F.regexp_replace(title, r"[^0-9A-Za-z \-_.]", ""), 1, 60))
    rows = conversations.withColumn("own", F.coalesce(F.nullif(safe, F.lit("")), F.lit("conversation")))
    rows = rows.withColumn("stem", F.col("own")) if stems is None else rows.join(stems, "id", "left").withColumn("stem", F.coalesce("stem", "own"))
    named = rows.select(F.col("id").alias("conversation_id"), "stem")

    listed = F.concat(F.lit("| "), link(), F.lit(" | "), mime, F.lit(" | "), "sha256", F.lit(" | conversation |"))
    tables = conversation_files.join(named, "conversation_id").groupBy(F.col("conversation_id").alias("id")).agg(F.concat(F.lit("## Attachments\n\n| File | Type | SHA256 | Placement |\n|---|---|---|---|\n"), joined(by_time(listed)), F.lit("\n\n")).alias("table"))
    placed = message_files.join(messages.select(F.col("id").alias("message_id"), "conversation_id", "sequence_index"), "message_id").join(named, "conversation_id")
    bullet = F.concat(F.lit("- "), link(F.format_string("msg-%03d-", F.col("sequence_index"))), F.lit(" · "), mime, F.lit(" · "), "sha256")
    files = placed.groupBy("message_id").agg(F.concat(F.lit("#### Attachments\n\n"), joined(by_time(bullet)), F.lit("\n\n")).alias("files"))

    stamp = F.coalesce(F.concat(F.lit("*"), T.iso(F.col("created_at_unix")), F.lit("*\n")), F.lit(""))
    role = F.coalesce(F.nullif(T.capitalized(F.col("role")), F.lit("")), F.lit("Unknown"))
    part = F.concat(F.lit("### "), role, F.lit("\n"), stamp, F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n\n"), F.coalesce("files", F.lit("")), F.lit("---\n"))
    said = messages.join(files, messages["id"] == files["message_id"], "left").groupBy(F.col("conversation_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence_index", messages["id"].alias("m"), part.alias("part")))), lambda x: x["part"]), "\n").alias("parts"), F.count("*").alias("n"))
    time = lambda c: F.coalesce(T.iso(F.col(c)), F.lit("N/A"))
    head = F.concat(F.lit("# "), title, F.lit("\n\n**Provider:** "), "source", F.lit("\n**Created:** "), time("created_at_unix"), F.lit("\n**Updated:** "), time("updated_at_unix"), F.lit("\n**Messages:** "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(f"\n**Exported from:** {exporter}\n\n"))
    whole = F.concat(head, F.coalesce("table", F.lit("")), F.lit("---\n"), F.coalesce(F.concat(F.lit("\n"), "parts"), F.lit("")))
    return rows.join(tables, "id", "left").join(said, "id", "left").select("id", F.concat("own", F.lit(".md")).alias("filename"), whole.alias("markdown"))
