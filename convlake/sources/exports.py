"""Provider export files to conversations with their messages.

A file is one row (path, content).  Detection and parsing are expressions over raw
JSON; the conversations of a file are exploded and spread before they are parsed.
Fields of open type are read as raw JSON and tested.  Every parser returns rows of

    provider, path, position, source_conversation_id, title, created_at, updated_at,
    metadata map<string,string>, messages array<struct<source_message_id, role,
    content, sequence_index, created_at>>
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.schemas import PROVIDERS
from convlake.shared import materialize

UNTITLED = "Untitled Conversation"
GAP_SECONDS = 1800
ACTIVITY_HEADER, PROMPTED = "Gemini Apps", "Prompted "
RECORD_TYPES = ("user", "assistant", "permission-mode", "attachment", "file-history-snapshot", "last-prompt", "custom-title", "agent-name", "system")
MESSAGE = "struct<source_message_id:string,role:string,content:string,sequence_index:int,created_at:double>"
OBJECT, LIST = "map<string,string>", "array<string>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """S3: path and content of each ``.json`` and ``.jsonl`` file below a folder; ``.zip`` files by :func:`zip_members`."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    plain = raw.filter(F.lower("path").rlike(r"\.jsonl?$")).select("path", F.col("content").cast("string").alias("content"))
    return plain.unionByName(chosen_member(zip_members(raw.filter(F.lower("path").endswith(".zip")))))


def zip_members(files: DataFrame) -> DataFrame:
    """Path, member, content of every ``.json`` in zip files (path, content binary); an archive without one has a row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        found = [(path, n, z.read(n).decode("utf-8", "replace"), None) for n in sorted(z.namelist()) if n.lower().endswith(".json")]
                    rows += found or [(path, None, None, "no .json file in the archive")]
                except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError) as e:
                    rows.append((path, None, None, f"broken archive: {e}"))
            yield pd.DataFrame(rows, columns=["path", "member", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, content string, error string")


def member_order() -> Column:
    """``conversations.json`` before the others, those in path order."""
    return F.struct((F.substring_index("member", "/", -1) != "conversations.json").alias("late"), "member")


def chosen_member(members: DataFrame) -> DataFrame:
    """Path and content of the first member that is some provider's export."""
    known = detect(members.filter("member is not null")).filter("provider is not null")
    return known.groupBy("path").agg(F.min_by("content", member_order()).alias("content"))


def zip_rejects(members: DataFrame) -> DataFrame:
    """Archives (path, problem) of which no member is an export, with the problem of the member that was tried last."""
    tried = detect(members.filter("member is not null")).groupBy("path").agg(F.max(F.col("provider").isNotNull()).alias("known"), F.max_by("problem", member_order()).alias("last"))
    broken = members.filter("error is not null").select("path", F.col("error").alias("problem"))
    return tried.filter("not known").select("path", F.col("last").alias("problem")).unionByName(broken)


def keys(c: Column) -> Column:
    return F.coalesce(F.map_keys(F.from_json(c, OBJECT)), F.array().cast(LIST))


def is_list(c: Column) -> Column:
    return F.coalesce(F.ltrim(c).startswith("["), F.lit(False))


def is_object(c: Column) -> Column:
    return F.coalesce(F.ltrim(c).startswith("{"), F.lit(False))


def items_of(c: Column) -> Column:
    return F.coalesce(F.from_json(c, LIST), F.array().cast(LIST))


def field(c: Column, name: str) -> Column:
    return F.try_element_at(F.from_json(c, OBJECT), F.lit(name))


def text_field(c: Column, name: str) -> Column:
    """A field that is a JSON string; null for other types (told apart by the type of the parsed value)."""
    value = F.variant_get(F.try_parse_json(c), f'$["{name}"]', "variant")
    return F.when(F.schema_of_variant(value) == "STRING", field(c, name))


def unwrapped(c: Column) -> Column:
    """Conversations of a list, or of a rescue object's ``conversations`` object, in file order."""
    inner = field(c, "conversations")
    return F.when(is_list(c), items_of(c)).when(is_object(inner), F.map_values(F.from_json(inner, OBJECT))).otherwise(F.array().cast(LIST))


def _claude_like(c: Column) -> Column:
    return is_object(c) & is_list(field(c, "chat_messages"))


def _gemini_like(c: Column) -> Column:
    some = F.exists(items_of(field(c, "messages")), lambda m: F.coalesce(field(m, "role").isin("user", "model"), F.lit(False)))
    return is_object(c) & is_list(field(c, "messages")) & some & ~F.array_contains(keys(c), "chat_messages") & ~F.array_contains(keys(c), "mapping")


def _activity(c: Column) -> Column:
    return F.exists(items_of(c), lambda e: (field(e, "header") == ACTIVITY_HEADER) & F.coalesce(text_field(e, "title").startswith(PROMPTED), F.lit(False)))


def _takeout(c: Column) -> Column:
    return F.exists(items_of(c), lambda e: F.contains(F.lower(F.coalesce(text_field(e, "header"), F.lit(""))), F.lit(ACTIVITY_HEADER.lower())) & text_field(e, "title").isNotNull())


def _session_log(c: Column) -> Column:
    """The first line that is JSON decides."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.try_parse_json(x).isNotNull() & (F.trim(x) != ""))
    first = F.get(lines, F.lit(0))
    return is_object(first) & F.coalesce(field(first, "type").isin(*RECORD_TYPES), F.lit(False)) & F.array_contains(keys(first), "sessionId")


DETECTORS: dict[str, Callable[[Column], Column]] = {
    "chatgpt": lambda c: F.exists(unwrapped(c), lambda i: F.array_contains(keys(i), "mapping")),
    "claude": lambda c: _claude_like(c) | is_list(c) & F.exists(items_of(c), _claude_like),
    "claude_code": _session_log,
    "gemini": lambda c: is_list(c) & (_activity(c) | _takeout(c) | F.exists(items_of(c), _gemini_like)) | _gemini_like(c),
    "grok": lambda c: is_object(c) & F.exists(items_of(field(c, "conversations")), lambda i: F.array_contains(keys(i), "conversation") & F.array_contains(keys(i), "responses")),
}


def valid_hint(hint: Column) -> Column:
    """A provider hint in canonical form; null if it names none."""
    low = F.lower(T.strip(hint))
    return F.when(low.isin(*PROVIDERS), low)


def detect(files: DataFrame) -> DataFrame:
    """Files with ``provider``, or null and a ``problem``: not JSON, no provider or several."""
    c = F.col("content")
    parsed = F.try_parse_json(c).isNotNull()
    found = F.array_compact(F.array(*(F.when(F.coalesce(test(c), F.lit(False)), F.lit(name)) for name, test in DETECTORS.items())))
    out = files.withColumn("__found", found)
    one = F.size("__found") == 1
    problem = F.when(one, None).when(F.size("__found") > 1, "several providers match").when(~parsed, "malformed JSON").otherwise("no provider matches")
    return out.withColumn("provider", F.when(one, F.element_at("__found", 1))).withColumn("problem", problem).drop("__found")


def seconds(c: Column) -> Column:
    """Unix seconds of a number, a numeric string or an ISO time; else null."""
    return F.coalesce(c.try_cast("double"), F.unix_micros(F.try_to_timestamp(F.trim(c))) / 1e6)


def grok_seconds(c: Column) -> Column:
    """A number (milliseconds above 1e12), an ISO time, or ``$date`` holding one or ``$numberLong`` milliseconds."""
    number = lambda x: F.when(x.try_cast("double") > 1e12, x.try_cast("double") / 1000.0).otherwise(x.try_cast("double"))
    plain = lambda x: F.coalesce(number(x), F.unix_micros(F.try_to_timestamp(x)) / 1e6)
    date = field(c, "$date")
    return F.when(is_object(c), F.when(is_object(date), field(date, "$numberLong").try_cast("double") / 1000.0).otherwise(plain(date))).otherwise(plain(c))


def title_of(c: Column, name: str) -> Column:
    return F.coalesce(F.nullif(T.strip(text_field(c, name)), F.lit("")), F.lit(UNTITLED))


def spread(files: DataFrame, items: Column) -> DataFrame:
    """One row for each conversation, dealt out anew, as a file may hold very many."""
    rows = files.select("path", F.posexplode(items).alias("position", "raw")).filter(is_object(F.col("raw")))
    return rows.repartition(F.col("path"), F.col("position"))


def numbered(messages: Column) -> Column:
    """Messages with content, renumbered from 0."""
    kept = F.filter(messages, lambda m: F.coalesce(m["content"], F.lit("")) != "")
    return F.transform(kept, lambda m, i: F.struct(m["source_message_id"].alias("source_message_id"), m["role"].alias("role"), m["content"].alias("content"), i.cast("int").alias("sequence_index"), m["created_at"].alias("created_at")))


def conversation(provider: str, key: Column, title: Column, created: Column, updated: Column, messages: Column, metadata: Column | None = None) -> list[Column]:
    meta = F.create_map().cast(OBJECT) if metadata is None else metadata
    return [F.lit(provider).alias("provider"), F.col("path"), F.col("position"), key.alias("source_conversation_id"), title.alias("title"), created.alias("created_at"), updated.alias("updated_at"), meta.alias("metadata"), messages.alias("messages")]


def walk(nodes: DataFrame) -> DataFrame:
    """Rows with ``nodes`` array<struct<id, parent, children>> and their pre-order in ``walked`` (ids).

    Roots come in file order, children in their own order; cycles are cut, nodes
    that are not reached follow in file order.
    """

    @F.pandas_udf("array<string>")
    def order(column: pd.Series) -> pd.Series:
        def one(rows) -> list[str]:
            known = {r["id"]: r for r in rows}
            seen: dict[str, None] = {}

            def visit(starts: list[str]) -> None:
                stack = starts[::-1]
                while stack:
                    node = stack.pop()
                    if node in seen:
                        continue
                    seen[node] = None
                    if node in known and known[node]["children"] is not None:
                        stack += [c for c in reversed(list(known[node]["children"])) if c is not None and c not in seen]

            visit([r["id"] for r in rows if r["is_object"] and r["parent"] is None])
            visit([r["id"] for r in rows if r["id"] not in seen])
            return list(seen)

        return column.map(one)

    return nodes.withColumn("walked", order("nodes"))


def parse_chatgpt(files: DataFrame) -> DataFrame:
    """S8 to S11."""
    rows = spread(files, unwrapped(F.col("content")))
    raw = F.col("raw")
    mapping = F.from_json(field(raw, "mapping"), OBJECT)  # keeps the file's order of keys
    nodes = F.transform(F.map_entries(mapping), lambda e: F.struct(e["key"].alias("id"), is_object(e["value"]).alias("is_object"), field(e["value"], "parent").alias("parent"), F.from_json(field(e["value"], "children"), LIST).alias("children")))
    rows = walk(rows.withColumn("mapping", mapping).withColumn("nodes", F.coalesce(nodes, F.array().cast("array<struct<id:string,is_object:boolean,parent:string,children:array<string>>>"))))

    def message(node: Column) -> Column:
        value = F.try_element_at("mapping", node)
        m = field(value, "message")
        parts = F.from_json(field(field(m, "content"), "parts"), "array<variant>")
        texts = F.transform(parts, lambda v: F.when(F.schema_of_variant(v) == "STRING", T.strip(v.cast("string"))))
        content = F.when(is_object(m), F.array_join(F.filter(texts, lambda t: t != ""), "\n"))
        role = F.coalesce(F.nullif(field(field(m, "author"), "role"), F.lit("")), F.lit("unknown"))
        at = F.coalesce(F.nullif(field(m, "create_time").try_cast("double"), F.lit(0.0)), field(value, "create_time").try_cast("double"))
        return F.struct(F.coalesce(F.nullif(field(m, "id"), F.lit("")), node).alias("source_message_id"), role.alias("role"), content.alias("content"), at.alias("created_at"))

    key = F.coalesce(F.nullif(field(raw, "id"), F.lit("")), F.concat(F.lit("conversation-"), F.col("position")))
    return rows.select(*conversation("chatgpt", key, title_of(raw, "title"), field(raw, "create_time").try_cast("double"), field(raw, "update_time").try_cast("double"), numbered(F.transform("walked", message))))


def nesting(json: Column) -> Column:
    """The depth of lists and objects in a JSON text, by a running sum over its brackets."""
    plain = F.regexp_replace(F.regexp_replace(json, r"(?s)\\.", ""), '"[^"]*"', "")
    shape = F.split(F.regexp_replace(plain, r"[^\[\]{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(done: Column, c: Column) -> Column:
        now = done["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(done["most"], now).alias("most"))

    return F.coalesce(F.aggregate(shape, start, step)["most"], F.lit(0))


def block_texts(content: Column, depth: Column) -> Column:
    """The texts of nested content blocks (a VARIANT), in order, whatever their depth.

    A frontier of blocks is expanded in place, so that the order is that of the
    blocks: a list to its items, a block to what its type holds.  After as many rounds
    as there are levels, only texts are left.
    """
    item = "struct<block: variant, text: string>"
    nothing = F.expr(f"cast(array() as array<{item}>)")
    text = lambda t: F.struct(F.lit(None).cast("variant").alias("block"), t.alias("text")).cast(item)
    block = lambda v: F.struct(v.alias("block"), F.lit(None).cast("string").alias("text")).cast(item)

    def expanded(one: Column) -> Column:
        v = one["block"]
        kind = F.schema_of_variant(v)
        inner = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
        string = lambda name: F.when(F.schema_of_variant(inner(name)) == "STRING", F.array(text(F.try_variant_get(v, f"$.{name}", "string")))).otherwise(nothing)
        of = F.when(F.schema_of_variant(inner("type")) == "STRING", F.try_variant_get(v, "$.type", "string"))
        held = F.when(of.isin("text", "voice_note"), string("text")).when(of == "thinking", string("thinking")).when(of == "tool_result", F.array(block(inner("content")))).when(of == "tool_use", F.array(block(inner("input")))).otherwise(F.array(*(block(inner(c)) for c in ("text", "thinking", "content"))))
        return F.when(one["text"].isNotNull(), F.array(one)).when(v.isNull(), nothing).when(kind == "STRING", F.array(text(v.cast("string")))).when(kind.startswith("ARRAY"), F.transform(v.try_cast("array<variant>"), block)).when(kind.startswith("OBJECT"), held).otherwise(nothing)

    rounds = F.sequence(F.lit(0), depth)
    return F.aggregate(rounds, F.array(block(content)), lambda done, _: F.flatten(F.transform(done, expanded)))["text"]


def claude_text(message: Column) -> Column:
    """The text, else the texts of the content blocks, however deep they lie."""
    blocks = block_texts(F.try_variant_get(F.try_parse_json(message), "$.content", "variant"), nesting(message))
    joined = F.array_join(F.filter(F.transform(blocks, T.strip), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n")
    return F.coalesce(F.nullif(T.strip(text_field(message, "text")), F.lit("")), joined)


def parse_claude(files: DataFrame) -> DataFrame:
    """S12 to S16; entries that are no conversation are left out."""
    c = F.col("content")
    rows = spread(files, F.when(_claude_like(c), F.array(c)).otherwise(items_of(c))).filter(_claude_like(F.col("raw")))
    raw = F.col("raw")
    key = F.coalesce(F.nullif(field(raw, "uuid"), F.lit("")), F.nullif(field(raw, "conversation_id"), F.lit("")), F.concat(F.lit("claude-conversation-"), F.col("position")))
    role = lambda m: F.coalesce(F.nullif(T.strip(F.lower(field(m, "sender"))), F.lit("")), F.lit("unknown"))
    placed = F.transform(items_of(field(raw, "chat_messages")), lambda m, i: F.struct(F.coalesce(F.when(field(m, "index").rlike(r"^-?[0-9]+(\.0+)?$"), field(m, "index").cast("double")), i.cast("double")).alias("k"), i.alias("i"), m.alias("m")))
    messages = F.transform(F.array_sort(placed), lambda p: F.struct(F.coalesce(F.nullif(field(p["m"], "uuid"), F.lit("")), F.concat(key, F.lit("-message-"), p["i"])).alias("source_message_id"), F.when(role(p["m"]) == "human", "user").otherwise(role(p["m"])).alias("role"), claude_text(p["m"]).alias("content"), seconds(field(p["m"], "created_at")).alias("created_at")))
    return rows.select(*conversation("claude", key, title_of(raw, "name"), seconds(field(raw, "created_at")), seconds(field(raw, "updated_at")), numbered(messages)))


def parse_grok(files: DataFrame) -> DataFrame:
    """S21, S22."""
    rows = spread(files, items_of(field(F.col("content"), "conversations")))
    raw = F.col("raw")
    conv, responses = field(raw, "conversation"), items_of(field(raw, "responses"))
    rows = rows.filter(is_object(conv) & (F.size(responses) > 0))
    key = F.coalesce(F.nullif(field(conv, "id"), F.lit("")), F.concat(F.lit("grok-conv-"), F.col("position")))
    role = lambda r: F.when(F.lower(field(r, "sender")) == "human", "user").otherwise(F.coalesce(F.lower(field(r, "sender")), F.lit("unknown")))
    inner = F.transform(responses, lambda r, i: F.struct(field(r, "response").alias("r"), i.alias("i")))
    messages = F.transform(inner, lambda x: F.struct(F.coalesce(F.nullif(field(x["r"], "_id"), F.lit("")), F.concat(key, F.lit("-msg-"), x["i"])).alias("source_message_id"), role(x["r"]).alias("role"), T.strip(field(x["r"], "message")).alias("content"), grok_seconds(field(x["r"], "create_time")).alias("created_at")))
    models = F.filter(F.transform(inner, lambda x: F.when(T.strip(field(x["r"], "message")) != "", F.nullif(field(x["r"], "model"), F.lit("")))), lambda m: m.isNotNull())
    meta = F.when(F.size(models) > 0, F.create_map(F.lit("grok_model"), F.element_at(models, 1))).otherwise(F.create_map().cast(OBJECT))
    return rows.select(*conversation("grok", key, title_of(conv, "title"), grok_seconds(field(conv, "create_time")), grok_seconds(field(conv, "modify_time")), numbered(messages), meta))


def sessions(entries: DataFrame, account: str, at: str, gap: float = GAP_SECONDS, tie: str | None = None) -> DataFrame:
    """Entries with ``session`` (from 0 in an account): a gap of more than ``gap`` seconds begins a new one.

    Entries without a time stay with the first of their account.  Sessions are found
    inside ranges of (account, time); an account's ranges are stitched by their
    first and last times and the sessions that begin in them, so that an account
    with any number of entries is in many tasks.
    """
    order = [F.col(at).asc_nulls_first(), *([F.col(tie)] if tie else [])]
    ranged = materialize(entries.repartitionByRange(F.col(account), *order).withColumn("__range", F.spark_partition_id()), "session-ranges")
    ends = ranged.groupBy(F.col(account).alias("__account"), F.col("__range").alias("__part")).agg(F.min(at).alias("low"), F.max(at).alias("high"), F.max(F.col(at).isNull()).alias("untimed"))
    inside = Window.partitionBy(account, "__range").orderBy(*order)
    opens = F.coalesce((F.col(at) - F.lag(at).over(inside) > gap).cast("int"), F.lit(0))
    rows = ranged.withColumn("__in", F.sum(opens).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    begun = rows.groupBy(F.col(account).alias("__account"), F.col("__range").alias("__part")).agg(F.max("__in").alias("begun"))
    both = ends.alias("e").join(begun.alias("b"), F.col("e.__account").eqNullSafe(F.col("b.__account")) & (F.col("e.__part") == F.col("b.__part"))).select("e.*", "begun")
    by = Window.partitionBy("__account").orderBy("__part")  # a row for each range of an account
    # the first of a range that has entries without a time is one of these
    edge = F.coalesce((F.when(~F.col("untimed"), F.col("low")) - F.lag("high").over(by) > gap).cast("int"), F.lit(0))
    both = both.withColumn("edge", edge).withColumn("before", F.sum("edge").over(by) + F.coalesce(F.sum("begun").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = both.select("__account", "__part", "before")
    found = rows.join(starts, F.col(account).eqNullSafe(F.col("__account")) & (F.col("__range") == F.col("__part")))
    return found.withColumn("session", F.col("before") + F.col("__in")).drop("__account", "__part", "__range", "__in", "before")


def activity_conversations(entries: DataFrame, gap: float = GAP_SECONDS) -> DataFrame:
    """Entries (path, position, prompt, response, at) to one conversation for each session of a file."""
    rows = sessions(entries, "path", "at", gap, "position")
    grouped = rows.groupBy("path", "session").agg(F.array_sort(F.collect_list(F.struct("at", "position", "prompt", "response"))).alias("e"))
    first = F.element_at("e", 1)
    key = F.concat(F.lit("gemini_activity_"), F.substring(F.sha2(F.concat(F.coalesce(first["at"].cast("string"), F.lit("None")), F.lit("|"), F.array_join(F.transform("e", lambda x: x["prompt"]), "|")), 256), 1, 16))
    turns = F.flatten(F.transform("e", lambda x: F.array(F.struct(F.lit("user").alias("role"), x["prompt"].alias("content"), x["at"].alias("created_at")), F.struct(F.lit("assistant").alias("role"), x["response"].alias("content"), x["at"].alias("created_at")))))
    kept = F.filter(turns, lambda m: F.coalesce(m["content"], F.lit("")) != "")
    messages = F.transform(kept, lambda m, i: F.struct(F.concat(key, F.lit("-msg-"), i).alias("source_message_id"), m["role"].alias("role"), m["content"].alias("content"), m["created_at"].alias("created_at")))
    return grouped.withColumn("position", F.col("session")).select(*conversation("gemini", key, T.cut(first["prompt"], 80), first["at"], F.element_at("e", -1)["at"], numbered(messages), F.create_map(F.lit("gemini_export_shape"), F.lit("myactivity"))))


def parse_gemini(files: DataFrame, gap: float = GAP_SECONDS) -> DataFrame:
    """The first of three shapes that a file has."""
    c = F.col("content")
    shaped = files.withColumn("shape", F.when(is_list(c) & _activity(c), 1).when(is_list(c) & _takeout(c), 2).otherwise(3))
    raw = F.col("raw")
    entries = spread(shaped.filter("shape = 1"), items_of(c)).filter((field(raw, "header") == ACTIVITY_HEADER) & text_field(raw, "title").startswith(PROMPTED))
    response = F.array_join(F.filter(F.transform(items_of(field(raw, "safeHtmlItem")), lambda h: T.html_text(field(h, "html"))), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    entries = entries.select("path", "position", T.strip(F.substring(text_field(raw, "title"), len(PROMPTED) + 1, 1 << 30)).alias("prompt"), response.alias("response"), seconds(field(raw, "time")).alias("at")).filter("prompt <> ''")
    grouped = activity_conversations(entries, gap)

    single = spread(shaped.filter("shape = 2"), items_of(c)).filter(F.contains(F.lower(F.coalesce(text_field(raw, "header"), F.lit(""))), F.lit(ACTIVITY_HEADER.lower())))
    prompt, at = T.strip(text_field(raw, "title")), seconds(field(raw, "time"))
    key = F.concat(F.lit("gemini-takeout-"), F.substring(F.sha2(F.concat_ws("|", prompt, F.coalesce(F.nullif(at, F.lit(0.0)).cast("string"), F.col("position").cast("string"))), 256), 1, 16))
    one = F.array(F.struct(F.concat(key, F.lit("-prompt")).alias("source_message_id"), F.lit("user").alias("role"), prompt.alias("content"), at.alias("created_at")))
    single = single.filter(prompt != "").select(*conversation("gemini", key, T.cut(prompt, 120), at, at, numbered(one), F.create_map(F.lit("gemini_export_shape"), F.lit("takeout"))))

    talks = spread(shaped.filter("shape = 3"), F.when(_gemini_like(c), F.array(c)).otherwise(items_of(c))).filter(is_list(field(raw, "messages")))
    named = F.coalesce(*(F.nullif(T.strip(text_field(raw, k)), F.lit("")) for k in ("id", "conversationId", "conversation_id")))
    slug = F.nullif(F.regexp_replace(T.strip(F.when(F.contains(text_field(raw, "url"), F.lit("/app/")), F.substring_index(text_field(raw, "url"), "/app/", -1))), "/+$", ""), F.lit(""))
    key3 = F.coalesce(named, F.concat(F.lit("gemini-"), slug), F.concat(F.lit("gemini-conversation-"), F.col("position")))

    def content(m: Column) -> Column:
        parts = F.transform(items_of(field(m, "parts")), lambda p: T.strip(F.when(is_object(p), text_field(p, "text")).otherwise(p)))
        return F.coalesce(F.nullif(T.strip(text_field(m, "content")), F.lit("")), F.nullif(T.strip(text_field(m, "text")), F.lit("")), F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n"))

    low = lambda m: F.coalesce(F.nullif(T.strip(F.lower(field(m, "role"))), F.lit("")), F.lit("unknown"))
    said = items_of(field(raw, "messages"))
    messages = F.transform(said, lambda m, i: F.struct(F.coalesce(F.nullif(field(m, "id"), F.lit("")), F.nullif(field(m, "messageId"), F.lit("")), F.concat(key3, F.lit("-message-"), i)).alias("source_message_id"), F.when(low(m).isin("user", "human"), "user").when(low(m).isin("model", "assistant"), "assistant").otherwise(low(m)).alias("role"), content(m).alias("content"), seconds(field(m, "timestamp")).alias("created_at")))
    first = F.get(F.filter(F.transform(said, lambda m: seconds(field(m, "timestamp"))), lambda t: t.isNotNull()), F.lit(0))
    exported = seconds(field(raw, "exportedAt"))
    talks = talks.select(*conversation("gemini", key3, title_of(raw, "title"), F.coalesce(F.nullif(first, F.lit(0.0)), exported), exported, numbered(messages), F.create_map(F.lit("gemini_export_shape"), F.lit("conversations"))))
    return grouped.unionByName(single).unionByName(talks)


def session_text(content: Column) -> Column:
    """Text of a session record's content: a string, or blocks rendered and joined."""
    tool = F.lit

    def result(b: Column) -> Column:
        prefix = F.when(field(b, "is_error") == "true", "[Error] ").otherwise("")
        inner = field(b, "content")
        parts = F.transform(items_of(inner), lambda p: F.when(field(p, "type") == "text", F.nullif(field(p, "text"), F.lit(""))).when(field(p, "type") == "tool_reference", F.concat(F.lit("[Reference: "), F.coalesce(field(p, "tool_name"), F.lit("")), F.lit("]"))))
        body = F.when(is_list(inner), F.array_join(F.array_compact(parts), "\n")).when(is_object(inner), "").otherwise(F.coalesce(inner, F.lit("")))
        shown = F.when(F.length(body) > 4000, F.concat(F.substring(body, 1, 4000), F.lit("... [truncated]"))).otherwise(body)
        return T.strip(F.concat(prefix, shown))

    def use(b: Column) -> Column:
        name, given = F.coalesce(field(b, "name"), F.lit("")), field(b, "input")
        shown = F.when(name == "Bash", F.concat(tool("[Tool: Bash] "), F.coalesce(field(given, "command"), F.lit("")))).when(name == "Write", F.concat(tool("[Tool: Write] "), F.coalesce(field(given, "file_path"), F.lit("")))).when(name.isin("Edit", "str_replace_based_edit_tool"), F.concat(tool("[Tool: Edit] "), F.coalesce(field(given, "file_path"), F.lit(""))))
        return F.rtrim(F.coalesce(shown, F.when(name != "", F.concat(tool("[Tool: "), name, tool("]"))).otherwise("[Tool]")))

    blocks = F.transform(items_of(content), lambda b: F.when(field(b, "type") == "text", field(b, "text")).when(field(b, "type") == "tool_use", use(b)).when(field(b, "type") == "tool_result", result(b)))
    return F.when(is_list(content), F.array_join(F.filter(blocks, lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n")).otherwise(content)


def parse_session_logs(lines: DataFrame) -> DataFrame:
    """Lines (path, position, line) of session logs to one conversation for each file; bad lines are skipped."""
    raw = F.col("line")
    m = field(raw, "message")
    rows = lines.filter(field(raw, "type").isin("user", "assistant") & is_object(m)).select("path", "position", seconds(field(raw, "timestamp")).alias("at"), F.coalesce(F.nullif(field(m, "role"), F.lit("")), field(raw, "type")).alias("role"), session_text(field(m, "content")).alias("content"), F.coalesce(field(raw, "sessionId"), F.lit("unknown")).alias("sid"), F.nullif(field(raw, "uuid"), F.lit("")).alias("uuid"))
    rows = rows.filter((F.col("at").isNotNull()) & (T.strip(F.col("content")) != ""))
    grouped = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("position", "at", "role", "content", "sid", "uuid"))).alias("r"))
    key = F.element_at("r", 1)["sid"]
    messages = F.transform("r", lambda x, i: F.struct(F.coalesce(x["uuid"], F.concat(x["sid"], F.lit(":"), i)).alias("source_message_id"), x["role"].alias("role"), x["content"].alias("content"), x["at"].alias("created_at")))
    return grouped.withColumn("position", F.lit(0)).select(*conversation("claude_code", key, F.concat(F.lit("Claude Code session "), F.substring(key, 1, 8)), F.element_at("r", 1)["at"], F.element_at("r", -1)["at"], numbered(messages), F.create_map(F.lit("session_id"), key)))


def session_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("position", "line"))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"chatgpt": parse_chatgpt, "claude": parse_claude, "claude_code": lambda f: parse_session_logs(session_lines(f)), "gemini": parse_gemini, "grok": parse_grok}


def register_source(name: str, detector: Callable[[Column], Column], parser: Callable[[DataFrame], DataFrame]) -> None:
    """Another provider: a test of a file's content, and a parser of its files."""
    DETECTORS[name], PARSERS[name] = detector, parser


def import_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of all files whose provider is clear, and the others (path, problem)."""
    known = detect(files)
    out = None
    for name, parser in PARSERS.items():
        part = parser(known.filter(F.col("provider") == name).select("path", "content"))
        out = part if out is None else out.unionByName(part)
    return out, known.filter("provider is null").select("path", "problem")


def discover_sessions(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Each session log (path, position, line) with a rough message count (to 1000), joined to an index (session_id, title)."""
    user = F.contains("line", F.lit('"type":"user"')) | F.contains("line", F.lit('"type":"assistant"')) | F.contains("line", F.lit('"type": "user"')) | F.contains("line", F.lit('"type": "assistant"'))
    found = lines.groupBy("path").agg(F.least(F.count_if(user), F.lit(1000)).alias("n_messages"), F.sum(F.octet_length("line") + 1).alias("size_bytes"))
    found = found.withColumn("session_id", F.regexp_replace(F.substring_index("path", "/", -1), r"\.jsonl$", ""))
    return found.join(titles, "session_id", "left")


def import_warnings(conversations: DataFrame) -> DataFrame:
    """For each provider, fallback titles, conversations without a time, messages without one."""
    missing = F.size(F.filter("messages", lambda m: m["created_at"].isNull()))
    return conversations.groupBy("provider").agg(F.count_if(F.col("title") == UNTITLED).alias("untitled"), F.count_if(F.col("created_at").isNull()).alias("conversations_without_time"), F.sum(missing).alias("messages_without_time"))


def file_outcomes(files: DataFrame, parsed: DataFrame, ledger: DataFrame) -> DataFrame:
    """(path, status, n): imported if a file brings a conversation that the ledger lacks, duplicate if none is new, failed if it has none."""
    key = [F.col("provider").alias("source"), "source_conversation_id"]
    seen = parsed.select("path", *key)
    new = seen.join(ledger.select("source", "source_conversation_id"), ["source", "source_conversation_id"], "left_anti").groupBy("path").agg(F.count("*").alias("n_new"))
    counts = files.select("path").join(seen.groupBy("path").agg(F.count("*").alias("n")), "path", "left").join(new, "path", "left")
    status = F.when(F.col("n").isNull(), "failed").when(F.col("n_new") > 0, "imported").otherwise("duplicate")
    return counts.select("path", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"))
