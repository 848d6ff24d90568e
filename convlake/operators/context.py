"""Transcripts under budgets, bridges, open loops and other assembled context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.operators.ranking import positions
from convlake.schemas import ARTIFACT_TYPES, BRIDGE_BUDGET, DISTILL_BUDGET, PACKET_BUDGET
from convlake.shared import materialize


def line_of(role: str = "role", content: str = "content") -> Column:
    return F.concat(F.lit("["), F.col(role), F.lit("]: "), F.coalesce(content, F.lit("")))


def transcript(messages: DataFrame, budget: int = PACKET_BUDGET) -> DataFrame:
    """conversation_id, transcript, dropped: the newest messages that fit, with a line on how many did not.

    The newest message is always kept; if it alone is too long, its tail is.
    """
    size = F.length(line_of()) + 1
    after = Window.partitionBy("conversation_id").orderBy(F.desc("sequence_index"), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = messages.withColumn("upto", F.sum(size).over(after) - 1).withColumn("k", F.row_number().over(after))
    lead = F.length(F.concat(F.lit("["), "role", F.lit("]: [message truncated] ")))
    # the last n characters; with no room at all the slice of the whole text is taken
    keep = F.greatest(F.lit(budget) - lead, F.lit(0))
    tail = F.concat(F.lit("["), "role", F.lit("]: [message truncated] "), F.when(keep == 0, F.col("content")).otherwise(F.right("content", keep)))
    shown = F.when((F.col("k") == 1) & (F.length(line_of()) > budget), tail).otherwise(line_of())
    kept = (F.col("k") == 1) | (F.col("upto") <= budget)
    out = rows.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.when(kept, F.struct("sequence_index", "id", shown.alias("line"))))).alias("l"), F.count_if(~kept).alias("dropped"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return out.select("conversation_id", F.when(F.col("dropped") > 0, F.concat(F.lit("["), F.col("dropped").cast("string"), F.lit(" earlier messages truncated to fit context]\n"), text)).otherwise(text).alias("transcript"), "dropped")


def blocks(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """id and one text block for each conversation, messages in order."""
    lines = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence_index", F.col("id").alias("m"), line_of().alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat(F.lit("=== Conversation: "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled")), F.lit(" (provider: "), "source", F.lit(") ==="))
    return conversations.join(lines, "id", "left").withColumn("block", F.concat(head, F.lit("\n"), F.coalesce("lines", F.lit("")))).drop("lines")


def newest_that_fit(rows: DataFrame, budget: int, cell: int = 1000) -> DataFrame:
    """``rows`` (group_id, id, newest, size) with their place ``k`` in the group, from 1: the newest, and those after it while they fit.

    Sizes are added up in cells of ``cell`` places; of the cells only those that
    begin within the budget are looked into.
    """
    placed = positions(materialize(rows.withColumn("older", -F.col("newest")), "sizes"), ["group_id"], ["older", "id"])
    placed = placed.withColumn("cell", F.floor(F.col("position") / cell)).withColumn("used", F.when(F.col("position") == 0, F.least("size", F.lit(budget))).otherwise(F.col("size") + 2))
    before = Window.partitionBy("group_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    cells = placed.groupBy("group_id", "cell").agg(F.sum("used").alias("sum")).withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    within = placed.join(cells.filter((F.col("before") <= budget) | (F.col("cell") == 0)).select("group_id", "cell", "before"), ["group_id", "cell"])
    inside = Window.partitionBy("group_id", "cell").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = within.withColumn("upto", F.col("before") + F.sum("used").over(inside)).filter((F.col("position") == 0) | (F.col("upto") <= budget))
    return fits.select("group_id", "id", "size", (F.col("position") + 1).alias("k"))


def multi_transcript(groups: DataFrame, conversations: DataFrame, messages: DataFrame, budget: int = DISTILL_BUDGET) -> DataFrame:
    """For each group (group_id, id) the blocks of its conversations, newest first, until one does not fit.

    The newest is always there, cut if need be.  Which ones fit is found from their
    sizes alone, so that a group may be of any size; texts are read for those only,
    and of a conversation no line that begins beyond the budget.
    """
    head = F.concat(F.lit("=== Conversation: "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled")), F.lit(" (provider: "), "source", F.lit(") ==="))
    said = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.sum(F.length(line_of()) + 1).alias("said"))
    talks = conversations.select("id", head.alias("head"), F.coalesce("created_at_unix", F.lit(0.0)).alias("newest"))
    sized = groups.filter("group_id is not null").join(talks, "id").join(said, "id", "left").withColumn("size", F.length("head") + 1 + F.coalesce(F.col("said") - 1, F.lit(0)))
    rows = materialize(sized.select("group_id", "id", "newest", "size"), "transcript-sizes")
    kept = materialize(newest_that_fit(rows, budget), "transcript-kept")
    lines = messages.join(kept.select("id").distinct().withColumnRenamed("id", "conversation_id"), "conversation_id")
    before = Window.partitionBy("conversation_id").orderBy("sequence_index", "id").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("at", F.coalesce(F.sum(F.length(line_of()) + 1).over(before), F.lit(0))).filter(F.col("at") <= budget)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence_index", F.col("id").alias("m"), line_of().alias("line")))), lambda x: x["line"]), "\n")
    texts = lines.groupBy(F.col("conversation_id").alias("id")).agg(joined.alias("lines"))
    blocks_ = kept.join(talks.select("id", "head"), "id").join(texts, "id", "left")
    block = F.concat("head", F.lit("\n"), F.coalesce("lines", F.lit("")))
    shown = F.array_sort(F.collect_list(F.struct("k", F.when(F.col("k") == 1, F.substring(block, 1, budget)).otherwise(block).alias("block"))))
    out = blocks_.groupBy("group_id").agg(F.array_join(F.transform(shown, lambda x: x["block"]), "\n\n").alias("transcript"), F.max(F.when(F.col("k") == 1, F.col("size") > budget)).alias("cut"), F.count("*").alias("n_kept"))
    counts = rows.groupBy("group_id").agg(F.count("*").alias("n_conversations"))
    return out.join(counts, "group_id").select("group_id", "transcript", (F.col("cut") | (F.col("n_kept") < F.col("n_conversations"))).alias("truncated"), "n_conversations", "n_kept")


def distillation(groups: DataFrame, conversations: DataFrame, messages: DataFrame, now: str, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """A distillation record for each group; the text is the model's, else the stub's."""
    facts = groups.join(conversations, "id").join(messages.groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    facts = facts.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("id", "title", "source"))).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("message_count"))
    rows = facts.join(multi_transcript(groups, conversations, messages), "group_id")
    done = complete(rows, "transcript", "distillation_text", model)
    return done.select(F.concat(F.lit("distillation:"), F.col("group_id").cast("string")).alias("distillation_id"), F.transform("c", lambda x: T.stable_id("imported_conversation", x["id"])).alias("source_conversation_ids"), F.transform("c", lambda x: x["title"]).alias("source_titles"), F.array_distinct(F.transform("c", lambda x: x["source"])).alias("providers"), "distillation_text", F.size("c").alias("conversation_count"), "message_count", F.col("truncated").alias("input_truncated"), F.lit(now).alias("generation_timestamp"))


def digests(scans: DataFrame, conversations: DataFrame, messages: DataFrame, now: str, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """C4: a digest for each topic cluster of topic scans."""
    topic = scans.select("scan_id", F.explode("clusters").alias("c")).select(F.concat_ws(":", "scan_id", "c.topic").alias("group_id"), F.col("c.topic").alias("topic_label"), F.explode("c.ids").alias("stable_id"))
    groups = topic.withColumn("id", T.stable_number(F.col("stable_id"), "imported_conversation"))
    labels = groups.select("group_id", "topic_label").distinct()
    return distillation(groups.select("group_id", "id"), conversations, messages, now, model).withColumn("group_id", F.regexp_replace("distillation_id", "^distillation:", "")).join(labels, "group_id").select(F.concat(F.lit("digest:"), "group_id").alias("digest_id"), "topic_label", "source_conversation_ids", F.col("source_titles").alias("titles"), F.col("distillation_text").alias("digest_text"), "generation_timestamp")


def summaries(conversations: DataFrame, messages: DataFrame, now: str, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """A summary record for each conversation."""
    rows = complete(transcript(messages), "transcript", "summary_text", model)
    return rows.join(conversations.select(F.col("id").alias("conversation_id"), "title"), "conversation_id").select(F.concat(F.lit("summary:"), F.col("conversation_id").cast("string")).alias("summary_id"), T.stable_id("imported_conversation", F.col("conversation_id")).alias("source_conversation_id"), "title", "summary_text", F.lit(now).alias("generation_timestamp"))


def stub(c: Column) -> Column:
    """C11: a deterministic reply: the text's length and beginning."""
    return F.concat(F.lit("[stub reply to "), F.length(c).cast("string"), F.lit(" characters] "), F.substring(T.squeeze(c), 1, 120))


def complete(rows: DataFrame, prompt: str, out: str, model: Callable[[list[str]], list[str]] | None) -> DataFrame:
    """C11: a reply column by a user's batch function of prompts, or by the stub."""
    if model is None:
        return rows.withColumn(out, stub(F.col(prompt)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: model(b[prompt].tolist())})

    return rows.mapInPandas(run, rows.select("*", F.lit("").alias(out)).schema)


def reply_object(c: Column) -> Column:
    """a model's reply as a JSON object of lists, code fences taken off; null if it is none."""
    bare = T.strip(F.regexp_replace(F.regexp_replace(T.strip(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    return F.when(F.coalesce(bare.startswith("{"), F.lit(False)) & F.try_parse_json(bare).isNotNull(), F.from_json(bare, "map<string,string>"))


def packets(replies: DataFrame, now: str) -> DataFrame:
    """Typed artifacts of replies (conversation_id, reply); a reply that is no object gives one row with an error."""
    sections = [t for t in ARTIFACT_TYPES if t != "bridge"]
    obj = reply_object(F.col("reply"))

    def lines(v: Column) -> Column:
        many = F.from_json(v, "array<string>")
        return F.when(v.startswith("["), many).otherwise(F.array(v))

    rows = replies.withColumn("o", obj)
    made = F.filter(F.array(*(F.struct(F.lit(t).alias("artifact_type"), lines(F.try_element_at("o", F.lit(t))).alias("items")) for t in sections)), lambda a: F.size(F.filter(a["items"], lambda x: F.coalesce(T.strip(x), F.lit("")) != "")) > 0)
    error = F.when(F.col("o").isNull(), "reply is no JSON object")
    rows = rows.select("conversation_id", F.explode_outer(made).alias("a"), error.alias("error")).filter("a is not null or error is not null")
    text = F.when(F.size("a.items") == 1, F.element_at("a.items", 1)).otherwise(F.array_join(F.transform("a.items", lambda x: F.concat(F.lit("- "), x)), "\n"))
    stable = T.stable_id("imported_conversation", F.col("conversation_id"))
    return rows.select(F.concat(F.lit("continuity_artifact:"), F.sha2(F.concat_ws("|", stable, F.col("a.artifact_type"), F.lit(now)), 256)).alias("artifact_id"), F.col("a.artifact_type").alias("artifact_type"), F.array(stable).alias("source_conversation_ids"), F.lit(now).alias("generation_timestamp"), F.lit("stub").alias("llm_provider_used"), F.lit("packet-v1").alias("prompt_template_version"), text.alias("content_text"), F.when(F.col("a").isNotNull(), F.create_map(F.col("a.artifact_type"), F.col("a.items"))).alias("content_json"), "error")


def artifact_problems(artifacts: DataFrame) -> DataFrame:
    """artifact_id and the list of rules that each artifact breaks."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = [
        (~F.coalesce(F.col("artifact_id").startswith("continuity_artifact:"), F.lit(False)), "artifact_id must start with 'continuity_artifact:'"),
        (~F.coalesce(F.col("artifact_type").isin(*ARTIFACT_TYPES), F.lit(False)), "artifact_type must be one of the known types"),
        (F.coalesce(F.size("source_conversation_ids"), F.lit(0)) < 1, "source_conversation_ids must not be empty"),
        (blank("generation_timestamp"), "generation_timestamp is required"),
        (blank("llm_provider_used"), "llm_provider_used is required"),
        (blank("prompt_template_version"), "prompt_template_version is required"),
        (blank("content_text"), "content_text is required"),
    ]
    return artifacts.select("artifact_id", F.array_compact(F.array(*(F.when(broken, F.lit(said)) for broken, said in rules))).alias("problems"))


def section(heading: str, body: Column) -> Column:
    bare = T.strip(F.coalesce(body, F.lit("")))
    return F.when(bare != "", F.concat(F.lit(f"## {heading}\n"), bare, F.lit("\n")))


def latest_by_type(artifacts: DataFrame, key: str = "conversation_id") -> DataFrame:
    """The newest text and items of each type, one row for each conversation (key)."""
    newest = lambda t, c: F.max_by(F.when(F.col("artifact_type") == t, F.col(c)), F.when(F.col("artifact_type") == t, F.struct("generation_timestamp", "artifact_id")))
    cols = [newest(t, "content_text").alias(t) for t in ARTIFACT_TYPES if t != "bridge"]
    return artifacts.groupBy(key).agg(*cols, F.max_by(F.when(F.col("artifact_type") == "open_loops", F.try_element_at("content_json", F.lit("open_loops"))), F.when(F.col("artifact_type") == "open_loops", F.struct("generation_timestamp", "artifact_id"))).alias("loops"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_conversation_ids")))).alias("sources"), F.array_sort(F.collect_set("artifact_id")).alias("artifact_ids"))


def bridges(artifacts: DataFrame, titles: DataFrame, parents: DataFrame | None = None, budget: int = BRIDGE_BUDGET) -> DataFrame:
    """conversation_id, bridge_text, source ids and parent artifact ids.

    artifacts have conversation_id, titles (conversation_id, title), parents
    (conversation_id, parent_id): artifacts of parents give the prior context.
    """
    own = latest_by_type(artifacts).join(titles, "conversation_id", "left")
    if parents is None:
        own = own.withColumns({"p_summary": F.lit(None).cast("string"), "p_decisions": F.lit(None).cast("string"), "p_sources": F.array().cast("array<string>"), "parent_packet_ids": F.array().cast("array<string>")})
    else:
        theirs = latest_by_type(parents.join(artifacts.withColumnRenamed("conversation_id", "parent_id"), "parent_id"))
        none = F.array().cast("array<string>")
        own = own.join(theirs.select("conversation_id", F.col("summary").alias("p_summary"), F.col("decisions").alias("p_decisions"), F.col("sources").alias("p_sources"), F.col("artifact_ids").alias("parent_packet_ids")), "conversation_id", "left").withColumns({"p_sources": F.coalesce("p_sources", none), "parent_packet_ids": F.coalesce("parent_packet_ids", none)})
    filled = lambda c: F.when(T.strip(F.coalesce(c, F.lit(""))) != "", F.col(c))
    prior = F.array_join(F.array_compact(F.array(filled("p_summary"), filled("p_decisions"))), "\n\n")
    seed = F.when(F.size("loops") > 0, F.concat(F.lit("Continue from these open threads:\n"), F.array_join(F.transform(F.slice("loops", 1, 5), lambda x: F.concat(F.lit("- "), x)), "\n"))).when(T.strip(F.coalesce("open_loops", F.lit(""))) != "", F.concat(F.lit("Continue from these open threads:\n"), T.strip(F.col("open_loops"))))
    parts = F.array(
        F.concat(F.lit("# Continuity Bridge"), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(": "), "title")).otherwise("")),
        F.lit("*Derived handoff — not canonical.*\n"),
        section("Prior Objective", F.col("summary")),
        section("Prior Context (from parent)", prior),
        section("Key Decisions", F.col("decisions")),
        section("Open Loops", F.col("open_loops")),
        section("Key Entities", F.col("entity_map")),
        section("Suggested Next Step", seed),
    )
    text = T.cut_at_line(F.array_join(F.array_compact(parts), "\n"), budget, "\n[truncated]")
    return own.select("conversation_id", text.alias("bridge_text"), F.array_sort(F.array_union(F.col("sources"), F.col("p_sources"))).alias("source_conversation_ids"), "parent_packet_ids")


def briefing(bridge: Column, wanted: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """Sections of a bridge by heading; each key takes the first of its aliases, and ``full`` the text without any."""
    parts = F.filter(F.split(bridge, r"(?m)^## "), lambda p: F.contains(p, F.lit("\n")))
    named = F.map_from_entries(F.transform(F.slice(parts, 2, 1 << 20), lambda p: F.struct(T.strip(F.substring_index(p, "\n", 1)).alias("k"), T.strip(F.substring(p, F.instr(p, F.lit("\n")) + 1, F.length(p))).alias("v"))))
    out = {key: F.coalesce(*(F.try_element_at(named, F.lit(a)) for a in aliases)) for key, aliases in wanted.items()}
    return {**out, "full": F.when(F.coalesce(*out.values()).isNull(), T.strip(bridge))}


def open_loops(artifacts: DataFrame, conversations: DataFrame) -> DataFrame:
    """Each open loop with the first of its conversations that is in the ledger."""
    rows = artifacts.filter("artifact_type = 'open_loops'")
    bullets = F.transform(F.split(F.coalesce("content_text", F.lit("")), "\n"), lambda x: T.strip(F.regexp_replace(T.strip(x), r"^[-*•]\s*", "")))
    texts = F.coalesce(F.try_element_at("content_json", F.lit("open_loops")), bullets)
    loops = rows.select("artifact_id", "source_conversation_ids", F.posexplode(texts).alias("nth", "loop")).filter("loop <> ''")
    from convlake.operators.browse import resolve_first

    named = resolve_first(rows, "artifact_id", "source_conversation_ids", conversations)
    return loops.join(named, "artifact_id", "left").select("artifact_id", "nth", "loop", "stable_id", "title")


def topic_reply(replies: DataFrame, known: DataFrame) -> DataFrame:
    """clusters of topic replies (scan_id, reply): TOPIC, IDS and CONFIDENCE lines; kept are those with two or more known ids."""
    lines = replies.select("scan_id", F.posexplode(F.split("reply", "\n")).alias("at", "line")).withColumn("line", T.strip(F.col("line")))
    by = Window.partitionBy("scan_id").orderBy("at")
    rows = lines.withColumn("n", F.sum(F.col("line").startswith("TOPIC:").cast("int")).over(by)).filter("n > 0")
    after = lambda k: F.max(F.when(F.col("line").startswith(f"{k}:"), T.strip(F.substring("line", len(k) + 2, 1 << 20))))
    clusters = rows.groupBy("scan_id", "n").agg(after("TOPIC").alias("topic"), after("IDS").alias("ids"), F.lower(after("CONFIDENCE")).alias("confidence"))
    each = clusters.select("scan_id", "n", "topic", "confidence", F.explode(F.split("ids", r"[,\s]+")).alias("x")).withColumn("id", F.col("x").try_cast("long")).filter("id is not null").distinct()
    return each.join(known.select("id"), "id", "left_semi").groupBy("scan_id", "n", "topic", "confidence").agg(F.array_sort(F.collect_set("id")).alias("ids")).filter(F.size("ids") >= 2).drop("n")
