"""Chat notes for a vault: rendering, links, refresh of generated parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.schemas import PROVIDERS

BEGIN, END = "<!-- AUTO:BEGIN -->", "<!-- AUTO:END -->"
EMPTY = "*No intelligence data generated yet.*"


def display(source: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in PROVIDERS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, source), T.capitalized(source))


def note_name(source: Column, id_: Column) -> Column:
    return F.concat(source, F.lit("--"), id_.cast("string"))


def chat_notes(conversations: DataFrame, counts: DataFrame, summaries: DataFrame | None = None, links: DataFrame | None = None, themes: DataFrame | None = None) -> DataFrame:
    """Id, path and content of each conversation's note.

    counts (id, message_count); summaries (id, summary); links as of lineage plus
    target_source; themes (id, label).
    """
    rows = conversations.join(counts, "id", "left")
    none = F.lit(None).cast("string")
    rows = rows.join(summaries, "id", "left") if summaries is not None else rows.withColumn("summary", none)
    if links is not None:
        line = F.concat(F.lit("- [["), note_name(F.col("target_source"), F.col("target_conversation_id")), F.lit("]] — "), "relation_type", F.lit(" ("), "target_title", F.lit(")"))
        by = links.groupBy(F.col("source_conversation_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("k"), "target_conversation_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("links"))
        rows = rows.join(by, "id", "left")
    else:
        rows = rows.withColumn("links", none)
    if themes is not None:
        rows = rows.join(themes.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("label")), lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n").alias("themes")), "id", "left")
    else:
        rows = rows.withColumn("themes", none)
    day, stamp = T.day(F.col("created_at_unix")), T.iso(F.col("updated_at_unix"))
    created = F.coalesce(F.concat(F.lit("[["), day, F.lit("]]")), F.lit("unknown"))
    shown = F.concat(F.lit("[["), display(F.col("source")), F.lit("]]"))
    front = F.concat_ws(
        "\n",
        F.lit("---"),
        F.lit('type: "chat"'),
        F.concat(F.lit('stable_id: "imported_conversation:'), F.col("id").cast("string"), F.lit('"')),
        F.concat(F.lit("provider: "), T.yaml_quote(shown)),
        F.lit('lane: "imported"'),
        F.concat(F.lit("title: "), T.yaml_quote(F.col("title"))),
        F.concat(F.lit("created: "), T.yaml_quote(created)),
        F.when(stamp.isNotNull(), F.concat(F.lit("updated: "), T.yaml_quote(stamp))),
        F.lit('categories:\n  - "[[Chat]]"'),
        F.concat(F.lit('tags:\n  - "chat"\n  - "imported"\n  - '), T.yaml_quote(F.col("source"))),
        F.lit("---\n"),
    )
    head = F.concat(F.lit("# "), "title", F.lit("\n> **Provider:** "), shown, F.lit(" · **Messages:** "), F.coalesce("message_count", F.lit(0)).cast("string"), F.lit(" · **Created:** "), created, F.lit("\n"))
    part = lambda title, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), F.col(c)))
    auto = F.coalesce(F.nullif(F.concat_ws("\n\n", part("Summary", "summary"), part("Related Conversations", "links"), part("Themes", "themes")), F.lit("")), F.lit(EMPTY))
    content = F.concat(front, head, F.lit(f"{BEGIN}\n\n"), auto, F.lit(f"\n\n{END}\n"))
    return rows.select("id", F.concat(F.lit("chats/"), note_name(F.col("source"), F.col("id")), F.lit(".md")).alias("path"), content.alias("content"))


def theme_notes(themes: DataFrame, conversations: DataFrame) -> DataFrame:
    """A note for each theme (id, label) with links to its conversations."""
    rows = themes.join(conversations, "id")
    listed = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("id", "source", "title"))), lambda x: F.concat(F.lit("- [["), note_name(x["source"], x["id"]), F.lit("|"), x["title"], F.lit("]]"))), "\n")
    return rows.groupBy("label").agg(listed.alias("listed"), F.count_distinct("id").alias("n")).select(F.concat(F.lit("themes/"), F.coalesce(F.nullif(T.slug(F.col("label")), F.lit("")), F.lit("untitled")), F.lit(".md")).alias("path"), F.concat(F.lit("# "), "label", F.lit("\n\n"), F.col("n").cast("string"), F.lit(" conversations\n\n"), "listed", F.lit("\n")).alias("content"))


def daily_notes(conversations: DataFrame) -> DataFrame:
    """A note for each day with conversations; those without a time are in none."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at_unix", "id", "source", "title"))), lambda x: F.concat(F.lit("- [["), note_name(x["source"], x["id"]), F.lit("|"), x["title"], F.lit("]]"))), "\n")
    return conversations.filter("created_at_unix is not null").groupBy(T.day(F.col("created_at_unix")).alias("day")).agg(listed.alias("listed")).select(F.concat(F.lit("daily/"), "day", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "day", F.lit("\n\n"), "listed", F.lit("\n")).alias("content"))


def provider_notes(conversations: DataFrame) -> DataFrame:
    """A note for each provider with its numbers."""
    rows = conversations.groupBy("source").agg(F.count("*").alias("n"), F.min("created_at_unix").alias("first"), F.max("created_at_unix").alias("last"))
    return rows.select(F.concat(F.lit("providers/"), "source", F.lit(".md")).alias("path"), F.concat(F.lit("# "), display(F.col("source")), F.lit("\n\n"), F.col("n").cast("string"), F.lit(" conversations, "), T.date_range(F.col("first"), F.col("last")), F.lit("\n")).alias("content"))


def category_notes(categories: DataFrame) -> DataFrame:
    """A note for each category (name, folder, fields, sort_field) with a table query over its folder."""
    lines = F.concat_ws("\n", F.lit("```dataview"), F.concat(F.lit("TABLE "), F.array_join("fields", ", ")), F.concat(F.lit('FROM "'), "folder", F.lit('"')), F.concat(F.lit("SORT "), "sort_field", F.lit(" DESC")), F.lit("```\n"))
    content = F.concat(F.lit('---\ntype: "category"\n---\n# '), "name", F.lit("\n\n"), lines)
    return categories.select(F.concat(F.lit("categories/"), "name", F.lit(".md")).alias("path"), content.alias("content"))


def vault_export(files: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X11: the files (path, content) that a vault (path) lacks, and for each folder how many are written and skipped."""
    there = listing.select("path", F.lit(True).alias("there")).distinct()
    rows = files.select("path").join(there, "path", "left").groupBy(F.substring_index("path", "/", 1).alias("folder"))
    return missing_files(files, listing), rows.agg(F.count_if(F.col("there").isNull()).alias("written"), F.count("there").alias("skipped"))


def missing_files(files: DataFrame, listing: DataFrame) -> DataFrame:
    """X11: files (path, content) that a vault's listing (path) lacks."""
    return files.join(listing.select("path").distinct(), "path", "left_anti")


def refreshed(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Old notes (path, content) with the part between the marks as in the fresh ones; notes without both marks or without a fresh one stay out."""
    inside = lambda c: F.substring_index(F.substring_index(c, BEGIN, -1), END, 1)
    marked = lambda c: F.contains(c, F.lit(BEGIN)) & (F.instr(c, END) > F.instr(c, BEGIN))
    both = old.filter(marked(F.col("content"))).join(fresh.select("path", F.col("content").alias("new")), "path")
    text = F.concat(F.substring_index("content", BEGIN, 1), F.lit(BEGIN), inside(F.col("new")), F.lit(END), F.substring(F.col("content"), F.instr("content", END) + len(END), F.length("content")))
    return both.select("path", text.alias("content")).join(old.withColumnRenamed("content", "before"), "path").filter("content <> before").drop("before")


def unique_names(rows: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch, id, name): file names of titles, with the id where a batch has the name twice, and once more if that too is taken."""
    named = rows.withColumn("base", T.safe_name(F.col("title")))
    once = named.withColumn("n", F.count("*").over(Window.partitionBy(batch, "base"))).withColumn("name", F.when(F.col("n") > 1, F.concat("base", F.lit("-"), F.col("id").cast("string"))).otherwise(F.col("base")))
    order = Window.partitionBy(batch, "name").orderBy("id")
    return once.withColumn("k", F.row_number().over(order)).select(batch, "id", F.when(F.col("k") > 1, F.concat("name", F.lit("-"), F.col("id").cast("string"))).otherwise(F.col("name")).alias("name"))


def lookups(summaries: DataFrame, scans: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The newest summary of each conversation, the labels in the latest scan, the newest digest of each topic."""
    s = summaries.groupBy("source_conversation_id").agg(F.max_by("summary_text", F.struct("generation_timestamp", "summary_id")).alias("summary_text"))
    last = scans.agg(F.max_by("clusters", F.struct("generation_timestamp", "scan_id")).alias("clusters")).select(F.explode("clusters").alias("c"))
    t = last.select(F.col("c.topic").alias("label"), F.explode("c.ids").alias("stable_id")).groupBy("stable_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    d = digests.groupBy("topic_label").agg(F.max_by("digest_text", F.struct("generation_timestamp", "digest_id")).alias("digest_text"))
    return s, t, d
