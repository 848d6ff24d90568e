"""Topics, threads and lineage of conversations, from titles, times and first messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.operators.components import components
from convlake.operators.ranking import global_index, positions
from convlake.schemas import CONTINUATION_PHRASES, LINEAGE_STOPWORDS, THREAD_STOPWORDS, TOPIC_STOPWORDS
from convlake.shared import materialize

NEAR_SECONDS = 48 * 3600


def thread_words(title: Column) -> Column:
    """Distinct words of two or more characters, punctuation as blanks, without stopwords."""
    parts = F.split(T.squeeze(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\p{Punct}", " ")), " ")
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 2) & ~w.isin(*THREAD_STOPWORDS)))


def topic_members(conversations: DataFrame, most: int = 5) -> DataFrame:
    """Topic, rank, n and id, a row for each member: words that most titles share (ties by word), unless earlier topics hold all their members."""
    worded = conversations.select("id", F.explode(T.words_of(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled")), "[a-zA-Z]{3,}", TOPIC_STOPWORDS)).alias("word"))
    counts = worded.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")
    order = Window.orderBy(F.desc("n"), "word")  # over ``most`` rows
    top = materialize(counts.orderBy(F.desc("n"), "word").limit(most).withColumn("rank", F.row_number().over(order)), "topic-words")
    # a conversation has at most ``most`` of the words
    members = worded.join(F.broadcast(top), "word").groupBy("id").agg(F.collect_list(F.struct("rank", "word", "n")).alias("t"), F.min("rank").alias("first"))
    members = materialize(members.select("id", "first", F.explode("t").alias("t")).select("id", "first", "t.*"), "topic-members")
    kept = members.filter("first = rank").select("rank").distinct()  # at most ``most`` rows
    return members.join(F.broadcast(kept), "rank").select(T.capitalized(F.col("word")).alias("topic"), "rank", "n", "id")


def topic_scan(conversations: DataFrame, scan_id: str, created_at: str, newest: int = 50) -> DataFrame:
    """One record with the topics of the newest conversations."""
    recent = conversations.orderBy(F.desc("id")).limit(newest)
    # at most ``newest`` members
    found = topic_members(recent).groupBy("topic", "rank").agg(F.array_sort(F.collect_list("id")).alias("members"))
    clusters = found.select(F.struct("topic", F.transform("members", lambda m: T.stable_id("imported_conversation", m)).alias("ids"), F.lit("low").alias("confidence"), "rank").alias("c"))
    return clusters.agg(F.array_sort(F.collect_list("c"), lambda a, b: a["rank"] - b["rank"]).alias("clusters")).select(F.lit(scan_id).alias("scan_id"), F.lit(created_at).alias("generation_timestamp"), F.lit("keyword").alias("llm_provider_used"), "clusters", F.lit("canonical_conversations").alias("derived_from"), F.lit("topic_scan_v1").alias("artifact_kind"))


def thread_edges(conversations: DataFrame) -> DataFrame:
    """Edges (src, dst) whose components are those of all similar pairs, linear in words.

    Similar are two shared title words, or one within 48 hours.  All conversations
    with a pair of words are linked to the first of them.  For a single word, time
    is cut in stretches of 48 hours: those of one stretch are linked to its first,
    and neighbouring stretches where the last of one and the first of the next are
    near enough, as any near pair across them implies that this pair is.
    """
    words = materialize(conversations.select("id", F.col("created_at_unix").alias("at"), thread_words(F.col("title")).alias("words")), "thread-words")
    pairs = words.select("id", F.explode(F.flatten(F.transform("words", lambda a: F.transform(F.filter("words", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("id", "p.a", "p.b")
    by_pair = pairs.join(pairs.groupBy("a", "b").agg(F.min("id").alias("dst")), ["a", "b"]).select(F.col("id").alias("src"), "dst")
    timed = words.filter("at is not null").select("id", "at", F.explode("words").alias("word"), F.floor(F.col("at") / NEAR_SECONDS).alias("stretch"))
    ends = timed.groupBy("word", "stretch").agg(F.min(F.struct("at", "id")).alias("first"), F.max(F.struct("at", "id")).alias("last"))
    by_word = timed.join(ends.select("word", "stretch", F.col("first.id").alias("dst")), ["word", "stretch"]).select(F.col("id").alias("src"), "dst")
    after = ends.select("word", (F.col("stretch") - 1).alias("stretch"), F.col("first").alias("then"))
    across = ends.join(after, ["word", "stretch"]).filter(F.col("then.at") - F.col("last.at") <= NEAR_SECONDS).select(F.col("last.id").alias("src"), F.col("then.id").alias("dst"))
    return by_pair.union(by_word).union(across).filter("src <> dst").distinct()


def thread_members(conversations: DataFrame) -> DataFrame:
    """(id, thread) of every conversation in a thread of two or more; the thread is its smallest id."""
    return components(thread_edges(conversations)).select(F.col("node").alias("id"), F.col("component").alias("thread"))


def threads(conversations: DataFrame, messages: DataFrame, most: int | None = 5, member: DataFrame | None = None) -> DataFrame:
    """Thread, label, size, first_unix, last_unix, date_range and total_messages, the largest first.

    The members are the rows of :func:`thread_members` (``member``, if it is there
    already), in the order of :func:`thread_places`: a thread may have any number.
    """
    member = materialize(thread_members(conversations), "thread-members") if member is None else member
    rows = conversations.join(member, "id")
    counts = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("messages"))
    rows = rows.join(counts, "id", "left")
    at = F.coalesce(F.nullif(F.col("created_at_unix"), F.lit(0.0)), F.nullif(F.col("updated_at_unix"), F.lit(0.0)))
    facts = rows.groupBy("thread").agg(F.count("*").alias("size"), F.min(at).alias("first_unix"), F.max(at).alias("last_unix"), F.coalesce(F.sum("messages"), F.lit(0)).alias("total_messages"))
    shared = rows.select("thread", F.explode(thread_words(F.col("title"))).alias("word")).groupBy("thread", "word").agg(F.count("*").alias("n")).filter("n >= 2")
    order = Window.partitionBy("thread").orderBy(F.desc("n"), "word")
    # the filter on the row's number lets each task keep three words of a thread before they are dealt out
    best = shared.withColumn("k", F.row_number().over(order)).filter("k <= 3").groupBy("thread").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("words"))
    label = F.coalesce(F.concat(F.upper(F.substring("words", 1, 1)), F.substring("words", 2, 1 << 30)), F.lit("Related conversations"))
    out = facts.join(best, "thread", "left").select("thread", label.alias("label"), "size", "first_unix", "last_unix", T.date_range(F.col("first_unix"), F.col("last_unix")).alias("date_range"), "total_messages")
    return out if most is None else out.orderBy(F.desc("size"), "label", "thread").limit(most)


def thread_places(conversations: DataFrame, member: DataFrame) -> DataFrame:
    """Thread, id and place (from 0) of every member, the newest first."""
    rows = member.join(conversations.select("id", (-F.coalesce("created_at_unix", F.lit(0.0))).alias("late")), "id")
    return positions(materialize(rows.select("thread", "id", "late"), "thread-times"), ["thread"], ["late", "id"], "place").drop("late")


def previews(messages: DataFrame, n: int) -> DataFrame:
    """conversation_id and its first n message texts."""
    order = Window.partitionBy("conversation_id").orderBy("sequence_index", "id")
    first = messages.select("conversation_id", "content", F.row_number().over(order).alias("k")).filter(F.col("k") <= n)
    return first.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "content"))), lambda x: x["content"]).alias("previews"))


def described(conversations: DataFrame, messages: DataFrame, n: int = 3) -> DataFrame:
    """What lineage compares: id, title, at, title words, content words, continuation phrase."""
    rows = conversations.join(previews(messages, n).withColumnRenamed("conversation_id", "id"), "id", "left")
    early = F.lower(F.array_join(F.slice(F.coalesce("previews", F.array().cast("array<string>")), 1, 2), " "))
    phrase = F.get(F.filter(F.array(*(F.lit(p) for p in CONTINUATION_PHRASES)), lambda p: F.contains(early, p)), F.lit(0))
    text = F.array_join(F.slice(F.coalesce("previews", F.array().cast("array<string>")), 1, 5), " ")
    return rows.select("id", "title", F.col("created_at_unix").alias("at"), T.words_of(F.col("title"), "[a-zA-Z]{3,}", LINEAGE_STOPWORDS).alias("title_words"), T.words_of(text, "[a-zA-Z]{3,}", LINEAGE_STOPWORDS).alias("content_words"), phrase.alias("phrase"))


def neighbours(rows: DataFrame, reach: int = 25) -> DataFrame:
    """Pairs (source, target) of rows at most ``reach`` places apart by creation.

    Places are cut in blocks of twice the reach; a row is a source in its own block
    and a target in that and the two beside it, so that it is sent four times in all.
    """
    placed = materialize(global_index(rows, [F.coalesce("at", F.lit(0.0)), F.col("id")]), "placed")
    block = F.floor(F.col("position") / (2 * reach))
    left = placed.select(F.struct(*rows.columns).alias("source"), F.col("position").alias("at_source"), block.alias("block"))
    right = placed.select(F.struct(*rows.columns).alias("target"), F.col("position").alias("at_target"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    apart = F.abs(F.col("at_source") - F.col("at_target"))
    return left.join(right, "block").filter(apart.between(1, reach)).select("source", "target")


def newest_others(rows: DataFrame, sources: DataFrame, most: int = 50) -> DataFrame:
    """Each source with the newest ``most`` other conversations."""
    newest = F.broadcast(rows.orderBy(F.desc("id")).limit(most + 1).select(F.struct(*rows.columns).alias("target")))
    pairs = sources.select(F.struct(*rows.columns).alias("source")).join(newest, F.col("source.id") != F.col("target.id"))  # most + 1 rows
    order = Window.partitionBy("source.id").orderBy(F.desc("target.id"))
    return pairs.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")


def lineage(pairs: DataFrame, limit: int = 3, least: float = 0.15) -> DataFrame:
    """Each source's best links with relation, confidence and signals."""
    s, t = (lambda c: F.col(f"source.{c}")), (lambda c: F.col(f"target.{c}"))

    def jaccard(words: str, floor: float) -> tuple[Column, Column]:
        both = F.array_intersect(s(words), t(words))
        share = F.size(both) / F.size(F.array_union(s(words), t(words)))
        some = (F.size(s(words)) > 0) & (F.size(t(words)) > 0) & (share >= floor)
        return F.when(some, share).otherwise(0.0), F.when(some, both)

    title, title_words = jaccard("title_words", 0.1)
    content, content_words = jaccard("content_words", 0.05)
    hours = F.abs(s("at") - t("at")) / 3600
    time = F.when(hours <= 48, 1.0).when(hours <= 168, 0.5).when(hours <= 720, 0.2).otherwise(0.0)
    scored = pairs.select("source", "target", title.alias("title"), time.alias("time"), F.least(content * 1.5, F.lit(1.0)).alias("content"), F.when(s("phrase").isNotNull(), 1.0).otherwise(0.0).alias("phrase"), title_words.alias("title_words"), content_words.alias("content_words"), hours.alias("hours"))
    scored = scored.withColumn("score", F.col("title") * 0.40 + F.col("time") * 0.20 + F.col("content") * 0.30 + F.col("phrase") * 0.10).filter(F.col("score") >= least)
    relation = (
        F.when((F.col("phrase") > 0) | ((F.col("time") >= 1.0) & (F.col("title") >= 0.2)), "continues")
        .when((F.col("title") >= 0.5) & (F.coalesce(t("at"), F.lit(0.0)) != 0) & (F.coalesce(s("at"), F.lit(0.0)) != 0) & (t("at") > s("at")), "supersedes")
        .when((F.col("title") >= 0.2) & (F.col("time") <= 0.2), "revisits")
        .otherwise("forks_from")
    )
    signals = F.array_compact(
        F.array(
            F.concat(F.lit("title overlap ("), F.array_join(F.slice(F.array_sort("title_words"), 1, 5), ", "), F.lit(")")),
            F.when(F.col("hours") <= 48, "within 48 hours").when(F.col("hours") <= 168, "within 7 days").when(F.col("hours") <= 720, "within 30 days"),
            F.concat(F.size("content_words").cast("string"), F.lit(" shared content keywords")),
            F.concat(F.lit('continuation phrase: "'), s("phrase"), F.lit('"')),
        )
    )
    order = Window.partitionBy("source.id").orderBy(F.desc(F.round("score", 3)), "target.id")
    return scored.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= limit).select(s("id").alias("source_conversation_id"), t("id").alias("target_conversation_id"), t("title").alias("target_title"), relation.alias("relation_type"), F.round("score", 3).alias("confidence"), signals.alias("signals"))
