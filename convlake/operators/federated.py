"""Keyword search and grounded answers over both lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.operators.browse import has, keyword_search, newest_imported
from convlake.operators.search import tokens
from convlake.schemas import IMPORTED_LANE, NATIVE_LANE, QUESTION_STOPWORDS
from convlake.shared import materialize

HIT = ("source_lane", "stable_id", "title", "timestamp_unix", "source_metadata", "evidence_text", "starred")


def note_hits(notes: DataFrame) -> DataFrame:
    meta = F.create_map(F.lit("role"), F.col("role"), F.lit("tags"), F.coalesce("tags", F.lit("")))
    return notes.select(F.lit(NATIVE_LANE).alias("source_lane"), T.stable_id("memory", F.col("id")).alias("stable_id"), F.col("content").alias("title"), F.col("timestamp").cast("double").alias("timestamp_unix"), meta.alias("source_metadata"), F.lit(None).cast("string").alias("evidence_text"), F.coalesce("is_starred", F.lit(False)).alias("starred"))


def conversation_hits(conversations: DataFrame, evidence: Column) -> DataFrame:
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("source_conversation_id"), F.col("source_conversation_id"))
    at = F.coalesce(F.nullif(F.col("updated_at_unix"), F.lit(0.0)), F.col("created_at_unix"))
    return conversations.select(F.lit(IMPORTED_LANE).alias("source_lane"), T.stable_id("imported_conversation", F.col("id")).alias("stable_id"), "title", at.alias("timestamp_unix"), meta.alias("source_metadata"), evidence.alias("evidence_text"), F.coalesce("is_starred", F.lit(False)).alias("starred"))


def merged_order() -> list[Column]:
    """K2, with lane and id against ties."""
    return [F.col("timestamp_unix").desc_nulls_last(), F.col("source_lane"), F.col("stable_id")]


def federated_search(conversations: DataFrame, messages: DataFrame, notes: DataFrame, keyword: str, per_lane: int = 25) -> DataFrame:
    """The newest hits of each lane, imported ones with their first matching message as evidence."""
    keyword = keyword.strip()
    noted = notes.filter(has(F.col("content"), keyword)) if keyword else notes
    noted = note_hits(noted.orderBy(F.desc("timestamp"), F.desc("id")).limit(per_lane))
    found = keyword_search(conversations, messages, keyword).orderBy(*newest_imported()).limit(per_lane)
    if not keyword:
        return noted.unionByName(conversation_hits(found, F.lit(None).cast("string"))).orderBy(*merged_order())
    first = messages.filter(has(F.col("content"), keyword)).join(found.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi").groupBy("conversation_id").agg(F.min_by("content", F.struct("sequence_index", "id")).alias("evidence"))
    with_evidence = found.join(first.withColumnRenamed("conversation_id", "id"), "id", "left")
    return noted.unionByName(conversation_hits(with_evidence, F.col("evidence"))).orderBy(*merged_order())


def question_terms(question: Column) -> Column:
    """Words of four or more ASCII letters and digits, without stopwords, in order of first use."""
    found = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 4) & ~w.isin(*QUESTION_STOPWORDS)))


def evidence_of(hit: dict[str, Column]) -> Column:
    """The matched message, else title, tags, role and source."""
    m = hit["source_metadata"]
    parts = F.array(T.strip(hit["title"]), *(T.strip(F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))) for k in ("tags", "role", "source", "source_conversation_id")))
    return F.coalesce(F.nullif(hit["evidence_text"], F.lit("")), F.array_join(F.filter(parts, lambda p: p != ""), " "))


def batch_hits(questions: DataFrame, conversations: DataFrame, messages: DataFrame, notes: DataFrame, per_lane: int = 10, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """The best of the newest hits of each lane for every question (question_id, question): texts with any of its terms as a word; and their summaries.

    The newest hits are found once for each term in use; those of a question are
    among the newest of its terms, so that a common word asked often costs no more.
    A text is compared with a question's terms where the two are joined and goes no
    further; summaries are a table of their own, for readers of the answers' texts.
    """
    terms = materialize(questions.select("question_id", question_terms(F.col("question")).alias("terms")), "question-terms")
    asked = terms.select("question_id", F.explode("terms").alias("term"))
    used = asked.select("term").distinct()

    def worded(df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, F.explode(F.array_distinct(tokens(F.col("content")))).alias("term")).join(used, "term", "left_semi")

    by_conversation = worded(messages, "conversation_id", "sequence_index", "id").groupBy("term", "conversation_id").agg(F.min(F.struct("sequence_index", "id")).alias("place"))
    imported = by_conversation.join(conversations.withColumnRenamed("id", "conversation_id"), "conversation_id").withColumn("id", F.col("conversation_id"))
    newest = Window.partitionBy("term").orderBy(*newest_imported())
    imported = imported.withColumn("__nth", F.row_number().over(newest)).filter(F.col("__nth") <= per_lane)
    per_question = asked.join(imported, "term").groupBy("question_id", "id").agg(F.min("place").alias("place"), *(F.any_value(c).alias(c) for c in ("title", "source", "source_conversation_id", "created_at_unix", "updated_at_unix", "is_starred")))
    newest = Window.partitionBy("question_id").orderBy(*newest_imported())
    kept = per_question.withColumn("__nth", F.row_number().over(newest)).filter(F.col("__nth") <= per_lane).withColumn("message_id", F.col("place.id"))
    kept = materialize(kept.drop("place", "__nth"), "imported-hits")
    noted = worded(notes, "id", "timestamp")
    newest = Window.partitionBy("term").orderBy(F.desc("timestamp"), F.desc("id"))
    noted = asked.join(noted.withColumn("__nth", F.row_number().over(newest)).filter(F.col("__nth") <= per_lane), "term").select("question_id", "id", "timestamp").distinct()
    newest = Window.partitionBy("question_id").orderBy(F.desc("timestamp"), F.desc("id"))
    noted = noted.withColumn("__nth", F.row_number().over(newest)).filter(F.col("__nth") <= per_lane).select("question_id", F.col("id").alias("note_id"))
    noted = materialize(noted, "note-hits")

    said = messages.select(F.col("id").alias("message_id"), F.col("content").alias("evidence"))
    lanes = lambda pairs, own: pairs.join(said, "message_id").select("question_id", *conversation_columns(), *own)
    compared = F.lower(evidence_of({c: F.col(c) for c in HIT}))
    overlap = F.size(F.filter("terms", lambda t: F.contains(F.col("compared"), t))).alias("overlap")
    slim = ("question_id", "source_lane", "stable_id", "timestamp_unix")
    first_lane = lanes(kept.join(terms, "question_id"), ("terms",)).withColumn("compared", compared).select(*slim, overlap)
    found = notes.join(noted.select(F.col("note_id").alias("id")).distinct(), "id", "left_semi")
    own = note_hits(found).withColumn("compared", compared).select("stable_id", "source_lane", "timestamp_unix", "compared")
    pairs = noted.join(terms, "question_id").withColumn("stable_id", T.stable_id("memory", F.col("note_id")))
    scored = first_lane.unionByName(pairs.join(own, "stable_id").select(*slim, overlap))
    order = Window.partitionBy("question_id").orderBy(F.desc("overlap"), *merged_order())
    best = materialize(scored.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top).select(*slim, "overlap", "nth"), "best-hits")
    imported = best.filter(F.col("source_lane") == IMPORTED_LANE).select("question_id", F.col("stable_id").alias("sid"), "nth")
    imported = lanes(kept.join(imported, "question_id").filter(F.col("sid") == T.stable_id("imported_conversation", F.col("id"))), ("nth",)).select("question_id", "nth", summary().alias("summary"))
    written = best.filter(F.col("source_lane") == NATIVE_LANE).select("question_id", "nth", "stable_id").join(note_hits(notes).select("stable_id", summary().alias("summary")), "stable_id")
    return best, imported.unionByName(written.drop("stable_id"))


def summary() -> Column:
    """What an answer shows of a hit."""
    snippet = T.cut(T.strip(F.col("evidence_text")), 200)
    source = T.strip(F.coalesce(F.try_element_at("source_metadata", F.lit("source")), F.lit("")))
    tags = T.strip(F.coalesce(F.try_element_at("source_metadata", F.lit("tags")), F.lit("")))
    title = T.strip(F.col("title"))
    quoted = F.concat(F.lit('"'), snippet, F.lit('" — from "'), title, F.lit('"'), F.when(source != "", F.concat(F.lit(" ("), source, F.lit(")"))).otherwise(""))
    plain = F.when(tags != "", F.concat(title, F.lit(" (tags: "), tags, F.lit(")"))).when(source != "", F.concat(title, F.lit(" (source: "), source, F.lit(")"))).otherwise(title)
    return F.when(F.coalesce("evidence_text", F.lit("")) != "", quoted).otherwise(plain)


def conversation_columns() -> list[Column]:
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("source_conversation_id"), F.col("source_conversation_id"))
    at = F.coalesce(F.nullif(F.col("updated_at_unix"), F.lit(0.0)), F.col("created_at_unix"))
    return [F.lit(IMPORTED_LANE).alias("source_lane"), T.stable_id("imported_conversation", F.col("id")).alias("stable_id"), F.col("title"), at.alias("timestamp_unix"), meta.alias("source_metadata"), F.col("evidence").alias("evidence_text"), F.coalesce("is_starred", F.lit(False)).alias("starred")]


def answered(questions: DataFrame, conversations: DataFrame, messages: DataFrame, notes: DataFrame) -> DataFrame:
    """T12, T13 for every question (question_id, question) of both lanes; one that is asked often is answered once."""
    once = materialize(questions.groupBy(F.col("question").alias("asked")).agg(F.min("question_id").alias("first_id")), "questions")
    own = once.select(F.col("first_id").alias("question_id"), F.col("asked").alias("question"))
    told = answers(own, *batch_hits(own, conversations, messages, notes)).withColumnRenamed("question_id", "first_id")
    asked = questions.join(once, F.col("question").eqNullSafe(F.col("asked"))).select("question_id", "first_id")
    return asked.join(told, "first_id").drop("first_id")


def answers(questions: DataFrame, best: DataFrame, summaries: DataFrame) -> DataFrame:
    """question_id, status, n_terms, best, second, lanes, citations, answer_text, note for every question, from its best hits and their summaries (batch_hits)."""
    asked = questions.select("question_id", T.strip(F.col("question")).alias("question"), question_terms(F.col("question")).alias("terms"))
    cited = best.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("nth", "source_lane", "stable_id", T.iso(F.col("timestamp_unix")).alias("timestamp"), "overlap"))).alias("c"))
    # one row for each question, so that it is not read at all where no text of an answer is
    told = summaries.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("nth", "summary"))).alias("told"))
    rows = asked.join(cited, "question_id", "left").withColumn("c", F.coalesce("c", F.expr("array()").cast(cited.schema["c"].dataType)))
    rows = rows.join(told, "question_id", "left").withColumn("told", F.coalesce("told", F.expr("array()").cast(told.schema["told"].dataType)))
    citations = F.zip_with("c", "told", lambda x, t: F.struct(*(x[k].alias(k) for k in ("nth", "source_lane", "stable_id", "timestamp", "overlap")), t["summary"].alias("summary")))
    first, second = F.coalesce(F.try_element_at("c", F.lit(1))["overlap"], F.lit(0)), F.coalesce(F.try_element_at("c", F.lit(2))["overlap"], F.lit(0))
    n = F.size("terms")
    ambiguous = (second > 0) & ((first == second) | ((first - second == 1) & (first < F.greatest(F.lit(3), n))))
    status = F.when((F.size("c") == 0) | (n == 0) | (first == 0), "insufficient_evidence").when(ambiguous, "ambiguous").otherwise("grounded")
    marks = F.array_join(F.transform("c", lambda x: F.concat(F.lit("["), x["nth"].cast("string"), F.lit("] "), x["stable_id"], F.lit(" ("), x["source_lane"], F.lit(")"))), "; ")
    shown = F.array_join(F.transform("told", lambda x: x["summary"]), " | ")
    q = F.col("question")
    # The sentences of answers and notes.
    text = (
        F.when(F.size("c") == 0, F.concat(F.lit("I could not find grounded evidence for '"), q, F.lit("' in canonical records. Try different keywords.")))
        .when(F.col("status") == "ambiguous", F.concat(F.lit("I found multiple plausible interpretations for '"), q, F.lit("'. Competing evidence: "), shown, F.lit(". Sources: "), marks, F.lit(".")))
        .when(F.col("status") == "grounded", F.concat(F.lit("Grounded evidence for '"), q, F.lit("': "), shown, F.lit(". Sources: "), marks, F.lit(".")))
        .otherwise(F.concat(F.lit("I found limited evidence for '"), q, F.lit("'. Evidence snippets: "), shown, F.lit(". Most relevant records: "), marks, F.lit(". Please refine the question for a stronger grounded answer.")))
    )
    note = F.when(F.size("c") == 0, "No matching records were found yet. Try different keywords or add more context.").when(n == 0, "Try a more specific question with a few distinctive keywords.").when(first == 0, "The closest records did not clearly match your wording. Try rephrasing with different terms.").when(ambiguous, "Multiple top hits plausibly match; clarify the intended interpretation.")
    rows = rows.withColumn("status", status)
    return rows.select("question_id", "question", "status", n.alias("n_terms"), first.alias("best"), second.alias("second"), F.transform("c", lambda x: x["source_lane"]).alias("lanes"), citations.alias("citations"), text.alias("answer_text"), note.alias("note"))


def traces(answered: DataFrame, created_at: str) -> DataFrame:
    """A trace row for each answer; the id is a hash, so that a rerun makes the same rows."""
    lanes = F.array_sort(F.array_distinct("lanes"))
    return answered.select(F.concat(F.lit("answer_trace:"), F.substring(F.sha2(F.concat_ws("|", "question", F.lit(created_at)), 256), 1, 32)).alias("trace_id"), F.lit(created_at).alias("created_at"), "question", F.array_join(question_terms(F.col("question")), " ").alias("retrieval_terms"), "status", "answer_text", "citations", lanes.alias("source_lanes"), F.array_compact(F.array("note")).alias("notes"), F.when(F.col("status") != "grounded", F.col("status")).alias("fallback_reason"), F.lit("canonical_ledger").alias("derived_from"), F.lit("answer_trace_v1").alias("trace_kind"))
