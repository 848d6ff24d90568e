"""Steps whose shuffles, files and Python groups must not outgrow the input."""

import gzip
import re

import pytest
from pyspark.sql import functions as F

from convlake.operators import chunks, federated, package, search
from convlake.plans import more
from convlake.streaming import capture as S


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bExchange\b", plan.split("== Initial Plan ==")[0]))


def test_an_index_is_made_where_the_texts_are(spark):
    """No exchange of postings; documents that share kind and id are one, and nulls are ids too."""
    table = lambda rows: spark.createDataFrame(rows, "kind string, id long, content string")
    assert exchanges(search.index_rows(table([("n", 1, "runs running 7x"), ("n", 2, None)]))) == 0
    postings, lengths, forms = search.index_tables(table([("n", 1, "a run"), ("n", 1, "runs"), ("m", 1, "run"), ("m", None, "run run"), ("m", None, "\u00c9x \u0411"), ("m", 2, "")]))
    got = {(r["term"], r["kind"], r["id"]): (r["tf"], r["positions"]) for r in postings.collect()}
    assert got == {("a", "n", 1): (1, [0]), ("run", "n", 1): (2, [0, 1]), ("run", "m", 1): (1, [0]), ("run", "m", None): (2, [0, 1]), ("ex", "m", None): (1, [0]), ("\u0431", "m", None): (1, [1])}
    assert {(r["kind"], r["id"]): r["length"] for r in lengths.collect()} == {("n", 1): 3, ("m", 1): 1, ("m", None): 4, ("m", 2): 0}
    assert {tuple(r) for r in forms.collect()} == {("a", "a"), ("run", "run"), ("run", "runs"), ("ex", "ex"), ("\u0431", "\u0431")}


def test_a_large_document_has_the_postings_of_its_words(spark):
    docs = spark.range(300).select(F.lit("n").alias("kind"), "id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("w"), i % (F.col("id") + 1))), " ").alias("content"))
    got = search.index_rows(docs, stemmed=False).filter("part = 'postings'")
    assert got.count() == sum(range(1, 301))
    assert got.select(F.explode("positions").alias("p"), "id").groupBy("id").agg(F.count_distinct("p").alias("n")).filter("n <> 1000").count() == 0


def test_an_index_takes_few_words_at_a_time(spark, monkeypatch):
    """What crosses to Python in a row, and what is inverted at once, has a bound that long documents do not lift."""
    seen = []
    docs = spark.range(1, 12).select(F.lit("n").alias("kind"), "id", F.array_join(F.transform(F.sequence(F.lit(1), 700 * F.col("id")), lambda i: F.concat(F.lit("w"), i % 500)), ", ").alias("content"))
    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", lambda self, run, schema: seen.append((self, run)) or self)
        search._inverted(docs, False)
    rows, run = seen[0]
    rows = rows.coalesce(1).toArrow()
    assert max(rows["words"].combine_chunks().value_lengths().to_pylist()) == search.PIECE
    assert [len(w) for k, w in zip(rows["id"].to_pylist(), rows["words"].to_pylist(), strict=True) if k == 1] == [search.PIECE] * 5 + [60]
    monkeypatch.setattr(search, "AT_ONCE", 1000)
    made = [b for b in run(iter(rows.to_batches(max_chunksize=9))) if b["part"][0].as_py() == "postings"]
    assert max(sum(b["tf"].to_pylist()) for b in made) < 1000 + 700 * 11
    assert sum(sum(b["tf"].to_pylist()) for b in made) == 700 * 66


def test_documents_go_on_from_batch_to_batch(spark):
    """Postings, lengths and forms do not depend on where a batch ends; empty texts, nulls, marks and long documents among them."""
    long = " ".join(f"Runs{i % 300}" for i in range(1000))
    rows = [("n", 1, "a run"), ("n", 2, long), ("m", 3, ""), ("m", 4, None), (None, 5, " .. "), ("n", None, "\u00c9x run, " * 400), ("n", 6, "-".join("ab" for _ in range(128))), ("n", 7, "x" * 50_000), ("m", 8, "\u0391\u03a3.\u0392 \u0130x " * 130)]
    docs = spark.createDataFrame(rows, "kind string, id long, content string").coalesce(1)
    got = lambda: sorted((str(r) for r in search.index_rows(docs).distinct().collect()))
    want = got()
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert got() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    postings, lengths, _ = search.index_tables(docs)
    assert {(r["kind"], r["id"]): r["length"] for r in lengths.collect()} == {("n", 1): 2, ("n", 2): 1000, ("m", 3): 0, ("m", 4): 0, (None, 5): 0, ("n", None): 800, ("n", 6): 128, ("n", 7): 1, ("m", 8): 520}
    assert {(r["id"], r["tf"], tuple(r["positions"][:2])) for r in postings.filter("term in ('run', 'runs299')").collect()} == {(1, 1, (1,)), (2, 3, (299, 599)), (None, 400, (1, 3))}
    assert postings.filter("size(positions) <> tf or array_sort(positions) <> positions").isEmpty()


def test_a_task_writes_few_files_of_an_index(spark, tmp_path):
    """A file of lengths and one of terms, in their order, however many terms there are."""
    docs = spark.range(0, 400, 1, 2).select(F.lit("n").alias("kind"), "id", F.concat_ws(" ", *(F.concat(F.lit(f"t{i}x"), "id") for i in range(9))).alias("content"))
    search.add_documents(docs, f"file://{tmp_path}/index")
    files = sorted((tmp_path / "index" / "rows").rglob("*.parquet"))
    assert len(files) == 4
    for f in files:
        terms = [r["term"] for r in spark.read.parquet(f"file://{f}").collect()]
        assert terms == sorted(terms) if "bucket=0" in str(f) else set(terms) == {None}


def test_hashes_share_rows_of_state(spark, tmp_path):
    """Many hashes in few Python groups: each envelope still has its own outcome, in later batches too."""
    home, n = str(tmp_path), 400
    rows = spark.range(n).select("id", F.lit("cli").alias("adapter_id"), F.lit("1").alias("adapter_version"), F.lit("text").alias("payload_kind"), F.concat(F.lit("body "), F.col("id") % 150).alias("body_text"), F.lit(None).cast("string").alias("source_url"), F.lit(60.0).alias("captured_at_unix"), F.col("id").cast("double").alias("received_at_unix"))
    for k, part in enumerate(("id < 100", "id >= 100")):
        rows.filter(part).write.json(f"{home}/inbox/round={k}")
        S.filed(S.judged(S.inbox(spark, f"{home}/inbox/*"), late="1 day", digits=1), f"{home}/out", f"{home}/state")
    got = {r["id"]: (r["outcome"], r["capture_id"]) for r in spark.read.schema(S.JUDGED).parquet(f"{home}/out").collect()}
    assert got == {i: ("new" if i < 150 else "existing", i % 150) for i in range(n)}
    assert spark.read.format("statestore").load(f"{home}/state").count() <= 16


def test_lines_of_a_package_are_parsed_and_written_once(spark, tmp_path, monkeypatch):
    """One table of all record files, findings among them; torn and blank parts, and lines that are no records."""
    written, real = [], package.materialize
    monkeypatch.setattr(package, "materialize", lambda df, name: written.append(name) or real(df, name))
    own = '"source_lane": "l", "source_provider": "p", "source_record_id": "r", "source_metadata": {"k": "v"}'
    shown = {
        "providers/p/conversations.jsonl/part-0": '{"stable_id": "c1", %s, "title": "t", "created_at_unix": 1.5}\n\n \t\n{"stable_id"\n[1]\n' % own,
        "providers/p/messages.jsonl/part-0": '{"stable_id": "m1", %s, "sequence_index": 3, "content": "{}"}\n  {"stable_id": "m2"}\n7\n' % own,
        "native/memory_entries.jsonl/part-0": '{"stable_id": "n1", "tags": "a, b", "content": "x"}\n{"stable_id": "n2", "content": 5, "tags": ["q"]}\n',
        "native/memory_entries.jsonl/part-1": " \n",
        "native/memory_entries.jsonl/part-2.gz": "torn",
        "provenance/index.jsonl/part-0": '{"unit_type": "canonical", "stable_id": "c1", "path": "elsewhere"}\n',
        "other/part-0": "no record\n",
    }
    for name, text in shown.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    parts, found = package.read_package(spark, f"file://{tmp_path}")
    assert written == ["package-lines", "manifest-file"]
    assert sorted((r["code"], r["severity"], r["stable_id"]) for r in found.collect()) == [
        ("file_read_error", "E", "native/memory_entries.jsonl/part-2.gz"), ("jsonl_parse_error", "E", "providers/p/conversations.jsonl"), ("jsonl_record_invalid_type", "E", "providers/p/conversations.jsonl"),
        ("jsonl_record_invalid_type", "E", "providers/p/messages.jsonl"), ("manifest_missing", "E", None)]
    got = lambda name, *c: sorted(tuple(r) for r in parts[name].select(*c).collect())
    assert got("conversations", "path", "stable_id", "title", "created_at_unix", "source_metadata.k") == [("providers/p/conversations.jsonl", "c1", "t", 1.5, "v")]
    assert got("messages", "stable_id", F.coalesce("sequence_index", F.lit(-1))) == [("m1", 3), ("m2", -1)]
    assert got("notes", "path", "stable_id", "tags", "content") == [("native/memory_entries.jsonl", "n1", "a, b", "x"), ("native/memory_entries.jsonl", "n2", '["q"]', "5")]
    assert got("provenance", "stable_id", "path") == [("c1", "elsewhere")]


def test_provider_counts_write_no_records_again(spark, sf, monkeypatch):
    """Conversations are made once for a package, and its records are counted where their lines are read."""
    written, real = [], package.materialize
    monkeypatch.setattr(package, "materialize", lambda df, name: written.append(name) or real(df, name))
    got = {r["provider"]: r["notes"] for r in more.package_provider_counts(spark, sf).collect()}
    assert got.pop("native") > 0 and set(got.values()) == {0}
    assert written == ["package-conversations"]


def test_parts_of_a_package_are_told_by_the_listing(spark, tmp_path):
    """No line's path is decoded or matched, for fewer kinds too; counts are those of the records read back, odd lines and parts among them."""
    long = '{"source_provider": "p", "content": "%s"}' % ("x" * 70000)
    shown = {
        "providers/p q+%41/conversations.jsonl/part-0": '{"source_provider": "p q+%41"}\n{"source_provider": null}\n{"title": "t"}\n{"source_provider"\n[1]\n\n{"source_provider": "p", "created_at_unix": "x"}\n',
        "providers/p/messages.jsonl/part-0": '{"source_provider": "p", "sequence_index": 99999999999999}\n%s\n{"source_provider": 7}\n' % long,
        "providers/p/messages.jsonl/part-1.gz": "torn",
        "providers/p/messages.jsonl/more/part-2": '{"source_provider": "deep"}\n',
        "native/memory_entries.jsonl/part-0": '{"source_provider": "native"}\n \t{"source_provider": "native"}\n{}\n',
        "native/memory_entries.jsonl/part-1": "",
        "provenance/index.jsonl/part-0": '{"source_provider": "unit"}\n',
        "other/part-0": '{"source_provider": "other"}\n',
    }
    for name, text in shown.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    home = f"file://{tmp_path}"
    for kinds in (package.RECORD_FILES, package.COUNTED):
        plan = package.record_lines(spark, home, kinds)._jdf.queryExecution().optimizedPlan().toString()
        of_lines = plan[: plan.index("Relation [value")]
        of_lines = of_lines[of_lines.index("Join") :]
        assert not re.search("UrlCodec|regexp_replace|RLIKE", of_lines)
    parts = package.read_package(spark, home)[0]
    counted = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    got = counted(package.folder_provider_counts(spark, home))
    assert got == counted(package.provider_counts(parts)) and ("p q+%41", 1, 0, 0) in got and ("native", 0, 0, 2) in got
    assert sum(r[1] for r in got) == 4 and sum(r[2] for r in got) == 3 and sum(r[3] for r in got) == 3
    assert {r["path"] for r in parts["conversations"].collect()} == {"providers/p q+%41/conversations.jsonl"}


def test_a_part_that_is_cut_short_is_no_smaller_count(spark, tmp_path, monkeypatch):
    """Counts of a package with a part that cannot be read to its end are an error; what is read of it comes with a finding."""
    data = "".join('{"source_provider": "p", "content": "%s"}\n' % " ".join(str(hash((i, j))) for j in range(20)) for i in range(3000)).encode()
    home, packed = tmp_path / "providers" / "p q+%41" / "messages.jsonl", gzip.compress(data)
    home.mkdir(parents=True)
    for name, content in (("part-0", data), ("part-1.gz", packed), ("part-2.gz", packed[: len(packed) // 2]), ("part-3.gz", b"torn"), ("part-4", b"")):
        (home / name).write_bytes(content)
    uri, errors = f"file://{tmp_path}", lambda: sorted(r["stable_id"] for r in package.read_package(spark, uri)[1].filter("code = 'file_read_error'").collect())
    monkeypatch.setattr(more, "_package_folder", lambda spark, sf: uri)
    try:
        spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
        with pytest.raises(Exception, match="FAILED_READ_FILE"):
            more.package_provider_counts(spark, "").collect()
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")
    n = package.read_package(spark, uri)[0]["messages"].count()
    assert 6000 < n < 9000 and package.folder_provider_counts(spark, uri).first()["messages"] == n
    assert errors() == ["providers/p q+%41/messages.jsonl/part-2.gz", "providers/p q+%41/messages.jsonl/part-3.gz"]
    for name in ("part-2.gz", "part-3.gz"):
        (home / name).unlink()
    assert errors() == [] and more.package_provider_counts(spark, "").first()["messages"] == 6000


def test_chunks_are_stripped_by_their_ends(spark):
    """No regular expression goes over a whole text to find the blanks at its ends; blanks are the same characters as before."""
    plan = chunks.chunk(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and "RLIKE" not in plan
    every = spark.range(1, 0x10000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    blank = {r["c"] for r in every.filter(F.col("c").rlike(rf"^[{chunks.WS}]\z")).collect()}
    assert blank == set(chunks.BLANKS) == {r["c"] for r in every.filter(chunks.stripped(F.concat("c", F.lit("x"), "c")) == "x").collect()}


def test_a_question_asked_often_is_answered_once(spark, monkeypatch):
    """Answers do not depend on how often a question is asked, no text is written beside a question, and traces read no summaries."""
    written, real = {}, federated.materialize
    monkeypatch.setattr(federated, "materialize", lambda df, name: written.setdefault(name, real(df, name)))
    c = spark.createDataFrame([(1, "grok", "g1", "Red boats", 5.0, None, True), (2, "claude", "c2", " ", None, None, None)], "id long, source string, source_conversation_id string, title string, created_at_unix double, updated_at_unix double, is_starred boolean")
    m = spark.createDataFrame([(10, 1, 0, "user", "the W\u00c4ter is warm"), (11, 1, 1, "user", "boats"), (20, 2, 0, "user", "water boats")], "id long, conversation_id long, sequence_index int, role string, content string")
    n = spark.range(1, 13).selectExpr("id", "timestamp_seconds(id) AS timestamp", "'user' AS role", "concat(' water ', repeat('boats ', cast(id % 3 AS int)), id) AS content", "if(id % 2 = 0, 't', null) AS tags", "false AS is_starred")
    asked = ["water boats", "water boats", " Water", "nothing there", "the", None, None, "warm water boats"]
    q = spark.createDataFrame([(i, x) for i, x in enumerate(asked * 3)], "question_id long, question string")
    made = federated.answered(q, c, m, n)
    got = {r["question_id"]: tuple(r)[1:] for r in made.select("question_id", *[x for x in made.columns if x != "question_id"]).collect()}
    assert written["questions"].count() == 6 and written["best-hits"].count() == 9 and len(got) == 24
    assert not {"title", "content", "evidence", "summary", "evidence_text"} & set(written["best-hits"].columns) and all(got[i] == got[i % 8] for i in got)
    assert got[3][got_at(made, "status")] == "insufficient_evidence" and got[0][got_at(made, "lanes")] == ["native_memory"] * 3
    traced = federated.traces(made, "now").select("trace_id", "question", "status", "source_lanes")
    assert "summary" not in traced._jdf.queryExecution().optimizedPlan().toString()


def got_at(df, name):
    return [x for x in df.columns if x != "question_id"].index(name)
