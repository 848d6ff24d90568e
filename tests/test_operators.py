import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.operators import browse, capture, components, context, ledger, notes, package, ranking, rollups, search, similarity
from convlake.plans import records
from convlake.schemas import THREAD_STOPWORDS
from convlake.shared import materialize
from convlake.sources import exports


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


def closure(nodes, pairs):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_match_closure(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(300, 300 + i) for i in range(1, 40)] + [(5, 5), (None, 3)]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == closure({x for e in real for x in e}, real)
    assert components.components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_threads_match_all_pairs(spark):
    for seed in range(3):
        r = random.Random(seed)
        words = ["alpha", "beta", "gamma", "delta", "the", "x", "rho", "tau", "phi"]
        rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 4))), float(r.randint(0, 40) * 50_000) if r.random() < 0.8 else None) for i in range(40)]
        bag = {i: {w for w in t.split() if len(w) >= 2 and w not in THREAD_STOPWORDS} for i, t, _ in rows}
        at = {i: a for i, _, a in rows}
        near = lambda a, b: at[a] is not None and at[b] is not None and abs(at[a] - at[b]) <= 48 * 3600
        pairs = [(a, b) for a, b in combinations(bag, 2) if len(bag[a] & bag[b]) >= 2 or (bag[a] & bag[b] and near(a, b))]
        got = {x["id"]: x["thread"] for x in similarity.thread_members(spark.createDataFrame(rows, "id long, title string, created_at_unix double")).collect()}
        want = closure(bag, pairs)
        assert got == {i: c for i, c in want.items() if any(i in p for p in pairs)}


def test_stems_are_porters():
    # Examples printed with the algorithm's definition.
    for word, want in {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control"}.items():
        assert search.stem(word) == want, word


def test_search_phrases_stems_and_incremental_index(spark):
    docs = spark.createDataFrame([("n", 1, "The Quick brown fox"), ("n", 2, "quick the fox, brown"), ("m", 3, "Résumé running"), ("n", 4, None)], "kind string, id long, content string")
    postings, lengths = search.index(docs)
    hits = lambda p, q: sorted(r["id"] for r in search.search(p, lengths, q).collect())
    assert hits(postings, "quick fox") == [1, 2] and hits(postings, "quick-brown") == [1] and hits(postings, 'resume "') == [3] and hits(postings, " ") == []
    assert hits(postings, "runs") == [3] and hits(postings, "runner") == [] and hits(postings, "foxes quickly") == []
    plain, _ = search.index(docs, stemmed=False)
    assert sorted(r["id"] for r in search.search(plain, lengths, "running", stemmed=False).collect()) == [3]
    assert search.search(plain, lengths, "runs", stemmed=False).count() == 0
    assert {r["id"]: r["length"] for r in lengths.collect()} == {1: 4, 2: 4, 3: 2, 4: 0}
    mark = one(spark, search.snippet(F.col("c"), ["fox"], 3), c="one two three fox, four five")
    assert mark == "…three <mark>fox</mark>, four…"


def test_saved_index_is_added_to_and_removed_from(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    table = lambda rows: spark.createDataFrame(rows, "kind string, id long, content string")
    ids = lambda text: sorted(r["id"] for r in search.search(*search.read_index(spark, path, text), text).collect())
    assert search.add_documents(table([("n", i, f"word{i} common running") for i in range(30)]), path) == 0
    assert {r["term"] for r in search.read_index(spark, path, "word7 common")[0].collect()} == {"word7", "common"}
    scans = search.read_index(spark, path, "word7")[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scans and "bucket" in scans.split("PartitionFilters", 1)[1].split("PushedFilters")[0]
    # 5 is there, 40 is new
    search.add_documents(table([("n", 5, "other words"), ("n", 40, "runs word7")]), path)
    assert ids("word7") == [7, 40] and ids("other") == [] and ids("run") == [*range(30), 40]
    assert search.saved_forms(spark, path, "run") == ["running", "runs"]
    search.remove_documents(table([("n", 7, ""), ("n", 40, ""), ("n", 99, "")]).select("kind", "id"), path)
    assert ids("word7") == [] and search.read_index(spark, path, "x")[1].count() == 29
    search.add_documents(table([("n", 7, "new text"), ("n", 40, "word7")]), path)
    assert ids("word7") == [40] and ids("new") == [7] and ids("common") == [i for i in range(30) if i != 7]
    fresh = [("n", i, f"word{i} common running") for i in range(30) if i != 7] + [("n", 7, "new text"), ("n", 40, "word7")]
    scores = lambda p, n: sorted((r["id"], round(r["score"], 9)) for r in search.search(p, n, "common").collect())
    assert scores(*search.read_index(spark, path, "common")) == scores(*search.index(table(fresh)))
    # a segment that was begun and not finished does not count
    (tmp_path / "index" / "done" / "3").unlink()
    assert ids("word7") == [] and search.segments(spark, path) == [0, 1, 2]
    assert search.add_documents(table([("n", 40, "word7 again")]), path) == 3 and ids("word7") == [40]


def test_global_index(spark):
    df = spark.range(500).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = [(r["k"], r["id"]) for r in ranking.global_index(df, ["k", "id"]).orderBy("position").collect()]
    assert got == sorted(got)
    assert sorted(r["position"] for r in ranking.global_index(df, ["k", "id"]).collect()) == list(range(500))


def test_text_functions(spark):
    c = F.col("c")
    assert one(spark, T.normalize_tags(c), c=" A, b  B ,,a,\tC") == "a, b b, c"
    assert one(spark, T.auto_tag(c), c="How do I Cook, rice") == "cook"
    assert one(spark, T.remove_tag(c, F.lit("B")), c="a, b, c") == "a, c" and one(spark, T.add_tag(c, F.lit("A")), c="a, b") == "a, b"
    assert one(spark, T.safe_name(c), c="a/b: c?") == "a_b_ c_" and one(spark, T.slug(c), c="Ab - Cd!") == "ab-cd"
    assert one(spark, T.cut_at_line(c, 20, "[x]"), c="0123456789ab\ncdefghijklmnop") == "0123456789ab[x]"
    assert one(spark, T.cut_at_line(c, 20, "[x]"), c="01\n3456789abcdefghijklmnop") == "01\n3456789abcdefg[x]"
    assert one(spark, T.iso(c), c=1704067200.5) == "2024-01-01T00:00:00Z"
    for age, want in ((-5.0, "just now"), (30.0, "just now"), (300.0, "5m ago"), (7200.0, "2h ago"), (86400.0 * 3, "3d ago"), (86400.0 * 800, "2y ago")):
        assert one(spark, T.relative(F.lit(1e9) - c, F.lit(1e9)), c=age) == want
    assert one(spark, T.date_range(c, c + 86400 * 8), c=1709251200.0) == "Mar 1 — Mar 9, 2024"
    assert one(spark, T.html_text(c), c="<p>a</p><p>b</p>") == "a\nb"
    assert one(spark, T.stable_number(c, "memory"), c="memory:12") == 12 and one(spark, T.stable_number(c, "memory"), c="memory:x") is None


def test_capture_hash_and_life_cycle(spark):
    rows = [(1, "browser", "1", "selection", "é x \n", None, 61.0, 5.0), (2, "browser", "1", "selection", "é x", "", 119.0, 4.0), (3, "browser", "1", "selection", "other", "u", 61.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, adapter_id string, adapter_version string, payload_kind string, body_text string, source_url string, captured_at_unix double, received_at_unix double")
    h = {r["id"]: r["content_hash"] for r in capture.hashed(df).collect()}
    assert h[1] == h[2] != h[3]
    assert sorted(r["id"] for r in capture.first_of_each(capture.hashed(df)).collect()) == [2, 3]
    commands = [(1, 1, "triage"), (1, 2, "triage"), (1, 3, "promote"), (1, 4, "reject"), (2, 1, "quarantine"), (2, 2, "promote"), (2, 3, "triage")]
    got = capture.replay(spark.createDataFrame([(c, n, a, float(n), "me", None) for c, n, a in commands], "capture_id long, command_id long, action string, at_unix double, decided_by string, reason string"))
    assert sorted((r["capture_id"], r["status"], r["n_applied"], r["n_rejected"]) for r in got.collect()) == [(1, "promoted", 2, 2), (2, "triaged", 2, 1)]


def test_topic_replies_and_model_hook(spark):
    known = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    reply = "noise\nTOPIC: Cars\nIDS: 1, 2, 99\nCONFIDENCE: High\nTOPIC: Lone\nIDS: 3\nCONFIDENCE: low"
    got = context.topic_reply(spark.createDataFrame([("s", reply)], "scan_id string, reply string"), known).collect()
    assert [(r["topic"], r["ids"], r["confidence"]) for r in got] == [("Cars", [1, 2], "high")]
    rows = spark.createDataFrame([(1, "abc")], "k long, prompt string")
    assert context.complete(rows, "prompt", "out", lambda texts: [t.upper() for t in texts]).first()["out"] == "ABC"


def test_refresh_replaces_only_the_marked_part(spark):
    f = lambda auto: f"mine\n{notes.BEGIN}\n{auto}\n{notes.END}\nmine too"
    old = spark.createDataFrame([("a", f("1")), ("b", "no marks"), ("c", f("1")), ("d", f("2"))], "path string, content string")
    fresh = spark.createDataFrame([("a", "other " + f("2")), ("b", f("2")), ("d", f("2"))], "path string, content string")
    assert [tuple(r) for r in notes.refreshed(old, fresh).collect()] == [("a", f("2"))]


def test_package_round_trip(spark, sf, tmp_path):
    from convlake import testbed as B

    c, m, n = B.conversations(spark, sf), B.messages(spark, sf), B.notes(spark, sf)
    package.write_package(f"file://{tmp_path}/p", c, m, n)
    parts, bad = package.read_package(spark, f"file://{tmp_path}/p")
    assert [parts[k].count() for k in ("conversations", "messages", "notes", "manifest")] == [c.count(), m.count(), n.count(), 1] and bad.count() == 0
    assert package.read_lines(spark.createDataFrame([("p", "{"), ("p", "[1]"), ("p", " ")], "path string, line string"), "a string")[1].count() == 2


def test_damage_is_found(spark, sf):
    codes = {r["code"] for r in records._damaged(spark, sf).select("code").distinct().collect()}
    assert {"conversation_title_missing", "conversation_source_metadata_mismatch", "provenance_canonical_path_mismatch"} <= codes


def test_outcomes(spark):
    rows = [(0, 0, 0, False, "failed"), (1, 0, 1, True, "partial"), (0, 0, 2, True, "failed"), (1, 1, 0, True, "success"), (0, 3, 0, True, "duplicate_only"), (0, 0, 0, True, "failed")]
    df = spark.createDataFrame(rows, "i int, s int, f int, r boolean, w string")
    assert df.filter(ledger.outcome(F.col("i"), F.col("s"), F.col("f"), F.col("r")) != F.col("w")).count() == 0


def test_every_rule_of_a_package_fires(spark):
    """A valid package, then one damage for each rule: each is found where it was done."""
    n = 40
    c = spark.range(1, n + 1).selectExpr("id", "'claude' AS source", "concat('c-', id) AS source_conversation_id", "concat('t ', id) AS title", "cast(100 + id AS double) AS created_at_unix", "cast(200 + id AS double) AS updated_at_unix")
    m = spark.range(2, 2 * n + 2).selectExpr("id", "id div 2 AS conversation_id", "concat('m-', id) AS source_message_id", "'user' AS role", "'x' AS content", "cast(id % 2 AS int) AS sequence_index", "cast(150 + id AS double) AS created_at_unix")
    notes = spark.range(1, n + 1).selectExpr("id", "timestamp_seconds(1000 + id) AS timestamp", "'user' AS role", "'x' AS content", "'a' AS tags", "false AS is_starred", "cast(null AS long) AS captured_via_id")
    cr, mr, nr, p, man = (materialize(df, "t") for df in (package.conversation_records(c), package.message_records(c, m), package.note_records(notes), package.provenance(c, m, notes), package.manifest(c, m, notes)))
    assert package.status(package.validate(cr, mr, nr, p, man)).collect()[0]["status"] == "valid"

    def damage(df, kind, *changes):
        """(code, number, column, SQL of the new value)"""
        out = df.withColumn("__n", F.col("stable_id"))
        for _, k, column, value in changes:
            out = out.withColumn(column, F.when(F.col("__n") == f"{kind}:{k}", F.expr(value)).otherwise(F.col(column)))
        return out.drop("__n")

    def meta(key, value):
        return f"map_concat(map_filter(source_metadata, (k, v) -> k <> '{key}'), map('{key}', '{value}'))"

    conv = [("conversation_lane_invalid", 1, "source_lane", "'other'"), ("field_missing_or_blank", 2, "source_record_id", "' '"), ("conversation_source_identity_conflict", 3, "source_record_id", "'c-4'"), ("conversation_source_identity_conflict", 4, "title", "title"), ("conversation_source_metadata_missing", 5, "source_metadata", "null"), ("conversation_source_missing", 6, "source_metadata", meta("source", "")), ("conversation_source_metadata_mismatch", 7, "source_metadata", meta("source", "grok")), ("conversation_source_id_missing", 8, "source_metadata", meta("source_conversation_id", "")), ("conversation_source_id_mismatch", 9, "source_metadata", meta("source_conversation_id", "zz")), ("conversation_timestamp_missing", 10, "created_at_unix", "null"), ("conversation_updated_timestamp_missing", 11, "updated_at_unix", "null"), ("conversation_title_missing", 12, "title", "' '"), ("conversation_stable_id_invalid", 13, "stable_id", "'imported_conversation:x'")]
    mess = [("message_lane_invalid", 2, "source_lane", "'other'"), ("message_conversation_reference_missing", 4, "conversation_stable_id", "'imported_conversation:999'"), ("message_provider_mismatch", 6, "source_provider", "'grok'"), ("message_source_identity_conflict", 8, "source_record_id", "'m-9'"), ("message_source_metadata_missing", 10, "source_metadata", "map()"), ("message_source_id_missing", 12, "source_metadata", meta("source_message_id", "")), ("message_source_id_mismatch", 14, "source_metadata", meta("source_message_id", "zz")), ("message_conversation_source_id_missing", 16, "source_metadata", meta("conversation_source_id", "")), ("message_conversation_source_id_mismatch", 18, "source_metadata", meta("conversation_source_id", "zz")), ("message_timestamp_missing", 20, "created_at_unix", "null"), ("field_invalid_integer", 22, "sequence_index", "-1"), ("message_stable_id_invalid", 28, "stable_id", "'imported_message:x'"), ("field_missing_or_blank", 30, "source_provider", "null")]
    note = [("native_lane_invalid", 1, "source_lane", "'other'"), ("native_source_id_mismatch", 2, "source_record_id", "'77'"), ("native_source_metadata_missing", 3, "source_metadata", "null"), ("native_role_missing", 4, "source_metadata", meta("role", "")), ("native_role_mismatch", 5, "source_metadata", meta("role", "bot")), ("native_tags_missing", 6, "source_metadata", "map_filter(source_metadata, (k, v) -> k <> 'tags')"), ("native_timestamp_missing", 7, "timestamp_unix", "null"), ("native_stable_id_invalid", 8, "stable_id", "'memory:x'")]
    prov = [("provenance_path_missing", "memory:10", "path", "''"), ("provenance_source_metadata_missing", "memory:11", "source_metadata", "null"), ("provenance_unit_type_invalid", "memory:12", "unit_type", "'other'"), ("provenance_index_missing", "memory:12", "path", "path"), ("provenance_canonical_path_mismatch", "memory:13", "path", "'elsewhere'"), ("provenance_identity_mismatch", "memory:14", "source_provider", "'grok'"), ("provenance_canonical_reference_missing", "memory:8", "path", "path"), ("provenance_derived_reference_missing", "derived:markdown:memory:15", "source_metadata", "map('canonical_stable_id', 'memory:999')"), ("provenance_derived_reference_invalid", "derived:markdown:memory:16", "source_metadata", "map('derived_kind', 'markdown')")]
    bad_c, bad_m, bad_n = damage(cr, "imported_conversation", *conv), damage(mr, "imported_message", *mess), damage(nr, "memory", *note)
    bad_p = p.withColumn("__n", F.col("stable_id"))
    for _, key, column, value in prov:
        bad_p = bad_p.withColumn(column, F.when(F.col("__n") == key, F.expr(value)).otherwise(F.col(column)))
    bad_p = bad_p.drop("__n").unionByName(p.filter("stable_id = 'memory:17'"))
    bad_c = bad_c.unionByName(cr.filter("stable_id = 'imported_conversation:20'"))
    bad_m = bad_m.filter("stable_id not in ('imported_message:40', 'imported_message:41', 'imported_message:42')")
    got = {(r["code"], r["stable_id"]) for r in package.validate(*(materialize(df, "t") for df in (bad_c, bad_m, bad_n, bad_p)), man).collect()}
    moved = {"imported_conversation:13": "imported_conversation:x", "imported_message:28": "imported_message:x", "memory:8": "memory:x"}
    want = {(code, moved.get(f"{kind}:{k}", f"{kind}:{k}")) for kind, changes in (("imported_conversation", conv), ("imported_message", mess), ("memory", note)) for code, k, *_ in changes}
    want |= {(code, key) for code, key, *_ in prov} | {("provenance_stable_id_duplicate", "memory:17"), ("canonical_stable_id_duplicate", "imported_conversation:20"), ("conversation_has_no_messages", "imported_conversation:20"), ("message_sequence_invalid", "imported_conversation:21"), ("manifest_count_mismatch", None)}
    assert want - got == set()
    # what was not damaged is not found
    assert not {s for _, s in got if s in {f"imported_conversation:{k}" for k in range(22, 40)} | {f"memory:{k}" for k in range(18, 40)}}
    one_row = lambda **kw: man.select(*(F.expr(kw[x]).alias(x) if x in kw else F.col(x) for x in man.columns))
    codes = lambda row: {r["code"] for r in package.validate(cr, mr, nr, p, row).collect()}
    assert codes(man.limit(0)) == {"manifest_missing"}
    assert codes(one_row(package_version="'0'", message_count="cast(-1 as long)", source_lanes="array('x')", source_providers="array('claude', ' ')", min_unix="1e9d", max_unix="1d")) == {"unsupported_package_version", "manifest_invalid_count", "manifest_count_mismatch", "manifest_source_lanes_mismatch", "manifest_source_providers_mismatch", "manifest_invalid_list_value", "manifest_invalid_time_range", "manifest_min_time_range_mismatch", "manifest_max_time_range_mismatch"}
    assert codes(one_row(native_count="cast(null as long)", includes_markdown="cast(null as boolean)", min_unix="cast(null as double)")) == {"manifest_missing_count", "manifest_missing_field", "manifest_time_range_missing"}


def test_logs_grow_and_stores_get_versions(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id long, t string"), spark.createDataFrame([(2, "y")], "id long, t string")
    ledger.append(a, f"{tmp_path}/log")
    ledger.append(b, f"{tmp_path}/log")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [1, 2]
    old, new = ledger.rewrite(a, f"{tmp_path}/store", "1"), ledger.rewrite(b, f"{tmp_path}/store", "2")
    assert [r["id"] for p in (old, new) for r in spark.read.json(p).collect()] == [1, 2]


def test_lookups_take_the_newest(spark):
    s = spark.createDataFrame([("c:1", "s:1", "old", "2024-01"), ("c:1", "s:2", "new", "2024-02"), ("c:2", "s:3", "only", "2024-01")], "source_conversation_id string, summary_id string, summary_text string, generation_timestamp string")
    scans = spark.createDataFrame([("t:1", "2024-01", [("Old", ["c:1"])]), ("t:2", "2024-03", [("B", ["c:1", "c:2"]), ("A", ["c:1"])])], "scan_id string, generation_timestamp string, clusters array<struct<topic:string,ids:array<string>>>")
    d = spark.createDataFrame([("A", "d:1", "first", "2024-01"), ("A", "d:2", "second", "2024-02")], "topic_label string, digest_id string, digest_text string, generation_timestamp string")
    got = [sorted(tuple(r) for r in x.collect()) for x in notes.lookups(s, scans, d)]
    assert got == [[("c:1", "new"), ("c:2", "only")], [("c:1", ["A", "B"]), ("c:2", ["B"])], [("A", "second")]]
    assert [tuple(r) for r in rollups.topic_highlights(scans).orderBy("nth").collect()] == [(1, "B"), (2, "A")]
    assert [r["summary_text"] for r in browse.record_by_id(s, "summary_id", "s:2").collect()] == ["new"]


def test_marks_go_and_sources_can_be_added(spark):
    assert one(spark, search.strip_marks(F.col("c")), c="a <mark>b</mark> c") == "a b c"
    exports.register_source("plain", lambda c: c.startswith("PLAIN"), exports.PARSERS["grok"])
    try:
        files = spark.createDataFrame([("p", "PLAIN text"), ("q", "other")], "path string, content string")
        assert {r["path"]: r["provider"] for r in exports.detect(files).collect()} == {"p": "plain", "q": None}
    finally:
        del exports.DETECTORS["plain"], exports.PARSERS["plain"]


def test_sweep_deletes_the_tables_of_this_application(spark, monkeypatch):
    from convlake import shared

    home = shared.folder(spark) + "-swept"
    monkeypatch.setattr(shared, "folder", lambda _: home)
    assert shared.materialize(spark.range(3), "three").count() == 3
    shared.sweep(spark)
    p = spark._jvm.org.apache.hadoop.fs.Path(home)
    assert not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
