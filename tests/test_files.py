import json

from convlake.operators import package
from convlake.sources import files


def written(rows):
    return {r["path"]: r["status"] for r in rows.collect()}


def test_files_are_written_once_and_never_out_of_the_folder(spark, tmp_path):
    home = f"file://{tmp_path}/vault"
    rows = [("a/b/one.md", "first\nsecond"), ("é +%.md", "ü"), ("empty.md", None), ("../out.md", "x"), ("/abs.md", "x"), (None, "x"), ("a/b/one.md", "other words")]
    df = spark.createDataFrame(rows, "path string, content string")
    refused = {"../out.md": "refused", "/abs.md": "refused", None: "refused"}
    assert written(files.write_files(df, home)) == {"a/b/one.md": "written", "é +%.md": "written", "empty.md": "written", **refused}
    assert written(files.write_files(df, home)) == {"a/b/one.md": "present", "é +%.md": "present", "empty.md": "present", **refused}
    assert {r["path"]: r["content"] for r in files.texts(spark, home).collect() if r["content"]} == {"a/b/one.md": "first\nsecond", "é +%.md": "ü"}
    assert {(r["path"], r["size"]) for r in files.listing(spark, home).collect()} == {("a/b/one.md", 12), ("é +%.md", 2)}
    changed = spark.createDataFrame([("a/b/one.md", "new")], "path string, content string")
    assert written(files.write_files(changed, home)) == {"a/b/one.md": "kept"}
    assert written(files.write_files(changed, home, True)) == {"a/b/one.md": "replaced"}
    assert not list(tmp_path.rglob("*.tmp")) and sorted(p.name for p in tmp_path.iterdir()) == ["vault"]


def test_packages_without_a_manifest_have_no_other_findings(spark, tmp_path):
    conversations = spark.createDataFrame([(1, "grok", "g1", "t", None, None, False, False, "", "")], "id long, source string, source_conversation_id string, title string, created_at_unix double, updated_at_unix double, is_archived boolean, is_starred boolean, tags string, source_metadata_json string")
    messages = spark.createDataFrame([(1, 1, "m1", "user", "hi", 0, 5.0)], "id long, conversation_id long, source_message_id string, role string, content string, sequence_index int, created_at_unix double")
    notes = spark.createDataFrame([], "id long, timestamp timestamp, role string, content string, tags string, is_starred boolean, captured_via_id long")
    home = f"file://{tmp_path}/p"
    package.write_package(home, conversations, messages, notes, True, "2024-01-01T00:00:00Z")
    codes = lambda: sorted(r["code"] for r in package.validate_folder(spark, home).collect())
    assert codes() == ["conversation_timestamp_missing", "conversation_updated_timestamp_missing"]
    manifest = tmp_path / "p" / "manifest.json"
    right = json.loads(manifest.read_text())
    for path in (tmp_path / "p").glob("*.crc"):
        path.unlink()
    for text, want in (("{", ["json_parse_error"]), ("[1]", ["manifest_invalid_type"])):
        manifest.write_text(text)
        assert codes() == want
    manifest.write_text(json.dumps({**right, "markdown_included": 1, "counts": {**right["counts"], "message_count": 9}}))
    assert codes() == ["conversation_timestamp_missing", "conversation_updated_timestamp_missing", "manifest_count_mismatch", "manifest_invalid_markdown_flag"]
    manifest.unlink()
    assert codes() == ["manifest_missing"]
    assert [tuple(r) for r in package.provider_counts(package.read_package(spark, home)[0]).collect()] == [("grok", 1, 1, 0)]
