import io
import json
import random
import zipfile

from pyspark.sql import functions as F

from convlake.sources import exports as X


def load(spark, files):
    out, bad = X.import_files(spark.createDataFrame([(p, c if isinstance(c, str) else json.dumps(c)) for p, c in files.items()], "path string, content string"))
    rows = {(r["path"], r["source_conversation_id"]): r for r in out.collect()}
    return rows, {r["path"]: r["problem"] for r in bad.collect()}


def said(row):
    return [(m["role"], m["content"], m["sequence_index"]) for m in row["messages"]]


TREE = {
    "n3": {"id": "n3", "parent": "n1", "children": [], "message": {"id": "m3", "author": {"role": "assistant"}, "create_time": 3.5, "content": {"parts": [" third ", {"x": 1}, "", "{not json}"]}}},
    "n1": {"id": "n1", "parent": None, "children": ["n2", "n3", "n1"], "message": {"author": {"role": "user"}, "content": {"parts": ["first"]}}},
    "n2": {"id": "n2", "parent": "n1", "children": ["n4"], "message": {"id": "m2", "author": {"role": "assistant"}, "content": {"parts": ["second"]}}},
    "n4": {"id": "n4", "parent": "n2", "children": ["n2"], "message": {"id": "m4", "author": None, "content": {"parts": ["   "]}}},
    "lost": {"id": "lost", "parent": "gone", "children": [], "message": {"id": "m9", "content": {"parts": ["stray"]}}},
    "none": None,
}


def test_providers_are_told_apart_and_parsed(spark):
    files = {
        "a.json": [{"id": "c1", "title": " Trip ", "create_time": 1.5, "update_time": "2", "mapping": TREE}, {"title": " ", "mapping": {}}, 7],
        "rescue.json": {"_meta": {}, "conversations": {"k": {"id": "r1", "title": "R", "mapping": {"x": {"parent": None, "children": [], "message": {"author": {"role": "user"}, "content": {"parts": ["hi"]}}}}}}},
        "b.json": [{"uuid": "u1", "name": "", "created_at": "2024-01-01T00:00:00Z", "chat_messages": [{"uuid": "q", "index": 2, "sender": "assistant", "text": "later"}, {"index": 1, "sender": "Human", "text": " ", "content": [{"type": "text", "text": "one"}, {"type": "thinking", "thinking": "two"}, {"type": "tool_result", "content": [{"type": "text", "text": "three"}]}]}, {"sender": "x", "text": ""}]}],
        "c.jsonl": "not json\n" + "\n".join(json.dumps(x) for x in [{"type": "system", "sessionId": "s-123456789"}, {"type": "user", "sessionId": "s-123456789", "uuid": "z1", "timestamp": "2024-01-01T00:00:05Z", "message": {"role": "user", "content": "go"}}, {"type": "assistant", "sessionId": "s-123456789", "timestamp": "2024-01-01T00:00:09Z", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}, {"type": "tool_result", "is_error": True, "content": "x" * 4100}]}}, {"type": "user", "message": {"content": "no time"}}]),
        "d.json": {"conversations": [{"conversation": {"id": "g1", "title": "G", "create_time": {"$date": {"$numberLong": "1737381600000"}}, "modify_time": "2025-01-20T14:00:00.000Z"}, "responses": [{"response": {"_id": "r", "message": " hey ", "sender": "human", "model": "m-1", "create_time": 1737381600000}}, {"response": {"message": "yo", "sender": "ASSISTANT", "create_time": 1737381601}}]}, {"conversation": {"id": "g2"}, "responses": []}]},
        "e.json": [{"header": "Gemini Apps", "title": "Prompted B", "time": "2024-01-01T00:05:00Z", "safeHtmlItem": [{"html": "<p>ans<br>wer</p>"}]}, {"header": "Gemini Apps", "title": "Prompted A", "time": "2024-01-01T00:00:00Z"}, {"header": "Gemini Apps", "title": "Prompted C", "time": "2024-01-01T00:35:01Z"}],
        "f.json": [{"header": "gemini apps", "title": "only", "time": "2024-01-01T00:00:00Z"}],
        "h.json": [{"url": "https://g/app/slug1/", "title": "T", "exportedAt": "2024-01-02T00:00:00Z", "messages": [{"role": "model", "parts": ["a", {"text": "b"}]}, {"role": "user", "text": "c", "timestamp": "2024-01-01T00:00:00Z"}]}],
        "bad.json": "{", "other.json": {"x": 1},
    }
    rows, bad = load(spark, files)
    assert bad == {"bad.json": "malformed JSON", "other.json": "no provider matches"}
    a = rows["a.json", "c1"]
    assert (a["provider"], a["title"], a["created_at"], a["updated_at"]) == ("chatgpt", "Trip", 1.5, 2.0)
    assert said(a) == [("user", "first", 0), ("assistant", "second", 1), ("assistant", "third\n{not json}", 2), ("unknown", "stray", 3)]
    assert [m["source_message_id"] for m in a["messages"]] == ["n1", "m2", "m3", "m9"]
    assert rows["a.json", "conversation-1"]["title"] == "Untitled Conversation" and said(rows["rescue.json", "r1"]) == [("user", "hi", 0)]
    b = rows["b.json", "u1"]
    assert b["title"] == "Untitled Conversation" and b["created_at"] == 1704067200.0
    assert said(b) == [("user", "one\n\ntwo\n\nthree", 0), ("assistant", "later", 1)]
    c = rows["c.jsonl", "s-123456789"]
    assert c["title"] == "Claude Code session s-123456" and c["updated_at"] - c["created_at"] == 4
    assert said(c)[1][1] == "ok\n\n[Tool: Bash] ls\n\n[Error] " + "x" * 4000 + "... [truncated]"
    d = rows["d.json", "g1"]
    assert d["created_at"] == d["messages"][0]["created_at"] == 1737381600.0 and d["metadata"] == {"grok_model": "m-1"} and d["updated_at"] == 1737381600.0
    assert said(d) == [("user", "hey", 0), ("assistant", "yo", 1)] and ("d.json", "g2") not in rows
    e = [r for (p, _), r in rows.items() if p == "e.json"]
    assert sorted(said(r) for r in e) == [[("user", "A", 0), ("user", "B", 1), ("assistant", "ans\nwer", 2)], [("user", "C", 0)]]
    f = next(r for (p, _), r in rows.items() if p == "f.json")
    assert said(f) == [("user", "only", 0)] and f["source_conversation_id"].startswith("gemini-takeout-")
    h = rows["h.json", "gemini-slug1"]
    assert said(h) == [("assistant", "a\nb", 0), ("user", "c", 1)] and h["created_at"] == 1704067200.0


def test_zip_prefers_conversations_json(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.json", json.dumps([{"id": "wrong", "mapping": {}}]))
        z.writestr("x/conversations.json", json.dumps([{"id": "right", "mapping": {}}]))
    df = spark.createDataFrame([("z.zip", buffer.getvalue()), ("bad.zip", b"no")], "path string, content binary")
    got = X.chosen_member(X.zip_members(df)).collect()
    assert len(got) == 1 and "right" in got[0]["content"]


def test_sessions_keep_exact_gaps_together(spark):
    rows = [("a", 0.0, 1), ("a", 1800.0, 2), ("a", 3600.1, 3), ("a", None, 4), ("b", 5.0, 5)]
    got = X.sessions(spark.createDataFrame(rows, "account string, at double, n int"), "account", "at").collect()
    assert {r["n"]: r["session"] for r in got} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}


def test_hints(spark):
    df = spark.createDataFrame([(" Claude ",), ("grok",), ("x",), (None,)], "h string")
    assert [r[0] for r in df.select(X.valid_hint(F.col("h"))).collect()] == ["claude", "grok", None, None]


def test_files_of_a_folder_and_archives_without_an_export(spark, tmp_path):
    export = json.dumps([{"uuid": "u1", "name": "n", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00Z", "chat_messages": [{"uuid": "m1", "sender": "human", "text": "hello", "created_at": "2024-01-01T00:00:00Z"}]}])
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text(export)
    (tmp_path / "notes.txt").write_text("not read")
    for name, members in (("good", {"x/other.json": export, "x/readme.md": "no"}), ("odd", {"a.json": "{}", "b.json": "[1"}), ("none", {"x.txt": "y"})):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for member, content in members.items():
                z.writestr(member, content)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    files = X.read_files(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.collect()) == ["good.zip", "one.json"]
    got = X.import_files(files)[0].collect()
    assert [(r["provider"], r["source_conversation_id"], r["messages"][0]["content"]) for r in got] == [("claude", "u1", "hello")] * 2
    raw = spark.read.format("binaryFile").load(f"{tmp_path}/*.zip")
    rejects = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in X.zip_rejects(X.zip_members(raw)).collect()}
    assert set(rejects) == {"odd.zip", "none.zip", "bad.zip"} and all(rejects.values())
    assert rejects["bad.zip"].startswith("broken archive") and rejects["none.zip"] == "no .json file in the archive"


def fragments(v):
    if isinstance(v, str):
        return [v]
    if isinstance(v, list):
        return [t for x in v for t in fragments(x)]
    if not isinstance(v, dict):
        return []
    kind = v.get("type")
    if kind in ("text", "voice_note", "thinking"):
        t = v.get("thinking" if kind == "thinking" else "text")
        return [t] if isinstance(t, str) else []
    if kind in ("tool_result", "tool_use"):
        return fragments(v.get("content" if kind == "tool_result" else "input"))
    return [t for k in ("text", "thinking", "content") for t in fragments(v.get(k))]


def test_content_blocks_of_any_depth(spark):
    rng = random.Random(5)

    def block(left):
        if not left or rng.random() < 0.2:
            return rng.choice(["plain", '{"type": "text", "text": "no block"}', "[1]", ' "q\\" [{', "", 7, None, True, {"type": "text", "text": "t\n\\{"}, {"type": "thinking", "thinking": "h"}, {"type": "text", "text": 5}, {"type": 3, "text": "x"}])
        kind = rng.choice(["list", "tool_result", "tool_use", "image", None, "text"])
        if kind == "list":
            return [block(left - 1) for _ in range(rng.randrange(4))]
        inner = {"content": block(left - 1), "input": block(left - 1), "text": block(left - 1), "thinking": "th"}
        return {k: v for k, v in inner.items() if rng.random() < 0.8} | ({"type": kind} if kind else {})

    contents = [block(rng.randrange(1, 16)) for _ in range(200)] + [None, [], {}]
    files = {f"{i:03d}.json": [{"uuid": "u", "name": "n", "chat_messages": [{"uuid": "m", "sender": "human", "content": c}, {"uuid": "e", "sender": "human", "text": "last one"}]}] for i, c in enumerate(contents)}
    rows, bad = load(spark, files)
    assert not bad
    for i, c in enumerate(contents):
        want = "\n\n".join(t.strip() for t in fragments(c) if t.strip())
        assert [x for x in said(rows[f"{i:03d}.json", "u"]) if x[1] != "last one"] == ([("user", want, 0)] if want else []), c


def test_sessions_of_a_hot_account_over_many_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), i, None if rng.random() < 0.02 else float(rng.randrange(40_000))) for i in range(900)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows, "account string, n long, at double")
        got = {r["n"]: r["session"] for r in X.sessions(df, "account", "at", 60.0, "n").collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    for account in ("hot", "b", None):
        last, session = None, 0
        for _, n, at in sorted((r for r in rows if r[0] == account), key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
            session += last is not None and at is not None and at - last > 60
            last = at
            assert got[n] == session
