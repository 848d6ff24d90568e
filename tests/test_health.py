import itertools

from convlake.operators import health


def expected(conversations, messages, notes):
    ids = [i for i, _, _ in conversations]
    places = {}
    for _, c, s in messages:
        places.setdefault(c, []).append(s)
    # nulls first; a place that is not the row's number breaks the sequence
    broken = sum(any(s is not None and s != k for k, s in enumerate(sorted(p, key=lambda s: (s is not None, s or 0)))) for p in places.values())
    twice = lambda keys: sum(n > 1 for n in map(keys.count, set(keys)))
    known = {i for i in ids if i is not None}
    used = {c for c in places if c is not None}
    return {
        "conversations": len(ids),
        "messages": len(messages),
        "notes": len(notes),
        "orphan_messages": sum(c not in known for _, c, _ in messages),
        "repeated_conversation_ids": twice(ids),
        "repeated_message_ids": twice([m for m, _, _ in messages]),
        "repeated_source_keys": twice([(s, k) for _, s, k in conversations]),
        "broken_sequences": broken,
        "empty_conversations": sum(i not in used for i in ids),
    }


def check(spark, conversations, messages, notes):
    got = health.checks(
        spark.createDataFrame(conversations, "id long, source string, source_conversation_id string"),
        spark.createDataFrame(messages, "id long, conversation_id long, sequence_index int"),
        spark.createDataFrame([(n,) for n in notes], "id long"),
    ).collect()
    want = expected(conversations, messages, notes)
    assert {r["name"]: r["n"] for r in got} == want and len(got) == len(want)
    assert all(r["ok"] == (r["n"] == 0 or r["name"] in ("conversations", "messages", "notes")) for r in got)


def test_counts_of_damaged_tables(spark):
    sequences = [[0, 1, 2], [1, 2], [0, 0, 1], [None, 1, 2], [None, 0, 1], [None, None], [0, 2], [2, 1, 0], [-1, 0], [None, 1, 1]]
    n = itertools.count()
    messages = [(next(n), c, s) for c, p in enumerate(sequences) for s in p]
    messages += [messages[0], (None, None, 0), (None, None, 3), (900, 77, 0)]
    conversations = [(c, "a", str(c)) for c in range(len(sequences) + 2)] + [(3, "a", "3"), (None, None, None), (None, None, None), (50, "a", "4")]
    check(spark, conversations, messages, [1, 1, None])


def test_empty_tables(spark):
    check(spark, [], [], [])


def test_no_table_is_read_more_than_twice(spark):
    conversations = spark.range(5).selectExpr("id", "'a' AS source", "string(id) AS source_conversation_id")
    messages = spark.range(9).selectExpr("id", "id % 5 AS conversation_id", "int(id div 5) AS sequence_index")
    plan = health.checks(conversations, messages, spark.range(3))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 5 and "Window" not in plan
