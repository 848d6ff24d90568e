import re

import corpus_pipeline
from convlake.llm import decontaminate, simhash
from test_decontaminate import brute as leaks
from test_simhash_langid import brute_components


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    extra = [(9000, None, "en", "s", 0), (9001, "12 34 56", None, "s", 8), (None, "the of and that with", None, None, None)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    docs = docs.union(docs.limit(2))
    expected = {(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "sequence_packing":
            assert {r["doc_id"] for r in out.collect()} == {d for d, _ in expected}
            break
        assert out.columns == columns
        rows = [(r["doc_id"], r["text"]) for r in out.collect()]
        if name == "simhash_dedup":
            before = sorted(expected, key=lambda r: (r[0] is None, r[0]))
            groups = [eval(x) for x in brute_components(before)]
            expected = {(d, t) for d, t in before if d in {c for _, _, c in groups} or d is None and (None, None) in {(i, c) for i, _, c in groups}}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            bad = {eval(x)[0] for x in leaks(sorted(expected, key=str), items)}
            expected = {(d, t) for d, t in expected if d not in bad}
        if name == "secret_masking":
            expected = {(d, re.sub(r'(?i)(token = ")[0-9a-f]{40}(?=")', r"\1[SECRET]", t)) for d, t in expected}
        assert set(rows) == expected
        if name != "language_id":
            assert len(rows) == len(expected)
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 100


def test_stages_take_empty_and_null_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp int"
    for rows in ([], [(None, None, None, None, None, None, None)] * 2, [(1, "", None, None, None, 0.5, 1), (1, "word", "en", "s", 4, 0.5, 1)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= max(len(rows), 1) and (name == "sequence_packing" or out.columns == docs.columns)
