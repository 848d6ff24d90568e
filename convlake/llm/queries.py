"""The queries of the numbered operators and the pipeline, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.llm import bpe, covertree, decontaminate, langid, licenses, merkle, packing, secrets, sharding, simhash, substrings, trie, urlfilter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.Scanner(spark).find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("nth").cast("long").alias("nth"), "kind", F.length("secret").cast("long").alias("n_chars"), F.sha2("secret", 256).alias("secret_sha256"), "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return covertree.top_k(vectors.filter("vec_id % 100 = 0"), vectors)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("proof")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run, "op1_decontamination": op1_decontamination, "op2_secret_scan": op2_secret_scan, "op3_url_filter": op3_url_filter, "op4_exact_top_k": op4_exact_top_k, "op5_best_fit_packing": op5_best_fit_packing, "op6_simhash": op6_simhash, "op7_license_scan": op7_license_scan, "op8_language_id": op8_language_id, "op9_suffix_dedup": op9_suffix_dedup, "op10_sharding": op10_sharding, "op11_merkle_manifest": op11_merkle_manifest, "op12_conversation_trie": op12_conversation_trie, "op13_bpe_codec": op13_bpe_codec}


OP1_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), s AS (
  SELECT DISTINCT side, id, array_to_string(w[k:k + 4], ' ') AS shingle
  FROM (SELECT side, id, w, unnest(generate_series(1, len(w) - 4)) AS k FROM w WHERE len(w) >= 5)
), n AS (SELECT id, count(*) AS n_item FROM s WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n_item) AS n_item, count(*) AS n_shared, count(*) / any_value(n_item) AS containment
FROM s d JOIN s i ON d.shingle = i.shingle AND d.side = 'd' AND i.side = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n_item)
"""

OP3_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rule, rhost, rpath, rverdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
)
SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, coalesce(max_by(rverdict, length(rule)), 'allow') AS verdict
FROM s LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY page_id, host, path
"""


OP4_SQL = r"""
WITH v AS (
  SELECT vec_id, len(embedding) AS n, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n = c.n AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
) WHERE rank <= 10
"""


#: crc32 of a decimal, bit by bit.
_CRC32 = """xor(list_reduce(range(8 * length({s})), lambda c, j:
    xor((CASE WHEN j % 8 = 0 THEN xor(c, ascii({s}[j // 8 + 1])) ELSE c END) >> 1, CASE WHEN (CASE WHEN j % 8 = 0 THEN xor(c, ascii({s}[j // 8 + 1])) ELSE c END) & 1 = 1 THEN 3988292384 ELSE 0 END),
    4294967295), 4294967295)"""

OP11_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS k, (n_chars IS NOT NULL AND CRC % 7 = 0) AS hit,
    concat_ws('', FIELD(CAST(doc_id AS VARCHAR)), FIELD(source), FIELD(lang)) AS a,
    FIELD(CAST(n_chars AS VARCHAR)) AS n, FIELD(CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)) AS n1, FIELD(text) AS t FROM documents
), p AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, k, sha256(a || n || t) AS leaf, CASE WHEN hit THEN sha256(a || n1 || t) ELSE sha256(a || n || t) END AS shown FROM f)
), t(k, lvl, pos, digest, n) AS (
  SELECT k, 0, pos, leaf, count(*) OVER (PARTITION BY k) FROM p
  UNION ALL
  SELECT k, lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY k, lvl, pos // 2, n
), g AS (SELECT k, lvl AS height, digest, row_number() OVER (ORDER BY k) - 1 AS pos FROM t WHERE n = 1
), u(lvl, pos, digest, n) AS (
  SELECT 0, pos, digest, count(*) OVER () FROM g
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n
), s AS (
  SELECT p.k, p.pos, v.lvl AS step, (p.pos >> v.lvl) % 2 = 1 AS odd, coalesce(w.digest, '') AS sib
  FROM p JOIN (SELECT DISTINCT k, lvl FROM t WHERE n > 1) v ON p.k = v.k LEFT JOIN t w ON w.k = p.k AND w.lvl = v.lvl AND w.pos = xor(p.pos >> v.lvl, 1)
  UNION ALL
  SELECT p.k, p.pos, g.height + v.lvl, (g.pos >> v.lvl) % 2 = 1, coalesce(w.digest, '')
  FROM p JOIN g ON p.k = g.k CROSS JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) v LEFT JOIN u w ON w.lvl = v.lvl AND w.pos = xor(g.pos >> v.lvl, 1)
), e(k, pos, step, done) AS (
  SELECT k, pos, 0, shown FROM p
  UNION ALL
  SELECT e.k, e.pos, e.step + 1, sha256(CASE WHEN odd THEN sib || done ELSE done || sib END) FROM e JOIN s ON e.k = s.k AND e.pos = s.pos AND e.step = s.step
), x AS (SELECT k, pos, arg_max(done, step) AS folded FROM e GROUP BY k, pos
), y AS (SELECT k, pos, string_agg(sib, '' ORDER BY step) AS sibs FROM s GROUP BY k, pos
)
SELECT p.doc_id, p.leaf, g.digest AS subroot, r.digest AS root, sha256(coalesce(y.sibs, '')) AS proof_sha256, x.folded AS folded_root, x.folded = r.digest AS verified
FROM p JOIN g ON p.k = g.k JOIN x ON p.k = x.k AND p.pos = x.pos LEFT JOIN y ON p.k = y.k AND p.pos = y.pos CROSS JOIN (SELECT digest FROM u WHERE n = 1) r
"""
OP11_SQL = re.sub(r"FIELD\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"coalesce(strlen(\1) || ':' || \1, '-')", OP11_SQL).replace("CRC", _CRC32.format(s="CAST(doc_id AS VARCHAR)"))

OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha256(strlen(role) || ':' || role || text), 32)) - 1 AS pos FROM t
), c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, CRC % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)
), b AS (SELECT c.conv_id, o.pos + 1 AS depth, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.pos < c.h
), k AS (SELECT conv_id, count(*) AS taken FROM b GROUP BY conv_id
), r AS (
  SELECT * FROM b
  UNION ALL
  SELECT c.conv_id, o.pos - c.h + coalesce(k.taken, 0) + 1, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h LEFT JOIN k ON k.conv_id = c.conv_id
), m AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS bytes FROM c
  UNION ALL
  SELECT conv_id, depth, string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth), strlen(text) FROM r
), l AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id
), n AS (SELECT path, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(bytes) AS bytes FROM m GROUP BY path
), u AS (SELECT n.path, p.path AS above FROM n JOIN m p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
), d AS (SELECT above AS path, count(*) AS n_children FROM u GROUP BY above
), s AS (
  SELECT v.path, sum(CASE WHEN d.path IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
  FROM n LEFT JOIN d ON d.path = n.path JOIN m v ON v.conv_id = n.conv_id AND v.depth <= n.depth GROUP BY v.path
), e AS (SELECT m.path, string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) AS ids FROM m JOIN l ON l.conv_id = m.conv_id AND l.depth = m.depth GROUP BY m.path
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(d.n_children, 0) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN d ON d.path = n.path LEFT JOIN u ON u.path = n.path LEFT JOIN n a ON a.path = u.above LEFT JOIN e ON e.path = n.path
"""
OP12_SQL = OP12_SQL.replace("CRC", _CRC32.format(s="CAST(conv_id AS VARCHAR)"))


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are tested against brute force."""
    return {"op1_decontamination": OP1_SQL, "op3_url_filter": OP3_SQL, "op4_exact_top_k": OP4_SQL, "op11_merkle_manifest": OP11_SQL, "op12_conversation_trie": OP12_SQL}
