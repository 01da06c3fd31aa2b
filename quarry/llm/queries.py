"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, exact, langid, license, packing, pii, simhash, substring, toxicity, trie, urls, warc, whitening

#: The rules that op4 is judged by.
URL_RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]

#: The key of op6; a caller of the operator brings its own secret.
PII_KEY = b"registered query"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_pii(_table(spark, sf_dir, "documents"), PII_KEY)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector and component: what is the same in all rows is a literal."""
    vectors = _table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    error = whitening.identity_error(vectors, model)
    rows = whitening.whiten(vectors, model).select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    return rows.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = trie.number_turns(_table(spark, sf_dir, "conversations"))
    return trie.build(*trie.graft(numbered, every=5, most=9))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    model = langid.train(langid.sample(docs.where(~held_out)))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def queries() -> dict:
    found = [op1_substring_dedup, op2_license_scan, op3_toxicity, op4_url_filters, op5_simhash, op6_pii, op7_warc, op8_exact_dedup, op9_packing, op10_decontamination, op11_whitening, op12_prefix_trie, op13_language]
    return {f.__name__: f for f in found}


_HEX = "(('0x' || substr(h, {0}, 5))::BIGINT)"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({_HEX.format(5 * g + 1)} >> {s}) & 31)::INT, 1)" for g in range(8) for s in (15, 10, 5, 0))
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
low AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM low WHERE m < doc_id),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""",
    "op4_url_filters": f"""
WITH u AS (
  SELECT page_id, coalesce(contains(url, '://'), false) AS ok,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id, CASE WHEN ok THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) ELSE '' END AS host,
         CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (
  SELECT s.page_id, s.host, s.path, r.verdict, rh || rp AS rule, row_number() OVER (PARTITION BY s.page_id, s.host, s.path ORDER BY length(rh || rp) DESC) AS k
  FROM s JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM s LEFT JOIN m ON s.page_id = m.page_id AND s.host = m.host AND s.path = m.path AND m.k = 1""",
    "op7_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""",
    "op8_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op10_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
hit AS (SELECT dp.doc_id, dp.i, dp.k, win.item_id FROM dp JOIN win ON dp.k = win.k AND array_to_string(w[i:i + dp.k - 1], ' ') = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op12_prefix_trie": """
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id FROM o),
b AS (SELECT conv_id, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT) AS bytes FROM c),
h AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(bytes, lambda x: [x, -1::BIGINT, -1, -1, -1, -1, -1, -1, -1]))),
  lambda r, x: CASE WHEN x = -1 THEN xor(r >> 1, (r & 1) * 3988292384) ELSE xor(r, x) END), 4294967295::BIGINT) % 9 AS h FROM b),
g AS (SELECT h.conv_id, o.p, o.role, o.text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5 AND o.p <= h.h),
r AS (SELECT conv_id, 0 AS own, p, role, text FROM g UNION ALL SELECT o.conv_id, 1, o.p, o.role, o.text FROM o JOIN h USING (conv_id) WHERE o.p > h.h),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS depth, sha256(strlen(role) || ':' || role || text) AS k, strlen(text) AS bytes FROM r),
w AS (SELECT conv_id, depth, bytes, sha256(string_agg(k, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS path FROM t UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, max(depth) AS n FROM w GROUP BY 1),
m AS (SELECT w.*, e.n, min(w.conv_id) OVER (PARTITION BY depth, path) AS node FROM w JOIN e USING (conv_id)),
u AS (SELECT depth, path, node, count(*) AS n_convs, min(bytes) AS bytes, string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends FROM m GROUP BY 1, 2, 3),
k AS (SELECT u.*, p.path AS up, p.node AS parent FROM u LEFT JOIN m p ON p.conv_id = u.node AND p.depth = u.depth - 1),
n AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN n ON n.depth = k.depth AND n.path = k.path),
s AS (SELECT a.depth, a.path, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved FROM f JOIN m a ON a.conv_id = f.node AND a.depth <= f.depth GROUP BY 1, 2)
SELECT f.node AS conv_id, f.depth::BIGINT AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s ON s.depth = f.depth AND s.path = f.path""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
