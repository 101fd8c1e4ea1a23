"""The thin queries over the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import bpe, html, neardup, packing, quality, sharding, tokenfiles, topk, toxicity, warc
from tarnlake.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), floor=0)
    return found.select("doc_id", "class_id", "kept")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2048, 1)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 0)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_topk": op4_topk,
    "op5_warc": op5_warc,
    "op6_bpe": op6_bpe,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_token_files": op9_token_files,
    "op10_html_extraction": op10_html_extraction,
}

_TOPK = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_QUALITY = r"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
    SELECT doc_id, t, w, len(w) AS n,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM w
), g AS (
    SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, n - 1)) AS i FROM p WHERE n >= 3)
), d AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1
), c AS (
    SELECT doc_id, count(DISTINCT i + o) AS rep FROM d, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id
), s AS (
    SELECT doc_id, CAST(n AS BIGINT) AS n_words,
           CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words,
           len(lines) AS n_lines,
           len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS letter_words
    FROM p LEFT JOIN c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR 100 * n_symbols > 5 * word_chars OR 100 * n_dup_lines > 40 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * letter_words < 50 * n_words) AS kept
FROM s
""".replace("\\\\", "\\")

# crc32 by its definition: a table of 256 remainders of the reversed polynomial, one step for each byte
_SHARDS = """
WITH tab AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), raw AS (
    SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, hex(coalesce(text, '')) AS h FROM documents
), b AS (
    SELECT doc_id, size, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substring(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM raw
), s AS (
    SELECT doc_id, size, CAST(xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT) AS text_crc32,
           sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total
    FROM b, tab
), p AS (SELECT *, CAST((2 * upto - size) * 24 // (2 * total) AS INTEGER) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""

_WARC = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM f
"""

# by the pages' own template: the article's paragraphs and heading
_HTML = r"""
WITH a AS (
    SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages
), b AS (
    SELECT page_id, url, string_split_regex(body, '</?(?:p|h1)>') AS parts FROM a
), c AS (
    SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(
        replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
            '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM b
), d AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

ORACLES = {"op2_sharding": _SHARDS, "op4_topk": _TOPK, "op5_warc": _WARC, "op7_quality_rules": _QUALITY, "op10_html_extraction": _HTML}
