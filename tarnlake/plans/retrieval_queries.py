"""Corpus preparation and hybrid retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnlake.functions.text import host_allowed
from tarnlake.operators import corpus, retrieval
from tarnlake.plans.registry import BLANK, query, with_views
from tarnlake.session import shared_dir
from tarnlake.sources import chunk_cache
from tarnlake.sources.tables import chunks, events, raw_corpus, read, router_logs, tool_outputs

QUERY = "the tion eau en the der of"
TERMS = list(dict.fromkeys(QUERY.split()))


@query("corpus_scan", with_views("scan", "SELECT doc_id, page_content, source_reference, title, site FROM corp"))
def corpus_scan(spark, sf_dir):
    return corpus.scan(raw_corpus(spark, sf_dir))


@query("corpus_skipped", f"SELECT count(*) FILTER (trim(coalesce(text, ''), {BLANK}) <> '') AS loaded, count(*) FILTER (trim(coalesce(text, ''), {BLANK}) = '') AS skipped FROM documents")
def corpus_skipped(spark, sf_dir):
    return corpus.scan_counts(raw_corpus(spark, sf_dir))


@query("chunk_fixed", with_views("scan chunk", "SELECT doc_id, source_reference, part, content FROM chunk"))
def chunk_fixed(spark, sf_dir):
    return chunks(spark, sf_dir)


def numbered(spark, sf_dir):
    return corpus.number_chunks(chunks(spark, sf_dir), whole=True)


@query("chunk_index", with_views("scan chunk numbered", "SELECT doc_id, part, chunk_index FROM numbered"))
def chunk_index(spark, sf_dir):
    return numbered(spark, sf_dir).select("doc_id", "part", "chunk_index")


@query("chunk_rehydrate", with_views("scan chunk", f"""
SELECT CAST(part AS VARCHAR) AS id, part AS chunk_index, trim(CASE WHEN part % 5 = 4 THEN ' ' ELSE content END, {BLANK}) AS page_content,
       CASE WHEN part % 3 = 0 THEN 'Unknown' ELSE source_reference END AS source_reference
FROM chunk WHERE trim(CASE WHEN part % 5 = 4 THEN ' ' ELSE content END, {BLANK}) <> ''"""))
def chunk_rehydrate(spark, sf_dir):
    part = F.col("part")
    rows = chunks(spark, sf_dir).select(part.alias("chunk_index"), F.when(part % 5 == 4, " ").otherwise(F.col("content")).alias("content"), F.when(part % 3 == 0, "").otherwise(F.col("source_reference")).alias("source_reference"))
    return corpus.rehydrate(rows)


@query("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    return corpus.chunk_recursive(corpus.scan(raw_corpus(spark, sf_dir)))


@query("chunk_recursive_facts", with_views("scan", """
SELECT doc_id, true AS fits, true AS inside, true AS covers, regexp_replace(substring(page_content, 1, 20), '\\s+.*$', '', 's') AS head FROM corp"""))
def chunk_recursive_facts(spark, sf_dir):
    """What holds of every text's pieces: none is longer than a chunk, each stands in the text, all its words are in them."""
    docs = corpus.scan(raw_corpus(spark, sf_dir))
    pieces = corpus.chunk_recursive(docs).join(docs.select("doc_id", "page_content"), "doc_id")
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    by_doc = pieces.groupBy("doc_id").agg(
        F.max(F.length("content") <= 200).alias("_any"),
        F.min(F.length("content") <= 200).alias("fits"),
        F.min(F.col("page_content").contains(F.col("content"))).alias("inside"),
        F.flatten(F.collect_list(words(F.col("content")))).alias("_words"),
        F.first("page_content").alias("_text"),
        F.min_by("content", "part").alias("_first"),
    )
    long = F.filter(words(F.col("_text")), lambda w: F.length(w) <= 50)
    covers = F.size(F.array_except(long, F.col("_words"))) == 0
    return by_doc.select("doc_id", "fits", "inside", covers.alias("covers"), F.regexp_replace(F.substring("_first", 1, 20), r"(?s)\s+.*$", "").alias("head"))


@query("chunk_cache_roundtrip", with_views("scan chunk numbered", f"""
SELECT CAST(chunk_index AS VARCHAR) AS id, chunk_index, trim(content, {BLANK}) AS page_content, source_reference FROM numbered WHERE trim(content, {BLANK}) <> ''"""))
def chunk_cache_roundtrip(spark, sf_dir):
    path = f"{shared_dir(spark)}/tarnlake/chunk-cache-{uuid.uuid4().hex[:12]}"
    chunk_cache.save(numbered(spark, sf_dir), path)
    return chunk_cache.load(spark, path)


def _query_vector(spark, sf_dir):
    """The query is a stored vector, that of the least id: 64 numbers."""
    row = read(spark, sf_dir, "embeddings").agg(F.min_by("embedding", "vec_id").alias("q")).first()
    return row["q"]


def _dense(spark, sf_dir):
    return retrieval.dense_topk(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), key="vec_id")


_DENSE = """dense AS (
    SELECT vec_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY s.score DESC, vec_id) AS INTEGER) AS rank FROM (
        SELECT vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(arg_min(embedding, vec_id) AS DOUBLE[]) FROM embeddings)) AS score FROM embeddings) s
    QUALIFY rank <= 10)"""
_TF = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))
_FACTS = ", ".join(f"ln(1 + (count(*) - count(*) FILTER (tf{i} > 0) + 0.5) / (count(*) FILTER (tf{i} > 0) + 0.5)) AS idf{i}" for i in range(len(TERMS)))
_SCORE = " + ".join(f"idf{i} * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * n / mean))" for i in range(len(TERMS)))
_BM25 = f"""tokens AS (
    SELECT chunk_index, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') AS t FROM numbered
), tf AS (SELECT chunk_index, len(t) AS n, {_TF} FROM tokens
), facts AS (SELECT avg(n) AS mean, {_FACTS} FROM tf
), sparse AS (
    SELECT chunk_index, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY s.score DESC, chunk_index) AS INTEGER) AS rank
    FROM (SELECT chunk_index, {_SCORE} AS score FROM tf, facts) s QUALIFY rank <= 10)"""


@query("dense_topk", f"WITH {_DENSE} SELECT vec_id, score, rank FROM dense")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir)


def _firsts(spark, sf_dir):
    return corpus.first_numbers(corpus.chunk_counts(corpus.scan(raw_corpus(spark, sf_dir))))


def _sparse(spark, sf_dir):
    """Ranked by document and part, the order of the numbers; only the ten hits get theirs."""
    rows = chunks(spark, sf_dir).withColumn("num", F.col("doc_id").cast("long"))
    return corpus.number_hits(retrieval.bm25_topk(rows, QUERY, key=["num", "part"]), _firsts(spark, sf_dir)).select("chunk_index", "score", "rank")


@query("bm25_topk", with_views("scan chunk numbered", "").rstrip() + f", {_BM25} SELECT chunk_index, score, rank FROM sparse")
def bm25_topk(spark, sf_dir):
    return _sparse(spark, sf_dir)


_FUSED = f"""{_BM25}, {_DENSE}, hits AS (
    SELECT h.*, content, source_reference FROM (SELECT vec_id AS chunk_index, rank, 0 AS list FROM dense UNION ALL SELECT chunk_index, rank, 1 FROM sparse) h JOIN numbered USING (chunk_index)
), fused AS (
SELECT chunk_index, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY f.score DESC, list, chunk_index) AS INTEGER) AS rank FROM (
    SELECT arg_min(chunk_index, list * 100 + rank) AS chunk_index, sum(0.5 / (60 + rank)) AS score, min(list) AS list FROM hits GROUP BY content) f)"""


def _fused(spark, sf_dir):
    """(fused list, chunks of all hits): a chunk's vector is that of its number, and hits of one text count as one."""
    dense = _dense(spark, sf_dir).withColumnRenamed("vec_id", "chunk_index").select("chunk_index", "rank", F.lit(0).alias("list"))
    both = dense.unionByName(_sparse(spark, sf_dir).select("chunk_index", "rank", F.lit(1).alias("list")))  # at most 20 rows
    hits = corpus.chunks_at(corpus.scan(raw_corpus(spark, sf_dir)), _firsts(spark, sf_dir), both)
    return retrieval.fuse(hits.filter("list = 0"), hits.filter("list = 1"), key="chunk_index", content="content"), hits


@query("rrf_fusion", with_views("scan chunk numbered", "").rstrip() + f", {_FUSED} SELECT chunk_index, score, rank FROM fused")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir)[0]


@query("retrieve_json", with_views("scan chunk numbered", "").rstrip() + f""", {_FUSED}
SELECT '{{"documents":[' || string_agg('{{"content":' || to_json(content) || ',"source_reference":' || to_json(source_reference) || ',"chunk_index":' || chunk_index || '}}', ',' ORDER BY rank) || ']}}' AS payload
FROM fused JOIN numbered USING (chunk_index)""")
def retrieve_json(spark, sf_dir):
    top, hits = _fused(spark, sf_dir)
    return retrieval.as_tool_json(top, hits.select("chunk_index", "content", "source_reference").distinct(), "chunk_index")


@query("retrieve_failures", with_views("rl", """
SELECT id, CASE k % 3 WHEN 0 THEN user_message WHEN 1 THEN '{"documents": [], "error": "Medical knowledge base is unavailable right now."}' ELSE 'Unable to retrieve information at this time.' END AS result FROM rl"""))
def retrieve_failures(spark, sf_dir):
    k = F.col("k")
    return router_logs(spark, sf_dir).select("id", retrieval.tool_result(F.col("user_message"), k % 3 != 1, k % 3 == 2).alias("result"))


def _items(spark, sf_dir):
    return retrieval.context_items(tool_outputs(spark, sf_dir), "key", "raw", at="at")


@query("context_items", with_views("ctx", "SELECT key, ordinal, content, source_reference, chunk_index, title, url, CAST(score AS DOUBLE) AS score FROM items"))
def context_items(spark, sf_dir):
    return _items(spark, sf_dir)


@query("citations", with_views("ctx", f"SELECT key, ordinal AS id, source_reference AS source, chunk_index, title, trim(substring(content, 1, 200), {BLANK}) AS excerpt, nullif(url, '') AS url, CAST(score AS DOUBLE) AS score FROM items"))
def citations(spark, sf_dir):
    return retrieval.citations(_items(spark, sf_dir), "key")


@query("grounding_context", with_views("ctx", """
SELECT key, string_agg('[' || ordinal || '] Source: ' || source_reference || CASE WHEN title <> '' THEN ' | Title: ' || title ELSE '' END || chr(10) || 'Content: ' || content, chr(10) || chr(10) ORDER BY ordinal) AS context FROM items GROUP BY key"""))
def grounding_context(spark, sf_dir):
    return retrieval.grounding_context(_items(spark, sf_dir), "key")


@query("sources_normalized", """
WITH s AS (SELECT doc_id, doc_id % 4 AS m, source FROM documents)
SELECT doc_id, CASE m WHEN 0 THEN 'https://' || source || '.example/' WHEN 1 THEN source WHEN 2 THEN 's:' || source ELSE 'Unknown Source' END AS label,
       CASE m WHEN 0 THEN 'https://' || source || '.example/' WHEN 2 THEN 'http://u/' || doc_id END AS href,
       CASE m WHEN 0 THEN 'https://' || source || '.example/' WHEN 1 THEN 'Title ' || doc_id WHEN 2 THEN 's:' || source ELSE 'Source 1' END AS shown FROM s""")
def sources_normalized(spark, sf_dir):
    m, source = F.col("doc_id") % 4, F.col("source")
    rows = read(spark, sf_dir, "documents").select(
        "doc_id",
        F.lit(1).alias("ordinal"),
        F.when(m == 0, F.concat(F.lit("https://"), source, F.lit(".example/"))).when(m == 1, source).otherwise("").alias("source_reference"),
        F.when(m == 2, F.concat(F.lit("s:"), source)).alias("source"),
        F.when(m == 2, F.concat(F.lit("http://u/"), F.col("doc_id").cast("string"))).otherwise("").alias("url"),
        F.when(m == 1, F.concat(F.lit("Title "), F.col("doc_id").cast("string"))).otherwise("").alias("title"),
    )
    return retrieval.normalize_sources(rows).select("doc_id", "label", "href", "shown")


_NOT_JSON, _NO_OBJECT, _NEITHER = "Tool output was not valid JSON.", "Tool output JSON was not an object.", "Tool output did not contain documents or web_results."
_CASES = [  # (raw, kind, error)
    ('{"documents": [{"content": "a"}]}', "documents", None),
    ('{"web_results": [], "error": "timeout"}', "web_results", "timeout"),
    ("no json", "malformed", _NOT_JSON),
    ("[1]", "malformed", _NO_OBJECT),
    ('{"documents": "x"}', "malformed", "RAG documents payload was not a list."),
    ('{"documents": null, "web_results": [1]}', "documents", None),
    ('{"error": "e"}', "malformed", "e"),
    ('{"web_results": {"a": 1}}', "malformed", "Web results payload was not a list."),
    ('{"error": {"documents": 1}, "web_results": []}', "web_results", '{"documents":1}'),
    ('{"answer": {"documents": []}}', "malformed", _NEITHER),
    ('{"documents": {}}', "documents", None),
    ('{"documents": 0, "web_results": [1]}', "documents", None),
]


def _case_sql(values) -> str:
    return f"CASE k % {len(_CASES)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(values) if x is not None) + " END"


@query("context_kind", with_views("rl", f"SELECT id AS event_id, {_case_sql(c[1] for c in _CASES)} AS kind, {_case_sql(c[2] for c in _CASES)} AS error FROM rl"))
def context_kind(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(c[0]) for c in _CASES]), (F.col("k") % len(_CASES) + 1).cast("int"))
    return events(spark, sf_dir).select("event_id", retrieval.tool_kind(raw).alias("kind"), retrieval.tool_error(raw).alias("error"))


@query("message_sources", f"""
WITH m AS (SELECT *, turn % 3 = 2 AND role = 'assistant' AS cites FROM conversations),
last AS (SELECT conv_id, max(turn) AS turn FROM m WHERE cites GROUP BY conv_id),
own AS (SELECT conv_id, CAST(0 AS BIGINT) AS turn, CAST(turn AS INTEGER) AS chunk_index, 'S' || turn % 2 AS source, 'e' || turn AS excerpt FROM last),
tool AS (SELECT conv_id, turn, CAST(turn % 5 AS INTEGER) AS chunk_index, 'Unknown Source' AS source, nullif(trim(substring(coalesce(text, ''), 1, 160), {BLANK}), '') AS excerpt
         FROM m WHERE role = 'user' AND turn % 2 = 0 AND conv_id NOT IN (SELECT conv_id FROM last))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, source, chunk_index, excerpt FROM (SELECT * FROM own UNION ALL SELECT * FROM tool)""")
def message_sources(spark, sf_dir):
    """Assistant messages of every third turn carry a source; users' even turns stand for tool messages."""
    turn = F.col("turn")
    cites = (F.col("role") == "assistant") & (turn % 3 == 2)
    cited = F.array(F.struct(F.concat(F.lit("S"), (turn % 2).cast("string")).alias("source_reference"), turn.cast("int").alias("chunk_index"), F.concat(F.lit("e"), turn.cast("string")).alias("excerpt")))
    as_tool = (F.col("role") == "user") & (turn % 2 == 0)
    payload = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("content"), (turn % 5).alias("chunk_index"))).alias("documents")))
    rows = read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(as_tool, "tool").otherwise(F.col("role")).alias("role"), F.when(as_tool, payload).otherwise(F.col("text")).alias("text"), F.when(cites, cited).alias("sources")
    )
    return retrieval.message_sources(rows).withColumn("id", F.col("id").cast("long"))


@query("web_domain_filter", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://([^/:?#]*\\.)?(tiontion\\.example\\.com|example\\.org)([/:?#]|$)')")
def web_domain_filter(spark, sf_dir):
    return read(spark, sf_dir, "pages").filter(host_allowed(F.col("url"), ("tiontion.example.com", "example.org"))).select("page_id", "url")


@query("web_results", """
SELECT url, '' AS title, html AS content, CAST(0 AS DOUBLE) AS score FROM pages WHERE regexp_matches(url, '^https?://([^/:?#]*\\.)?example\\.org([/:?#]|$)') ORDER BY url LIMIT 5""")
def web_results(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("url", F.col("html").alias("content"))
    return retrieval.web_results(pages, ("example.org",))
