"""Query registry: each name with its Spark form and, where SQL can express it, DuckDB SQL of its own making.

The SQL is written from an operator's meaning, not from the Spark code. ``SQL`` holds the shared views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
STEP = 150

SQL = {
    "rl": """rl AS (
        SELECT event_id AS id, CAST(user_id AS VARCHAR) AS session_id, ts AS created_at, event_type AS intent,
               CAST(floor(value) AS BIGINT) AS latency_ms, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               'L' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS language, props AS user_message,
               [lower(event_type), 'k' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 10, 'u' || user_id % 10] AS keywords
        FROM events)""",
    "scan": f"""corp AS (
        SELECT doc_id AS num, CAST(doc_id AS VARCHAR) AS doc_id, trim(text, {BLANK}) AS page_content,
               CASE WHEN doc_id % 3 = 0 THEN 'https://' || source || '.example/' || doc_id
                    WHEN doc_id % 3 = 1 THEN source || '.pdf' ELSE CAST(doc_id AS VARCHAR) END AS source_reference,
               '' AS title, source AS site
        FROM documents WHERE trim(coalesce(text, ''), {BLANK}) <> '')""",
    "chunk": f"""chunk AS (
        SELECT * FROM (
            SELECT num, doc_id, source_reference, CAST(part AS INTEGER) AS part, substring(page_content, CAST(part * {STEP} + 1 AS BIGINT), 200) AS content
            FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((length(page_content) - 50) / {STEP}.0) AS BIGINT)))) AS part FROM corp))
        WHERE content <> '')""",
    "numbered": """numbered AS (
        SELECT *, row_number() OVER (ORDER BY num, part) - 1 AS chunk_index FROM chunk)""",
    "newest": "newest AS (SELECT * FROM rl ORDER BY created_at DESC, id DESC LIMIT 5000)",
    "nodes": """kw AS (
        SELECT id, created_at, unnest(keywords) AS keyword, generate_subscripts(keywords, 1) AS pos
        FROM (SELECT * FROM rl ORDER BY created_at DESC, id DESC LIMIT 1000)
    ), nodes AS (
        SELECT keyword, count(*) AS size FROM kw GROUP BY keyword
        ORDER BY size DESC, max(created_at) DESC, max((created_at, id)) DESC, max((created_at, id, -pos)) DESC LIMIT 30)""",
    "links": """links AS (
        SELECT least(a.keyword, b.keyword) AS source, greatest(a.keyword, b.keyword) AS target, count(*) AS value
        FROM kw a JOIN kw b ON a.id = b.id AND a.pos < b.pos GROUP BY 1, 2
        HAVING count(*) > 1 AND source IN (SELECT keyword FROM nodes) AND target IN (SELECT keyword FROM nodes))""",
    "turns": """turns AS (
        SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS BIGINT) AS turn_index, id, intent, latency_ms FROM rl)""",
    "ctx": f"""ctx AS (
        SELECT source AS key, doc_id AS pos, trim(text, {BLANK}) AS content,
               CASE WHEN doc_id % 8 = 0 THEN 'https://x.example/' || source WHEN doc_id % 4 = 0 THEN 'Unknown Source' ELSE source END AS source_reference,
               CASE WHEN doc_id % 8 = 0 THEN 'https://x.example/' || source ELSE '' END AS url,
               CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END || n_chars % 3 AS number, CASE WHEN doc_id % 7 <> 0 THEN CAST(n_chars % 3 AS INTEGER) END AS chunk_index,
               CASE WHEN doc_id % 5 = 0 THEN (doc_id % 10) / 4.0 END AS score, CASE WHEN doc_id % 2 = 0 THEN 'T' || source ELSE '' END AS title
        FROM documents WHERE trim(coalesce(text, ''), {BLANK}) <> ''
    ), once AS (
        SELECT *, row_number() OVER (PARTITION BY key, source_reference, number, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) ORDER BY pos) AS n FROM ctx
    ), items AS (
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY pos) AS INTEGER) AS ordinal FROM once WHERE n = 1) WHERE ordinal <= 5)""",
}


def with_views(views: str, body: str) -> str:
    """``body`` behind the named shared views, in the order given."""
    return "WITH " + ",\n".join(SQL[v] for v in views.split()) + "\n" + body


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
