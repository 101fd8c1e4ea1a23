"""Log analytics and the turn log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions.text import day_label, iso_timestamp
from tarnlake.operators import logs, turns
from tarnlake.plans.registry import query, with_views
from tarnlake.sources.tables import events, router_logs

ISO = "strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ')"
ROW = ["id", "session_id", "intent", "language", "latency_ms", "user_message"]
ROW_SQL = ", ".join(ROW)


@query("rl_stats", with_views("rl newest", """
SELECT count(*) AS total_queries, count(DISTINCT nullif(session_id, '')) AS unique_sessions,
       (SELECT intent FROM newest GROUP BY intent ORDER BY count(*) DESC, max((created_at, id)) DESC LIMIT 1) AS top_intent,
       CAST(coalesce(sum(latency_ms) // nullif(count(latency_ms), 0), 0) AS BIGINT) AS avg_latency_ms FROM newest"""))
def rl_stats(spark, sf_dir):
    return logs.stats(router_logs(spark, sf_dir))


@query("rl_stats_all", with_views("rl", """
SELECT count(*) AS total_queries, count(DISTINCT nullif(session_id, '')) AS unique_sessions,
       (SELECT intent FROM rl GROUP BY intent ORDER BY count(*) DESC, max((created_at, id)) DESC LIMIT 1) AS top_intent,
       CAST(coalesce(sum(latency_ms) // nullif(count(latency_ms), 0), 0) AS BIGINT) AS avg_latency_ms FROM rl"""))
def rl_stats_all(spark, sf_dir):
    return logs.stats(router_logs(spark, sf_dir), cap=None)


@query("rl_page", with_views("rl", f"SELECT {ROW_SQL}, {ISO} AS created_at, (SELECT count(*) FROM rl) AS total FROM rl ORDER BY rl.created_at DESC, id DESC LIMIT 25 OFFSET 50"))
def rl_page(spark, sf_dir):
    rows = router_logs(spark, sf_dir)
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    return logs.page_of(rows, page=3).join(F.broadcast(total)).select(*ROW, iso_timestamp(F.col("created_at")).alias("created_at"), "total")


@query("rl_page_meta", with_views("rl", "SELECT count(*) AS total, CAST((count(*) + 24) // 25 AS BIGINT) AS total_pages, CAST(51 AS BIGINT) AS shown_from, least(CAST(75 AS BIGINT), count(*)) AS shown_to FROM rl WHERE intent = 'click'"))
def rl_page_meta(spark, sf_dir):
    return logs.page_meta(logs.filter_logs(router_logs(spark, sf_dir), intent="click"), page=3)


def _filter_query(name, where, **filters):
    @query(name, with_views("rl", f"SELECT {ROW_SQL} FROM rl WHERE {where}"))
    def run(spark, sf_dir):
        return logs.filter_logs(router_logs(spark, sf_dir), **filters).select(*ROW)


_filter_query("rl_search", "user_message ILIKE '%K\": 1_}%'", search='K": 1_}')
_filter_query("rl_filter_intent", "intent = 'click'", intent="click")
_filter_query("rl_filter_language", "language = 'L3'", language="L3")
_filter_query("rl_filter_dates", "created_at >= '2024-01-05' AND created_at <= '2024-01-20'", date_from="2024-01-05", date_to="2024-01-20")
_filter_query("rl_filter_all", "user_message ILIKE '%2%' AND intent = 'view' AND language = 'L2' AND created_at >= '2024-01-03'", search="2", intent="view", language="L2", date_from="2024-01-03")


@query("rl_fallback_filter", with_views("rl", f"SELECT {ROW_SQL} FROM rl WHERE (contains(lower(user_message), '7') OR contains(lower(session_id), '7')) AND intent = 'error'"))
def rl_fallback_filter(spark, sf_dir):
    return logs.fallback_filter(router_logs(spark, sf_dir), "7", intent="error").select(*ROW)


@query("rl_intent_distribution", with_views("rl newest", "SELECT intent, count(*) AS n FROM newest WHERE intent <> '' GROUP BY intent"))
def rl_intent_distribution(spark, sf_dir):
    return logs.distribution(router_logs(spark, sf_dir), "intent")


@query("rl_language_distribution", with_views("rl newest", "SELECT language, count(*) AS n FROM newest WHERE language <> '' GROUP BY language"))
def rl_language_distribution(spark, sf_dir):
    return logs.distribution(router_logs(spark, sf_dir), "language")


@query("rl_language_share", with_views("rl newest", "SELECT language, n, round(n / sum(n) OVER (), 6) AS share, n = max(n) OVER () AS is_largest FROM (SELECT language, count(*) AS n FROM newest GROUP BY language)"))
def rl_language_share(spark, sf_dir):
    return logs.shares(router_logs(spark, sf_dir), "language")


@query("rl_keyword_nodes", with_views("rl nodes", "SELECT keyword, size FROM nodes"))
def rl_keyword_nodes(spark, sf_dir):
    return logs.keyword_nodes(router_logs(spark, sf_dir))


@query("rl_keyword_links", with_views("rl nodes links", "SELECT source, target, value FROM links"))
def rl_keyword_links(spark, sf_dir):
    return logs.keyword_links(router_logs(spark, sf_dir))


@query("kw_graph_resolved", with_views("rl nodes links", """
SELECT source, target, value, a.size AS source_size, b.size AS target_size, round(greatest(1.0, value / 3), 6) AS width
FROM links JOIN nodes a ON a.keyword = source JOIN nodes b ON b.keyword = target"""))
def kw_graph_resolved(spark, sf_dir):
    rows = router_logs(spark, sf_dir)
    return logs.graph_resolved(logs.keyword_nodes(rows), logs.keyword_links(rows))


@query("kw_node_scale", with_views("rl nodes", """
SELECT keyword, size, round(6 + 18 * (sqrt(size) - (SELECT sqrt(min(size)) FROM nodes)) / ((SELECT sqrt(max(size)) FROM nodes) - (SELECT sqrt(min(size)) FROM nodes)), 6) AS radius FROM nodes"""))
def kw_node_scale(spark, sf_dir):
    return logs.node_scale(logs.keyword_nodes(router_logs(spark, sf_dir)))


@query("rl_display", with_views("rl", """
SELECT id, substring(session_id, 1, 8) || '...' AS session_label, replace(intent, '_', ' ') AS intent_label,
       CASE WHEN length(user_message) > 16 THEN substring(user_message, 1, 14) || '…' ELSE user_message END AS short_label,
       substring(user_message, 1, 48) AS title FROM rl"""))
def rl_display(spark, sf_dir):
    return logs.display(router_logs(spark, sf_dir))


@query("rl_intent_distribution_all", with_views("rl", "SELECT intent, count(*) AS n FROM rl WHERE intent <> '' GROUP BY intent"))
def rl_intent_distribution_all(spark, sf_dir):
    return logs.distribution(router_logs(spark, sf_dir), "intent", cap=None)


@query("radar_scale", with_views("rl", "SELECT intent, count(*) AS n, round(count(*) / max(count(*)) OVER () * 110.0, 6) AS radius FROM rl GROUP BY intent"))
def radar_scale(spark, sf_dir):
    return logs.radar_scale(logs.distribution(router_logs(spark, sf_dir), "intent", cap=None), "intent", "n", 110.0)


@query("rl_export", with_views("rl", f"""
SELECT id, session_id, {ISO} AS created_at, intent, language, latency_ms, user_message, array_to_string(keywords, ', ') AS keywords,
       '{{"language":"' || language || '","intent":"' || intent || '","keywords":["' || array_to_string(keywords, '","') || '"]}}' AS payload
FROM (SELECT * FROM rl WHERE intent = 'purchase' ORDER BY created_at DESC, id DESC LIMIT 10000)"""))
def rl_export(spark, sf_dir):
    return logs.export_rows(router_logs(spark, sf_dir), intent="purchase")


@query("iso_timestamps", f"SELECT event_id, {ISO.replace('created_at', 'ts')} AS iso FROM events")
def iso_timestamps(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", iso_timestamp(F.col("ts")).alias("iso"))


@query("today_str", "SELECT event_id, strftime(ts, '%a %b %-d, %Y') AS label FROM events")
def today_str(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", day_label(F.col("ts")).alias("label"))


# ---- turns -----------------------------------------------------------------------------------------


@query("turn_index", with_views("rl turns", "SELECT session_id, turn_index, id FROM turns"))
def turn_index(spark, sf_dir):
    return turns.number_turns(router_logs(spark, sf_dir)).select("session_id", "turn_index", "id")


@query("turn_latency", with_views("rl", """
SELECT id, greatest(CAST(0 AS BIGINT), latency_ms * (k % 3 - 1)) AS latency_ms, k % 2 = 0 AS is_clarification, k % 2 = 1 AS is_final_answer FROM rl"""))
def turn_latency(spark, sf_dir):
    rows = router_logs(spark, sf_dir)
    start = F.col("created_at").cast("timestamp")
    end = F.timestamp_millis(F.unix_millis(start) + F.col("latency_ms") * (F.col("k") % 3 - 1))
    kind = F.when(F.col("k") % 2 == 0, "clarification").otherwise("final")
    return rows.select("id", turns.latency_ms(start, end).alias("latency_ms"), (kind == "clarification").alias("is_clarification"), (kind == "final").alias("is_final_answer"))


def _numbered(spark, sf_dir):
    return turns.number_turns(router_logs(spark, sf_dir)).select("session_id", "turn_index", "id", "intent", "latency_ms")


@query("turn_upsert", with_views("rl turns", """
SELECT session_id, turn_index, id, intent, CASE WHEN intent = 'error' THEN latency_ms + 1000 ELSE latency_ms END AS latency_ms FROM turns
UNION ALL SELECT 'new' || session_id, turn_index, id, intent, latency_ms + 1000 FROM turns WHERE intent = 'error'"""))
def turn_upsert(spark, sf_dir):
    """The batch corrects the turns of one intent and brings as many of new sessions."""
    rows = _numbered(spark, sf_dir)
    fixed = rows.filter("intent = 'error'").withColumn("latency_ms", F.col("latency_ms") + 1000)
    return turns.upsert(rows, fixed.unionByName(fixed.withColumn("session_id", F.concat(F.lit("new"), "session_id"))))


@query("turn_append", with_views("rl turns", """
SELECT session_id, turn_index, id, intent, latency_ms FROM turns
UNION ALL SELECT session_id, turn_index + count(*) OVER (PARTITION BY session_id), id, intent, latency_ms FROM turns"""))
def turn_append(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    new = router_logs(spark, sf_dir).withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 100 DAYS"))
    return turns.append_turns(rows, new)


@query("turn_violations", with_views("rl", """
, t AS (
    SELECT session_id, CAST(k AS BIGINT) AS turn_index, nullif(k % 11, 0) IS NULL AS no_answer, latency_ms - 1 AS latency_ms,
           created_at - to_milliseconds(CAST((k % 5 = 0) AS BIGINT)) < created_at AS early, k % 7 = 0 AND k % 2 = 0 AS both_flags FROM rl)
SELECT 'null_assistant_message' AS rule, session_id, turn_index FROM t WHERE no_answer
UNION ALL SELECT 'negative_latency', session_id, turn_index FROM t WHERE latency_ms < 0
UNION ALL SELECT 'answer_before_question', session_id, turn_index FROM t WHERE early
UNION ALL SELECT 'both_flags', session_id, turn_index FROM t WHERE both_flags
UNION ALL SELECT 'duplicate_key', session_id, turn_index FROM t GROUP BY ALL HAVING count(*) > 1""".replace("\n, t AS", ", t AS", 1).replace("GROUP BY ALL", "GROUP BY session_id, turn_index")))
def turn_violations(spark, sf_dir):
    k = F.col("k")
    ms = F.unix_millis(F.col("created_at").cast("timestamp"))
    rows = router_logs(spark, sf_dir).select(
        "session_id",
        k.cast("long").alias("turn_index"),
        "user_message",
        F.when(k % 11 != 0, "answer").alias("assistant_message"),
        (k % 7 == 0).alias("is_clarification"),
        (k % 2 == 0).alias("is_final_answer"),
        F.timestamp_millis(ms).alias("created_at"),
        F.timestamp_millis(ms - F.when(k % 5 == 0, 1).otherwise(0)).alias("responded_at"),
        (F.col("latency_ms") - 1).alias("latency_ms"),
    )
    return turns.violations(rows)
