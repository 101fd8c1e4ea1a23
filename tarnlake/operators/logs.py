"""Router-log analytics: filters, pages, statistics, keyword graph, export.

Rows: id, session_id, created_at, intent, language, latency_ms, user_message, keywords. The newest-first
order is (created_at, id), both descending, so that pages and caps are stable. ``cap`` bounds a statistic to
the newest rows, as a dashboard wants; None takes the whole table without a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.config import SETTINGS
from tarnlake.functions.text import message_error, sanitize

ALL = (None, "", "All Intents", "All Languages")


def newest() -> list[Column]:
    return [F.col("created_at").desc_nulls_last(), F.col("id").desc_nulls_last()]


def filter_logs(df: DataFrame, search: str | None = None, intent: str | None = None, language: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Any subset of the filters. % and _ in ``search`` stay wildcards; both dates are inclusive."""
    if search:
        df = df.filter(F.ilike("user_message", F.lit("%" + search.replace("\\", "\\\\") + "%")))
    if intent not in ALL:
        df = df.filter(F.col("intent") == intent)
    if language not in ALL:
        df = df.filter(F.col("language") == language)
    if date_from:
        df = df.filter(F.col("created_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        df = df.filter(F.col("created_at") <= F.lit(date_to).cast("timestamp_ntz"))
    return df


def fallback_filter(df: DataFrame, search: str = "", intent: str | None = None, language: str | None = None) -> DataFrame:
    """The offline filter: a literal, case-insensitive search in the message or the session."""
    if search:
        s = search.lower()
        df = df.filter(F.lower("user_message").contains(s) | F.lower("session_id").contains(s))
    return filter_logs(df, intent=intent, language=language)


def check_page(page: int, page_size: int) -> None:
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page starts at 1; page_size lies between 1 and 100")


def page_of(df: DataFrame, page: int = 1, page_size: int = SETTINGS.page_size) -> DataFrame:
    """One page, newest first: a top-k, never a global sort."""
    check_page(page, page_size)
    return df.orderBy(*newest()).offset((page - 1) * page_size).limit(page_size)


def page_meta(df: DataFrame, page: int = 1, page_size: int = SETTINGS.page_size) -> DataFrame:
    """total, total_pages and the range shown."""
    check_page(page, page_size)
    size = F.lit(page_size).cast("long")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.expr(f"(total + {page_size} - 1) div {page_size}").alias("total_pages"),
        (F.lit(page - 1).cast("long") * size + 1).alias("shown_from"),
        F.least(F.lit(page).cast("long") * size, F.col("total")).alias("shown_to"),
    )


def capped(df: DataFrame, cap: int | None) -> DataFrame:
    return df if cap is None else df.orderBy(*newest()).limit(cap)


def stats(df: DataFrame, cap: int | None = SETTINGS.stats_cap) -> DataFrame:
    """total_queries, unique_sessions, top_intent, avg_latency_ms. Blank values count as missing, a latency
    of 0 does not; equal counts go to the intent seen first, newest first."""
    rows = capped(df.select("id", "created_at", "session_id", "intent", "latency_ms"), cap)
    by_intent = rows.filter(F.nullif("intent", F.lit("")).isNotNull()).groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("created_at", "id")).alias("latest"))
    top = by_intent.agg(F.max_by("intent", F.struct("n", "latest")).alias("top"))
    totals = rows.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_distinct(F.nullif("session_id", F.lit(""))).alias("unique_sessions"),
        F.expr("coalesce(sum(latency_ms) div nullif(count(latency_ms), 0), 0)").alias("avg_latency_ms"),
    )
    # two one-row results
    return totals.join(top).select("total_queries", "unique_sessions", F.coalesce("top", F.lit("N/A")).alias("top_intent"), "avg_latency_ms")


def distribution(df: DataFrame, column: str, cap: int | None = SETTINGS.stats_cap) -> DataFrame:
    rows = capped(df.select("id", "created_at", column), cap)
    return rows.filter(F.nullif(column, F.lit("")).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, column: str, cap: int | None = SETTINGS.stats_cap) -> DataFrame:
    counts = distribution(df, column, cap)
    total = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"))  # one row
    return counts.join(F.broadcast(total)).select(column, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), (F.col("n") == F.col("most")).alias("is_largest"))


def keyword_rows(df: DataFrame, cap: int | None = SETTINGS.keyword_cap) -> DataFrame:
    """id, created_at, kw: lower-cased keywords without blanks, repeats kept."""
    kw = F.transform(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: k.isNotNull() & (k != "")), F.lower)
    return capped(df.select("id", "created_at", "keywords"), cap).select("id", "created_at", kw.alias("kw"))


def keyword_nodes(df: DataFrame, cap: int | None = SETTINGS.keyword_cap, top: int = SETTINGS.top_keywords) -> DataFrame:
    """keyword, size of the most frequent; ties go to the keyword met first (newest row, then position)."""
    each = keyword_rows(df, cap).select("id", "created_at", F.posexplode("kw").alias("at", "keyword"))
    counted = each.groupBy("keyword").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("created_at", "id", (-F.col("at")).alias("at"))).alias("seen"))
    return counted.orderBy(F.desc("size"), F.desc("seen")).limit(top).select("keyword", "size")


def keyword_links(df: DataFrame, cap: int | None = SETTINGS.keyword_cap, top: int = SETTINGS.top_keywords, least: int = SETTINGS.min_link_weight) -> DataFrame:
    """source, target, value: unordered pairs within a row, both ends among the top keywords."""
    pair = lambda x, y: F.struct(F.least(x, y).alias("source"), F.greatest(x, y).alias("target"))
    kw = F.col("kw")
    pairs = F.flatten(F.transform(kw, lambda x, i: F.transform(F.slice(kw, i + 2, F.size(kw)), lambda y: pair(x, y))))
    counted = keyword_rows(df, cap).select(F.explode(pairs).alias("p")).groupBy("p.source", "p.target").agg(F.count(F.lit(1)).alias("value"))
    ends = F.broadcast(keyword_nodes(df, cap, top).select("keyword"))  # at most ``top`` rows
    for side in ("source", "target"):
        counted = counted.join(ends.withColumnRenamed("keyword", side), side, "left_semi")
    return counted.filter(F.col("value") >= least).select("source", "target", "value")


def graph_resolved(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links with the sizes of both ends. ``nodes`` is a top list, so it may be broadcast."""
    n = F.broadcast(nodes)
    a, b = n.select(F.col("keyword").alias("source"), F.col("size").alias("source_size")), n.select(F.col("keyword").alias("target"), F.col("size").alias("target_size"))
    width = F.greatest(F.lit(1.0), F.col("value") / 3)
    return links.join(a, "source").join(b, "target").select("source", "target", "value", "source_size", "target_size", F.round(width, 6).alias("width"))


def node_scale(nodes: DataFrame, low: float = 6.0, high: float = 24.0) -> DataFrame:
    """Radius on a square-root scale between the least and the largest size."""
    ends = nodes.agg(F.sqrt(F.min("size")).alias("a"), F.sqrt(F.max("size")).alias("b"))  # one row
    radius = F.when(F.col("a") == F.col("b"), F.lit((low + high) / 2)).otherwise(low + (high - low) * F.try_divide(F.sqrt("size") - F.col("a"), F.col("b") - F.col("a")))
    return nodes.join(F.broadcast(ends)).select("keyword", "size", F.round(radius, 6).alias("radius"))


def radar_scale(counts: DataFrame, name: str = "intent", count: str = "count", radius: float = 1.0) -> DataFrame:
    """Adds radius: linear from 0 to the largest count, which is 1 at least."""
    top = counts.agg(F.greatest(F.max(count), F.lit(1)).alias("_most"))  # one row
    return counts.join(F.broadcast(top)).select(name, count, F.round(F.col(count) / F.col("_most") * radius, 6).alias("radius"))


def checked_message(message: Column, max_length: int = SETTINGS.max_input_length) -> Column:
    """The sanitized message; an error if nothing is left of it."""
    clean = sanitize(message, max_length)
    return F.when(clean == "", F.raise_error(message_error(clean)).cast("string")).otherwise(clean)


def display(df: DataFrame) -> DataFrame:
    """Short labels: session of 8 characters (N/A without one), intent without underscores (Unclear without one), cut
    message and title."""
    msg = F.col("user_message")
    return df.select(
        "id",
        F.coalesce(F.concat(F.substring(F.nullif("session_id", F.lit("")), 1, 8), F.lit("...")), F.lit("N/A")).alias("session_label"),
        F.coalesce(F.replace(F.nullif("intent", F.lit("")), F.lit("_"), F.lit(" ")), F.lit("Unclear")).alias("intent_label"),
        F.when(F.length(msg) > 16, F.concat(F.substring(msg, 1, 14), F.lit("…"))).otherwise(msg).alias("short_label"),
        F.substring(msg, 1, 48).alias("title"),
    )


def export_rows(df: DataFrame, cap: int = SETTINGS.export_cap, **filters) -> DataFrame:
    """The newest filtered rows, flat, in the order of export."""
    payload = F.struct("language", "intent", "keywords")
    return capped(filter_logs(df, **filters), cap).select(
        "id",
        "session_id",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
        "intent",
        "language",
        "latency_ms",
        "user_message",
        F.concat_ws(", ", "keywords").alias("keywords"),
        F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"),
    )


def write_csv(rows: DataFrame, path: str) -> bool:
    """Quotes doubled, no trimming, header; an empty result writes nothing at all and gives False."""
    if rows.isEmpty():
        return False
    options = {"header": True, "escape": '"', "emptyValue": "", "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.coalesce(1).write.mode("overwrite").options(**options).csv(path)  # at most the export cap of rows
    return True
