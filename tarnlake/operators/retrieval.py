"""Hybrid retrieval: dense and BM25 top-k, rank fusion, context items, citations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.config import SETTINGS
from tarnlake.functions.text import bind, first_filled, normalize, py_strip

UNKNOWN = "Unknown Source"
VARIANT_SURE = 16 << 20  # bytes of JSON; any shorter text that gives no variant is malformed


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    each = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v)


def dense_topk(vectors: DataFrame, query: list[float], k: int = SETTINGS.retrieval_k, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k rows of largest inner product (for unit vectors also the nearest), ties to the smaller key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, dot(F.col(vector), q).alias("score"))
    return ranked(scored, [key], k)


def ranked(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, score (rounded once ranked), rank from 1 of the k best: a top-k, then numbers for its k rows."""
    order = [F.desc("score"), *[F.asc(c) for c in keys]]
    top = scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return top.withColumn("score", F.round("score", 6))


def bm25_topk(docs: DataFrame, query: str, k: int = SETTINGS.retrieval_k, key: str | list[str] = "chunk_id", text: str = "content", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 with whitespace tokens, case kept: idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    Only the query's terms are counted, in each row's own array, so no token table is shuffled: one pass
    gives N, the mean length and all document frequencies, a second one scores.
    """
    keys = [key] if isinstance(key, str) else key
    terms = list(dict.fromkeys(query.split()))
    tokens = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda t: t != "")
    counted = bind(tokens, lambda t: F.struct(F.size(t).alias("n"), F.filter(t, lambda w: w.isin(*terms)).alias("hits")))
    occurrences = lambda term: F.size(F.filter("_c.hits", lambda t: t == term))
    rows = docs.select(*keys, counted.alias("_c")).select(*keys, F.col("_c.n").alias("_len"), *[occurrences(x).alias(f"_tf{i}") for i, x in enumerate(terms)])
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (facts["n"] - facts[f"df{i}"] + 0.5) / (facts[f"df{i}"] + 0.5))
        tf = F.col(f"_tf{i}").cast("double")
        score = score + F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.lit(facts["avg"] or 1.0)))
    return ranked(rows.select(*keys, score.alias("score")), keys, k)


def fuse(dense: DataFrame, sparse: DataFrame, key: str = "chunk_id", weight: float = SETTINGS.dense_weight, c: int = SETTINGS.rrf_c, content: str | None = None) -> DataFrame:
    """Weighted reciprocal ranks: the sum of weight / (c + rank); ties to the dense list, then the key.

    ``content`` names a text column of both lists: rows of one text are then one hit, under the key that came first in
    the dense list, else in the sparse one.
    """
    same = F.col(key) if content is None else F.sha2(F.col(content), 256)
    side = lambda top, w, at: top.select(key, same.alias("_same"), "rank", F.lit(w).alias("w"), F.lit(at).alias("list"))
    both = side(dense, weight, 0).unionByName(side(sparse, 1 - weight, 1))
    summed = both.groupBy("_same").agg(F.sum(F.col("w") / (c + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank", key)).alias("_first"))
    order = [F.desc("score"), F.asc("_first.list"), F.asc(f"_first.{key}")]
    numbered = summed.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most both lists' rows
    return numbered.select(F.col(f"_first.{key}").alias(key), F.round("score", 6).alias("score"), "rank")


def _fields(raw: Column) -> Column:
    """The top-level fields of a JSON object, as a map of variants; null for any other text."""
    return F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>")


def _listed(value: Column) -> Column:
    """A list, or an empty value of any kind, which counts as an empty list."""
    return F.schema_of_variant(value).startswith("ARRAY") | F.to_json(value).isin("null", '""', "0", "0.0", "false", "{}")


def tool_kind(raw: Column) -> Column:
    """documents, web_results or malformed: what the top level of a tool's JSON text holds; documents win."""
    return bind(_fields(raw), lambda m: _kind(m, F.lit("documents"), F.lit("web_results"), F.lit("malformed"), F.lit("malformed"), F.lit("malformed"), F.lit("malformed")))


def _kind(m: Column, documents: Column, web: Column, unread: Column, no_documents: Column, no_web: Column, neither: Column) -> Column:
    has = lambda name: F.map_contains_key(m, F.lit(name))
    return (
        F.when(m.isNull(), unread)
        .when(has("documents"), F.when(_listed(m["documents"]), documents).otherwise(no_documents))
        .when(has("web_results"), F.when(_listed(m["web_results"]), web).otherwise(no_web))
        .otherwise(neither)
    )


def tool_error(raw: Column) -> Column:
    """What is wrong with a tool's JSON text: the tool's own error if it is well formed, null if there is none."""
    whole = F.when(F.try_parse_json(raw).isNull(), "Tool output was not valid JSON.").otherwise("Tool output JSON was not an object.")

    def told(m: Column) -> Column:
        own = F.try_variant_get(m["error"], "$", "string")
        neither = F.coalesce(F.nullif(own, F.lit("")), F.lit("Tool output did not contain documents or web_results."))
        return _kind(m, own, own, whole, F.lit("RAG documents payload was not a list."), F.lit("Web results payload was not a list."), neither)

    return bind(_fields(raw), told)


def context_items(df: DataFrame, key: str, raw: str, most: int = SETTINGS.max_context_items, at: str | None = None) -> DataFrame:
    """key, ordinal, content, source_reference, chunk_index, title, url, score: items of a tool's JSON in order, blank
    ones dropped, repeats (same source, number as text and normalized content) dropped, first ``most`` kept.
    Where a text has documents, be they null, its web results do not count. A number that is no integer is null.

    A key's items may be spread over rows, whose order ``at`` gives: no value then holds more than a row's items.
    Repeats meet in an aggregate by digest, and each task hands on ``most`` rows of a key at most. JSON that is
    well formed but larger than a variant may be is an error, as it would else count as malformed.
    """
    v = F.try_parse_json(F.col(raw))
    too_large = (F.octet_length(raw) > VARIANT_SURE) & F.get_json_object(raw, "$").isNotNull()
    v = F.coalesce(v, F.when(too_large, F.raise_error(F.lit("a tool's JSON is larger than a variant may be: give its items in several rows"))).cast("variant"))
    has_documents = F.map_contains_key(F.try_variant_get(v, "$", "map<string,variant>"), F.lit("documents"))
    listed = F.when(has_documents, F.try_variant_get(v, "$.documents", "array<variant>")).otherwise(F.try_variant_get(v, "$.web_results", "array<variant>"))
    place = F.lit(0) if at is None else F.col(at)
    rows = df.select(key, place.alias("_at"), F.posexplode(listed).alias("_pos", "_v")).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    field = lambda name, kind="string": F.try_variant_get("_v", f"$.{name}", kind)
    rows = rows.withColumn("_content", py_strip(F.coalesce(field("content"), F.lit("")))).filter("_content != ''")
    items = rows.select(
        key,
        F.coalesce(*[F.nullif(field(c), F.lit("")) for c in ("source_reference", "source", "url")], F.lit(UNKNOWN)).alias("source_reference"),
        field("chunk_index").alias("_number"),
        F.sha2(normalize(F.col("_content")), 256).alias("_same"),
        F.struct(
            "_at",
            "_pos",
            F.col("_content").alias("content"),
            field("chunk_index", "int").alias("chunk_index"),
            F.coalesce(field("title"), F.lit("")).alias("title"),
            F.coalesce(field("url"), F.lit("")).alias("url"),
            field("score", "double").alias("score"),
        ).alias("_item"),
    )
    once = items.groupBy(key, "source_reference", "_number", "_same").agg(F.min("_item").alias("_item"))
    numbered = once.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy("_item"))).filter(F.col("ordinal") <= most)
    return numbered.select(key, "source_reference", "ordinal", *[F.col(f"_item.{c}").alias(c) for c in ("content", "chunk_index", "title", "url", "score")])


def citations(items: DataFrame, key: str, excerpt: int = SETTINGS.excerpt_length) -> DataFrame:
    """key, id (from 1), source, number, title, excerpt, url (null if none), score."""
    return items.select(key, F.col("ordinal").alias("id"), F.col("source_reference").alias("source"), "chunk_index", "title", py_strip(F.substring("content", 1, excerpt)).alias("excerpt"), F.nullif("url", F.lit("")).alias("url"), "score")


def grounding_context(items: DataFrame, key: str) -> DataFrame:
    """key, context: numbered blocks joined by a blank line."""
    title = F.when(F.col("title") != "", F.concat(F.lit(" | Title: "), F.col("title"))).otherwise("")
    block = F.concat(F.lit("["), F.col("ordinal").cast("string"), F.lit("] Source: "), F.col("source_reference"), title, F.lit("\nContent: "), F.col("content"))
    listed = F.sort_array(F.collect_list(F.struct("ordinal", block.alias("b"))))
    return items.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n").alias("context"))


def normalize_sources(df: DataFrame) -> DataFrame:
    """Adds label, href and display title to rows of (ordinal, source_reference, source, url, title)."""
    label = F.coalesce(F.nullif("source_reference", F.lit("")), F.nullif("source", F.lit("")), F.lit(UNKNOWN))
    web = label.rlike("(?i)^https?://")
    href = F.coalesce(F.nullif("url", F.lit("")), F.when(web, label))
    named = F.coalesce(F.nullif("source_reference", F.lit("")), F.nullif("source", F.lit("")))
    shown = F.coalesce(F.nullif("title", F.lit("")), named, F.concat(F.lit("Source "), F.col("ordinal").cast("string")))
    return df.withColumns({"label": label, "href": href, "shown": shown})


def as_tool_json(top: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: the retrieval tool's JSON of the fused list, in order. ``top`` has at most 2k rows."""
    rows = chunks.join(F.broadcast(top.select(key, "rank")), key)
    doc = F.struct("content", "source_reference", F.col(key).alias("chunk_index"))
    listed = F.sort_array(F.collect_list(F.struct("rank", doc.alias("d"))))
    return rows.agg(F.to_json(F.struct(F.transform(listed, lambda x: x["d"]).alias("documents"))).alias("payload"))


UNAVAILABLE = '{"documents": [], "error": "Medical knowledge base is unavailable right now."}'
RETRIEVAL_FAILED = "Unable to retrieve information at this time."


def tool_result(payload: Column, available: Column, failed: Column) -> Column:
    """What the retrieval tool gives: its JSON, or what stands for it without an index or after an error."""
    return F.when(failed, RETRIEVAL_FAILED).when(~available, UNAVAILABLE).otherwise(payload)


def web_results(pages: DataFrame, hosts: tuple[str, ...] = SETTINGS.web_hosts, most: int = SETTINGS.web_results) -> DataFrame:
    """Rows on allowed hosts with defaults for missing fields; the first ``most`` by score, then URL."""
    from tarnlake.functions.text import host_allowed

    rows = pages.filter(host_allowed(F.col("url"), hosts))
    cols = [first_filled(F.col(c)).alias(c) if c in pages.columns else F.lit("").alias(c) for c in ("title", "content")]
    score = F.coalesce("score", F.lit(0.0)) if "score" in pages.columns else F.lit(0.0)
    return rows.select("url", *cols, score.alias("score")).orderBy(F.desc("score"), "url").limit(most)


def message_sources(df: DataFrame, excerpt: int = 160) -> DataFrame:
    """conv_id, id (from 1), source, chunk_index, excerpt: what a conversation's answers rest on.

    df: conv_id, turn, role, text, sources (array<struct<source_reference,chunk_index,excerpt>>, null or empty if
    none). The latest assistant message with sources gives them, however far back; without one, the documents
    of all tool messages in order do, where a tool text that is no JSON and longer than 50 characters counts
    as one general source.
    """
    given = df.filter((F.col("role") == "assistant") & (F.size(F.coalesce("sources", F.array().cast(df.schema["sources"].dataType))) > 0))
    last = given.groupBy("conv_id").agg(F.max_by("sources", "turn").alias("s"))
    own = last.select("conv_id", F.posexplode("s").alias("at", "d")).select("conv_id", F.lit(0).cast("long").alias("turn"), "at", "d.source_reference", "d.chunk_index", "d.excerpt")
    v = F.try_parse_json("text")
    docs = F.try_variant_get(v, "$.documents", "array<variant>")
    tools = df.filter(F.col("role") == "tool").join(last.select("conv_id"), "conv_id", "left_anti")
    field = lambda name, kind="string": F.try_variant_get("d", f"$.{name}", kind)
    parsed = tools.select("conv_id", "turn", F.posexplode(docs).alias("at", "d")).select(
        "conv_id", "turn", "at", field("source_reference").alias("source_reference"), field("chunk_index", "int").alias("chunk_index"), py_strip(F.substring(F.coalesce(field("content"), F.lit("")), 1, excerpt)).alias("excerpt")
    )
    general = tools.filter(v.isNull() & (F.length("text") > 50)).select("conv_id", "turn", F.lit(0).alias("at"), F.lit("Medical Knowledge Base").alias("source_reference"), F.lit(None).cast("int").alias("chunk_index"), F.lit("").alias("excerpt"))
    rows = own.unionByName(parsed).unionByName(general)
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "at"))
    return rows.select("conv_id", number.alias("id"), F.coalesce(F.nullif("source_reference", F.lit("")), F.lit(UNKNOWN)).alias("source"), "chunk_index", F.nullif("excerpt", F.lit("")).alias("excerpt"))
