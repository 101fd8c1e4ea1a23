"""Readers, and adapters that give the shared synthetic tables the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators import corpus
from tarnlake.session import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df  # whole texts: the work is in the rows


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def router_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("intent"),
        F.floor("value").cast("long").alias("latency_ms"),
        "k",
        F.concat(F.lit("L"), (k % 7).cast("string")).alias("language"),
        F.col("props").alias("user_message"),
        F.array(F.lower("event_type"), F.concat(F.lit("k"), (k % 10).cast("string")), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))).alias("keywords"),
    )


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), doc.cast("string"))
    return read(spark, sf_dir, "documents").select(
        doc.cast("string").alias("doc_id"),
        F.col("text").alias("markdown"),
        F.when(doc % 3 == 0, url).otherwise("").alias("source_url"),
        F.when(doc % 3 == 1, F.concat("source", F.lit(".pdf"))).alias("source_pdf"),
        F.lit(None).cast("string").alias("title"),
        F.col("source").alias("site"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunk_fixed(corpus.scan(raw_corpus(spark, sf_dir)))


def tool_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (the documents' source), at (the id, which gives the order) and raw: a retrieval tool's JSON of one document."""
    doc = F.col("doc_id")
    item = F.struct(
        F.col("text").alias("content"),
        F.when(doc % 4 == 0, "").otherwise(F.col("source")).alias("source_reference"),
        F.when(doc % 8 == 0, F.concat(F.lit("https://x.example/"), "source")).alias("url"),
        F.concat(F.when(doc % 7 == 0, "x").otherwise(""), (F.col("n_chars") % 3).cast("string")).alias("chunk_index"),
        F.when(doc % 2 == 0, F.concat(F.lit("T"), "source")).alias("title"),
        F.when(doc % 5 == 0, (doc % 10) / 4).alias("score"),
    )
    payload = F.to_json(F.struct(F.array(item).alias("documents")))
    return read(spark, sf_dir, "documents").select(F.col("source").alias("key"), doc.alias("at"), payload.alias("raw"))
