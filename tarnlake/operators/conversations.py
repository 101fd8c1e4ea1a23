"""Conversations as nested rows, and lookups over their messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.operators.numbering import number_within


def nest(df: DataFrame) -> DataFrame:
    """conv_id, title (first message, 48 characters), messages in order of turn. A conversation is one value here, which
    bounds it to what a row can hold (2 GB); the functions that give a row for each message have no such bound."""
    messages = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return df.groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 48).alias("title"), messages.alias("messages"))


def merge_messages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append, where a message whose (conv_id, turn) is known replaces it."""
    w = Window.partitionBy("conv_id", "turn").orderBy(F.desc("_new"))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_new", "_at")


def render(df: DataFrame) -> DataFrame:
    """conv_id, transcript: one "role: text" line for each message."""
    line = lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["text"], F.lit("")))
    return nest(df).select("conv_id", F.array_join(F.transform("messages", line), "\n").alias("transcript"))


def last_message(df: DataFrame, role: str) -> DataFrame:
    """The latest message of that role with content, for each conversation that has one."""
    rows = df.filter((F.col("role") == role) & (F.coalesce("text", F.lit("")) != ""))
    return rows.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def new_messages(df: DataFrame, known: DataFrame) -> DataFrame:
    """Messages after the first ``n_known`` of each conversation, without system ones. Conversations may be of any size."""
    rows = number_within(df.select("conv_id", "turn", "role"), "conv_id", ("turn",), "position").join(known, "conv_id", "left")
    return rows.filter((F.col("position") > F.coalesce("n_known", F.lit(0))) & (F.col("role") != "system")).select("conv_id", "turn", "position", "role")


def last_values(df: DataFrame, session: str, order: str, keys: list[str]) -> DataFrame:
    """The values of each session's latest row: a null there overwrites what was before."""
    latest = F.max_by(F.struct(*keys), order)
    return df.groupBy(session).agg(latest.alias("_v")).select(session, *[F.col(f"_v.{k}").alias(k) for k in keys])


def newest_first(df: DataFrame, without: int | None = None) -> DataFrame:
    rows = df if without is None else df.filter(F.col("conv_id") != without)
    return rows.orderBy(F.desc("created_at"), F.desc("conv_id"))


def by_id(df: DataFrame, conv_id: int) -> DataFrame:
    return df.filter(F.col("conv_id") == conv_id)


SAVED = "array<struct<id:string,sessionId:string,title:string,createdAt:bigint,updatedAt:bigint,messages:array<struct<id:string,role:string,content:string,timestamp:bigint>>>>"


def parse_saved(text: Column) -> Column:
    """Conversations saved as a JSON list; anything else is an empty list. Times are epoch milliseconds."""
    return F.coalesce(F.from_json(text, SAVED), F.array().cast(SAVED))


def to_saved(nested: DataFrame) -> DataFrame:
    """conv_id and saved: one conversation of ``nest`` as JSON."""
    messages = F.transform("messages", lambda m: F.struct(m["turn"].cast("string").alias("id"), m["role"].alias("role"), m["text"].alias("content")))
    return nested.select("conv_id", F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), "title", messages.alias("messages"))).alias("saved"))
