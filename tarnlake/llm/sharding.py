"""Contiguous shards of near-equal bytes, from per-partition totals and prefix sums.

DataFrame operations only. Rows are put in id order by a range exchange of narrow rows (the text
itself never moves). Each range partition's total enters one running sum over partitions, which is
bounded by their number; within a partition a window adds the rows before. A row's global byte
prefix decides its shard: the shard whose equal target interval holds the row's middle byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.scratch import Scratch, partitions


def row_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """id, size (UTF-8 bytes plus ``overhead``; a null text has none) and the text's crc32 (null text: 0)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def byte_shards(rows: DataFrame, shards: int = 24) -> DataFrame:
    """Give every row of (doc_id, size, text_crc32) a shard 0..shards-1 and a slot in it.

    Order is doc_id (nulls first), then crc and size, so repeated rows sit side by side in any order
    and equal ids are defined. Shards are contiguous in that order and differ from the equal target
    by less than one row's size; with fewer rows than shards some shards stay empty. An empty table
    gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = rows.sparkSession
    scratch = Scratch(spark, "shards")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    ranged = rows.repartitionByRange(4 * partitions(spark), *order).withColumn("_part", F.spark_partition_id())
    ranged = scratch.table(ranged, "ranged", keep=True)

    # one row for each range partition: bounded by their number, so it may meet in one task and be broadcast
    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_byte_base"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_row_base"),
        F.sum("_bytes").over(every).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    placed = (
        ranged.withColumn("_upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(bases), "_part")
        .withColumn("_twice_mid", 2 * (F.col("_byte_base") + F.col("_upto")) - F.col("size"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.expr(f"cast((_twice_mid * {shards}) div (2 * _all) as int)").alias("shard"),  # below shards: a middle lies before the end
            (F.col("_row_base") + F.col("_row")).alias("_row"),
        )
    )
    placed = scratch.table(placed, "placed", keep=True)
    scratch.drop("ranged")
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    return byte_shards(row_sizes(docs), shards)
