"""Positions and running sums within groups, where one group may hold a large share of all rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_within(df: DataFrame, group: str, order: tuple[str, ...], name: str, parts: int | None = None, weight: Column | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, ... within each group, in order; with ``weight`` its running sum instead, the row's own included.

    A range exchange on (group, order) cuts large groups between tasks. Only a range's first and last group can go
    on in another range, so the sums that such a group has in earlier ranges form a table of a few rows for each range,
    which is what is broadcast; each range sums up its own rows and adds that. ``order`` should be total.
    """
    weight = F.lit(1) if weight is None else weight
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    # kept: both readers must see the same ranges
    ranged = df.repartitionByRange(n, *by).withColumns({"_range": F.spark_partition_id(), "_weight": weight.cast("long")}).persist(StorageLevel.MEMORY_AND_DISK)
    # in a struct, so that a group that is null counts as one too
    ends = ranged.select("_range", F.struct(F.col(group).alias("g")).alias("_g")).groupBy("_range").agg(F.min("_g").alias("a"), F.max("_g").alias("b"))
    ends = ends.select(F.explode(F.array("a", "b")).alias("_g")).distinct()
    at_ends = ranged.select("_range", "_weight", F.struct(F.col(group).alias("g")).alias("_g")).join(F.broadcast(ends), "_g", "left_semi")
    counts = at_ends.groupBy("_g", "_range").agg(F.sum("_weight").alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_g.g").alias("_group"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", group).orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, 0)
    numbered = ranged.withColumn("_own", F.sum("_weight").over(inside))
    joined = numbered.join(F.broadcast(offsets), (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    return joined.withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_range", "_weight", "_own", "_group", "_r", "_before")
