"""Tables that are reused if they hold rows, probes, and sinks that report what they wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table there, if it can be read and holds a row."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    return None if df.limit(1).isEmpty() else df


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A persisted collection: what is there, else what ``build`` gives, written first."""
    found = table_or_none(spark, path)
    if found is None:
        build().write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    return found


def vector_index(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_index") -> DataFrame:
    """Chunks with their vectors: what dense retrieval reads. An equi-join, left to the planner."""
    return chunks.join(vectors, key)


def write_counted(df: DataFrame, path: str, mode: str = "append", **counted) -> dict[str, int]:
    """Write and return rows written, and of each named condition how many rows met it; one pass."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counted.items()]]
    df.observe(seen, *counts).write.mode(mode).parquet(path)
    return dict(seen.get)
