"""A versioned cache of chunk tables: Parquet plus a one-row table of the settings it was made with."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators.corpus import rehydrate


@dataclass(frozen=True)
class CacheHeader:
    cache_version: int = 1
    chunk_size: int = 200
    chunk_overlap: int = 50


def save(chunks: DataFrame, path: str, header: CacheHeader = CacheHeader()) -> None:  # noqa: B008
    """Chunks first, settings last: a reader that finds the settings finds whole chunks."""
    chunks.select("content", "chunk_index", "source_reference").write.mode("overwrite").parquet(f"{path}/chunks")
    chunks.sparkSession.createDataFrame([tuple(asdict(header).values())], ", ".join(f"{k} int" for k in asdict(header))).write.mode("overwrite").parquet(f"{path}/header")


def load(spark: SparkSession, path: str, header: CacheHeader = CacheHeader()) -> DataFrame | None:  # noqa: B008
    """The cached documents, or None: no cache, other settings, or no chunks."""
    try:
        found = spark.read.parquet(f"{path}/header").first()
        chunks = spark.read.parquet(f"{path}/chunks")
    except AnalysisException:
        return None
    if found is None or found.asDict() != asdict(header) or chunks.limit(1).isEmpty():
        return None
    return rehydrate(chunks)


def load_jsonl(spark: SparkSession, path: str, header: CacheHeader = CacheHeader()) -> DataFrame | None:  # noqa: B008
    """The older form: gzip JSON lines whose first line is the header. Blank lines are skipped."""
    try:
        lines = spark.read.text(path)
        first = lines.first()
    except AnalysisException:
        return None
    row = spark.range(1).select(F.from_json(F.lit(first[0] if first else ""), "cache_version int, chunk_size int, chunk_overlap int").alias("h")).first()["h"]
    if row is None or row.asDict() != asdict(header):
        return None
    parsed = lines.filter(F.trim("value") != "").select(F.from_json("value", "content string, chunk_index int, source_reference string").alias("c")).select("c.*")
    chunks = parsed.filter(F.col("chunk_index").isNotNull())
    return None if chunks.limit(1).isEmpty() else rehydrate(chunks)
