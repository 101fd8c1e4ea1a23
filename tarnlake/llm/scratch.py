"""Intermediate tables in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir`` (tarnlake.session.shared_dir).
Tables are written through Spark's commit protocol, so a lost executor costs its open tasks only.
"""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tarnlake.session import shared_dir


def _delete(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lower the session's Arrow batches to ``most`` bytes, and leave them so, as results run later.

    Rows of whole texts and shingle sets have any width, and an executor holds a few batches for each task
    beside its heap.
    """
    if _batch_bytes(spark) > most:
        spark.conf.set(BATCH_BYTES, f"{most}b")


def _batch_bytes(spark: SparkSession) -> float:
    size = re.fullmatch(r"(\d+)([bkmg]?)b?", spark.conf.get(BATCH_BYTES, "64m").strip().lower())
    return int(size[1]) << {"k": 10, "m": 20, "g": 30}.get(size[2], 0) if size else float("inf")


class Scratch:
    """One operator call's tables. ``drop`` frees those that the result no longer reads. With ``clean`` the shuffle files
    of a table's writing go with its end, not when the driver collects garbage. ``batch`` bounds Arrow batches while a table
    is written."""

    def __init__(self, spark: SparkSession, name: str, clean: bool = False, batch: int = 8 << 20):
        bound_batches(spark)
        self.spark = spark
        self._settings = ({CLEANUP: "true"} if clean else {}) | ({BATCH_BYTES: f"{batch}b"} if _batch_bytes(spark) > batch else {})
        self.uri = f"{shared_dir(spark)}/tarnlake/{name}-{uuid.uuid4().hex[:12]}"
        self._held: list[str] = []
        atexit.register(self._at_exit)

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def table(self, df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
        """Write, with the writer's options, and reread: cuts the lineage, and later readers see one fixed set of rows."""
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in self._settings}
        for k, v in self._settings.items():
            conf.set(k, v)
        try:
            df.write.mode("overwrite").options(**options).parquet(self.path(name))
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        if not keep:
            self._held.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names or list(self._held):
            _delete(self.spark, self.path(name))
            if name in self._held:
                self._held.remove(name)

    def _at_exit(self) -> None:
        try:
            _delete(self.spark, self.uri)
        except Exception:  # the session may have ended first; the folder is the cluster's to clear
            pass


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
