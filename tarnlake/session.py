"""Session settings that hold on a cluster and in tests alike."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI without a trailing slash: ``spark.checkpoint.dir``.

    Only a session on one machine may leave it unset; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tarnlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """A table that arrives in fewer parts than there are cores is dealt to all of them; any larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def build_session(app: str = "tarnlake", master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session in UTC with adaptive planning; ``extra`` settings win."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master:
        conf |= {"spark.master": master, "spark.driver.memory": "8g"}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = SparkSession.builder.appName(app).config(map=conf | extra).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
