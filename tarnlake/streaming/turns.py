"""Turn numbering on a stream: state for each session, and an idempotent sink.

The sink's table is a set of runs, folders ``run-<first>-<last>`` of the micro-batches they hold. A batch writes its own
rows only; each ``fanout`` runs of equal length then become one, so a row is written again once for each power of
``fanout`` batches, and a reader meets fewer than ``fanout`` runs of each length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnlake.operators.turns import newest

NUMBERED = "session_id string, id long, user_message string, turn_index long"


def number_turns(stream: DataFrame) -> DataFrame:
    """session_id, id, user_message with turn_index, which goes on from the session's last one in state.

    Within a micro-batch turns are numbered in order of id, those of one session in one task: what the source admits to
    a micro-batch (maxFilesPerTrigger and the like) bounds them.
    """

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("id", ignore_index=True)
        rows["turn_index"] = range(last + 1, last + 1 + len(rows))
        state.update((last + len(rows),))
        yield rows[["session_id", "id", "user_message", "turn_index"]]

    keyed = stream.select("session_id", "id", "user_message").groupBy("session_id")
    return keyed.applyInPandasWithState(number, NUMBERED, "last long", "append", GroupStateTimeout.NoTimeout)


Run = tuple[int, int]


def _folder(path: str, run: Run) -> str:
    return f"{path}/run-{run[0]}-{run[1]}"


def _hadoop(spark: SparkSession, path: str):
    """(file system, path)"""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def runs(spark: SparkSession, path: str) -> tuple[list[Run], list[Run]]:
    """(the runs that make the table, those that longer ones hold) of the committed ones, oldest first."""
    fs, folder = _hadoop(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    found = [(int(m[1]), int(m[2])) for m in (re.fullmatch(r"run-(\d+)-(\d+)", n) for n in names) if m]
    done = sorted(r for r in found if fs.exists(_hadoop(spark, f"{_folder(path, r)}/_SUCCESS")[1]))
    held = {r for r in done if any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in done)}
    return [r for r in done if r not in held], sorted(held)


def _merged(spark: SparkSession, path: str, of: list[Run]) -> DataFrame:
    """The runs' rows, the newest of each key."""
    parts = [spark.read.parquet(_folder(path, r)).withColumn("_run", F.lit(r[1])) for r in of]
    return newest(reduce(DataFrame.unionByName, parts), "_run")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that a sink wrote, one row for each key; None before its first batch."""
    current, _ = runs(spark, path)
    return _merged(spark, path, current) if current else None


def upsert_sink(numbered: DataFrame, path: str, checkpoint: str, fanout: int = 8) -> StreamingQuery:
    """Upserts each micro-batch by (session_id, turn_index); ``read_table`` gives the table.

    A replayed batch writes its own folder again, or one that a longer run holds already, so it changes nothing. A run
    counts once its commit mark is written; those that it holds are deleted a batch later, as readers may be at them.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        for old in runs(spark, path)[1]:
            fs, folder = _hadoop(spark, _folder(path, old))
            fs.delete(folder, True)
        batch.write.mode("overwrite").parquet(_folder(path, (batch_id, batch_id)))
        length = fanout
        while (batch_id + 1) % length == 0:
            whole = (batch_id + 1 - length, batch_id)
            current, _ = runs(spark, path)
            if whole not in current and not any(r[0] <= whole[0] and whole[1] <= r[1] for r in current):
                _merged(spark, path, [r for r in current if whole[0] <= r[0] and r[1] <= whole[1]]).write.mode("overwrite").parquet(_folder(path, whole))
            length *= fanout

    return numbered.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
