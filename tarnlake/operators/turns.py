"""The turn log: numbering, pairing, integrity, appends and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.operators.numbering import number_within

KEY = ["session_id", "turn_index"]
REQUIRED = ["session_id", "turn_index", "user_message", "assistant_message", "is_clarification", "is_final_answer", "created_at", "responded_at", "latency_ms"]


def number_turns(df: DataFrame, session: str = "session_id", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """Adds turn_index: 1, 2, ... within a session in order of arrival. A session may be of any size."""
    return number_within(df, session, order, "turn_index")


def append_turns(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``existing`` and ``new`` rows, the latter numbered on from each session's last turn."""
    last = existing.groupBy("session_id").agg(F.max("turn_index").alias("_last"))
    numbered = number_turns(new).join(last, "session_id", "left")
    numbered = numbered.withColumn("turn_index", F.col("turn_index") + F.coalesce("_last", F.lit(0))).drop("_last")
    return existing.unionByName(numbered.select(*existing.columns))


def newest(rows: DataFrame, version: str, key: list[str] | None = None) -> DataFrame:
    """One row for each key, that of the highest ``version``, a column which goes."""
    w = Window.partitionBy(*(key or KEY)).orderBy(F.desc(version))
    return rows.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop(version, "_at")


def upsert(existing: DataFrame, batch: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row for each key, the batch's where it has one. Plain Parquet has no merge, so both are ranked once."""
    return newest(existing.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1))), "_new", key)


def missing_after(result: DataFrame, batch: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Read-back check of an upsert: the batch's keys that the result lacks."""
    key = key or KEY
    return batch.select(*key).join(result.select(*key), key, "left_anti")


def sync_turns(existing: DataFrame, batch: DataFrame, path: str, unique: bool = True) -> dict[str, int]:
    """Write ``existing`` with ``batch`` to a new ``path``, read it back and count the batch's rows as success or fail.

    ``unique`` tells that the target keeps one row for each key; a target without that takes the batch as plain inserts.
    """
    (upsert(existing, batch) if unique else existing.unionByName(batch)).write.mode("errorifexists").parquet(path)
    missing = missing_after(batch.sparkSession.read.parquet(path), batch).count()
    return {"success": batch.count() - missing, "fail": missing}


def violations(df: DataFrame) -> DataFrame:
    """rule, session_id, turn_index of every row that breaks a constraint; a null passes comparisons, as in SQL."""
    both = F.col("is_clarification") & F.col("is_final_answer")
    rules: dict[str, Column] = {f"null_{c}": F.col(c).isNull() for c in REQUIRED}
    rules |= {"negative_latency": F.col("latency_ms") < 0, "answer_before_question": F.col("responded_at") < F.col("created_at"), "both_flags": both}
    broken = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda r: r.isNotNull())
    rows = df.select(F.explode(broken).alias("rule"), *KEY)
    repeated = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate_key").alias("rule"), *KEY)
    return rows.unionByName(repeated)


def pair_turns(df: DataFrame) -> DataFrame:
    """Each user message with the next message of its conversation, if the assistant's.

    Positions are numbered over ranges and neighbours meet by (conversation, position), so that a conversation of any size
    is shared among tasks.
    """
    rows = number_within(df.select("conv_id", "turn", "role", "text"), "conv_id", ("turn",), "position")
    answers = rows.filter("role = 'assistant'").select(F.col("conv_id").alias("_conv"), (F.col("position") - 1).alias("_before"), F.col("text").alias("assistant_message"))
    asked = rows.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_message"), "position")
    joined = asked.join(answers, (F.col("position") == F.col("_before")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select("conv_id", "turn", "user_message", "assistant_message")


def running_turns(df: DataFrame) -> DataFrame:
    """User turns so far in each conversation, which may be of any size."""
    asked = F.when(F.col("role") == "user", 1).otherwise(0)
    return number_within(df.select("conv_id", "turn", "role"), "conv_id", ("turn",), "user_turns", weight=asked)


def latency_ms(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.unix_millis(end) - F.unix_millis(start))
