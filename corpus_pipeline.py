"""The corpus pipeline: STAGES in order, each reading what its predecessor kept.

quality rules (documents that a rule rejects go), toxicity (toxic documents go), near-dedup (one document
of each class stays, by exact document frequencies of what came so far), packing (the kept documents' pieces in windows).

Null and empty texts have no words, so the first stage rejects them; texts of any length are read whole by every stage. Rows
are judged each on their own until near-dedup, which keeps one of equal rows, as of equal texts. A null doc_id is an id
like others, but its label is never learned. Other columns pass through whatever their names until packing, which
returns its own. An empty table gives no rows, and without labels no document counts as toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import neardup, packing, quality, toxicity
from tarnlake.llm.queries import table, tokenizer_file
from tarnlake.llm.scratch import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_of_each(docs, floor=0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-dedup", near_dedup_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k}", keep=True)
    return docs


ORACLE_SQL = None  # trained scores, sampled signatures and packing have no SQL form
