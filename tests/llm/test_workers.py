"""What the pipeline's stages leave in the Python workers, which the executors hold beside their heap."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from public_tokenizers import path
from test_neardup import corpus

from tarnlake.llm import neardup, packing, tokens, toxicity, workers

corpus_pipeline = __import__("corpus_pipeline")


def kept_tables(spark):
    """How many encoders each of some tasks' workers keeps."""

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens._ENCODERS)] * len(batch), pa.int64())], ["n"])

    return [r.n for r in spark.range(0, 16, 1, 16).mapInArrow(count, "n long").collect()]


def test_encoders_leave_the_workers_with_packing(spark):
    df = spark.createDataFrame(corpus(3), "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(d, d % 7 == 0) for d in range(40)], "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) toxic")
    stages = [
        lambda: neardup.keep_one_of_each(df, floor=0),
        lambda: toxicity.drop_toxic(df, labels),
        lambda: packing.pack_documents(df, path("word_bpe_49k.json"), group=4),
    ]
    for stage in stages:
        packing.token_pieces(df, path("word_bpe_49k.json"), 2048, 512, 1).collect()
        before = sum(kept_tables(spark))
        assert before > 0
        stage().collect()
        assert sum(kept_tables(spark)) < before


def anon_mb():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_a_task_gives_back_what_it_freed():
    def task(batches):
        held = [np.ones(2000) for _ in range(10_000)]  # 160 MB in pieces below the allocator's own limit for giving back
        held[:-1] = [None] * (len(held) - 1)
        last = held.pop()  # noqa: F841
        yield from batches

    list(workers.lean(task)([]))
    before = anon_mb()
    list(workers.lean(task)([]))
    assert anon_mb() < before + 40


def test_kept_tables_go_before_a_task():
    tables = workers.kept()
    tables["x"] = 1
    seen = []

    def task(batches):
        seen.append(dict(tables))
        yield from batches

    assert list(workers.lean(task)(iter([1, 2]))) == [1, 2] and seen == [{}]


def test_sampled_hashes_need_no_python_workers(spark, monkeypatch):
    """A list would be an RDD of Python objects, for which each executor starts another set of workers."""
    given = []
    made = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: (given.append(made(self, data, *a, **b)), given[-1])[1])
    df = spark.range(6).selectExpr("id doc_id", "concat('text ', id) text")
    assert sorted(toxicity.sample_texts(df, df, 4, 1000)) and len(given) == 1
    assert "PythonRDD" not in given[0]._jdf.queryExecution().toRdd().toDebugString()
