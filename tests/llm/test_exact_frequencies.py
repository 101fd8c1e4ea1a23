"""op1 with a document frequency of its own for every shingle, rare ones included."""

import math
from collections import Counter

import numpy as np
import pytest
from test_neardup import brute_classes, corpus, shingle_counts

from tarnlake.llm import neardup, queries, shingles
from tarnlake.llm.scratch import Scratch


def exact_classes(docs, threshold=0.8):
    """Classes of (id, text) rows from all pairs, each shingle weighed by its exact document frequency."""
    counts = [shingle_counts(t)[1] for _, t in docs]
    df = Counter(x for c in counts for x in c)
    sets = [{x: k * (1 + math.log((len(docs) + 1) / (df[x] + 1))) for x, k in c.items()} for c in counts]
    total = [sum(s.values()) for s in sets]
    label = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = sum(min(w, sets[j][x]) for x, w in a.items() if x in sets[j])
            alike = both >= (threshold - 1e-9) * (total[i] + total[j] - both)  # two texts without words are alike
            if alike and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    return {d: docs[label[i]][0] for i, (d, _) in enumerate(docs)}


@pytest.fixture
def small_parts(spark, monkeypatch):
    """Many chunks and slices, so that what they ask and answer must meet."""
    monkeypatch.setattr(neardup, "SLICE", 500)
    monkeypatch.setattr(neardup, "CHUNK", 4000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_op1_weighs_rare_shingles_by_their_own_frequency(spark, tmp_path, small_parts):
    for seed in (1, 3):
        docs = corpus(seed)
        want = exact_classes(docs)
        assert want != brute_classes(docs)  # which counts shingles of fewer than 5 % of the documents as standing in 5 %
        spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/{seed}/documents.parquet")
        got = queries.op1_near_dedup(spark, f"{tmp_path}/{seed}").collect()
        assert {r.doc_id: r.class_id for r in got} == want and len(got) == len(docs)
        assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_blocks_weigh_alike(spark):
    docs = corpus(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for more in ({"levels": ((40, 1),), "block": 4}, {"levels": ((40, 1), (38, 6)), "block": 4, "most_blocks": 2}):
        assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df, floor=0, **more).collect()} == exact_classes(docs)


def test_every_shingle_has_its_own_frequency(spark, small_parts):
    docs = corpus(2)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows, drawn = neardup._drawn_exactly(Scratch(spark, "exact"), df, 5, 2, 2)
    sets = {shingles.text_key(w): np.unique(s) for w, s in shingles.of_texts([t for _, t in docs])}
    df_of = Counter(x for r in rows.collect() for x in sets[bytes(r.node)].tolist())
    assert min(df_of.values()) == 1 and sum(k > 1 for k in df_of.values()) > 100
    got = drawn.collect()
    assert {bytes(r.node) for r in got} == {k for k, s in sets.items() if len(s)} and rows.count() == len(docs)
    for r in got:
        want = [1 + math.log((len(docs) + 1) / (df_of[x] + 1)) for x in sets[bytes(r.node)].tolist()]
        assert np.allclose(np.frombuffer(r.idf, "<f4"), want, rtol=1e-6)


def test_tables_without_words(spark):
    for texts in ([], [None], ["", " ", None]):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        assert [(r.doc_id, r.class_id) for r in neardup.near_duplicates(df, floor=0).orderBy("doc_id").collect()] == [(i, 0) for i in range(len(texts))]


def test_pipeline_weighs_rare_shingles_by_their_own_frequency(spark):
    docs = corpus(3)
    classes = exact_classes(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = dict(__import__("corpus_pipeline").STAGES)["near-dedup"](spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values())) != sorted(set(brute_classes(docs).values()))
